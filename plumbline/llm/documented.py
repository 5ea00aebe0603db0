"""Functions paired with their documentation.

Source text is read line by line: regular expressions find signatures; a body ends where the indentation falls back
(Python) or where a stack of brackets, or of block words and their `end`, empties; a comment belongs to the function
that follows it at a line distance of zero, not counting markers such as annotations and attributes between them.
Which comment is documentation depends on the language: the string that opens the body in Python, /** */ in
JavaScript, TypeScript and Java, /// or /** */ in Rust, comments right above in Go, # or -- above in Ruby and Lua.

A description is trivial if nothing is left of it besides placeholders and boilerplate, bare parameter lists and
headings, the function's own name, or if it has fewer than four words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.codetext import clean, functions, language_of

MIN_WORDS = 4
# Sentences that say nothing of a function's behaviour.
PLACEHOLDER = re.compile(
    r"(?ix) (?: to-?do\b.* | fixme\b.* | tbd\b.* | tba | n/?a | none | null | xxx+ | \?+ | [\W_]* | (?:doc)?string | docs? | documentation | description | comment | summary | placeholder | empty | wip"
    r" | see (?:above|below|base(?:\ class)?|super(?:class)?|parent|overrides?|interface|readme|the\ (?:docs?|source|code))\b.* | (?:inherited|copied)\ (?:from|docs?)\b.* | \{?@?inherit-?doc\}?"
    r" | (?:documentation|docs?|description)\ (?:is\ )?(?:pending|missing|to\ (?:do|come|follow)|goes\ here|needed|coming\ soon)\b.* | (?:add|write|insert)\ (?:a\ |the\ |some\ )?(?:docs?|docstring|documentation|description|comment)\b.*"
    r" | (?:does|do)\ (?:some\ )?(?:stuff|things?|something|the\ (?:work|thing|job))\b.{0,12} | (?:a\ |the\ |simple\ |small\ |internal\ |private\ |utility\ )*(?:helper|utility|main|wrapper|test|internal|default)(?:\ (?:function|method|class|routine|code))?"
    r" | (?:the\ |a\ |default\ |simple\ )*(?:getter|setter|accessor|mutator|constructor|destructor)(?:\ (?:function|method))?(?:\ for\ \w+)? | (?:function|method)"
    r" | (?:auto-?|automatically\ )?generated\ (?:from|by|with|code|file|method|function|stub)\b.* | auto-?generated\b.* | changes\ will\ be\ lost.* | do\ not\ (?:edit|modify|change)\b.* | (?:for\ )?internal\ use(?:\ only)?"
    r" | (?:this\ (?:function|method)\ )?(?:has|is)\ not\ (?:been\ )?(?:yet\ )?documented(?:\ yet)? | not\ (?:yet\ )?documented(?:\ yet)? | undocumented | no\ (?:description|documentation|docs?|comment|docstring)(?:\ (?:provided|available|yet|given))?"
    r" | please\ (?:describe|document|fill|write|add|complete)\b.* | (?:one|two|a\ few)\ (?:or\ two\ )?sentences? | description\ of\ (?:the\ )?(?:function|method)\b.* | (?:method|function)\ (?:stub|body)\b.* | fill\ (?:this\ |me\ )?in\b.* | not\ implemented(?:\ yet)? | lorem\ ipsum\b.*"
    r" | deprecated | private | public | nothing\ (?:to\ see\ )?here | same\ as\ above | as\ (?:above|below|named) | self-?explanatory | see\ (?:name|title|code) | ditto | idem"
    r" | noqa\b.* | pylint:.* | type:\ ignore.* | eslint-.* | @?ts-ignore.* | @?override | copyright\b.* | licen[sc]ed?\b.* | spdx-.* | all\ rights\ reserved.* ) [\s.!:;,-]*"
)
_HEADING = re.compile(r"(?i)(?:args|arguments|params|parameters|returns?|yields?|raises|throws|examples?|notes?|see also|errors|panics|safety|attributes|keyword args|other parameters)\s*:?\s*-*|-{3,}|={3,}")
_TAG = re.compile(r"(?i)(?:[@:\\](?:param|parameter|arg|argument|return|returns|rtype|type|raise|raises|throws|exception|yield|yields|tparam|since|author|version|see)\b)(?P<rest>.*)")
_ENTRY = re.compile(r"[-*]?\s*`?\w+`?\s*(?:\([^)]*\))?\s*(?::|--?|–)\s*(?P<rest>.*)")
_WORD = re.compile(r"[^\W_]+(?:['’_\-][^\W_]+)*")
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\u0e00-\u0e7f]")  # scripts without blanks: two characters are taken as a word
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_FILLER = {"a", "an", "the", "this", "function", "method", "func", "fn", "def", "routine", "procedure", "helper", "implementation", "of", "for", "to", "is", "it", "that", "which", "s"}


def _stem(word: str) -> str:
    return re.sub(r"(?:ies|es|s|ed|ing|e|y)$", "", word) if len(word) > 3 else word


def is_trivial(description: str, name: str) -> bool:
    """Whether a (cleaned) description says nothing of the behaviour of the function `name`."""
    said = []
    for line in description.split("\n"):
        s = line.strip().strip("/*#").strip()
        if not s or _HEADING.fullmatch(s):
            continue
        if m := _TAG.match(s):
            rest = re.sub(r"^\s*(?:\{[^}]*\}\s*)?(?:[\w.$]+\s*)?:?\s*", "", m.group("rest"), count=1)
            s = rest if len(_WORD.findall(rest)) >= 2 else ""
        elif (m := _ENTRY.fullmatch(s)) and not m.group("rest").strip():
            s = ""
        if s:
            said.append(s)
    text = "\n".join(said)
    left = [x for x in re.split(r"(?<=[.!?;])\s+|\n", text) if x.strip() and not PLACEHOLDER.fullmatch(x.strip())]
    if not left or PLACEHOLDER.fullmatch(" ".join(said)):
        return True
    words = _WORD.findall(" ".join(left))
    if sum(max(1, len(_UNSPACED.findall(w)) // 2) for w in words) < MIN_WORDS:
        return True
    own = {_stem(p.lower()) for p in _PARTS.findall(name)}
    rest = [_stem(p.lower()) for w in words for p in _PARTS.findall(w) if p.lower() not in _FILLER]
    return all(p in own for p in rest)


def describe(name: str | None, signature: str | None, source: str | None, docstring: str | None) -> tuple[str, str, str | None] | None:
    """(description, code without it, language) of a record, or None if it is not really documented."""
    source = source or ""
    language = language_of(signature, source)
    own = None
    if language:
        every = functions(source, language)
        own = next((f for f in every if f.name == name), every[0] if every else None)
    if docstring is not None and docstring.strip():
        description = clean(docstring)
    else:
        description = own.documentation if own else None
    if not description or is_trivial(description, name or (own.name if own else "")):
        return None
    code = source
    if own and own.documentation:
        lines = source.split("\n")
        a, b = own.doc_lines
        code = "\n".join(lines[:a] + lines[b:])
    return description, code, language


def _pairs(with_code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("name", "signature", "source", "docstring")]
            for r, record in enumerate(zip(*columns)):
                if got := describe(*record):
                    rows.append(r)
                    found.append(got)
            took = pa.array(rows, pa.int64())
            if not with_code:
                yield pa.record_batch([batch.column("key").take(took)], names=["key"])
                continue
            description, code, language = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.record_batch(
                [batch.column("key").take(took), pa.array(language, pa.string()), batch.column("signature").take(took), pa.array(description, pa.string()), pa.array(code, pa.string())],
                names=["key", "language", "signature", "description", "code"],
            )

    return run


def documented(df: DataFrame, id_col: str = "id", with_code: bool = True) -> DataFrame:
    """(id, language, signature, description, code) of the records (name, signature, source, docstring) that are really
    documented; only (id) if with_code is False.

    The description is the docstring or, where that is null or blank, the documentation in the source; the code is the
    source without its documentation. Null columns count as empty; repeated rows repeat; other columns are not carried.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("key"), "name", "signature", "source", "docstring")
    out = f"key {kind}" + (", language string, signature string, description string, code string" if with_code else "")
    return rows.mapInArrow(_pairs(with_code), out).withColumnRenamed("key", id_col)


def _file_pairs():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for r, (text, language) in enumerate(zip(batch.column("text").to_pylist(), batch.column("language").to_pylist())):
                lines = text.split("\n")
                for f in functions(text, language or ""):
                    if f.documentation and not is_trivial(f.documentation, f.name):
                        code = lines[f.line : f.end] if language != "python" else [x for j, x in enumerate(lines[f.line : f.end], f.line) if not f.doc_lines[0] <= j < f.doc_lines[1]]
                        for column, v in zip(out, (r, f.name, f.line + 1, f.signature, f.documentation, "\n".join(code))):
                            column.append(v)
            keys = batch.column("key").take(pa.array(out[0], pa.int64()))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([keys, *[pa.array(c, k) for c, k in zip(out[1:], kinds)]], names=["key", "name", "lineno", "signature", "description", "code"])

    return run


def documented_in_files(df: DataFrame, id_col: str, text_col: str, language_col: str) -> DataFrame:
    """(id, name, lineno from 1, signature, description, code): the really documented functions of whole files.

    Null texts and unknown languages give no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"), F.lower(F.col(f"`{language_col}`")).alias("language")).filter("text is not null")
    return rows.mapInArrow(_file_pairs(), f"key {kind}, name string, lineno int, signature string, description string, code string").withColumnRenamed("key", id_col)
