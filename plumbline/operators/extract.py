"""Table-valued extraction: one source text in, rows out. The parsers are registered by language.

Each operator runs a Python parser in Arrow batches on the executors; the texts of a batch are parsed one by one, so
memory is bounded by a batch. Null texts are empty. A language without a parser is an error when the plan is made for a
fixed language, and gives no rows where the language is a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline import schema
from plumbline.functions import codetext, pysource
from plumbline.operators.reports import counted_functions


class Registry:
    """Parsers, frameworks or log readers by key; an unknown key is an error that names the known ones."""

    def __init__(self, kind: str):
        self.kind, self._held = kind, {}

    def register(self, key: str, value: object) -> None:
        self._held[key] = value

    def require(self, key: str):
        if key not in self._held:
            raise KeyError(f"no {self.kind} for {key!r}; known: {', '.join(sorted(self._held))}")
        return self._held[key]

    def get(self, key: str | None):
        return self._held.get(key)

    def keys(self) -> list[str]:
        return sorted(self._held)


PARSERS = Registry("parser")
PARSERS.register("python", pysource.functions)
for _language in ("javascript", "typescript", "java", "go", "rust"):
    PARSERS.register(_language, lambda text, language=_language: codetext.described(text, language))

FUNCTION = "name string, qualified_name string, source string, lineno int, end_line int, signature string, docstring string, params array<struct<name:string,annotation:string,default:string>>, return_annotation string, raise_statements array<struct<exception_class:string,condition:string,lineno:int>>, mutation_patterns array<struct<target:string,method:string,line:int>>"


def rows_from(df: DataFrame, keep: list[str], take: list[str], out: str, f: Callable[..., list[dict]]) -> DataFrame:
    """keep columns and, for every row, the rows that f(*take columns) returns, with the columns of the DDL `out`."""
    made = T.StructType([df.schema[c] for c in keep] + list(T.StructType.fromDDL(out)))
    arrow = to_arrow_schema(T.StructType(made.fields[len(keep) :]))
    names = [x.name for x in T.StructType.fromDDL(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[dict] = []
            for i, values in enumerate(zip(*[b.column(c).to_pylist() for c in take])):
                got = f(*values)
                at += [i] * len(got)
                rows += got
            took = pa.array(at, pa.int64())
            columns = [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(took) for c in keep], *columns], names=[*keep, *names])

    return df.select(*dict.fromkeys(keep + take)).mapInArrow(run, made)


def functions(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    """(key, language, the columns of FUNCTION): functions of each text by the parser of its language."""

    def parse(text: str | None, lang: str | None) -> list[dict]:
        parser = PARSERS.get(lang)
        return parser(text) if parser and text else []

    return rows_from(df, [key, language], [source, language], FUNCTION, parse)


def retrieval_chunks(df: DataFrame, path: str, source: str) -> DataFrame:
    """(path, chunk_id, start_line, end_line, function_name, docstring, content, chunk_type): one chunk per Python function,
    or overlapping blocks of lines where a text has none."""

    def cut(p: str | None, text: str | None) -> list[dict]:
        found = [c | {"chunk_type": "function"} for c in pysource.chunks(text or "", p or "")]
        if found:
            return found
        lines, out = (text or "").splitlines(), []
        for i in range(0, len(lines), 20):
            part = lines[i : i + 25]
            key = pysource.hashlib.md5(f"{p}:{i + 1}:{i + len(part)}".encode()).hexdigest()[:12]
            out.append({"chunk_id": key, "start_line": i + 1, "end_line": i + len(part), "content": "\n".join(part), "chunk_type": "code_block"})
        return out

    return rows_from(df, [path], [path, source], "chunk_id string, start_line int, end_line int, function_name string, docstring string, content string, chunk_type string", cut)


def documentation_tree(df: DataFrame, key: str, source: str) -> DataFrame:
    return rows_from(df, [key], [source], "node string, parent string, kind string, name string, signature string, docstring string, lineno int", lambda s: pysource.documentation_tree(s or ""))


def graph_nodes(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    return rows_from(df, [key], [source, language], "node string, type string, name string, lineno int", lambda s, x: pysource.graph(s or "", x or "python")[0])


def graph_edges(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    return rows_from(df, [key], [source, language], "source string, target string, type string", lambda s, x: pysource.graph(s or "", x or "python")[1])


def comments(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    return rows_from(df, [key], [source, language], "text string, start_line int, end_line int, function string", lambda s, x: codetext.comments(s or "", x) if x in codetext.SIGNATURES else [])


def syntax(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    """(key, valid, message): whether each text is well formed; the parser never raises."""

    def look(text: str | None, lang: str | None) -> list[dict]:
        message = codetext.syntax_error(text or "", lang or "python")
        return [{"valid": message is None, "message": message}]

    return rows_from(df, [key], [source, language], "valid boolean, message string", look)


def function_counts(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    """(key, n): functions of Python texts at any depth; other languages are counted by reports.counted_functions()."""
    python = df.filter(F.col(language) == "python")
    return rows_from(python, [key], [source], "n bigint", lambda s: [{"n": pysource.count_functions(s or "")}])


def all_function_counts(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    """(key, n): functions of every text: Python's on the syntax tree, at any depth, so that a def in a string is none;
    those of other languages, and of texts without one, by the line heuristic."""
    other = df.filter(~F.col(language).eqNullSafe("python")).select(key, counted_functions(F.col(source), F.col(language)).alias("n"))
    return function_counts(df, key, source, language).union(other)


LANGUAGES = tuple(dict.fromkeys(schema.LANGUAGES.values()))
