"""Credentials written out in source code: found by entropy in context, masked without touching anything else.

Candidates are quoted strings (pieces added with + count as one, also over line ends), long tokens outside of strings,
the words of commands, addresses and comments, and bare values after a secret's name. Each is measured by its Shannon entropy relative to its alphabet, against a
threshold that falls with the strength of the context and is adjusted to the length (a short string cannot have high
entropy): a value that is assigned or passed under a secret's name, stands in a login or as the password of an address
needs little; a token with an issuer's prefix or a signed web token needs less; a bare string needs long, mixed, high
entropy. Hashes, identifiers, record ids, images, certificates, reads from an environment or vault, and placeholders
are excluded.

One pass over each text finds spans; they are used both for the report and for masking. Lines without a trigger (a
secret's name, an issuer's prefix, a long token) are never looked at closely. The time grows in proportion to the text,
also within one line of many megabytes: every expression starts at the edge of a run, and the name of a value is sought
in the NAME_REACH characters before it only.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names under which secrets are kept (parts of identifiers; pairs are neighbouring parts), issuers'
# prefixes, placeholders. Plain nouns such as "token" only count for values that pass the entropy test.
NAME_PARTS = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "pw", "secret", "token", "apikey", "credential", "credentials", "apitoken", "authtoken", "secretkey"}
NAME_PAIRS = {("api", "key"), ("access", "key"), ("secret", "key"), ("signing", "key"), ("private", "key"), ("storage", "key"), ("encryption", "key"), ("auth", "key"), ("master", "key"), ("account", "key"), ("shared", "key"), ("service", "key"), ("hmac", "key"), ("session", "key"), ("client", "key")}
NOT_NAMES = {"public", "hash", "digest", "checksum", "fingerprint", "id", "name", "names", "count", "length", "len", "limit", "type", "field", "url", "uri", "path", "file", "policy", "rules", "hint", "label"}
ISSUED = re.compile(
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{18,}|npm_[A-Za-z0-9]{30,}|xox[abeoprs]-[\w-]{20,}"
    r"|SG\.[\w-]{16,}\.[\w-]{30,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{40,}|hf_[A-Za-z]{30,}|ya29\.[\w-]{30,}"
)
PLACEHOLDER = re.compile(
    r"(?i)[*x•.\-_#?]+|<.*>|\[.*\]|\$\{.*\}?|\$\(.*\)?|\$\w+|\{.*\}|%[\w(].*|(?:your|insert|change.?me|replace).*"
    r"|(?:none|null|nil|undefined|true|false|password|passwd|pwd|secret|token|apikey|api[_-]key|test|foo|bar|empty|default|optional|required|string|str|admin|user|root)"
)
#: Words of placeholders that also occur in real passwords: they count in values of letters and separators only.
PLACEHOLDER_WORD = re.compile(r"(?i)(?=[a-z _.\-]+\d{0,2}$).*(?:your|insert|replace|example|sample|dummy|placeholder|redacted|masked|hidden|here\b|todo|fixme|fake|goes.?here|not.?set|to.?be.?set).*")
MARK = "***"
#: How the base 64 of common binary files begins (PNG, JPEG, GIF, BMP-less WebP, PDF, ZIP, gzip, fonts, DER).
BINARY = ("iVBORw0KGgo", "/9j/", "R0lGOD", "UklGR", "JVBERi", "UEsDB", "H4sI", "d09GR", "AAEAAAA", "MII")
#: The name of a value, its type and a call around the value stand within so many characters before it.
NAME_REACH = 400

_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\\n]|\\.)*)`')
_PLUS = re.compile(r"\s*[+.]\s*")
_RUN = r"[A-Za-z0-9+/=]"
# A private key: its opening mark, a body with key text, and its closing mark; or, cut short, the lines of key text.
_KEY_BLOCK = re.compile(
    rf"(?P<open>-----BEGIN (?P<kind>(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----)"
    rf"(?P<body>(?=(?:(?!-----)[\s\S])*?{_RUN}{{16}})(?:(?!-----)[\s\S])*(?=-----END (?P=kind)-----)|(?:(?:\s|\\[nr]|[\"'+,#*/;])*{_RUN}{{16,}})+)(?:-----END (?P=kind)-----)?"
)
_ADDRESS = re.compile(r"(?<![a-zA-Z0-9+.\-])[a-zA-Z0-9+.\-]++://[^\s/:@\"'`<>]*:(?P<secret>[^\s/@\"'`]+)@")
_HEADER = re.compile(r"(?i)\b(?:Bearer|Basic|Token)\s+(?P<secret>[A-Za-z0-9+/=._~\-]{12,})")
_FLAG = re.compile(r"(?:(?<!\S)|(?<=[\"'`]))(?:(?:-u|--user)[ =](?P<u>[^\s:\"']+):(?P<a>[^\s\"'`]+)|--?(?:password|passwd|pass|pwd|token|secret|api-?key|access-?key|auth)[ =](?P<b>[^\s\"'`]+)|-p(?P<c>[^\s\"'`]{4,}))")
_PAIR = re.compile(r"(?<![\w$.\-])(?P<name>[\w$.\-]++)[\"'`]?\s*(?::=|=>|=(?!=)|:(?!:))\s*(?P<value>(?=[^\s\"'`(\[{<])[^\s\"'`,;(){}\[\]]+)(?P<after>[(\[]?)")
_TOLD = re.compile(r"(?i)\b(?P<name>password|passwd|pwd|pw|pass|passphrase|secret|token|api key|key|login|credentials?)\b[\w ,'’\-]{0,40}?(?::| is )\s*(?:(?P<user>[\w.@\-]+)\s*/\s*)?(?P<value>[^\s\"'`]{6,})")
# Read backwards from the quote: an optional call and a separator; then an optional type and the name.
_ARGUMENT = re.compile(r"\s*(?:\(\s*[\w.:]*[A-Za-z_])?\s*[,:=]")
_NAMED = re.compile(r"\s*(?:[\w<>\[\], &']+\s*:\s*)?([\w$.\-]*[A-Za-z_$])")
_READ = re.compile(r"\s*\w*(?:\.\w+)*\.?(?i:read|get|env|getenv|vault|load|fetch|lookup|secret|next\w*|resolve)\s*\(")
_TOKEN = re.compile(r"(?<![\w+/.\-\"'`@$#%&\\])(?=[A-Za-z+/_.\-]*+\d)[A-Za-z0-9+/_.\-]{24,}+={0,2}(?![\w\"'`(\[@:=])")
_CLIENT = re.compile(r"\bmysql|\bmariadb|\bsshpass|\bpsql|\b7z\b")
_SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->|-)[A-Za-z_$]\w*)*")
_PATH = re.compile(r"\.{0,2}(?:/[a-z0-9_.\-]+)+/?")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# What a line must contain to be looked at closely; the words in lower case.
_TRIGGER_WORDS = ("pass", "pwd", "pw", "secret", "token", "key", "credential", "login", "auth", "bearer", "basic", "://", "-u ", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "xox", "sg.", "k_live_", "aiza", "eyj", "pypi-", "dop_v1_", "hf_", "ya29.")
_TRIGGER_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_.\-])(?=[A-Za-z+/=_.\-]*+\d)[A-Za-z0-9+/=_.\-]{24,}+")


class Span(NamedTuple):
    start: int  # of the secret itself, offsets in the text
    end: int
    rule: str


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> int:
    """Size of the smallest usual alphabet that holds the value: digits, hexadecimal, letters, base 64, printable."""
    if value.isdigit():
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 16
    if re.fullmatch(r"[a-z]+|[A-Z]+", value):
        return 26
    if re.fullmatch(r"[a-z0-9]+|[A-Z0-9]+", value):
        return 36
    return 64 if re.fullmatch(r"[A-Za-z0-9+/=_\-]+", value) else 94


def relative_entropy(value: str) -> float:
    """Entropy over what a random string of this length and alphabet would show (about): 1 is random."""
    n, k = len(value), alphabet(value)
    if n < 2:
        return 0.0
    # the plug-in estimate of n uniform draws from k signs falls short by about (k - 1) / (2 n ln 2) bits, never above log2 n
    expected = min(math.log2(n), max(math.log2(k) - (k - 1) / (2 * n * math.log(2)), 0.86 * math.log2(min(n, k))))
    return entropy(value) / expected


def is_secret_name(name: str) -> bool:
    parts = [x.lower() for x in _SPLIT_NAME.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts or parts[-1] in NOT_NAMES:
        return False
    return any(p in NAME_PARTS for p in parts) or any(x in NAME_PAIRS for x in zip(parts, parts[1:])) or "".join(parts[-2:]) in NAME_PARTS


def _mixed(value: str) -> int:
    return bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^A-Za-z0-9]", value))


def _excluded(value: str) -> bool:
    return bool(PLACEHOLDER.fullmatch(value) or PLACEHOLDER_WORD.fullmatch(value) or _UUID.fullmatch(value) or "://" in value or value.startswith(("data:", "-----BEGIN")) or len(value) > 100 and value.startswith(BINARY))


def secret_in_context(value: str) -> bool:
    """Whether a value under a secret's name (or in a login) is a written-out secret."""
    if len(value) < 6 or any(c.isspace() for c in value) or _excluded(value) or "${" in value or _PATH.fullmatch(value):
        return False
    if ISSUED.fullmatch(value):
        return True
    if _IDENTIFIER.fullmatch(value) and not re.search(r"\d{2,}|[a-z]\d[a-zA-Z]|[A-Z]\d|\d[A-Z]", value):
        return False  # a name, perhaps with a number behind
    if re.fullmatch(r"[\d.,:]+|(?:[a-z]+[-_./ ]?)+\d?|[A-Z]+(?:_[A-Z]+)*", value):
        return False
    return _mixed(value) >= 2 and relative_entropy(value) >= (0.55 if len(value) >= 10 else 0.7)


def secret_alone(value: str) -> bool:
    """Whether a string or token without any context is a written-out secret: long, mixed, of nearly random entropy."""
    if ISSUED.fullmatch(value):
        return True
    if len(value) < 24 or _excluded(value) or _HEX.fullmatch(value) or not re.fullmatch(r"[A-Za-z0-9+/=_.\-]+", value):
        return False
    # a run of small letters is a word, unless random text of this length would show one as long
    word = 7 + max(0.0, math.log(len(value) / 60) / 0.6)
    if max(map(len, re.findall(r"[a-z]+|[A-Z]?[a-z]+", value)), default=0) >= word or value.count("/") > len(value) / 8:
        return False
    digits = len(re.findall(r"\d", value))
    return _mixed(value) >= 3 and digits * 25 >= len(value) and relative_entropy(value) >= 0.9


class _String(NamedTuple):
    """A quoted string, or several added with +: from the first character of the first to the last of the last."""

    start: int
    end: int
    parts: list[str]

    @property
    def value(self) -> str:
        return "".join(self.parts)


def _strings(text: str, a: int, b: int) -> list[_String]:
    """Quoted strings of text[a:b], neighbours joined by + taken together."""
    out: list[_String] = []
    for m in _QUOTED.finditer(text, a, b):
        g = m.lastindex or 1
        s, e = m.span(g)
        if out and _PLUS.fullmatch(text, out[-1].end + 1, m.start()):
            out[-1].parts.append(m.group(g))
            out[-1] = out[-1]._replace(end=e)
        else:
            out.append(_String(s, e, [m.group(g)]))
    return out


def _continued(text: str, last: _String) -> _String:
    """A string with the pieces that are added to it on the lines below."""
    while (plus := _PLUS.match(text, last.end + 1)) and plus.group().strip() and (m := _QUOTED.match(text, plus.end())):
        g = m.lastindex or 1
        last.parts.append(m.group(g))
        last = last._replace(end=m.end(g))
    return last


def find(text: str) -> list[Span]:
    """Spans of all credentials in a text, in order, without overlaps. A private key's span is its whole block."""
    taken = [m.span() for m in _KEY_BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    blocks = [m.span() for m in _PUBLIC.finditer(text)] if "-----BEGIN" in text else []
    found = [Span(a, b, "private key") for a, b in taken]
    for a, b in _lines(text):
        if not _meets(blocks, a, a + 1):
            found += [s for s in _line(text, a, b) if not _meets(taken, s.start, s.end)]
    found.sort()
    out: list[Span] = []
    for s in found:
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the spans (in order, without overlaps) has a character of text[a:b]."""
    k = bisect.bisect_left(spans, (b,)) - 1
    return k >= 0 and spans[k][1] > a


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines that hold a trigger, or follow one that ends openly, in order."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; offsets must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts = set()
    for word in _TRIGGER_WORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(low.rfind("\n", 0, at) + 1)
            at = low.find("\n", at)
            if at >= 0:
                at = low.find(word, at)
    line_end = -1
    for m in _TRIGGER_TOKEN.finditer(text):
        if m.start() > line_end:
            starts.add(text.rfind("\n", 0, m.start()) + 1)
            line_end = text.find("\n", m.end())
            if line_end < 0:
                break
    last = -1
    for a in sorted(starts):
        while a > last:
            b = text.find("\n", a)
            b = len(text) if b < 0 else b
            yield a, b
            last = a
            if text[max(a, b - 80) : b].rstrip().endswith(("=", ":", "(")) and b < len(text):  # its value may stand on the next line
                a = b + 1


_PUBLIC = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE KEY)([A-Z0-9 ]+)-----[\s\S]*?-----END \1-----")


def _line(text: str, a: int, b: int) -> Iterator[Span]:
    for m in _ADDRESS.finditer(text, a, b):
        v = m.group("secret")
        if not _excluded(v) and len(v) >= 4 and _mixed(v) >= 2 and relative_entropy(v) >= 0.55:
            yield Span(*m.span("secret"), "address")
    for m in ISSUED.finditer(text, a, b):
        if (m.start() == a or not text[m.start() - 1].isalnum()) and relative_entropy(m.group()[4:]) > 0.5:
            yield Span(*m.span(), "issued")
    for m in _HEADER.finditer(text, a, b):
        v = m.group("secret")
        if _mixed(v) >= 2 and not _excluded(v) and relative_entropy(v) >= 0.7 and re.search(r"\d|[A-Z].*[A-Z]", v):
            yield Span(*m.span("secret"), "header")
    client = (c.start() if (c := _CLIENT.search(text, a, b)) else -1) if "-p" in text[a:b] else -1
    for m in _FLAG.finditer(text, a, b):
        for g in "abc":
            v = m.group(g)
            if v and secret_in_context(v) and (g != "c" or 0 <= client < m.start()):
                yield Span(*m.span(g), "command")
    strings = _strings(text, a, b)
    if strings:
        strings[-1] = _continued(text, strings[-1])
    for k, string in enumerate(strings):
        value = string.value
        named = _has_secret_name(text, a, string.start - 1, strings[k - 1] if k else None)
        if named and secret_in_context(value) or not named and secret_alone(value):
            yield Span(string.start, string.end, "named" if named else "entropy")
    inside = [(x.start - 1, x.end + 1) for x in strings]
    for m in _TOKEN.finditer(text, a, b):
        v = m.group().rstrip(".")
        if not _meets(inside, m.start(), m.end()) and len(re.findall(r"\d+", v)) > 1 and secret_alone(v) and not _PATH.fullmatch(v):
            yield Span(m.start(), m.start() + len(v), "token")
    for m in _PAIR.finditer(text, a, b):
        v = m.group("value")
        if not m.group("after") and is_secret_name(m.group("name")) and _bare_secret(v):
            yield Span(*m.span("value"), "setting")
    for m in _TOLD.finditer(text, a, b):
        v = m.group("value").rstrip(".,;)")
        if (m.group("user") or m.group("name").lower() != "login") and _bare_secret(v):
            s = m.start("value")
            yield Span(s, s + len(v), "told")


def _has_secret_name(text: str, line: int, quote: int, previous: _String | None) -> bool:
    """Whether the string that opens at `quote` is assigned, passed or keyed under a secret's name. The name stands to its
    left on its line, on the line above if the value stands on one of its own, or is the string just before it."""
    reach = max(line, quote - NAME_REACH)
    own = bool(text[reach:quote].strip()) or not line
    reach = reach if own else max(0, quote - NAME_REACH)
    back = text[reach:quote][::-1]
    m = _ARGUMENT.match(back)
    if not m or not own and m.group().endswith(",") or _READ.match(text, quote - m.end() + 1, quote):
        return False
    head = back[m.end() :].lstrip()  # still backwards
    head = head[1:] if head.startswith(":") else head
    at = reach + len(head)
    if previous and previous.end + 1 >= at - 1 and previous.end < quote:
        name = previous.value if len(previous.parts) == 1 and previous.end - previous.start < 60 else ""
        if is_secret_name(name):
            return True
    w = _NAMED.match(head)
    return bool(w) and is_secret_name(w.group(1)[::-1])


def _bare_secret(v: str) -> bool:
    """A value without quotes must not look like code: it needs digits among letters or signs, and no call or path."""
    return secret_in_context(v) and bool(re.search(r"\d", v)) and not re.fullmatch(r"\w+(?:\.\w+)+\d?|[a-z]+(?:_[a-z]+)*_?\d{1,2}|[a-z]+(?:[A-Z][a-z]+)*\d{1,2}", v)


def redact(text: str, spans: list[Span] | None = None) -> str:
    """The text with each credential masked: quotes, names and line breaks stay as they are.

    The body of a private key is masked line by line, so that the number of lines stays.
    """
    out, at = [], 0
    for s in find(text) if spans is None else spans:
        out.append(text[at : s.start])
        secret = text[s.start : s.end]
        if s.rule == "private key":
            out.append(_redact_key(secret))
        elif '"' in secret or "'" in secret or "`" in secret:  # several strings added: mask what stands within each
            out.append(_mask_parts(secret))
        else:
            out.append(MARK)
        at = s.end
    return "".join(out) + text[at:]


def _redact_key(block: str) -> str:
    m = _KEY_BLOCK.match(block)
    body = re.sub(rf"(\\[nr])|{_RUN}{{4,}}", lambda x: x.group(1) or MARK, m.group("body"))
    return block[: m.start("body")] + body + block[m.end("body") :]


def _mask_parts(secret: str) -> str:
    quote = next(c for c in secret if c in "\"'`")
    pieces = secret.split(quote)
    return quote.join(MARK if k % 2 == 0 and p else p for k, p in enumerate(pieces))


def _scan(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, rules, texts = [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                spans = find(text)
                if with_text:
                    if spans:
                        rows.append(r)
                        lines.append(len(spans))
                        texts.append(redact(text, spans))
                    continue
                line, at = 1, 0
                for s in spans:
                    line, at = line + text.count("\n", at, s.start), s.start
                    rows.append(r)
                    lines.append(line)
                    rules.append(s.rule)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            if with_text:
                yield pa.record_batch([keys, pa.array(lines, pa.int32()), pa.array(texts, pa.string())], names=["key", "n", "redacted"])
            else:
                yield pa.record_batch([keys, pa.array(lines, pa.int32()), pa.array(rules, pa.string())], names=["key", "line_no", "rule"])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).filter("length(text) >= 8")
    return rows, df.schema[id_col].dataType.simpleString()


def credential_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, rule): each line of the text on which a credential begins, once for each rule that found one there.

    Lines end at \\n and count from 1. Null, empty and harmless texts give no rows; repeated rows repeat.
    """
    rows, kind = _keyed(df, id_col, text_col)
    return rows.mapInArrow(_scan(False), f"key {kind}, line_no int, rule string").withColumnRenamed("key", id_col)


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, redacted): the texts that hold credentials, with how many, and the text with each masked.

    Texts without credentials are as they were and give no row.
    """
    rows, kind = _keyed(df, id_col, text_col)
    return rows.mapInArrow(_scan(True), f"key {kind}, n int, redacted string").withColumnRenamed("key", id_col)
