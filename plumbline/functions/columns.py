"""Column expressions: everything that one row can say, kept inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import schema

# The three patterns of the sanitizer, in the order in which they apply.
SCRIPT_TAG = r"(?is)<script[\s>].*?</script>"
EVENT_HANDLER = r"""(?i)\bon\w+\s*=\s*["'][^"']*["']"""
SCRIPT_ADDRESS = r"(?i)javascript\s*:"
CITATION = r"\[Source:\s*([^:\]\s]+):(\d+)(?:-(\d+))?(?:\s*\|\s*ID:\s*([a-zA-Z0-9_-]+))?\]"
ASCII_TOKEN = "[a-zA-Z_][a-zA-Z0-9_]*"
UNICODE_TOKEN = r"(?U)\b[a-zA-Z_]\w*\b"


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def label(category: Column, legacy: bool = False) -> Column:
    """The name of a category; an unknown one, or any in legacy mode, is its own name."""
    return _lookup(category, schema.EXPORT_LABELS if legacy else schema.CATEGORY_LABELS, category)


def severity(category: Column, legacy: bool = False) -> Column:
    return _lookup(category, schema.EXPORT_SEVERITY if legacy else schema.CATEGORY_SEVERITY, F.lit("low"))


def extension(filename: Column) -> Column:
    """The lower-case extension with its dot; '' if there is none (a leading dot of the last part makes none)."""
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*(\.[^./]*)$", 1))


def language_of(filename: Column, default: str | None = "python") -> Column:
    """The language of a file name; unknown or missing extensions, and null, give the default."""
    return _lookup(extension(F.coalesce(filename, F.lit(""))), schema.LANGUAGES, F.lit(default).cast("string"))


def is_supported(filename: Column) -> Column:
    return F.coalesce(extension(filename).isin(*schema.LANGUAGES), F.lit(False))


def sanitized(source: Column) -> Column:
    """Source text without script elements, inline event handlers and script addresses; one pass of each, in order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(source, SCRIPT_TAG, ""), EVENT_HANDLER, ""), SCRIPT_ADDRESS, "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """The text without white space (line ends and tabs too) around it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return ~or_empty(c).rlike(r"(?U)\S")


def cut(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def risk(rate: Column) -> Column:
    r = F.coalesce(rate, F.lit(0.0))
    return F.when(r < 0.1, "LOW").when(r < 0.3, "MEDIUM").otherwise("HIGH")


def health_colour(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "yellow").when(score >= 40, "orange").otherwise("red")


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole as a double; `empty` where whole is 0 or null."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty))


def bar(n: Column, width: int = 30) -> Column:
    return F.repeat(F.lit("#"), F.least(n * 2, F.lit(width)).cast("int"))


def wrapped(text: Column, width: int = 60) -> Column:
    """Greedy word wrap to an array of lines: a word joins the line while the lengths, each with a blank, stay within the
    width; the first word of a line counts without its blank unless the text begins with it. No words: one empty line."""
    words = F.filter(F.split(F.trim(F.regexp_replace(or_empty(text), r"\s+", " ")), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0).alias("n"))

    def add(acc: Column, w: Column) -> Column:
        fits = acc["n"] + F.length(w) + 1 <= width
        joined = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        closed = F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        return F.struct(
            F.when(fits, acc["lines"]).otherwise(closed).alias("lines"),
            F.when(fits, joined).otherwise(w).alias("line"),
            F.when(fits, acc["n"] + F.length(w) + 1).otherwise(F.length(w)).alias("n"),
        )

    return F.aggregate(words, start, add, lambda acc: F.when((acc["line"] == "") & (F.size(acc["lines"]) > 0), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))))


def tokens(text: Column, unicode: bool = True) -> Column:
    """Lower-case identifiers of a text, in order. The Unicode form takes letters of any script after the first sign."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(UNICODE_TOKEN if unicode else ASCII_TOKEN), F.lit(0))


def words(text: Column, unicode: bool = True) -> Column:
    """Lower-case words (letters, digits, underscores) of a text, in order."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"(?U)\w+" if unicode else "[a-z0-9_]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Parts between white space; 0 for null, empty and blank texts."""
    bare = F.trim(F.regexp_replace(or_empty(text), r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " "))).cast("bigint")


def stage_state(status: Column, run: str, done: str) -> Column:
    """pending, active, complete or failed: the state of a pipeline stage given the status of its analysis."""
    order = F.array(*[F.lit(s) for s in schema.STATUSES[:7]])
    at = F.array_position(order, status)
    return F.when(status == "failed", "failed").when(at >= schema.STATUSES.index(done) + 1, "complete").when(at >= schema.STATUSES.index(run) + 1, "active").otherwise("pending")


#: Floor and ceiling of the progress shown for a status.
PROGRESS = {"pending": (0, 2), "bce_running": (2, 30), "bce_complete": (33, 34), "dts_running": (34, 63), "dts_complete": (66, 67), "rv_running": (67, 97), "complete": (100, 100), "failed": (0, 0)}


def progress(status: Column, which: int) -> Column:
    pairs = [F.lit(x) for k, v in PROGRESS.items() for x in (k, v[which])]
    return F.element_at(F.create_map(*pairs), status).cast("bigint")


def elapsed(start: Column, end: Column) -> Column:
    """'42s' or '3m 5s'; null while it runs."""
    s = F.floor(F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp")))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def citations(text: Column) -> Column:
    """The citation tags of a text as an array of (path, first, last, chunk_id); last is first where it is missing."""

    def group(k: int) -> Column:
        return F.regexp_extract_all(or_empty(text), F.lit(CITATION), F.lit(k))

    zipped = F.arrays_zip(group(1).alias("path"), group(2).alias("s"), group(3).alias("e"), group(4).alias("id"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            z["path"].alias("path"), z["s"].cast("int").alias("first"), F.when(z["e"] == "", z["s"]).otherwise(z["e"]).cast("int").alias("last"), F.when(z["id"] == "", None).otherwise(z["id"]).alias("chunk_id")
        ),
    )


def citation_tag(path: Column, first: Column, last: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit("[Source: "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" | ID: "), chunk_id, F.lit("]"))
