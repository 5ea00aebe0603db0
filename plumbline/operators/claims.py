"""Claims mined from documentation and from syntax trees.

The 47 patterns are literal expressions on one column (each compiled once per task), their matches one array per
pattern; one explode of these arrays turns them into rows, and what a claim says is put together from the rows. No join
with a pattern relation, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import or_empty, stripped
from plumbline.functions.patterns import PATTERNS, TRIGGERS, Pattern, group_number, java

_TEXTS = "array<string>"


def _matches(text: Column, low: Column, p: Pattern, unicode: bool) -> Column:
    """(no, hits): the matches of one pattern with their groups; hits is null where there are none."""
    regex = F.lit(java(p.regex, unicode))

    def group(name: str) -> Column:
        n = group_number(p.regex, name)
        return (F.regexp_extract_all(text, regex, F.lit(n)) if n else F.array().cast(_TEXTS)).alias(name)

    hits = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(0)).alias("raw"), group("subject"), group("object"), group("condition"))
    # most patterns miss most texts: a plain search for their word comes before the expression, and the groups are only
    # taken where there is a match
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in TRIGGERS[p.number]])
    return F.struct(F.lit(p.number).alias("no"), F.when(held & F.regexp_like(text, regex), hits).alias("hits"))


def documentation_claims(functions: DataFrame, key: str, docstring: str = "docstring", categories: tuple[str, ...] | None = None, unicode: bool = True) -> DataFrame:
    """(key, pattern_no, category, subject, predicate_object, conditionality, match_no, raw_text): one row per match.

    Functions without documentation give no rows. The verbs' parts of speech are not checked: a documented superset.
    """
    patterns = [p for p in PATTERNS if categories is None or p.category in categories]
    # the lower case is made once per text, for all patterns (the long s folds onto a letter in the expressions, so here too)
    kept = functions.filter(or_empty(F.col(docstring)) != "").select(F.col(key), F.col(docstring).alias("_text"), F.translate(F.lower(docstring), "\u017f", "s").alias("_low"))
    every = F.array(*[_matches(F.col("_text"), F.col("_low"), p, unicode) for p in patterns])
    # the array is a column of its own and exploded as "outer": otherwise it would be computed again for every field that
    # is read, and once more by the filter on its size that an inner explode brings
    found = kept.select(F.col(key), every.alias("_all")).select(key, F.explode_outer("_all").alias("m")).filter("m.hits is not null")
    rows = found.select(key, F.col("m.no").alias("pattern_no"), F.posexplode("m.hits").alias("match_no", "m"))

    # what is said is put together once for all patterns, from the rows: the plan stays small
    def by_pattern(value: Callable[[Pattern], object]) -> Column:
        return F.element_at(F.array(*[F.lit(value(p)) for p in PATTERNS]), F.col("pattern_no"))

    read = rows.select(
        key, "pattern_no", "match_no", by_pattern(lambda p: p.category).alias("category"), by_pattern(lambda p: p.name.replace("_", " ")).alias("title"), stripped(F.col("m.raw")).alias("raw_text"),
        *[stripped(or_empty(F.col(f"m.{k}"))).alias(f"_{k}") for k in ("subject", "object", "condition")],
    )
    must = [p.number for p in patterns if p.must]
    kept_rows = read.filter((F.col("raw_text") != "") & (~F.col("pattern_no").isin(must) | F.lower("raw_text").rlike(r"\bmust\b")) if must else F.col("raw_text") != "")
    said = F.when(F.col("_object") != "", F.concat_ws(": ", "title", "_object")).when(F.col("_subject") != "", F.concat_ws(": ", "title", "_subject")).otherwise(F.col("title"))
    bare = F.regexp_replace("_condition", r"\.+$", "")
    return kept_rows.select(
        key, "pattern_no", "category", F.when(F.col("_subject") != "", F.col("_subject")).otherwise("return").alias("subject"), said.alias("predicate_object"), F.when(bare != "", bare).alias("conditionality"), "match_no", "raw_text",
    )


def syntax_claims(functions: DataFrame, key: str) -> DataFrame:
    """(key, category, subject, predicate_object, conditionality, source_line, raw_text): what the code itself shows, from
    its raise statements and the changes to its parameters. Null arrays are empty."""
    raised = F.transform(
        F.coalesce("raise_statements", F.array().cast("array<struct<exception_class:string,condition:string,lineno:int>>")),
        lambda r: F.struct(F.lit("ECV").alias("category"), r["exception_class"].alias("subject"), F.concat(F.lit("raises "), r["exception_class"]).alias("predicate_object"), r["condition"].alias("conditionality"), r["lineno"].alias("source_line"), F.concat(F.lit("raises "), r["exception_class"], F.coalesce(F.concat(F.lit(" if "), F.when(r["condition"] != "", r["condition"])), F.lit(""))).alias("raw_text")),
    )
    changed = F.transform(
        F.coalesce("mutation_patterns", F.array().cast("array<struct<target:string,method:string,line:int>>")),
        lambda m: F.struct(F.lit("SEV").alias("category"), m["target"].alias("subject"), F.concat(F.lit("modifies "), m["target"], F.lit(" via "), m["method"]).alias("predicate_object"), F.lit(None).cast("string").alias("conditionality"), m["line"].alias("source_line"), F.concat(F.lit("modifies "), m["target"], F.lit(" via "), m["method"]).alias("raw_text")),
    )
    return functions.select(key, F.posexplode(F.concat(raised, changed)).alias("place", "c")).select(key, "place", "c.*")


def merged(syntax: DataFrame, documentation: DataFrame, key: str) -> DataFrame:
    """Both tracks, the first claim of each (category, subject, predicate) per function kept: syntax first, then by
    pattern and match."""
    cols = [key, "category", "subject", "predicate_object", "conditionality", "raw_text"]
    a = syntax.select(*cols, F.lit(0).alias("track"), F.lit(0).alias("pattern_no"), F.col("place").alias("match_no"))
    b = documentation.select(*cols, F.lit(1).alias("track"), "pattern_no", "match_no")
    w = Window.partitionBy(key, "category", "subject", "predicate_object").orderBy("track", "pattern_no", "match_no")
    return reduce(DataFrame.unionByName, [a, b]).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def line_of(text: Column, match: Column, first_line: Column) -> Column:
    """The line on which the first occurrence of `match` in `text` begins, the text beginning on `first_line`; the first
    line if it does not occur."""
    at = F.instr(text, match)
    before = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return (first_line + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("bigint")
