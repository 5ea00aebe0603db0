"""Joins and aggregates over the four tables: reports, statistics, health, client-side summaries, exports.

All take DataFrames with the columns of the model. Keys are taken as given: run once() on tables in which rows may have
been delivered twice. Nulls: counts of nothing are 0, ratios over nothing are the stated default, text fields of
reports are '' where null. Empty tables give empty results, or one row of zeros for global totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import columns as C
from plumbline.session import written

HOT_ROWS = 1_000_000  # rows of one key that one task may number


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key; rows delivered twice are byte for byte the same."""
    return df.dropDuplicates([key])


# -- joins -----------------------------------------------------------------------------------------------------------


def violation_rows(functions: DataFrame, claims: DataFrame, violations: DataFrame, legacy: bool = False) -> DataFrame:
    """One row per violation with its claim and function. The selective side leads; all keys are unique on the right."""
    f = functions.select(F.col("id").alias("function_id"), "analysis_id", F.col("name").alias("function_name"), C.or_empty(F.col("signature")).alias("function_signature"))
    c = claims.select(F.col("id").alias("claim_id"), "function_id", "category", F.col("raw_text").alias("claim_text"), "subject", "predicate_object", "conditionality", "source_line")
    joined = violations.withColumnRenamed("id", "violation_id").join(c, "claim_id").join(f, "function_id")
    return joined.select(
        "analysis_id", "function_id", "claim_id", "violation_id", "function_name", "function_signature", "category", C.label(F.col("category"), legacy).alias("category_label"), C.severity(F.col("category"), legacy).alias("severity"),
        "claim_text", C.or_empty(F.col("subject")).alias("claim_subject"), C.or_empty(F.col("predicate_object")).alias("claim_predicate"), C.or_empty(F.col("conditionality")).alias("claim_condition"), "source_line",
        "outcome", C.or_empty(F.col("expected")).alias("expected"), C.or_empty(F.col("actual")).alias("actual"), C.or_empty(F.col("test_code")).alias("test_code"), C.or_empty(F.col("traceback")).alias("traceback"), "execution_time_ms",
    )


def number_within(df: DataFrame, key: str, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """df with a number from 1 within each key in the order of columns that are total there. Keys are not null.

    If one key holds more than HOT_ROWS rows, the rows are spread by ranges of (key, order) instead of by key, and each
    range adds the rows that its first key has in the ranges before it: no task sees a whole hot key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("n")).first()["n"] or 0
    if largest <= HOT_ROWS:
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    ranges = written(df.repartitionByRange(parts, key, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    ends = ranges.groupBy("_p").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    # only the first and the last key of a range go on in another: two rows for each range
    counts = ranges.groupBy("_p", key).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(ends), "_p").filter((F.col(key) == F.col("_lo")) | (F.col(key) == F.col("_hi")))
    before = counts.select("_p", key, (F.sum("_n").over(Window.partitionBy(key).orderBy("_p")) - F.col("_n")).alias("_before"))
    own = ranges.withColumn("_i", F.row_number().over(Window.partitionBy("_p", key).orderBy(*order)))
    joined = own.join(F.broadcast(before), ["_p", key], "left")
    return joined.select(*df.columns, (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))


def claims_in_parts(claims: DataFrame, most: int = 10_000) -> DataFrame:
    """(function_id, part_no from 0, claims): the claims of each function as ordered arrays of at most `most`, so that a
    function that holds much of the table is many rows. Functions without claims have none."""
    item = F.struct("source_line", F.col("id").alias("claim_id"), "category", "subject", "predicate_object", "conditionality", "raw_text")
    placed = number_within(claims.filter("function_id is not null"), "function_id", ["source_line", "id"], "_place").withColumn("part_no", F.floor((F.col("_place") - 1) / most).cast("bigint"))
    return placed.groupBy("function_id", "part_no").agg(F.sort_array(F.collect_list(item)).alias("claims"))


def claims_by_function(functions: DataFrame, claims: DataFrame) -> DataFrame:
    """Every function with its claims as an ordered array (empty for none); the claims are sorted within their group. All
    claims of a function are one row: where one may hold more than fits there, use claims_in_parts()."""
    item = F.struct("source_line", F.col("id").alias("claim_id"), "category", "subject", "predicate_object", "conditionality", "raw_text")
    grouped = claims.groupBy(F.col("function_id").alias("fid")).agg(F.sort_array(F.collect_list(item)).alias("claims"))
    joined = functions.join(grouped, functions["id"] == grouped["fid"], "left")
    empty = F.array().cast(grouped.schema["claims"].dataType)
    return joined.select(functions["id"].alias("function_id"), "analysis_id", "name", "signature", F.coalesce("claims", empty).alias("claims"))


def function_claim_violation(functions: DataFrame, claims: DataFrame, violations: DataFrame) -> DataFrame:
    """Functions left joined with claims left joined with violations."""
    c = claims.select(F.col("id").alias("claim_id"), "function_id", "category")
    v = violations.select(F.col("id").alias("violation_id"), "claim_id", "outcome")
    f = functions.select(F.col("id").alias("function_id"), "analysis_id", "name", "docstring", "signature")
    return f.join(c, "function_id", "left").join(v, "claim_id", "left")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: later rows win. `order` must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def match_results(results: DataFrame, functions: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, orphans) of results (function_name, raw_text, ...) looked up by function name and claim text.

    The legacy way of storing outcomes: where several claims share both, the last claim id wins.
    """
    named = claims.join(functions.select(F.col("id").alias("function_id"), F.col("name").alias("function_name")), "function_id")
    known = last_per_key(named.select("function_name", "raw_text", F.col("id").alias("claim_id")), ["function_name", "raw_text"], [F.col("claim_id")])
    joined = results.join(known, ["function_name", "raw_text"], "left")
    return joined.filter("claim_id is not null"), joined.filter("claim_id is null").drop("claim_id")


def cascade_survivors(deleted: DataFrame, functions: DataFrame, claims: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions, claims and violations left after the analyses in `deleted` (id) are removed with all below them."""
    gone_f = functions.join(deleted.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi").select(F.col("id").alias("function_id"))
    gone_c = claims.join(gone_f, "function_id", "left_semi").select(F.col("id").alias("claim_id"))
    f = functions.join(deleted.select(F.col("id").alias("analysis_id")), "analysis_id", "left_anti")
    return f, claims.join(gone_f, "function_id", "left_anti"), violations.join(gone_c, "claim_id", "left_anti")


def rerun_reset(analyses: DataFrame, rerun: DataFrame, provider: str | None = None) -> DataFrame:
    """Analyses with the counters, status and completion of those in `rerun` (id) reset, and optionally a new provider."""
    marked = analyses.join(rerun.select("id").distinct().withColumn("_again", F.lit(True)), "id", "left")
    again = F.coalesce("_again", F.lit(False))
    zero = {c: F.when(again, F.lit(0)).otherwise(F.col(c)).cast(analyses.schema[c].dataType).alias(c) for c in ("total_functions", "total_claims", "total_violations", "bcv_rate")}
    new = zero | {"status": F.when(again, "pending").otherwise(F.col("status")).alias("status"), "completed_at": F.when(~again, F.col("completed_at")).alias("completed_at")}
    if provider is not None:
        new["llm_provider"] = F.when(again, provider).otherwise(F.col("llm_provider")).alias("llm_provider")
    return marked.select([new.get(c, F.col(c)) for c in analyses.columns])


# -- statistics ------------------------------------------------------------------------------------------------------


def totals(analyses: DataFrame) -> DataFrame:
    """One row: counts, sums and the mean rate of complete analyses, from one scan."""
    done = F.col("status") == "complete"
    return analyses.agg(
        F.count("id").alias("total_analyses"), F.count_if(done).alias("completed_analyses"), F.count_if(F.col("status") == "failed").alias("failed_analyses"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total_functions", "total_claims", "total_violations")],
        F.round(F.coalesce(F.avg(F.when(done, F.col("bcv_rate"))), F.lit(0.0)), 6).alias("avg_bcv_rate"),
    )


def by_provider(analyses: DataFrame) -> DataFrame:
    sums = analyses.groupBy("llm_provider").agg(
        F.count(F.lit(1)).alias("analyses"), F.sum("total_claims").cast("bigint").alias("claims"), F.sum("total_violations").cast("bigint").alias("violations"), F.round(F.avg("bcv_rate"), 6).alias("avg_bcv_rate")
    )
    return sums.withColumn("violation_ratio", F.round(C.ratio(F.col("violations"), F.col("claims")), 6))


def percent_of_total(df: DataFrame, key: str) -> DataFrame:
    """(key, n, percent): counts and their share of all rows; no rows for an empty table."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


def batch_rollup(analyses: DataFrame) -> DataFrame:
    """Per batch id of the config: analyses, complete, failed, in progress, and shares in percent (0 for none)."""
    batch = F.get_json_object("config", "$.batch_id")
    sums = analyses.select(batch.alias("batch_id"), "status").filter("batch_id is not null").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return sums.select(
        "*", (F.col("total") - F.col("complete") - F.col("failed")).alias("in_progress"), F.round(100 * C.ratio(F.col("complete"), F.col("total")), 4).alias("complete_percent"), F.round(100 * C.ratio(F.col("failed"), F.col("total")), 4).alias("failed_percent")
    )


def outcome_rates(rows: DataFrame, key: str) -> DataFrame:
    """Per key: passed, failed, errors, and failed over passed and failed (errors and undetermined left out; 0 for none)."""
    sums = rows.groupBy(key).agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("pass", "passed"), ("fail", "failed"), ("error", "errors"), ("undetermined", "undetermined"))])
    return sums.withColumn("bcv_rate", F.round(C.ratio(F.col("failed"), F.col("passed") + F.col("failed")), 6))


def detection_quality(rows: DataFrame) -> DataFrame:
    """One row from (predicted boolean, actual boolean): precision, recall, F1 and false-positive rate; 0 over nothing."""
    tp, fp = F.count_if(F.col("predicted") & F.col("actual")), F.count_if(F.col("predicted") & ~F.col("actual"))
    fn, tn = F.count_if(~F.col("predicted") & F.col("actual")), F.count_if(~F.col("predicted") & ~F.col("actual"))
    counts = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    p, r = C.ratio(F.col("tp"), F.col("tp") + F.col("fp")), C.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), F.round(C.ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"))


# -- health ----------------------------------------------------------------------------------------------------------


def function_health(functions: DataFrame, claims: DataFrame, violations: DataFrame) -> DataFrame:
    """Per function: claims, failed ones, a score (50 without claims), distinct categories sorted and joined by commas."""
    rows = function_claim_violation(functions, claims, violations)
    sums = rows.groupBy("function_id").agg(
        F.first("analysis_id").alias("analysis_id"), F.first("name").alias("name"), F.first("signature").alias("signature"), F.coalesce(F.first(F.length("docstring")), F.lit(0)).cast("bigint").alias("docstring_length"),
        F.count("claim_id").alias("claim_count"), F.count_if(F.col("outcome") == "fail").alias("violation_count"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
    )
    score = F.when(F.col("claim_count") == 0, 50).otherwise(F.floor(100 * (1 - F.col("violation_count") / F.col("claim_count"))))
    return sums.withColumn("health_score", score.cast("bigint"))


def analysis_health(analyses: DataFrame, functions: DataFrame, claims: DataFrame, violations: DataFrame, counts: DataFrame) -> DataFrame:
    """Per analysis: coverage, density, violation rate and the overall score. counts: (id, n), the functions of each whole
    source, see extract.all_function_counts(); 1 where it has none for an analysis."""
    c = claims.groupBy("function_id").agg(F.count(F.lit(1)).alias("n_claims"))
    fails = violations.filter("outcome = 'fail'").select("claim_id")
    v = claims.select(F.col("id").alias("claim_id"), "function_id").join(fails, "claim_id", "left_semi").groupBy("function_id").agg(F.count(F.lit(1)).alias("n_fail"))
    f = functions.select(F.col("id").alias("function_id"), "analysis_id").join(c, "function_id", "left").join(v, "function_id", "left")
    sums = f.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("documented"), F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"), F.coalesce(F.sum("n_fail"), F.lit(0)).alias("violations"))
    counted = counts.select(F.col("id").alias("analysis_id"), F.col("n").cast("bigint").alias("counted"))
    joined = analyses.select(F.col("id").alias("analysis_id")).join(counted, "analysis_id", "left").na.fill(1, ["counted"]).join(sums, "analysis_id", "left").na.fill(0, ["documented", "claims", "violations"])
    rows = joined.select("analysis_id", "documented", F.greatest("counted", "documented").alias("functions"), "claims", "violations")
    coverage, density, rate = C.ratio(F.col("documented"), F.col("functions")), C.ratio(F.col("claims"), F.col("documented")), C.ratio(F.col("violations"), F.col("claims"))
    score = F.floor(F.round(F.lit(0.4) * coverage * 100 + F.lit(0.3) * F.least(density / 3, F.lit(1.0)) * 100 + F.lit(0.3) * (1 - rate) * 100, 9))
    return rows.select("*", F.round(coverage, 6).alias("coverage"), F.round(density, 6).alias("density"), F.round(rate, 6).alias("violation_rate"), F.when(F.col("functions") == 0, 0).otherwise(score).cast("bigint").alias("health"))


def counted_functions(source: Column, language: Column) -> Column:
    """The line heuristic for languages other than Python: lines that start a def, or in JavaScript and TypeScript hold
    'function ' or '=>'; at least 1. (Python is counted on the syntax tree, see plumbline.functions.pysource.)"""
    def hit(x: Column) -> Column:
        s = F.trim(x)
        return s.startswith("def ") | s.startswith("async def ") | (language.isin("javascript", "typescript") & (s.contains("function ") | s.contains("=>")))

    return F.greatest(F.size(F.filter(F.split(C.or_empty(source), "\n"), hit)), F.lit(1)).cast("bigint")


# -- client-side summaries -------------------------------------------------------------------------------------------


def signature_parts(signature: Column) -> tuple[Column, Column, Column]:
    """(what stands before the brackets, the brackets, the type behind an arrow) of a signature; empty where it has none."""
    shape = r"^([^(]+)(\([^)]*\))(.*)$"
    return F.regexp_extract(signature, shape, 1), F.regexp_extract(signature, shape, 2), F.regexp_extract(F.regexp_extract(signature, shape, 3), r"^\s*->\s*(.+)$", 1)


def per_function_results(functions: DataFrame, claims: DataFrame, failures: DataFrame) -> DataFrame:
    """Per function of each analysis: claims, failures, passes and status. failures: (function_id), one row each."""
    c = claims.groupBy("function_id").agg(F.count(F.lit(1)).alias("n_claims"))
    v = failures.groupBy("function_id").agg(F.count(F.lit(1)).alias("n_violations"))
    rows = functions.select(F.col("id").alias("function_id"), "analysis_id", "name").join(c, "function_id", "left").join(v, "function_id", "left").na.fill(0, ["n_claims", "n_violations"])
    failed = F.least("n_violations", "n_claims")
    status = F.when(F.col("n_violations") > 0, "has-failures").when(F.col("n_claims") > 0, "all-pass").otherwise("no-claims")
    return rows.select("function_id", "analysis_id", "name", (F.col("n_claims") - failed).alias("pass_count"), failed.alias("fail_count"), status.alias("status"))


def with_category(results: DataFrame, category: str) -> DataFrame:
    """Results (…, violations array<struct<category,…>>) that have a violation of the category, narrowed to those."""
    narrowed = results.withColumn("violations", F.filter("violations", lambda v: v["category"] == category))
    return narrowed.filter(F.size("violations") > 0)


def text_search(results: DataFrame, needle: str) -> DataFrame:
    """Results (name, claims array<struct<subject,raw_text,…>>) whose name, or any claim's text or subject, holds the
    needle in any case. An empty needle keeps all."""
    n = needle.lower()
    claim = F.exists("claims", lambda c: C.or_empty(F.lower(c["raw_text"])).contains(n) | C.or_empty(F.lower(c["subject"])).contains(n))
    return results.filter(C.or_empty(F.lower("name")).contains(n) | claim)


def line_violations(rows: DataFrame) -> DataFrame:
    """(analysis_id, line, n, claims): failed claims by source line above 0, their ids sorted and joined by commas."""
    return rows.filter("outcome = 'fail' and source_line > 0").groupBy("analysis_id", F.col("source_line").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("claim_id")), ",").alias("claims"))


def stages(analyses: DataFrame) -> DataFrame:
    """Three rows per analysis: the state of each pipeline stage. A projection and an explode; nothing is joined."""
    state = lambda run, done: C.stage_state(F.col("status"), run, done)
    three = F.array(*[F.struct(F.lit(k).alias("stage"), state(r, d).alias("state")) for k, r, d in (("BCE", "bce_running", "bce_complete"), ("DTS", "dts_running", "dts_complete"), ("RV", "rv_running", "complete"))])
    return analyses.select(F.col("id").alias("analysis_id"), "status", F.explode(three).alias("s")).select("analysis_id", "status", "s.stage", "s.state")


# -- exports ---------------------------------------------------------------------------------------------------------


def csv_rows(rows: DataFrame) -> DataFrame:
    """The 15 columns of the CSV export, numbered from 1 within each analysis by function, claim and violation id."""
    flag = lambda c: F.when(F.col(c) != "", "yes").otherwise("no")
    return number_within(rows, "analysis_id", ["function_name", "claim_id", "violation_id"], "row_no").select(
        "analysis_id", "row_no", "function_name", "function_signature", "category", "category_label", "severity", "claim_text", "claim_subject", "claim_predicate", "claim_condition", "outcome", "expected", "actual",
        flag("test_code").alias("has_test_code"), flag("traceback").alias("has_traceback"),
    )


def report_lines(analyses: DataFrame, rows: DataFrame) -> DataFrame:
    """(analysis_id, line_no, line): the text report, one row per line, as a union of its sections with sort keys.

    Sections: metrics, risk, counts by severity with bars, counts by category, and each violation with its wrapped
    claim. No section is collected: a report with many violations stays distributed until it is written.
    """
    pct = lambda c: F.format_string("%.1f%%", c)
    rate = F.coalesce("bcv_rate", F.lit(0.0))
    head = F.array(
        F.lit("METRICS"), F.format_string("Functions analyzed: %d", "total_functions"), F.format_string("Claims extracted: %d", "total_claims"), F.format_string("Violations detected: %d", "total_violations"), F.concat(F.lit("Violation rate: "), pct(rate * 100)),
        F.concat(F.lit("Documentation accuracy: "), pct((1 - rate) * 100)), F.concat(F.lit("RISK "), C.risk(rate)),
    )
    part = analyses.select(F.col("id").alias("analysis_id"), F.posexplode(head).alias("k", "line")).select("analysis_id", F.array(F.lit(0), F.col("k")).alias("place"), F.lit("").alias("sub"), "line")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    sev = rows.groupBy("analysis_id", "severity").agg(F.count(F.lit(1)).alias("n")).select("analysis_id", F.array(F.lit(1), rank).alias("place"), F.lit("").alias("sub"), F.concat(F.rpad(F.upper("severity"), 8, " "), F.lit(" "), F.lpad(F.col("n").cast("string"), 3, " "), F.lit("  "), C.bar(F.col("n"))).alias("line"))
    cat = rows.groupBy("analysis_id", "category").agg(F.count(F.lit(1)).alias("n"), F.first("category_label").alias("l"), F.first("severity").alias("s")).select(
        "analysis_id", F.array(F.lit(2), F.lit(0)).alias("place"), F.col("category").alias("sub"), F.format_string("[%s] %s: %d, severity %s", "category", "l", "n", F.upper("s")).alias("line")
    )
    numbered = number_within(rows, "analysis_id", ["function_name", "claim_id", "violation_id"], "no").withColumn("no", F.col("no").cast("int"))
    lines = F.concat(
        F.array(F.format_string("VIOLATION #%d", "no"), F.concat(F.lit("Function: "), F.col("function_name"))), F.when(F.col("function_signature") != "", F.array(F.concat(F.lit("Signature: "), C.cut(F.col("function_signature"), 60)))).otherwise(F.array().cast("array<string>")),
        F.array(F.format_string("Category: [%s] %s", "category", "category_label")), F.transform(C.wrapped(F.col("claim_text")), lambda x: F.concat(F.lit("  "), x)), F.array(F.concat(F.lit("Outcome: "), F.col("outcome"))),
        F.when(F.col("expected") != "", F.array(F.concat(F.lit("Expected: "), F.substring("expected", 1, 80)))).otherwise(F.array().cast("array<string>")), F.when(F.col("actual") != "", F.array(F.concat(F.lit("Actual: "), F.substring("actual", 1, 80)))).otherwise(F.array().cast("array<string>")),
    )
    detail = numbered.select("analysis_id", "no", F.posexplode(lines).alias("k", "line")).select("analysis_id", F.array(F.lit(3), F.col("no"), F.col("k")).alias("place"), F.lit("").alias("sub"), "line")
    every = part.unionByName(sev).unionByName(cat).unionByName(detail)
    return number_within(every, "analysis_id", ["place", "sub"], "line_no").select("analysis_id", "line_no", "line")


def text_to_pdf(lines: list[str]) -> bytes:
    """A minimal PDF 1.4 of one page in Courier from lines of text; signs outside Latin-1 become question marks."""
    out = bytearray(b"%PDF-1.4\n")
    shown = [x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for x in lines]
    stream = "\n".join(["BT", "/F1 10 Tf", "36 756 Td", "12 TL", *[f"({x}) Tj T*" for x in shown], "ET"]).encode("latin-1", "replace")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>",
    ]
    at = []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table))


def json_reports(analyses: DataFrame, rows: DataFrame) -> DataFrame:
    """(analysis_id, report): the JSON report of each analysis.

    The violations of one analysis meet in one row, as the document demands; only their aggregates join the analysis.
    """
    item = F.struct("claim_id", "violation_id", "function_name", "function_signature", "category", "category_label", "severity", "claim_text", "claim_subject", "claim_predicate", "claim_condition", "outcome", "expected", "actual", "test_code", "traceback")
    counts = lambda key: rows.groupBy("analysis_id", key).agg(F.count(F.lit(1)).alias("n")).groupBy("analysis_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"by_{key}"))
    body = rows.groupBy("analysis_id").agg(F.sort_array(F.collect_list(item)).alias("violations"), F.sort_array(F.collect_set("function_name")).alias("affected_functions"))
    joined = analyses.join(body, analyses["id"] == body["analysis_id"], "left").drop("analysis_id").withColumnRenamed("id", "analysis_id").join(counts("category"), "analysis_id", "left").join(counts("severity"), "analysis_id", "left")
    rate = F.coalesce("bcv_rate", F.lit(0.0))
    report = F.struct(
        F.struct(F.col("analysis_id").alias("id"), "filename", F.coalesce("language", F.lit("python")).alias("language"), "llm_provider", "status", "created_at", "completed_at").alias("analysis"),
        F.struct("total_functions", "total_claims", "total_violations", F.round(rate, 4).alias("bcv_rate"), F.format_string("%.1f%%", rate * 100).alias("bcv_rate_percentage"), F.format_string("%.1f%%", (1 - rate) * 100).alias("pass_rate"), F.coalesce(F.size("affected_functions"), F.lit(0)).alias("functions_with_violations")).alias("summary"),
        F.struct("by_category", "by_severity").alias("breakdown"), "violations", "affected_functions",
    )
    return joined.select("analysis_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def with_counters(analyses: DataFrame, functions: DataFrame, claims: DataFrame, violations: DataFrame) -> DataFrame:
    """Analyses with their four counters computed from the rows below them (what the writers keep up to date)."""
    f = functions.select(F.col("id").alias("function_id"), "analysis_id")
    c = claims.select(F.col("id").alias("claim_id"), "function_id").join(f, "function_id")
    v = violations.select("claim_id", "outcome").join(c, "claim_id")
    parts = f.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_f")), c.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_c")), v.groupBy("analysis_id").agg(F.count_if(F.col("outcome") == "fail").alias("_v"), F.count_if(F.col("outcome").isin("pass", "fail")).alias("_r"))
    out = analyses.withColumnRenamed("id", "analysis_id")
    for p in parts:
        out = out.join(p, "analysis_id", "left")
    new = {"total_functions": "_f", "total_claims": "_c", "total_violations": "_v"}
    cols = [F.coalesce(F.col(new[c]), F.lit(0)).cast(analyses.schema[c].dataType).alias(c) if c in new else F.round(C.ratio(F.coalesce("_v", F.lit(0)), F.coalesce("_r", F.lit(0))), 6).alias(c) if c == "bcv_rate" else F.col("analysis_id").alias("id") if c == "id" else F.col(c) for c in analyses.columns]
    return out.select(cols)


def valid_claims(claims: DataFrame) -> DataFrame:
    """Claims with text in subject, predicate and raw text, a known category, and a line above 0."""
    said = [~C.is_blank(F.col(c)) for c in ("subject", "predicate_object", "raw_text")]
    return claims.filter(said[0] & said[1] & said[2] & (F.col("source_line") > 0) & F.col("category").isin(*schema.CATEGORIES))


class NotComplete(ValueError):
    """The analysis is there but has not ended well yet."""


def completed(analyses: DataFrame, analysis_id: str) -> DataFrame:
    """The one analysis, if it is complete: LookupError for an unknown id, NotComplete for another status. One row is read
    on the driver to decide."""
    row = analyses.filter(F.col("id") == analysis_id)
    found = row.select("status").head()
    if found is None:
        raise LookupError(f"no analysis {analysis_id}")
    if found.status != "complete":
        raise NotComplete(f"analysis {analysis_id} is {found.status}")
    return row


def category_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, counts map of all six categories, present map of those above 0)."""
    pairs = [F.lit(x) if isinstance(x, str) else x for c in schema.CATEGORIES for x in (c, F.count_if(F.col("category") == c))]
    counts = rows.groupBy(key).agg(F.create_map(*pairs).alias("counts"))
    return counts.withColumn("present", F.map_filter("counts", lambda _, n: n > 0))
