"""Writers: CSV, JSON, text and PDF reports, and the files of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.reports import csv_rows, json_reports, match_results, report_lines, text_to_pdf, with_counters


def write_csv(rows: DataFrame, path: str) -> None:
    """The CSV export of violation_rows(), with a header, one folder per analysis."""
    out = csv_rows(rows)
    out.repartition("analysis_id").sortWithinPartitions("analysis_id", "row_no").write.partitionBy("analysis_id").option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_json(analyses: DataFrame, rows: DataFrame, path: str) -> None:
    """One JSON document per line and analysis."""
    json_reports(analyses, rows).select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_text(analyses: DataFrame, rows: DataFrame, path: str) -> None:
    """The text reports, one folder per analysis, lines in order."""
    out = report_lines(analyses, rows)
    out.repartition("analysis_id").sortWithinPartitions("analysis_id", "line_no").select("analysis_id", "line").write.partitionBy("analysis_id").mode("overwrite").text(path)


def pdf_report(analyses: DataFrame, rows: DataFrame, analysis_id: str) -> bytes:
    """The PDF of one analysis; only its own lines come to the driver."""
    own = F.col("analysis_id") == analysis_id
    lines = report_lines(analyses.filter(F.col("id") == analysis_id), rows.filter(own)).orderBy("line_no").select("line")
    return text_to_pdf([r.line for r in lines.toLocalIterator()])


def store_functions(analyses: DataFrame, functions: DataFrame, claims: DataFrame, path: str) -> DataFrame:
    """Stores extracted functions and their claims below `path`, and returns the analyses with total_functions and
    total_claims counted from what was stored for them (others unchanged). The tables are read back before they are
    counted, so that the counters agree with the store."""
    append(functions, f"{path}/function_records")
    append(claims, f"{path}/claims")
    spark = analyses.sparkSession
    f, c = (spark.read.parquet(f"{path}/{t}") for t in ("function_records", "claims"))
    own = f.dropDuplicates(["id"]).select(F.col("id").alias("function_id"), "analysis_id")
    nf = own.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_f"))
    nc = c.dropDuplicates(["id"]).join(own, "function_id").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_c"))
    joined = analyses.join(nf, analyses["id"] == nf["analysis_id"], "left").drop("analysis_id").join(nc, analyses["id"] == nc["analysis_id"], "left").drop("analysis_id")
    return joined.withColumns({"total_functions": F.coalesce(F.col("_f").cast("int"), F.col("total_functions")), "total_claims": F.when(F.col("_f").isNotNull(), F.coalesce("_c", F.lit(0)).cast("int")).otherwise(F.col("total_claims"))}).drop("_f", "_c")


def store_results(analyses: DataFrame, functions: DataFrame, claims: DataFrame, results: DataFrame, path: str) -> DataFrame:
    """Stores test results below `path` as violations, keyed to the claims by (function name, claim text), and returns the
    analyses with total_violations and bcv_rate counted from them. Results without a claim are left out."""
    append(match_results(results, functions, claims)[0], f"{path}/violations")
    stored = analyses.sparkSession.read.parquet(f"{path}/violations").dropDuplicates(["claim_id"])
    return with_counters(analyses, functions, claims, stored)


def upsert(current: DataFrame, changes: DataFrame, key: str, path: str) -> None:
    """The table `current` with the rows of `changes` in place of those of the same key, written to `path` (another folder
    than it was read from; swap them afterwards)."""
    kept = current.join(changes.select(key), key, "left_anti")
    kept.unionByName(changes).write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table (functions, claims, violations, evaluation history)."""
    df.write.mode("append").parquet(path)
