"""The tables of the model as the queries use them, and the same as SQL."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.reports import once
from plumbline.sources.tables import table

#: Rows delivered twice count once.
WITH = """WITH a AS (SELECT DISTINCT ON (id) * FROM analyses), f AS (SELECT DISTINCT ON (id) * FROM function_records),
c AS (SELECT DISTINCT ON (id) * FROM claims), v AS (SELECT DISTINCT ON (id) * FROM violations),
k AS (SELECT DISTINCT ON (chunk_id) * FROM code_chunks)"""


class Model(NamedTuple):
    analyses: DataFrame
    functions: DataFrame
    claims: DataFrame
    violations: DataFrame


def model(spark: SparkSession, folder: str) -> Model:
    return Model(*[once(table(spark, folder, t)) for t in ("analyses", "function_records", "claims", "violations")])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "code_chunks"), "chunk_id")


def case_map(column: str, table_: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {default} END"
