"""The status machine of an analysis: legal steps, the latest status, and both over a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import schema


def transitions(spark: SparkSession) -> DataFrame:
    """(from_status, to_status): the legal steps; 13 rows."""
    return spark.createDataFrame(list(schema.TRANSITIONS), "from_status string, to_status string")


def checked_steps(log: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """(key, tie, from_status, to_status, legal): each entry of a log against the one before it; the first must be pending.
    Entries of one time are ordered by `tie`, which is unique within a key."""
    w = Window.partitionBy(key).orderBy(time, tie)
    steps = log.select(key, tie, F.lag(status).over(w).alias("from_status"), F.col(status).alias("to_status"))
    legal = F.array(*[F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in schema.TRANSITIONS])
    return steps.withColumn("legal", F.when(F.col("from_status").isNull(), F.col("to_status") == "pending").otherwise(F.array_contains(legal, F.concat_ws(">", "from_status", "to_status"))))


def latest(log: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """(key, status, since, completed_at): the last entry of each key; completed_at is its time if the status is terminal.
    A maximum of fixed size per key: partial sums combine before the shuffle."""
    last = F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(status).alias("s")))
    rows = log.groupBy(key).agg(last.alias("x")).select(key, F.col("x.s").alias("status"), F.col("x.t").alias("since"))
    return rows.withColumn("completed_at", F.when(F.col("status").isin(*schema.TERMINAL), F.col("since")))


def until_terminal(read: Callable[[], str | None], every: float = 2.0, limit: float | None = None, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Polls `read` (which returns a status) every so many seconds until it is terminal; returns the last status read, also
    when `limit` seconds have passed without a terminal one."""
    waited = 0.0
    while (status := read()) not in schema.TERMINAL and (limit is None or waited < limit):
        sleep(every)
        waited += every
    return status


def latest_stream(log: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """latest() over a stream; write it in update mode (a key's new status replaces its old one)."""
    return latest(log, key, status, time, tie)
