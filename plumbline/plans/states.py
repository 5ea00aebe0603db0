"""The rate limiter and the status machine over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, model
from plumbline.sources.tables import table
from plumbline.streaming import limits, status

_STATUS = "['pending','bce_running','bce_complete','dts_running','dts_complete','rv_running','complete','failed']"
_LOG = f"l AS (SELECT user_id, event_id, ts, ({_STATUS})[(CASE WHEN event_id % 7 = 0 THEN event_id % 8 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 7 END + 1)::INT] AS status FROM events)"


def _log(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", "ts")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    place = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 8).otherwise(n % 7)
    return e.select("user_id", "event_id", "ts", F.element_at(F.array(*[F.lit(s) for s in schema.STATUSES]), (place + 1).cast("int")).alias("status"))


_LEGAL = "(f.from_status, f.to_status) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in schema.TRANSITIONS) + ")"


@query("status_transition_check", f"WITH {_LOG}, f AS (SELECT user_id, event_id, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, status AS to_status FROM l) SELECT user_id, event_id, from_status, to_status, CASE WHEN from_status IS NULL THEN to_status = 'pending' ELSE {_LEGAL} END AS legal FROM f")
def _(spark, folder):
    return status.checked_steps(_log(spark, folder), "user_id", "status", "ts", "event_id")


@query("latest_status", f"WITH {_LOG}, x AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, status, ts AS since, CASE WHEN status IN ('complete', 'failed') THEN ts END AS completed_at FROM x")
def _(spark, folder):
    return status.latest(_log(spark, folder), "user_id", "status", "ts", "event_id")


@query(
    "rate_limiter",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, ts, n, [us] AS held, true AS accepted FROM o WHERE n = 1 UNION ALL
    SELECT o.user_id, o.event_id, o.ts, o.n, CASE WHEN len(list_filter(r.held, lambda u: u > o.us - 21600000000)) < 2 THEN list_append(list_filter(r.held, lambda u: u > o.us - 21600000000), o.us) ELSE list_filter(r.held, lambda u: u > o.us - 21600000000) END,
    len(list_filter(r.held, lambda u: u > o.us - 21600000000)) < 2 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, event_id, ts, accepted FROM r""",
)
def _(spark, folder):
    return limits.rate_limited(table(spark, folder, "events"), "user_id", "ts", "event_id", 21_600, 2)


@query("running_and_terminal", f"{WITH} SELECT status IN ('complete', 'failed') AS terminal, count(*) AS n FROM a GROUP BY 1")
def _(spark, folder):
    return model(spark, folder).analyses.groupBy(F.col("status").isin("complete", "failed").alias("terminal")).agg(F.count(F.lit(1)).alias("n"))
