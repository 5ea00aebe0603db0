"""Verification: outcomes, expected and actual values, rates, runners' logs, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import reports as R
from plumbline.operators import verify as V
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, model

_RAW = "CASE outcome WHEN 'pass' THEN 'passed' WHEN 'fail' THEN 'failed' ELSE outcome END"


@query("outcome_classification", f"{WITH}, x AS (SELECT id, {_RAW} AS raw FROM v) SELECT id, CASE raw WHEN 'passed' THEN 'pass' WHEN 'failed' THEN 'fail' WHEN 'error' THEN 'error' ELSE 'undetermined' END AS outcome FROM x")
def _(spark, folder):
    v = model(spark, folder).violations
    raw = F.when(F.col("outcome") == "pass", "passed").when(F.col("outcome") == "fail", "failed").otherwise(F.col("outcome"))
    return v.select("id", V.outcome(raw).alias("outcome"))


@query("expected_actual", f"{WITH} SELECT id, nullif(trim(regexp_extract(traceback, '(?m)assert (.+?) == (.+?)$', 2)), '') AS expected, nullif(trim(regexp_extract(traceback, '(?m)assert (.+?) == (.+?)$', 1)), '') AS actual FROM v")
def _(spark, folder):
    expected, actual = V.expected_actual(F.col("traceback"))
    return model(spark, folder).violations.select("id", expected.alias("expected"), actual.alias("actual"))


_JOIN = f"{WITH}, x AS (SELECT v.*, c.function_id, f.analysis_id FROM v JOIN c ON c.id = v.claim_id JOIN f ON f.id = c.function_id)"
_RATE = "count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'undetermined') AS undetermined, round(CASE WHEN count(*) FILTER (outcome IN ('pass', 'fail')) > 0 THEN count(*) FILTER (outcome = 'fail') / count(*) FILTER (outcome IN ('pass', 'fail')) ELSE 0 END, 6) AS bcv_rate"


def _rows(spark, folder):
    m = model(spark, folder)
    return R.violation_rows(m.functions, m.claims, m.violations)


@query("function_bcv_rate", f"{_JOIN} SELECT function_id, {_RATE} FROM x GROUP BY 1")
def _(spark, folder):
    return R.outcome_rates(_rows(spark, folder), "function_id")


@query("analysis_bcv_rate", f"{_JOIN} SELECT analysis_id, {_RATE} FROM x GROUP BY 1")
def _(spark, folder):
    return R.outcome_rates(_rows(spark, folder), "analysis_id")


@query("violations_fail_only", f"{_JOIN} SELECT id AS violation_id, function_id FROM x WHERE outcome = 'fail'")
def _(spark, folder):
    return _rows(spark, folder).filter("outcome = 'fail'").select("violation_id", "function_id")


@query(
    "empty_suite_report",
    f"""{WITH} SELECT f.id AS function_id, count(v.id) AS results, coalesce(round(CASE WHEN count(*) FILTER (outcome IN ('pass', 'fail')) > 0 THEN count(*) FILTER (outcome = 'fail') / count(*) FILTER (outcome IN ('pass', 'fail')) ELSE 0 END, 6), 0) AS bcv_rate
    FROM f LEFT JOIN c ON c.function_id = f.id LEFT JOIN v ON v.claim_id = c.id GROUP BY 1""",
)
def _(spark, folder):
    m = model(spark, folder)
    rows = R.function_claim_violation(m.functions, m.claims, m.violations).withColumn("outcome", F.coalesce("outcome", F.lit("")))
    counts = rows.groupBy("function_id").agg(F.count("violation_id").alias("results"))
    return counts.join(R.outcome_rates(rows, "function_id").select("function_id", "bcv_rate"), "function_id")


@query(
    "test_result_left_join",
    f"""{WITH}, t AS (SELECT c.id AS claim_id, 'test_' || substring(c.id, 1, 3) AS test_name FROM c), r AS (SELECT 'suite.py::test_' || substring(claim_id, 1, 3) AS nodeid, {_RAW} AS o, traceback, execution_time_ms / 1000 AS duration, id FROM v),
    one AS (SELECT string_split(nodeid, '::')[-1] AS test_name, o, traceback, duration FROM r QUALIFY row_number() OVER (PARTITION BY string_split(nodeid, '::')[-1] ORDER BY id DESC) = 1)
    SELECT claim_id, t.test_name, CASE o WHEN 'passed' THEN 'pass' WHEN 'failed' THEN 'fail' WHEN 'error' THEN 'error' ELSE 'undetermined' END AS outcome, nullif(trim(regexp_extract(traceback, '(?m)assert (.+?) == (.+?)$', 2)), '') AS expected, round(coalesce(duration, 0) * 1000, 6) AS execution_time_ms
    FROM t LEFT JOIN one USING (test_name)""",
)
def _(spark, folder):
    m = model(spark, folder)
    tests = m.claims.select(F.col("id").alias("claim_id"), F.concat(F.lit("test_"), F.substring("id", 1, 3)).alias("test_name"))
    raw = F.when(F.col("outcome") == "pass", "passed").when(F.col("outcome") == "fail", "failed").otherwise(F.col("outcome"))
    results = m.violations.select(F.concat(F.lit("suite.py::test_"), F.substring("claim_id", 1, 3)).alias("nodeid"), raw.alias("outcome"), "traceback", (F.col("execution_time_ms") / 1000).alias("duration"), "id")
    rows = V.joined_results(tests, results, [F.col("id")])
    return rows.select("claim_id", "test_name", "outcome", "expected", F.round("execution_time_ms", 6).alias("execution_time_ms"))


# Logs built from the outcomes of each function, the same way in both engines where SQL can read them.
def _outcomes(spark, folder):
    return _rows(spark, folder).select("function_id", "violation_id", "outcome", "execution_time_ms", "traceback")


@query("go_event_fold", f"{_JOIN} SELECT function_id, 'T' || id AS nodeid, CASE outcome WHEN 'pass' THEN 'passed' WHEN 'fail' THEN 'failed' ELSE 'error' END AS outcome, 'line ' || id || ';end' AS stdout, round(execution_time_ms / 1000, 6) AS duration FROM x")
def _(spark, folder):
    action = F.when(F.col("outcome") == "pass", "pass").when(F.col("outcome") == "fail", "fail").otherwise("skip")
    name = F.concat(F.lit("T"), "violation_id")
    event = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()]))
    lines = F.concat_ws("\n", event(Action=F.lit("run"), Test=name), F.lit("noise, no JSON"), event(Action=F.lit("output"), Test=name, Output=F.concat(F.lit("line "), "violation_id", F.lit(";"))), F.lit(""), event(Action=F.lit("output"), Test=name, Output=F.lit("end")), event(Action=action, Test=name, Elapsed=F.col("execution_time_ms") / 1000), event(Action=action))
    logs = _outcomes(spark, folder).select("function_id", "violation_id", lines.alias("part")).groupBy("function_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("violation_id", "part"))), lambda x: x["part"]), "\n").alias("log"))
    return V.go_events(logs, "function_id", "log").select("function_id", "nodeid", "outcome", "stdout", F.round("duration", 6).alias("duration"))


@query("nested_result_flatten", f"{_JOIN} SELECT function_id, 'suite > ' || id AS nodeid, CASE outcome WHEN 'pass' THEN 'passed' WHEN 'fail' THEN 'failed' ELSE 'error' END AS outcome, CASE WHEN traceback <> '' THEN traceback END AS traceback, round(execution_time_ms / 1000, 6) AS duration FROM x")
def _(spark, folder):
    status = F.when(F.col("outcome") == "pass", "passed").when(F.col("outcome") == "fail", "failed").otherwise("pending")
    result = F.struct(F.array(F.lit("suite")).alias("ancestorTitles"), F.col("violation_id").alias("title"), status.alias("status"), F.col("execution_time_ms").alias("duration"), F.array("traceback").alias("failureMessages"))
    grouped = _outcomes(spark, folder).groupBy("function_id").agg(F.collect_list(result).alias("assertionResults"))
    logs = grouped.select("function_id", F.concat(F.lit("warming up\n"), F.to_json(F.struct(F.array(F.struct("assertionResults")).alias("testResults")))).alias("log"))
    return V.nested_results(logs, "function_id", "log").withColumn("duration", F.round("duration", 6))


@query("json_results", f"{_JOIN} SELECT function_id, id AS nodeid, outcome, traceback, round(execution_time_ms / 1000, 6) AS duration FROM (SELECT x.* REPLACE (coalesce(traceback, '') AS traceback) FROM x)")
def _(spark, folder):
    result = F.struct(F.col("violation_id").alias("nodeid"), "outcome", "traceback", (F.col("execution_time_ms") / 1000).alias("duration"))
    logs = _outcomes(spark, folder).groupBy("function_id").agg(F.to_json(F.collect_list(result)).alias("log"))
    return V.pytest_results(logs, "function_id", "log").select("function_id", "nodeid", "outcome", "traceback", F.round("duration", 6).alias("duration"))


def _text_logs(spark, folder, line):
    rows = _outcomes(spark, folder)
    return rows.select("function_id", "violation_id", line.alias("part")).groupBy("function_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("violation_id", "part"))), lambda x: x["part"]), "\n").alias("log"))


@query("junit_log", f"{_JOIN} SELECT function_id, 'test' || replace(id, '-', '') || '()' AS nodeid, CASE WHEN outcome = 'pass' THEN 'passed' ELSE 'failed' END AS outcome, CASE WHEN outcome <> 'pass' THEN '    expected: x' END AS traceback FROM x")
def _(spark, folder):
    name = F.concat(F.lit("test"), F.replace("violation_id", F.lit("-"), F.lit("")), F.lit("()"))
    line = F.concat(F.lit("│     ├─ "), name, F.when(F.col("outcome") == "pass", " ✔").otherwise(" ✘\n    expected: x"))
    return V.text_results(_text_logs(spark, folder, line), "function_id", "log", "java").select("function_id", "nodeid", "outcome", "traceback")


@query("cargo_log", f"{_JOIN} SELECT function_id, 'tests::t_' || replace(id, '-', '') AS nodeid, CASE outcome WHEN 'pass' THEN 'passed' WHEN 'fail' THEN 'failed' ELSE 'error' END AS outcome FROM x")
def _(spark, folder):
    name = F.concat(F.lit("tests::t_"), F.replace("violation_id", F.lit("-"), F.lit("")))
    line = F.concat(F.lit("test "), name, F.lit(" ... "), F.when(F.col("outcome") == "pass", "ok").when(F.col("outcome") == "fail", "FAILED").otherwise("ignored"))
    return V.text_results(_text_logs(spark, folder, line), "function_id", "log", "rust").select("function_id", "nodeid", "outcome")


@query("answer_test_code", f"{_JOIN} SELECT violation_id, 'import copy' || chr(10) || chr(10) || regexp_replace(test_code, '\\s+$', '') AS test_code, regexp_extract(test_code, 'def (test_\\w+)', 1) AS test_name FROM (SELECT id AS violation_id, test_code FROM x) WHERE test_code LIKE 'def test_%'")
def _(spark, folder):
    """The tests of the table wrapped as answers, taken out again."""
    rows = _rows(spark, folder).select("violation_id", "category", F.col("claim_subject").alias("subject"), F.concat(F.lit("Here is the test.\n```python\nimport copy\n"), "test_code", F.lit("\n```\nDone.")).alias("answer"))
    return V.synthesized(rows, ["violation_id"], "answer")


@query("stored_results", f"{_JOIN} SELECT analysis_id, count(*) AS n, count(*) FILTER (outcome = 'fail') AS total_violations FROM x GROUP BY 1")
def _(spark, folder):
    return _rows(spark, folder).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "fail").alias("total_violations"))


@query("test_syntax")
def _(spark, folder):
    rows = _rows(spark, folder).select("violation_id", "test_code", F.lit("pytest").alias("framework"))
    return V.syntax_checks(rows, ["violation_id"], "test_code", "framework")


@query("test_modules", f"{_JOIN} SELECT function_id, 'import copy' || chr(10) || chr(10) || 'import pytest' || chr(10) || chr(10) || chr(10) || string_agg(test_code, chr(10) || chr(10) || chr(10) ORDER BY id) || chr(10) AS module FROM x WHERE test_code <> '' GROUP BY 1")
def _(spark, folder):
    return V.test_modules(_rows(spark, folder), "function_id", "violation_id")
