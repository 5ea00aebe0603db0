"""Listing, joins, statistics, health, client-side summaries, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import columns as C
from plumbline.operators import extract
from plumbline.operators import reports as R
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, case_map, model

_SUMMARY = "id, filename, llm_provider, status, total_functions, total_claims, total_violations, bcv_rate, language, created_at, completed_at"
_SUMMARY_COLS = [x.strip() for x in _SUMMARY.split(",")]
_LABEL, _SEVERITY = case_map("category", schema.CATEGORY_LABELS, "category"), case_map("category", schema.CATEGORY_SEVERITY, "'low'")
_ROWS = f"""{WITH}, r AS (SELECT f.analysis_id, f.id AS function_id, c.id AS claim_id, v.id AS violation_id, f.name AS function_name, coalesce(f.signature, '') AS function_signature, category,
{_LABEL} AS category_label, {_SEVERITY} AS severity, c.raw_text AS claim_text, coalesce(subject, '') AS claim_subject, coalesce(predicate_object, '') AS claim_predicate, coalesce(conditionality, '') AS claim_condition,
c.source_line, outcome, coalesce(expected, '') AS expected, coalesce(actual, '') AS actual, coalesce(test_code, '') AS test_code, coalesce(traceback, '') AS traceback, execution_time_ms
FROM v JOIN c ON c.id = v.claim_id JOIN f ON f.id = c.function_id)"""


def _rows(spark, folder, legacy=False):
    m = model(spark, folder)
    return R.violation_rows(m.functions, m.claims, m.violations, legacy)


# -- listing ---------------------------------------------------------------------------------------------------------


@query("list_analyses", f"{WITH} SELECT {_SUMMARY} FROM a ORDER BY created_at DESC, id")
def _(spark, folder):
    return model(spark, folder).analyses.select(*_SUMMARY_COLS).orderBy(F.desc("created_at"), "id")


@query("get_analysis", f"{WITH} SELECT {_SUMMARY} FROM a WHERE id = (SELECT min(id) FROM a)")
def _(spark, folder):
    a = model(spark, folder).analyses
    return a.join(F.broadcast(a.agg(F.min("id").alias("id"))), "id", "left_semi").select(*_SUMMARY_COLS)


@query("recent_analyses_top10", f"{WITH} SELECT id, filename, status, created_at FROM a ORDER BY created_at DESC, id LIMIT 10")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", "filename", "status", "created_at").orderBy(F.desc("created_at"), "id").limit(10)


@query(
    "batch_rollup",
    f"""{WITH} SELECT *, total - complete - failed AS in_progress, round(100 * (complete / total), 4) AS complete_percent, round(100 * (failed / total), 4) AS failed_percent FROM (
    SELECT json_extract_string(config, '$.batch_id') AS batch_id, count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed FROM a GROUP BY 1) WHERE batch_id IS NOT NULL""",
)
def _(spark, folder):
    return R.batch_rollup(model(spark, folder).analyses)


@query("status_filter", f"{WITH} SELECT id, status, total_claims FROM a WHERE status = 'complete'")
def _(spark, folder):
    return model(spark, folder).analyses.filter("status = 'complete'").select("id", "status", "total_claims")


@query("json_batch_predicate", f"{WITH} SELECT id, created_at FROM a WHERE json_extract_string(config, '$.batch_id') = 'b0-0' ORDER BY created_at, id")
def _(spark, folder):
    return model(spark, folder).analyses.filter(F.get_json_object("config", "$.batch_id") == "b0-0").select("id", "created_at").orderBy("created_at", "id")


# -- joins -----------------------------------------------------------------------------------------------------------


@query("violation_report", f"{_ROWS} SELECT * FROM r")
def _(spark, folder):
    return _rows(spark, folder)


@query("export_severity_legacy", f"{_ROWS} SELECT violation_id, category AS category_label, 'low' AS severity FROM r")
def _(spark, folder):
    return _rows(spark, folder, legacy=True).select("violation_id", "category_label", "severity")


@query(
    "claims_by_function",
    f"""{WITH} SELECT f.id AS function_id, f.analysis_id, f.name, f.signature, count(c.id) AS n_claims, coalesce(string_agg(c.id, ',' ORDER BY c.source_line, c.id), '') AS claim_ids
    FROM f LEFT JOIN c ON c.function_id = f.id GROUP BY ALL""",
)
def _(spark, folder):
    m = model(spark, folder)
    rows = R.claims_by_function(m.functions, m.claims)
    return rows.select("function_id", "analysis_id", "name", "signature", F.size("claims").cast("bigint").alias("n_claims"), F.array_join(F.transform("claims", lambda c: c["claim_id"]), ",").alias("claim_ids"))


@query("function_claim_violation_left", f"{WITH} SELECT f.id AS function_id, c.id AS claim_id, c.category, v.id AS violation_id, v.outcome FROM f LEFT JOIN c ON c.function_id = f.id LEFT JOIN v ON v.claim_id = c.id")
def _(spark, folder):
    m = model(spark, folder)
    return R.function_claim_violation(m.functions, m.claims, m.violations).select("function_id", "claim_id", "category", "violation_id", "outcome")


_LOOKUP = f"""{WITH}, known AS (SELECT f.name AS function_name, raw_text, max(c.id) AS claim_id FROM c JOIN f ON f.id = c.function_id GROUP BY ALL),
res AS (SELECT v.id AS violation_id, outcome, CASE WHEN outcome = 'error' THEN upper(raw_text) ELSE raw_text END AS raw_text, f.name AS function_name FROM v JOIN c ON c.id = v.claim_id JOIN f ON f.id = c.function_id)"""


def _lookup(spark, folder):
    m = model(spark, folder)
    rows = R.violation_rows(m.functions, m.claims, m.violations)
    results = rows.select("violation_id", "outcome", F.when(F.col("outcome") == "error", F.upper("claim_text")).otherwise(F.col("claim_text")).alias("raw_text"), "function_name")
    return R.match_results(results, m.functions, m.claims)


@query("rv_lookup_matched", f"{_LOOKUP} SELECT violation_id, outcome, claim_id FROM res JOIN known USING (function_name, raw_text)")
def _(spark, folder):
    return _lookup(spark, folder)[0].select("violation_id", "outcome", "claim_id")


@query("rv_lookup_orphans", f"{_LOOKUP} SELECT violation_id, function_name, raw_text FROM res ANTI JOIN known USING (function_name, raw_text)")
def _(spark, folder):
    return _lookup(spark, folder)[1].select("violation_id", "function_name", "raw_text")


_DELETED = "d AS (SELECT id FROM a WHERE status = 'failed')"
_LEFT = f"{WITH}, {_DELETED}, lf AS (SELECT * FROM f WHERE analysis_id NOT IN (SELECT id FROM d)), lc AS (SELECT * FROM c WHERE function_id NOT IN (SELECT id FROM f WHERE analysis_id IN (SELECT id FROM d)))"


@query(
    "cascade_survivors",
    f"""{_LEFT} SELECT 'function' AS kind, id FROM lf UNION ALL SELECT 'claim', id FROM lc UNION ALL SELECT 'violation', id FROM v WHERE claim_id NOT IN (SELECT id FROM c WHERE id NOT IN (SELECT id FROM lc))""",
)
def _(spark, folder):
    m = model(spark, folder)
    left = R.cascade_survivors(m.analyses.filter("status = 'failed'").select("id"), m.functions, m.claims, m.violations)
    f, c, v = [x.select(F.lit(k).alias("kind"), "id") for k, x in zip(("function", "claim", "violation"), left)]
    return f.union(c).union(v)


@query(
    "rerun_reset",
    f"""{WITH} SELECT id, CASE WHEN r THEN 'pending' ELSE status END AS status, CASE WHEN r THEN 0 ELSE total_claims END AS total_claims, CASE WHEN r THEN 0 ELSE bcv_rate END AS bcv_rate,
    CASE WHEN r THEN NULL ELSE completed_at END AS completed_at, CASE WHEN r THEN 'bedrock' ELSE llm_provider END AS llm_provider FROM (SELECT *, status = 'failed' AS r FROM a)""",
)
def _(spark, folder):
    a = model(spark, folder).analyses
    return R.rerun_reset(a, a.filter("status = 'failed'"), "bedrock").select("id", "status", "total_claims", "bcv_rate", "completed_at", "llm_provider")


# -- statistics ------------------------------------------------------------------------------------------------------


@query(
    "stats_totals",
    f"""{WITH} SELECT count(id) AS total_analyses, count(*) FILTER (status = 'complete') AS completed_analyses, count(*) FILTER (status = 'failed') AS failed_analyses, coalesce(sum(total_functions), 0)::BIGINT AS total_functions,
    coalesce(sum(total_claims), 0)::BIGINT AS total_claims, coalesce(sum(total_violations), 0)::BIGINT AS total_violations, round(coalesce(avg(bcv_rate) FILTER (status = 'complete'), 0), 6) AS avg_bcv_rate FROM a""",
)
def _(spark, folder):
    return R.totals(model(spark, folder).analyses)


@query("stats_filtered_avg", f"{WITH} SELECT language, round(coalesce(avg(bcv_rate) FILTER (status = 'complete'), 0), 6) AS avg_bcv_rate FROM a GROUP BY 1")
def _(spark, folder):
    return model(spark, folder).analyses.groupBy("language").agg(F.round(F.coalesce(F.avg(F.when(F.col("status") == "complete", F.col("bcv_rate"))), F.lit(0.0)), 6).alias("avg_bcv_rate"))


@query("category_breakdown", f"{_ROWS} SELECT analysis_id, category, count(*) AS n FROM r GROUP BY ALL")
def _(spark, folder):
    return _rows(spark, folder).groupBy("analysis_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("category_counts", f"{WITH} SELECT category, count(v.id) AS n FROM c JOIN v ON v.claim_id = c.id GROUP BY 1")
def _(spark, folder):
    m = model(spark, folder)
    v = m.violations.select("claim_id")
    return m.claims.select(F.col("id").alias("claim_id"), "category").join(v, "claim_id").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("language_distribution", f"{WITH} SELECT language, count(*) AS n FROM a GROUP BY 1")
def _(spark, folder):
    return model(spark, folder).analyses.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "provider_stats",
    f"""{WITH} SELECT *, round(CASE WHEN claims > 0 THEN violations / claims ELSE 0 END, 6) AS violation_ratio FROM (SELECT llm_provider, count(*) AS analyses, sum(total_claims)::BIGINT AS claims,
    sum(total_violations)::BIGINT AS violations, round(avg(bcv_rate), 6) AS avg_bcv_rate FROM a GROUP BY 1)""",
)
def _(spark, folder):
    return R.by_provider(model(spark, folder).analyses)


@query("category_percent_of_total", f"{_ROWS} SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM r GROUP BY 1")
def _(spark, folder):
    return R.percent_of_total(_rows(spark, folder), "category")


@query("severity_breakdown", f"{_ROWS} SELECT analysis_id, severity, count(*) AS n FROM r GROUP BY ALL")
def _(spark, folder):
    return _rows(spark, folder).groupBy("analysis_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("affected_functions", f"{_ROWS} SELECT analysis_id, count(DISTINCT function_name) AS n FROM r GROUP BY 1")
def _(spark, folder):
    return _rows(spark, folder).groupBy("analysis_id").agg(F.count_distinct("function_name").alias("n"))


@query(
    "detection_quality",
    f"""{_ROWS}, q AS (SELECT severity = 'high' AS p, outcome = 'fail' AS t FROM r), n AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM q)
    SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(fp / (fp + tn), 6) AS fpr FROM n""",
)
def _(spark, folder):
    return R.detection_quality(_rows(spark, folder).select((F.col("severity") == "high").alias("predicted"), (F.col("outcome") == "fail").alias("actual")))


# -- health ----------------------------------------------------------------------------------------------------------

_COUNTED = """greatest(len(list_filter(string_split(source_code, chr(10)), lambda x: starts_with(trim(x), 'def ') OR starts_with(trim(x), 'async def ')
OR (language IN ('javascript', 'typescript') AND (contains(trim(x), 'function ') OR contains(trim(x), '=>'))))), 1)"""


# Python: lines that begin a def, after all strings of three quotes are taken out
_TREE = f"""CASE WHEN language = 'python' THEN len(regexp_extract_all(regexp_replace(source_code, '\"\"\"[\\s\\S]*?\"\"\"', '', 'g'), '(?m)^[ \\t]*(?:async[ \\t]+)?def[ \\t]+\\w+[ \\t]*\\(')) ELSE {_COUNTED} END"""


@query("function_counts", f"{WITH} SELECT id, {_TREE} AS n FROM a")
def _(spark, folder):
    return extract.all_function_counts(model(spark, folder).analyses, "id", "source_code", "language")


@query("function_count_heuristic", f"{WITH} SELECT id, {_COUNTED} AS n FROM a")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", R.counted_functions(F.col("source_code"), F.col("language")).alias("n"))


@query(
    "doc_health_overall",
    f"""{WITH}, s AS (SELECT f.analysis_id, count(DISTINCT f.id) AS documented, count(DISTINCT c.id) AS claims, count(DISTINCT c.id) FILTER (v.outcome = 'fail') AS violations FROM f LEFT JOIN c ON c.function_id = f.id LEFT JOIN v ON v.claim_id = c.id GROUP BY 1),
    t AS (SELECT a.id AS analysis_id, coalesce(documented, 0) AS documented, greatest({_TREE}, coalesce(documented, 0)) AS functions, coalesce(claims, 0) AS claims, coalesce(violations, 0) AS violations FROM a LEFT JOIN s ON s.analysis_id = a.id),
    q AS (SELECT *, CASE WHEN functions > 0 THEN documented / functions ELSE 0 END AS cov, CASE WHEN documented > 0 THEN claims / documented ELSE 0 END AS den, CASE WHEN claims > 0 THEN violations / claims ELSE 0 END AS vr FROM t)
    SELECT analysis_id, documented, functions, claims, violations, round(cov, 6) AS coverage, round(den, 6) AS density, round(vr, 6) AS violation_rate,
    CASE WHEN functions = 0 THEN 0 ELSE floor(round(0.4::DOUBLE * cov * 100 + 0.3::DOUBLE * least(den / 3, 1) * 100 + 0.3::DOUBLE * (1 - vr) * 100, 9))::BIGINT END AS health FROM q""",
)
def _(spark, folder):
    m = model(spark, folder)
    return R.analysis_health(m.analyses, m.functions, m.claims, m.violations, extract.all_function_counts(m.analyses, "id", "source_code", "language"))


@query(
    "doc_health_functions",
    f"""{WITH} SELECT *, CASE WHEN claim_count = 0 THEN 50 ELSE floor(100 * (1 - violation_count / claim_count))::BIGINT END AS health_score FROM (SELECT f.id AS function_id, f.analysis_id, f.name, f.signature, coalesce(length(any_value(f.docstring)), 0)::BIGINT AS docstring_length,
    count(c.id) AS claim_count, count(*) FILTER (v.outcome = 'fail') AS violation_count, coalesce(string_agg(DISTINCT c.category, ',' ORDER BY c.category), '') AS categories FROM f LEFT JOIN c ON c.function_id = f.id LEFT JOIN v ON v.claim_id = c.id GROUP BY f.id, f.analysis_id, f.name, f.signature)""",
)
def _(spark, folder):
    m = model(spark, folder)
    return R.function_health(m.functions, m.claims, m.violations).orderBy("health_score", "function_id")


# -- client ----------------------------------------------------------------------------------------------------------


@query(
    "per_function_results",
    f"""{WITH}, s AS (SELECT f.id AS function_id, f.analysis_id, f.name, count(c.id) AS nc, count(*) FILTER (v.outcome = 'fail') AS nv FROM f LEFT JOIN c ON c.function_id = f.id LEFT JOIN v ON v.claim_id = c.id GROUP BY ALL)
    SELECT function_id, analysis_id, name, nc - least(nv, nc) AS pass_count, least(nv, nc) AS fail_count, CASE WHEN nv > 0 THEN 'has-failures' WHEN nc > 0 THEN 'all-pass' ELSE 'no-claims' END AS status FROM s""",
)
def _(spark, folder):
    m = model(spark, folder)
    failures = R.violation_rows(m.functions, m.claims, m.violations.filter("outcome = 'fail'")).select("function_id")
    return R.per_function_results(m.functions, m.claims, failures).orderBy(F.desc("fail_count"), "function_id")


@query("category_filter", f"{_ROWS} SELECT function_id, count(*) AS n FROM r WHERE category = 'ECV' GROUP BY 1")
def _(spark, folder):
    grouped = _rows(spark, folder).groupBy("function_id").agg(F.collect_list(F.struct("category", "violation_id")).alias("violations"))
    return R.with_category(grouped, "ECV").select("function_id", F.size("violations").cast("bigint").alias("n"))


@query("text_search", f"{WITH} SELECT f.id AS function_id FROM f WHERE contains(lower(f.name), 'matrix') OR f.id IN (SELECT function_id FROM c WHERE contains(lower(raw_text), 'matrix') OR contains(lower(subject), 'matrix'))")
def _(spark, folder):
    m = model(spark, folder)
    return R.text_search(R.claims_by_function(m.functions, m.claims), "Matrix").select("function_id")


_STAGE = "CASE WHEN status = 'failed' THEN 'failed' WHEN o >= {d} THEN 'complete' WHEN o >= {r} THEN 'active' ELSE 'pending' END"
_ORDER = "list_position(['pending','bce_running','bce_complete','dts_running','dts_complete','rv_running','complete'], status)"


@query(
    "stage_states",
    f"{WITH}, o AS (SELECT id AS analysis_id, status, {_ORDER} AS o FROM a) "
    + " UNION ALL ".join(f"SELECT analysis_id, status, '{k}' AS stage, {_STAGE.format(r=r, d=d)} AS state FROM o" for k, r, d in (("BCE", 2, 3), ("DTS", 4, 5), ("RV", 6, 7))),
)
def _(spark, folder):
    return R.stages(model(spark, folder).analyses)


@query(
    "progress_and_elapsed",
    f"""{WITH}, e AS (SELECT id, status, floor(epoch(completed_at)) - floor(epoch(created_at)) AS s FROM a)
    SELECT id, {case_map('status', {k: str(v[0]) for k, v in C.PROGRESS.items()}, "'0'")}::BIGINT AS floor_percent, {case_map('status', {k: str(v[1]) for k, v in C.PROGRESS.items()}, "'0'")}::BIGINT AS ceiling_percent,
    status IN ('complete', 'failed') AS terminal, ends_with(status, '_running') AS running, CASE WHEN s < 60 THEN s::BIGINT::VARCHAR || 's' ELSE floor(s / 60)::BIGINT::VARCHAR || 'm ' || (s::BIGINT % 60)::VARCHAR || 's' END AS elapsed FROM e""",
)
def _(spark, folder):
    a = model(spark, folder).analyses
    return a.select("id", C.progress(F.col("status"), 0).alias("floor_percent"), C.progress(F.col("status"), 1).alias("ceiling_percent"), F.col("status").isin(*schema.TERMINAL).alias("terminal"), F.endswith("status", F.lit("_running")).alias("running"), C.elapsed(F.col("created_at"), F.col("completed_at")).alias("elapsed"))


@query("line_violation_map", f"{_ROWS} SELECT analysis_id, source_line AS line, count(*) AS n, string_agg(claim_id, ',' ORDER BY claim_id) AS claims FROM r WHERE outcome = 'fail' AND source_line > 0 GROUP BY ALL")
def _(spark, folder):
    return R.line_violations(_rows(spark, folder))


@query(
    "signature_parts",
    f"""{WITH} SELECT id, regexp_extract(signature, '^([^(]+)(\\([^)]*\\))(.*)$', 1) AS name_part, regexp_extract(signature, '^([^(]+)(\\([^)]*\\))(.*)$', 2) AS params_part,
    regexp_extract(regexp_extract(signature, '^([^(]+)(\\([^)]*\\))(.*)$', 3), '^\\s*->\\s*(.+)$', 1) AS return_part FROM f""",
)
def _(spark, folder):
    parts = zip(R.signature_parts(F.col("signature")), ("name_part", "params_part", "return_part"))
    return model(spark, folder).functions.select("id", *[c.alias(n) for c, n in parts])


@query("batch_percentages", f"{WITH} SELECT json_extract_string(config, '$.batch_id') AS batch_id, round(100 * count(*) FILTER (status = 'complete') / count(*), 4) AS complete_percent FROM a GROUP BY 1 HAVING batch_id IS NOT NULL")
def _(spark, folder):
    return R.batch_rollup(model(spark, folder).analyses).select("batch_id", "complete_percent")


# -- exports ---------------------------------------------------------------------------------------------------------


@query(
    "export_csv_rows",
    f"""{_ROWS} SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY function_name, claim_id, violation_id) AS row_no, function_name, function_signature, category, category_label, severity, claim_text, claim_subject,
    claim_predicate, claim_condition, outcome, expected, actual, CASE WHEN test_code <> '' THEN 'yes' ELSE 'no' END AS has_test_code, CASE WHEN traceback <> '' THEN 'yes' ELSE 'no' END AS has_traceback FROM r""",
)
def _(spark, folder):
    return R.csv_rows(_rows(spark, folder))


@query(
    "export_json_report",
    f"""{_ROWS}, g AS (SELECT analysis_id, count(*) AS n, count(DISTINCT function_name) AS nf, count(*) FILTER (category = 'RSV') AS rsv FROM r GROUP BY 1)
    SELECT a.id AS analysis_id, coalesce(g.n, 0) AS n_violations, coalesce(g.nf, 0) AS n_functions, coalesce(g.rsv, 0) AS n_rsv, round(coalesce(bcv_rate, 0), 4) AS bcv_rate, a.status FROM a LEFT JOIN g ON g.analysis_id = a.id""",
)
def _(spark, folder):
    m = model(spark, folder)
    made = R.json_reports(m.analyses, _rows(spark, folder))
    at = lambda p: F.get_json_object("report", p)
    return made.select(
        "analysis_id", F.coalesce(F.json_array_length(at("$.violations")), F.lit(0)).cast("bigint").alias("n_violations"), at("$.summary.functions_with_violations").cast("bigint").alias("n_functions"),
        F.coalesce(at("$.breakdown.by_category.RSV").cast("bigint"), F.lit(0)).cast("bigint").alias("n_rsv"), at("$.summary.bcv_rate").cast("double").alias("bcv_rate"), at("$.analysis.status").alias("status"),
    )


@query("export_report_lines")
def _(spark, folder):
    return R.report_lines(model(spark, folder).analyses, _rows(spark, folder))


@query(
    "counters_recomputed",
    f"""{WITH}, s AS (SELECT f.analysis_id, count(DISTINCT f.id) AS nf, count(DISTINCT c.id) AS nc, count(DISTINCT c.id) FILTER (v.outcome = 'fail') AS nv, count(DISTINCT c.id) FILTER (v.outcome IN ('pass', 'fail')) AS nr FROM f LEFT JOIN c ON c.function_id = f.id LEFT JOIN v ON v.claim_id = c.id GROUP BY 1)
    SELECT a.id, coalesce(nf, 0)::INT AS total_functions, coalesce(nc, 0)::INT AS total_claims, coalesce(nv, 0)::INT AS total_violations, round(CASE WHEN nr > 0 THEN nv / nr ELSE 0 END, 6) AS bcv_rate FROM a LEFT JOIN s ON s.analysis_id = a.id""",
)
def _(spark, folder):
    m = model(spark, folder)
    return R.with_counters(m.analyses, m.functions, m.claims, m.violations).select("id", "total_functions", "total_claims", "total_violations", "bcv_rate")


@query("claim_validity", f"{WITH} SELECT id FROM c WHERE regexp_matches(subject, '\\S') AND regexp_matches(predicate_object, '\\S') AND regexp_matches(raw_text, '\\S') AND source_line > 0 AND category IN ('RSV','PCV','SEV','ECV','COV','CCV')")
def _(spark, folder):
    return R.valid_claims(model(spark, folder).claims).select("id")


@query("positive_categories", f"{_ROWS} SELECT analysis_id, category, count(*) AS n FROM r GROUP BY ALL")
def _(spark, folder):
    return R.category_counts(_rows(spark, folder), "analysis_id").select("analysis_id", F.explode("present").alias("category", "n"))


@query("gated_read", f"{WITH} SELECT {_SUMMARY} FROM a WHERE id = (SELECT min(id) FROM a WHERE status = 'complete')")
def _(spark, folder):
    a = model(spark, folder).analyses
    first = a.filter("status = 'complete'").agg(F.min("id").alias("id")).head().id
    return R.completed(a, first).select(*_SUMMARY_COLS) if first else a.limit(0).select(*_SUMMARY_COLS)
