"""Scalar functions on text, admission of files, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import columns as C
from plumbline.operators import ingest, prompts
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, case_map, chunks, model
from plumbline.sources.tables import table

_EXT = "lower(regexp_extract(coalesce(filename, ''), '[^/.][^/]*(\\.[^./]*)$', 1))"


@query("sanitize_source", f"""{WITH} SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(source_code, '<script[\\s>].*?</script>', '', 'gis'), '\\bon\\w+\\s*=\\s*["''][^"'']*["'']', '', 'gi'), 'javascript\\s*:', '', 'gi')) AS digest FROM a""")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", F.md5(C.sanitized(F.col("source_code"))).alias("digest"))


@query("sanitize_built_pages", """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(h, '<script[\\s>].*?</script>', '', 'gis'), '\\bon\\w+\\s*=\\s*["''][^"'']*["'']', '', 'gi'), 'javascript\\s*:', '', 'gi') AS clean FROM (SELECT doc_id, '<SCRIPT src=x>' || kind || '</script><a onClick="' || kind || '" href="JavaScript :go()">' || source || '</a><script>' AS h FROM documents)""")
def _(spark, folder):
    h = F.concat(F.lit("<SCRIPT src=x>"), "kind", F.lit('</script><a onClick="'), "kind", F.lit('" href="JavaScript :go()">'), "source", F.lit("</a><script>"))
    return table(spark, folder, "documents").select("doc_id", C.sanitized(h).alias("clean"))


@query("detect_language", f"{WITH} SELECT id, {case_map(_EXT, schema.LANGUAGES, chr(39) + 'python' + chr(39))} AS detected, {case_map(_EXT, schema.LANGUAGES, 'NULL')} AS detected_strict FROM a")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", C.language_of(F.col("filename")).alias("detected"), C.language_of(F.col("filename"), None).alias("detected_strict"))


@query("supported_extension", f"{WITH} SELECT id, {_EXT} IN ({', '.join(repr(x) for x in schema.LANGUAGES)}) AS supported FROM a")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", C.is_supported(F.col("filename")).alias("supported"))


@query("risk_bucket", f"{WITH} SELECT id, CASE WHEN coalesce(bcv_rate, 0) < 0.1 THEN 'LOW' WHEN bcv_rate < 0.3 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM a")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", C.risk(F.col("bcv_rate")).alias("risk"))


@query("health_colour", f"{WITH} SELECT id, CASE WHEN s >= 80 THEN 'green' WHEN s >= 60 THEN 'yellow' WHEN s >= 40 THEN 'orange' ELSE 'red' END AS colour FROM (SELECT id, 100 * (1 - bcv_rate) AS s FROM a)")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", C.health_colour(100 * (1 - F.col("bcv_rate"))).alias("colour"))


@query("truncate_fields", f"{WITH} SELECT v.id, CASE WHEN length(expected) > 80 THEN left(expected, 80) || '...' ELSE expected END AS expected, CASE WHEN length(raw_text) > 50 THEN left(raw_text, 50) || '...' ELSE raw_text END AS claim FROM v JOIN c ON c.id = v.claim_id")
def _(spark, folder):
    m = model(spark, folder)
    c = m.claims.select(F.col("id").alias("claim_id"), "raw_text")
    return m.violations.join(c, "claim_id").select("id", C.cut(F.col("expected"), 80).alias("expected"), C.cut(F.col("raw_text"), 50).alias("claim"))


@query("severity_bar", f"{WITH} SELECT category, count(*) AS n, repeat('#', least(2 * count(*), 30)::INT) AS bar FROM c GROUP BY 1")
def _(spark, folder):
    return model(spark, folder).claims.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("bar", C.bar(F.col("n")))


@query("percent_format", f"{WITH} SELECT id, format('{{:.1f}}%', round(bcv_rate * 100, 1)) AS rate FROM a")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", F.format_string("%.1f%%", F.col("bcv_rate") * 100).alias("rate"))


@query(
    "word_wrap",
    f"""{WITH}, w AS (SELECT id, regexp_split_to_array(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), ' ') AS ws FROM c),
    x AS (SELECT id, list_reduce(list_transform(list_filter(ws, lambda y: y <> ''), lambda y: {{'lines': []::VARCHAR[], 'line': y, 'n': 0}}), lambda acc, y: CASE WHEN acc.n + length(y.line) + 1 <= 60
    THEN {{'lines': acc.lines, 'line': CASE WHEN acc.line = '' THEN y.line ELSE acc.line || ' ' || y.line END, 'n': acc.n + length(y.line) + 1}}
    ELSE {{'lines': CASE WHEN acc.line = '' THEN acc.lines ELSE list_append(acc.lines, acc.line) END, 'line': y.line, 'n': length(y.line)}} END, {{'lines': []::VARCHAR[], 'line': '', 'n': 0}}) AS acc FROM w)
    SELECT id, array_to_string(CASE WHEN acc.line = '' AND len(acc.lines) > 0 THEN acc.lines ELSE list_append(acc.lines, acc.line) END, '|') AS wrapped FROM x""",
)
def _(spark, folder):
    return model(spark, folder).claims.select("id", F.array_join(C.wrapped(F.col("raw_text")), "|").alias("wrapped"))


_LINES = "CASE WHEN ends_with(t, chr(10)) OR t = '' THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END"


@query(
    "line_blocks",
    f"""WITH d AS (SELECT 'doc/' || doc_id AS path, coalesce(text, '') AS t FROM documents), l AS (SELECT path, {_LINES} AS lines FROM d), b AS (SELECT path, lines, unnest(range(0, greatest(len(lines), 1), 20)) AS i FROM l WHERE len(lines) > 0),
    e AS (SELECT path, (i + 1)::BIGINT AS start_line, least(i + 25, len(lines))::BIGINT AS end_line, lines[i + 1 : i + 25] AS x FROM b)
    SELECT path, start_line, end_line, substring(md5(path || ':' || start_line || ':' || end_line), 1, 12) AS chunk_id, array_to_string(x, chr(10)) AS content FROM e""",
)
def _(spark, folder):
    documents = table(spark, folder, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    return ingest.line_blocks(documents, "path", "text")


@query("chunk_ids", f"{WITH} SELECT chunk_id, substring(md5(file_path || ':' || start_line || ':' || coalesce(function_name, end_line::VARCHAR)), 1, 12) AS derived FROM k")
def _(spark, folder):
    key = F.concat_ws(":", "file_path", F.col("start_line").cast("string"), F.coalesce("function_name", F.col("end_line").cast("string")))
    return chunks(spark, folder).select("chunk_id", F.substring(F.md5(key), 1, 12).alias("derived"))


@query(
    "path_tree",
    f"""{WITH}, p AS (SELECT string_split(filename, '/') AS x FROM a WHERE trim(filename) <> ''), s AS (SELECT x, unnest(range(1, len(x) + 1)) AS k FROM p)
    SELECT array_to_string(x[1:k], '/') AS node, array_to_string(x[1:k-1], '/') AS parent, x[k] AS name, k::INT AS depth, bool_or(k = len(x)) AS is_file, count(*) AS n_files FROM s GROUP BY 1, 2, 3, 4""",
)
def _(spark, folder):
    return ingest.path_tree(model(spark, folder).analyses, "filename").orderBy("parent", "is_file", "name")


@query(
    "upload_running_size",
    f"""{WITH}, b AS (SELECT id, json_extract_string(config, '$.batch_id') AS batch_id, strlen(source_code) AS size, created_at FROM a)
    SELECT id, batch_id, row_number() OVER w AS file_no, (sum(size) OVER w)::BIGINT AS running_bytes, row_number() OVER w <= 50 AND sum(size) OVER w <= 60000 AS within FROM b WHERE batch_id IS NOT NULL
    WINDOW w AS (PARTITION BY batch_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, folder):
    a = model(spark, folder).analyses.select("id", F.get_json_object("config", "$.batch_id").alias("batch_id"), "source_code", "created_at").filter("batch_id is not null")
    return ingest.running_size(a, "batch_id", ["created_at", "id"], F.octet_length("source_code"), most_bytes=60_000).select("id", "batch_id", "file_no", "running_bytes", "within")


_CHECK = f"CASE WHEN NOT {_EXT} IN ({', '.join(repr(x) for x in schema.LANGUAGES)}) THEN 'unsupported' WHEN strlen(source_code) > 30000 THEN 'too large' WHEN NOT regexp_matches(source_code, '\\S') THEN 'empty' WHEN NOT status <> 'failed' THEN 'syntax' END AS error"


def _checked(spark, folder):
    return ingest.checked(model(spark, folder).analyses, F.col("filename"), F.col("source_code"), F.col("status") != "failed", most=30_000)


@query("valid_invalid_split", f"{WITH} SELECT id, {_CHECK} FROM a")
def _(spark, folder):
    return _checked(spark, folder).select("id", "error")


@query(
    "batch_acceptance",
    f"""{WITH}, e AS (SELECT json_extract_string(config, '$.batch_id') AS batch_id, {_CHECK} FROM a) SELECT batch_id, count(*) FILTER (error IS NULL) AS admitted, count(*) FILTER (error IS NOT NULL) AS refused,
    coalesce(string_agg(DISTINCT error, ',' ORDER BY error), '') AS errors, CASE WHEN count(*) FILTER (error IS NULL) > 0 THEN 202 ELSE 422 END::INT AS verdict FROM e WHERE batch_id IS NOT NULL GROUP BY 1""",
)
def _(spark, folder):
    files = _checked(spark, folder).withColumn("batch_id", F.get_json_object("config", "$.batch_id")).filter("batch_id is not null")
    return ingest.batch_verdicts(files, "batch_id")


def _prompts(spark, folder, framework=False):
    m = model(spark, folder)
    a = m.analyses.select(F.col("id").alias("analysis_id"), "language")
    f = m.functions.select(F.col("id").alias("function_id"), "signature", "analysis_id").join(a, "analysis_id")
    rows = m.claims.join(f, "function_id")
    return prompts.build(rows, F.col("signature"), prompts.framework_of(F.col("language")) if framework else None)


_GUIDE = case_map("category", {k: v.replace("'", "''") for k, v in prompts.GUIDANCE.items()}, "NULL")
_BASE = f"{WITH}, p AS (SELECT c.*, signature, language FROM c JOIN f ON f.id = c.function_id JOIN a ON a.id = f.analysis_id)"


@query("prompt_by_category", f"{_BASE} SELECT id, '{prompts.SYSTEM} ' || {_GUIDE} AS system, predicate_object AS claim, conditionality AS condition, signature, subject, category <> 'SEV' AS has_schema FROM p")
def _(spark, folder):
    at = lambda p: F.get_json_object("user", p)
    return _prompts(spark, folder).select("id", "system", at("$.claim").alias("claim"), at("$.condition").alias("condition"), at("$.signature").alias("signature"), at("$.subjects[0]").alias("subject"), at("$.output_schema").isNotNull().alias("has_schema"))


@query("framework_prompt", f"{_BASE} SELECT id, 'Framework: ' || {case_map('language', prompts.FRAMEWORKS, 'NULL')} || '. {prompts.SYSTEM} ' || {_GUIDE} AS system FROM p")
def _(spark, folder):
    return _prompts(spark, folder, True).select("id", "system")


@query("prompt_token_counts", f"{WITH} SELECT v.id, CASE WHEN trim(regexp_replace(test_code, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(test_code, '\\s+', ' ', 'g')), ' ')) END AS response_tokens FROM v")
def _(spark, folder):
    return prompts.token_counts(model(spark, folder).violations, "expected", "test_code").select("id", "response_tokens")


@query("code_block_extract", """SELECT doc_id, CASE WHEN regexp_matches(t, '(?s)```(?:python)?\\s*\\n(.*?)```') THEN regexp_extract(t, '(?s)```(?:python)?\\s*\\n(.*?)```', 1) ELSE t END AS code FROM (SELECT doc_id, text AS t FROM documents)""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", prompts.code_block(F.col("text")).alias("code"))


@query("upload_mode", f"{WITH} SELECT id, CASE WHEN ends_with(lower(coalesce(filename, '')), '.zip') THEN 'archive' WHEN {_EXT} IN ({', '.join(repr(x) for x in schema.LANGUAGES)}) THEN 'file' WHEN regexp_matches(source_code, '\\S') THEN 'paste' ELSE 'nothing' END AS mode FROM a")
def _(spark, folder):
    return model(spark, folder).analyses.select("id", ingest.upload_mode(F.col("filename"), F.col("source_code")).alias("mode"))
