"""The pN_ queries and, where SQL can say the same, the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import credentials, documented, garbled, heldout, near_duplicates, splitting, token_ids, truncation
from plumbline.sources.tables import table


def _near(spark: SparkSession, folder: str) -> near_duplicates.NearDuplicates:
    functions = table(spark, folder, "function_records").select("id", "source", "docstring")
    return near_duplicates.NearDuplicates(functions, "id", ["source", "docstring"], threshold=0.7, shingle=3)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    join = _near(spark, folder)
    return near_duplicates.expand_pairs(join.pairs(), join.members())


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(_near(spark, folder))


_CODE = {"analyses": "source_code", "function_records": "source"}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [credentials.credential_lines(table(spark, folder, t).select("id", c), "id", c).select(F.lit(t).alias("src_table"), "id", "line_no") for t, c in _CODE.items()]
    return found[0].union(found[1]).distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that hold credentials, with each masked; one row per table and id."""
    masked = [credentials.redacted(table(spark, folder, t).select("id", c), "id", c).select(F.lit(t).alias("src_table"), "id", "n", "redacted") for t, c in _CODE.items()]
    return masked[0].union(masked[1]).dropDuplicates(["src_table", "id"])


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "code_chunks").select("chunk_id", "content", "start_line")
    return splitting.split_oversized(chunks).dropDuplicates(["chunk_id", "piece_no"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "code_chunks").select("chunk_id", "content", "start_line")
    return splitting.split_oversized(chunks).filter("piece_no = 1").select("chunk_id").distinct()


def _truncation(spark: SparkSession, folder: str) -> truncation.Truncation:
    return truncation.Truncation(table(spark, folder, "violations").select("id", "expected", "actual"), "id", ["expected", "actual"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncation(spark, folder).cut()


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The hidden storage limits: field, unit, length, values of that length, and how many of them end openly."""
    return _truncation(spark, folder).limits()


def p4_providers(spark: SparkSession, folder: str) -> DataFrame:
    """Values and cut values by the provider of the analysis behind the claim; null where no analysis is known."""
    verdicts = _truncation(spark, folder).verdicts().groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("cause").alias("n_cut"))
    claims = table(spark, folder, "violations").select("id", "claim_id").dropDuplicates(["id"]).join(verdicts, "id")
    functions = table(spark, folder, "claims").select(F.col("id").alias("claim_id"), "function_id").dropDuplicates(["claim_id"])
    analyses = table(spark, folder, "function_records").select(F.col("id").alias("function_id"), "analysis_id").dropDuplicates(["function_id"])
    providers = table(spark, folder, "analyses").select(F.col("id").alias("analysis_id"), "llm_provider").dropDuplicates(["analysis_id"])
    # one row per violation goes up the keys; sums by few providers combine before the last shuffle
    found = claims.join(functions, "claim_id", "left").join(analyses, "function_id", "left").join(providers, "analysis_id", "left")
    sums = found.groupBy("llm_provider").agg(F.sum("n").alias("n_values"), F.sum("n_cut").alias("n_cut"))
    return sums.withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "function_records").select("id", "name", "signature", "source", "docstring")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented.documented(_records(spark, folder), with_code=False).distinct()


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented.documented(_records(spark, folder)).dropDuplicates(["id"])


def p5_file_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The documented functions of the uploaded files themselves."""
    files = table(spark, folder, "analyses").select("id", "source_code", "language")
    return documented.documented_in_files(files, "id", "source_code", "language").dropDuplicates(["id", "lineno"])


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids.encode_corpus(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "eval_items").select("item_id", "passage")
    return heldout.leaks(documents, "doc_id", "text", items, "item_id", "passage", least=12)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per test item: in how many documents it leaked, and the longest span of it."""
    found = _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words").alias("longest"))
    items = table(spark, folder, "eval_items").select("item_id").distinct()
    return items.join(found, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


def _garbled(spark: SparkSession, folder: str) -> garbled.Garbled:
    return garbled.Garbled(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).restored().select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).restored()


def p8_transformations(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of encodings that aligned near-twins gave evidence of."""
    return _garbled(spark, folder).votes()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# Endings read by expressions: quoted strings are taken out, then brackets are counted. No phrase or number of the tables
# fills a limit, so endings alone say which values were cut.
_CUT = r"""WITH pairs AS (SELECT id, claim_id, 'expected' AS field_name, expected AS v FROM violations UNION SELECT id, claim_id, 'actual', actual FROM violations),
    e AS (SELECT *, regexp_replace(v, '\s+$', '') AS b FROM pairs WHERE length(v) > 0),
    q AS (SELECT *, regexp_replace(b, '"(\\.|[^"\\])*"|''(\\.|[^''\\])*''', '', 'g') AS bare, len(regexp_extract_all(b, '\S+')) AS words, regexp_matches(b, '^([(\[{"'']|[A-Za-z_][\w.]*[(\[{])') AS literal FROM e),
    r AS (SELECT *, len(regexp_extract_all(bare, '[(\[{]')) AS opened, len(regexp_extract_all(bare, '[)\]}]')) AS closed, contains(bare, '"') OR contains(bare, '''') AS quoted,
    regexp_matches(b, '(?i)(\.\.\.|…|[\[(<{]\s*(truncated|cut|snip(ped)?|clipped|shortened|output omitted|\d+ (more|chars?|characters|bytes)[^\])>}]*|\.{3}|…)\s*[\])>}])$') AS marked FROM q),
    cut AS (SELECT id, claim_id, field_name, CASE WHEN b = '' THEN false WHEN right(b, 1) = chr(65533) THEN true WHEN marked THEN NOT (regexp_matches(b, '^[(\[{]') AND opened = closed AND NOT quoted)
      WHEN b IN ('True', 'False', 'None', 'null', 'true', 'false', 'NaN', 'nan', 'inf') OR regexp_full_match(b, '[-+]?\d[\d_,]*(\.\d+)?([eE][-+]?\d+)?j?') THEN false WHEN left(b, 1) = '<' THEN right(b, 1) <> '>'
      WHEN literal AND (quoted OR opened > closed) THEN true WHEN literal AND regexp_matches(b, '[)\]}"'']$') THEN false WHEN (length(b) - length(replace(b, '`', ''))) % 2 = 1 THEN true
      WHEN regexp_matches(b, '[.!?。！？｡][)\]}"”’''»」』`*]*$') THEN false ELSE v <> b AND words > 1 OR regexp_matches(b, '[.!?] +\S|[。！？].') OR words > (CASE WHEN regexp_matches(b, '^\p{Lu}') THEN 3 ELSE 12 END) END AS is_cut FROM r)
    """

_SQL = {
    "p4_found": _CUT + "SELECT id, field_name FROM cut WHERE is_cut",
    "p4_providers": _CUT
    + """, o AS (SELECT DISTINCT id, claim_id, field_name, is_cut FROM cut), c AS (SELECT DISTINCT id AS claim_id, function_id FROM claims), f AS (SELECT DISTINCT id AS function_id, analysis_id FROM function_records),
    a AS (SELECT DISTINCT id AS analysis_id, llm_provider FROM analyses), s AS (SELECT llm_provider, count(*) AS n_values, count_if(is_cut)::BIGINT AS n_cut FROM o LEFT JOIN c USING (claim_id) LEFT JOIN f USING (function_id) LEFT JOIN a USING (analysis_id) GROUP BY 1)
    SELECT *, round(n_cut / n_values, 6) AS share FROM s""",
    # every pair of records that share a sequence of three words, by counting
    "p1_found": """WITH d AS (SELECT DISTINCT ON (id) id, regexp_extract_all(lower(source || ' ' || coalesce(docstring, '')), '[a-z0-9_]+') AS w FROM function_records),
    s AS (SELECT DISTINCT id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
    SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE c / (a.n + b.n - c) >= 0.7""",
    # classes of equal word sequences, links between their least ids, and what can be reached over links
    "p1_groups": """WITH RECURSIVE d AS (SELECT DISTINCT ON (id) id, regexp_extract_all(lower(source || ' ' || coalesce(docstring, '')), '[a-z0-9_]+') AS w FROM function_records),
    k AS (SELECT id, w, CASE WHEN len(w) >= 3 THEN min(id) OVER (PARTITION BY w) END AS class_id FROM d), s AS (SELECT DISTINCT id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM k WHERE id = class_id)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2), p AS (SELECT a, b FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c / (na.n + nb.n - c) >= 0.7),
    r AS (SELECT id, id AS other FROM n UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.other), g AS (SELECT id, min(other) AS group_id FROM r GROUP BY 1), l AS (SELECT a AS id, count(*) AS n_links FROM p GROUP BY 1)
    SELECT k.id, class_id, coalesce(group_id, k.id) AS group_id, coalesce(n_links, 0)::BIGINT AS n_links FROM k LEFT JOIN g ON g.id = class_id LEFT JOIN l ON l.id = class_id""",
    "p3_found": "SELECT DISTINCT chunk_id FROM code_chunks WHERE length(content) > 2000",
    # runs of common sequences of twelve words that go on in step in text and passage: k of them are k + 11 words
    "p7_items": """WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), e AS (SELECT DISTINCT ON (item_id) item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
    x AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)), y AS (SELECT item_id, i AS j, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
    m AS (SELECT doc_id, item_id, i, i - j AS k FROM x JOIN y USING (g)), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, k ORDER BY i) AS run FROM m), l AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, k, run),
    t AS (SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(words) AS longest FROM l GROUP BY 1) SELECT e.item_id, coalesce(n_documents, 0)::BIGINT AS n_documents, coalesce(longest, 0)::INT AS longest FROM e LEFT JOIN t USING (item_id)""",
    # every run of twelve words of a text that is one of a passage
    "p7_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
    x AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)), y AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
    SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
