"""Retrieval, reranking, citations and answer metrics over code_chunks; the queries are those of eval_items.

Compared with SQL on ASCII tokens; the operators' default takes letters of any script.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import retrieval as X
from plumbline.operators.graph import numbered
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, chunks
from plumbline.sources.tables import table

_Q = f"""{WITH}, q AS (SELECT DISTINCT ON (item_id) item_id, query, expected FROM eval_items),
d AS (SELECT chunk_id, concat_ws(' ', coalesce(file_path, ''), coalesce(function_name, ''), coalesce(docstring, ''), coalesce(content, '')) AS text, content, function_name, docstring FROM k)"""
_TF = "tk AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*') AS t FROM d), tf AS (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM tk), tc AS (SELECT chunk_id, length, term, count(*) AS n FROM tf GROUP BY ALL)"
_IDF = "w AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)) + 1 AS idf FROM tc GROUP BY 1)"
_VEC = "rw AS (SELECT chunk_id, term, n / length * idf AS w FROM tc JOIN w USING (term)), nm AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM rw GROUP BY 1), ix AS (SELECT chunk_id, term, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS weight FROM rw JOIN nm USING (chunk_id))"
_QVEC = "qk AS (SELECT item_id, regexp_extract_all(lower(query), '[a-zA-Z_][a-zA-Z0-9_]*') AS t FROM q), qf AS (SELECT item_id, len(t) AS length, unnest(t) AS term FROM qk), qc AS (SELECT item_id, length, term, count(*) AS n FROM qf GROUP BY ALL), qr AS (SELECT item_id, term, n / length * idf AS w FROM qc JOIN w USING (term)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qr GROUP BY 1), qv AS (SELECT item_id, term, w / norm AS qw FROM qr JOIN qn USING (item_id))"
_DENSE = "sc AS (SELECT item_id, chunk_id, round(sum(weight * qw), 9) AS score FROM ix JOIN qv USING (term) GROUP BY 1, 2), fl AS (SELECT item_id, chunk_id, 0.0::DOUBLE AS score FROM q, (SELECT chunk_id FROM d ORDER BY chunk_id LIMIT 20) x), ds AS (SELECT item_id, chunk_id, max(score) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM fl) GROUP BY 1, 2), dt AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 10)"
_QWORDS = "ql AS (SELECT item_id, regexp_extract_all(lower(query), '[a-z0-9_]+') AS t FROM q), qt AS (SELECT item_id, len(t) AS length, unnest(t) AS term FROM ql), qx AS (SELECT item_id, length, term, count(*) AS n FROM qt GROUP BY ALL)"
_SPARSE = "st AS (SELECT DISTINCT term FROM qx), sh AS (SELECT chunk_id, term FROM d JOIN st ON contains(lower(content), term)), ss AS (SELECT item_id, chunk_id, round(sum(n) / greatest(length, 1), 9) AS score FROM sh JOIN qx USING (term) GROUP BY item_id, chunk_id, length), sp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM ss QUALIFY rank <= 10)"
_HYBRID = "hy AS (SELECT item_id, chunk_id, coalesce(dt.score, 0) AS dense, coalesce(sp.score, 0) AS sparse, coalesce(dt.rank, 2147483647) AS dr, coalesce(sp.rank, 2147483647) AS sr FROM dt FULL JOIN sp USING (item_id, chunk_id)), hs AS (SELECT *, round(0.6::DOUBLE * dense + 0.4::DOUBLE * sparse, 9) AS score FROM hy), ht AS (SELECT item_id, chunk_id, dense, sparse, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, dr, sr, chunk_id) AS rank FROM hs QUALIFY rank <= 5)"
_RERANK = """rk AS (SELECT item_id, chunk_id, expected, function_name, query, score AS initial, list_distinct(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS terms, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS held, docstring, content FROM ht JOIN d USING (chunk_id) JOIN q USING (item_id)),
rs AS (SELECT item_id, chunk_id, expected, function_name, round(0.30::DOUBLE * greatest(0, least(1, initial)) + 0.30::DOUBLE * (len(list_intersect(terms, held)) / greatest(len(terms), 1)) + 0.25::DOUBLE * (0.6::DOUBLE * CASE WHEN coalesce(function_name, '') <> '' AND contains(lower(query), lower(function_name)) THEN 1 ELSE 0 END
+ 0.4::DOUBLE * CASE WHEN coalesce(docstring, '') <> '' AND len(list_filter(terms, lambda t: contains(lower(docstring), t))) > 0 THEN 1 ELSE 0 END) + 0.15::DOUBLE * CASE WHEN regexp_matches(lower(content), 'return|returns|raises|raise|param|params|mutates|contract|bcv') THEN 1 ELSE 0 END, 9) AS score FROM rk),
rr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM rs QUALIFY rank <= 3)"""


_HELD: dict[tuple[str, str], X.Corpus] = {}


def _corpus(spark, folder) -> X.Corpus:
    """The corpus of a folder, indexed once in a session: all searches read the same tables."""
    key = spark.sparkContext.applicationId, folder
    if key not in _HELD:
        _HELD[key] = X.Corpus(table(spark, folder, "code_chunks"), unicode=False)
    return _HELD[key]


def _queries(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", "query", "expected").dropDuplicates(["item_id"])


def _index(spark, folder):
    return _corpus(spark, folder).index


def _dense(spark, folder, k=10):
    return _corpus(spark, folder).dense(_queries(spark, folder), "item_id", "query", k)


def _sparse(spark, folder, k=10):
    return _corpus(spark, folder).sparse(_queries(spark, folder), "item_id", "query", k)


def _hybrid(spark, folder):
    return _corpus(spark, folder).hybrid(_queries(spark, folder), "item_id", "query", 5)


def _reranked(spark, folder):
    return _corpus(spark, folder).reranked(_queries(spark, folder), "item_id", "query")


@query("tokenize", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_][a-zA-Z0-9_]*')) AS n, md5(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_][a-zA-Z0-9_]*'), ' ')) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM documents)")
def _(spark, folder):
    t = C.tokens(F.regexp_replace("text", "[^\\x00-\\x7F]", " "), unicode=False)
    return table(spark, folder, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("term_frequency", f"{_Q}, {_TF} SELECT chunk_id, term, n, length::BIGINT AS length FROM tc")
def _(spark, folder):
    return _index(spark, folder).counts.select("chunk_id", "term", "n", F.col("length").cast("bigint").alias("length"))


@query("idf", f"{_Q}, {_TF}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM w")
def _(spark, folder):
    return _index(spark, folder).weights.select("term", "df", F.round("idf", 6).alias("idf"))


@query("vocabulary", f"{_Q}, {_TF}, vo AS (SELECT DISTINCT term FROM tc) SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM vo")
def _(spark, folder):
    return numbered(_index(spark, folder).weights.select("term"), "term")


@query("tfidf_norm", f"{_Q}, {_TF}, {_IDF}, {_VEC} SELECT chunk_id, term, round(weight, 6) AS weight FROM ix")
def _(spark, folder):
    return _index(spark, folder).vectors.select("chunk_id", "term", F.round("weight", 6).alias("weight"))


@query("dense_topk", f"{_Q}, {_TF}, {_IDF}, {_VEC}, {_QVEC}, {_DENSE} SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM dt")
def _(spark, folder):
    return _dense(spark, folder).select("item_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("sparse_overlap_topk", f"{_Q}, {_QWORDS}, {_SPARSE} SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM sp")
def _(spark, folder):
    return _sparse(spark, folder).select("item_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("hybrid_topk", f"{_Q}, {_TF}, {_IDF}, {_VEC}, {_QVEC}, {_DENSE}, {_QWORDS}, {_SPARSE}, {_HYBRID} SELECT item_id, chunk_id, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(score, 6) AS score, rank FROM ht")
def _(spark, folder):
    return _hybrid(spark, folder).select("item_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("dense", "sparse", "score")], F.col("rank").cast("bigint").alias("rank"))


@query("feature_rerank", f"{_Q}, {_TF}, {_IDF}, {_VEC}, {_QVEC}, {_DENSE}, {_QWORDS}, {_SPARSE}, {_HYBRID}, {_RERANK} SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM rr")
def _(spark, folder):
    return _reranked(spark, folder).select("item_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "hit_at_k_mrr",
    f"""{_Q}, {_TF}, {_IDF}, {_VEC}, {_QVEC}, {_DENSE}, {_QWORDS}, {_SPARSE}, {_HYBRID}, {_RERANK}, fi AS (SELECT item_id, min(rank) AS first FROM rr WHERE function_name = expected GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM (SELECT DISTINCT item_id FROM q JOIN k ON k.function_name = q.expected) x LEFT JOIN fi USING (item_id)""",
)
def _(spark, folder):
    relevant = _queries(spark, folder).join(chunks(spark, folder).select("chunk_id", F.col("function_name").alias("expected")), "expected").select("item_id", "chunk_id")
    return X.ranking_quality(_reranked(spark, folder), relevant, "item_id", "chunk_id")


@query(
    "bm25_topk",
    f"""{_Q}, {_TF}, {_QWORDS}, b0 AS (SELECT term, ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tc GROUP BY 1), b1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM b0) ELSE idf END AS idf FROM b0),
    al AS (SELECT avg(length) AS a FROM (SELECT DISTINCT chunk_id, length FROM tc)), b2 AS (SELECT item_id, chunk_id, sum(qx.n * idf * tc.n * 2.5::DOUBLE / (tc.n + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tc.length / (SELECT a FROM al)))) AS raw FROM tc JOIN qx USING (term) JOIN b1 USING (term) GROUP BY 1, 2),
    b3 AS (SELECT item_id, chunk_id, round(raw / CASE WHEN max(raw) OVER (PARTITION BY item_id) > 0 THEN max(raw) OVER (PARTITION BY item_id) ELSE 1 END, 9) AS score FROM b2) SELECT item_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM b3 QUALIFY rank <= 10""",
)
def _(spark, folder):
    index = _index(spark, folder)
    terms = X.query_terms(_queries(spark, folder), "item_id", "query", unicode=False)
    scores = X.bm25_scores(index.counts, terms, index.n_docs, "chunk_id", "item_id")
    return X.top(scores, "item_id", "chunk_id", 10).select("item_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "embedding_cosine_topk",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM u),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
)
def _(spark, folder):
    e = table(spark, folder, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return X.cosine_top(e, "vec_id", "embedding", q, "query_id", "qe", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# -- answers: one run per chunk, its retrieved set the chunk and the next two of its file ----------------------------------

_RESPONSE = """'Extracted ' || coalesce(function_name, 'block') || ' with its contract from the file. ' || CASE WHEN start_line % 4 = 0 THEN '' ELSE '[Source: ' || file_path || ':' || (start_line + start_line % 2) || '-' || end_line || CASE WHEN start_line % 3 = 0 THEN '' ELSE ' | ID: ' || chunk_id END || ']' END
|| CASE WHEN start_line % 5 = 0 THEN chr(10) || chr(10) || 'See also the notes of the older module. [Source: nowhere/else.py:3 | ID: zzz]' ELSE '' END || chr(10) || chr(10) || '# Heading' || chr(10) || chr(10) || coalesce(docstring, 'Nothing is said about the behaviour of this part of the code.')"""
_RUNS = f"""{WITH}, o AS (SELECT *, lead(chunk_id, 1) OVER w AS n1, lead(chunk_id, 2) OVER w AS n2 FROM k WINDOW w AS (PARTITION BY file_path ORDER BY start_line, chunk_id)),
s AS (SELECT chunk_id, file_path AS path, start_line AS first, end_line AS last, function_name AS function, docstring, content FROM k),
u AS (SELECT chunk_id AS run_id, 'what does ' || coalesce(function_name, chunk_type) || ' return' AS query, {_RESPONSE} AS response, docstring AS ground_truth, unnest(list_filter([chunk_id, n1, n2], lambda x: x IS NOT NULL)) AS cid, unnest(range(3)[1:len(list_filter([chunk_id, n1, n2], lambda x: x IS NOT NULL))]) AS pos FROM o),
r AS (SELECT run_id, query, response, ground_truth, list(s ORDER BY pos) AS retrieved FROM u JOIN s ON s.chunk_id = u.cid GROUP BY ALL)"""


def _runs(spark, folder):
    k = chunks(spark, folder)
    w = Window.partitionBy("file_path").orderBy("start_line", "chunk_id")
    row = k.withColumn("me", X.chunk_struct())
    ahead = row.withColumn("n1", F.lead("me", 1).over(w)).withColumn("n2", F.lead("me", 2).over(w))
    s, own = F.col("start_line"), F.when(F.col("start_line") % 3 == 0, "").otherwise(F.concat(F.lit(" | ID: "), "chunk_id"))
    tag = F.concat(F.lit("[Source: "), "file_path", F.lit(":"), (s + s % 2).cast("string"), F.lit("-"), F.col("end_line").cast("string"), own, F.lit("]"))
    response = F.concat(
        F.lit("Extracted "), F.coalesce("function_name", F.lit("block")), F.lit(" with its contract from the file. "), F.when(s % 4 == 0, "").otherwise(tag), F.when(s % 5 == 0, "\n\nSee also the notes of the older module. [Source: nowhere/else.py:3 | ID: zzz]").otherwise(""),
        F.lit("\n\n# Heading\n\n"), F.coalesce("docstring", F.lit("Nothing is said about the behaviour of this part of the code.")),
    )
    return ahead.select(F.col("chunk_id").alias("run_id"), F.concat(F.lit("what does "), F.coalesce("function_name", "chunk_type"), F.lit(" return")).alias("query"), response.alias("response"), F.col("docstring").alias("ground_truth"), F.array_compact(F.array("me", "n1", "n2")).alias("retrieved"))


_CITE = "\\[Source:\\s*([^:\\]\\s]+):(\\d+)(?:-(\\d+))?(?:\\s*\\|\\s*ID:\\s*([a-zA-Z0-9_-]+))?\\]"
_CITES = f"""ci AS (SELECT run_id, unnest(regexp_extract_all(response, '{_CITE}', 1)) AS path, unnest(regexp_extract_all(response, '{_CITE}', 2))::INT AS first, unnest(regexp_extract_all(response, '{_CITE}', 3)) AS l, nullif(unnest(regexp_extract_all(response, '{_CITE}', 4)), '') AS chunk_id FROM r),
cx AS (SELECT run_id, path, first, coalesce(nullif(l, '')::INT, first) AS last, chunk_id FROM ci)"""
_VALID = f"{_CITES}, cv AS (SELECT cx.*, len(list_filter(retrieved, lambda c: coalesce(c.chunk_id = cx.chunk_id, false) OR (contains(c.path, cx.path) AND c.first <= cx.first AND c.last >= cx.last))) > 0 AS valid FROM cx JOIN r USING (run_id))"
_UNCITED = f"len(list_filter(list_transform(string_split(response, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 40 AND NOT starts_with(p, '#') AND NOT regexp_matches(p, '{_CITE}')))"
_NEEDS = f"regexp_matches(x, '\\S') AND NOT starts_with(regexp_replace(x, '^\\s+', ''), '#') AND NOT regexp_matches(x, '{_CITE}')"
_STATS = f"""{_VALID}, cn AS (SELECT run_id, count(*) AS n, count(*) FILTER (valid) AS nv FROM cv GROUP BY 1), cs AS (SELECT r.*, coalesce(n, len(list_filter(string_split(response, chr(10)), lambda x: {_NEEDS}))) AS total_citations, coalesce(nv, len(list_filter(string_split(response, chr(10)), lambda x: {_NEEDS}))) AS valid_citations,
{_UNCITED} AS uncited_paragraphs FROM r LEFT JOIN cn USING (run_id)), ct AS (SELECT *, round(CASE WHEN total_citations > 0 THEN valid_citations / total_citations ELSE 0 END, 4) AS compliance_rate FROM cs)"""


@query("citation_extract", f"{_RUNS}, {_CITES} SELECT run_id, path, first, last, chunk_id FROM cx")
def _(spark, folder):
    return _runs(spark, folder).select("run_id", F.explode(C.citations(F.col("response"))).alias("c")).select("run_id", "c.path", "c.first", "c.last", "c.chunk_id")


@query("citation_valid", f"{_RUNS}, {_VALID} SELECT run_id, path, first, chunk_id, valid FROM cv")
def _(spark, folder):
    rows = _runs(spark, folder).select("run_id", "retrieved", F.explode(C.citations(F.col("response"))).alias("c"))
    return rows.select("run_id", "c.path", "c.first", "c.chunk_id", X.valid_citation(F.col("c"), F.col("retrieved")).alias("valid"))


@query("citation_compliance", f"{_RUNS}, {_STATS} SELECT run_id, total_citations, valid_citations, uncited_paragraphs, compliance_rate, valid_citations / total_citations >= 0.75 AND total_citations > 0 AS is_compliant FROM ct")
def _(spark, folder):
    return X.citation_stats(_runs(spark, folder), ["run_id"])


@query("uncited_paragraphs", f"{_RUNS} SELECT run_id, {_UNCITED} AS n FROM r")
def _(spark, folder):
    return _runs(spark, folder).select("run_id", X.uncited_paragraphs(F.col("response")).alias("n"))


_TAG1 = "'[Source: ' || retrieved[1].path || ':' || retrieved[1].first || '-' || retrieved[1].last || ' | ID: ' || retrieved[1].chunk_id || ']'"


@query("citation_inject", f"{_RUNS} SELECT run_id, CASE WHEN regexp_matches(response, '{_CITE}') THEN response ELSE array_to_string(list_transform(string_split(response, chr(10)), lambda x: CASE WHEN {_NEEDS} THEN x || ' ' || {_TAG1} ELSE x END), chr(10)) END AS text FROM r")
def _(spark, folder):
    return _runs(spark, folder).select("run_id", X.injected(F.col("response"), F.col("retrieved"))[0].alias("text"))


_SEGMENT = "\\[Source:\\s*[^\\]]+\\]"


@query(
    "answer_segments",
    f"""{_RUNS}, g AS (SELECT run_id, regexp_split_to_array(response, '{_SEGMENT}') AS parts, regexp_extract_all(response, '{_SEGMENT}') AS tags FROM r),
    t AS (SELECT run_id, unnest(parts) AS value, unnest(range(len(parts))) AS i FROM g), tg AS (SELECT run_id, regexp_replace(unnest(tags), '\\[Source:\\s*|\\s*\\]', '', 'g') AS value, unnest(range(len(tags))) AS i FROM g),
    sgm AS (SELECT run_id, 'text' AS kind, value, 2 * i AS o FROM t WHERE value <> '' UNION ALL SELECT run_id, 'citation', value, 2 * i + 1 FROM tg) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS place, kind, value FROM sgm""",
)
def _(spark, folder):
    rows = _runs(spark, folder).select("run_id", F.posexplode(X.answer_segments(F.col("response"))).alias("place", "s"))
    return rows.select("run_id", F.col("place").cast("bigint").alias("place"), "s.kind", "s.value")


_DOC = "concat_ws(' ', coalesce(c.path, ''), coalesce(c.function, ''), coalesce(c.docstring, ''), coalesce(c.content, ''))"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_PARTS = f"""hw AS (SELECT *, {_WORDS.format(f"array_to_string(list_transform(retrieved, lambda c: {_DOC}), ' ')")} AS held, {_WORDS.format("array_to_string(list_transform(retrieved, lambda c: coalesce(c.content, '')), ' ')")} AS cw, {_WORDS.format('query')} AS qw, {_WORDS.format('response')} AS rw, {_WORDS.format("coalesce(ground_truth, '')")} AS gw,
list_filter(list_transform(regexp_split_to_array(response, '[.!?]\\s+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 15) AS sents FROM ct),
sm AS (SELECT run_id, unnest(sents) AS s FROM hw), sx AS (SELECT run_id, list_filter({_WORDS.format('s')}, lambda w: NOT list_contains({_STOP}, w)) AS meant FROM sm), sg AS (SELECT run_id, count(*) AS n, count(*) FILTER (len(meant) = 0 OR len(list_intersect(meant, held)) >= 0.4 * len(meant)) AS ng FROM sx JOIN hw USING (run_id) GROUP BY 1),
mt AS (SELECT hw.run_id, round(coalesce(ng / n, 1), 9) AS g, compliance_rate AS c, round(len(list_filter(retrieved, lambda c: len(list_filter(qw, lambda t: contains(lower({_DOC}), t))) > 0)) / len(retrieved), 9) AS h, round(least(1, 0.7::DOUBLE * (len(list_intersect(qw, rw)) / greatest(len(qw), 1)) + 0.3::DOUBLE * least(1, len(rw) / 30)), 9) AS e,
round(CASE WHEN coalesce(ground_truth, '') = '' THEN 1 ELSE len(list_intersect(gw, cw)) / greatest(len(gw), 1) END, 9) AS t FROM hw LEFT JOIN sg USING (run_id)),
mx AS (SELECT run_id, round(g, 6) AS grounding_ratio, c AS citation_compliance, round(h, 6) AS retrieval_hit_rate, round(e, 6) AS query_term_echo, round(t, 6) AS ground_truth_coverage, round(round(0.30::DOUBLE * g + 0.25::DOUBLE * c + 0.20::DOUBLE * h + 0.15::DOUBLE * e + 0.10::DOUBLE * t, 9), 6) AS composite FROM mt)"""


def _metric(name: str, column: str) -> None:
    @query(name, f"{_RUNS}, {_STATS}, {_PARTS} SELECT run_id, {column} FROM mx")
    def _(spark, folder):
        return X.run_metrics(_runs(spark, folder), ["run_id"], unicode=False, places=6).select("run_id", column)


for _name in ("grounding_ratio", "retrieval_hit_rate", "ground_truth_coverage", "query_term_echo"):
    _metric(_name, _name)
_metric("composite_score", "composite")


@query("benchmark_averages", f"{_RUNS}, {_STATS}, {_PARTS} SELECT count(*) AS runs, " + ", ".join(f"round(avg({n}), 4) AS avg_{n}" for n in ("grounding_ratio", "citation_compliance", "retrieval_hit_rate", "query_term_echo", "ground_truth_coverage", "composite")) + " FROM mx")
def _(spark, folder):
    return X.benchmark(X.run_metrics(_runs(spark, folder), ["run_id"], unicode=False, places=6))


_TAGC = "'[Source: ' || c.path || ':' || c.first || '-' || c.last || ' | ID: ' || c.chunk_id || ']'"
_FALLBACK = f"""'### Findings' || chr(10) || chr(10) || array_to_string(list_transform(retrieved, lambda c: '- Extracted ' || CASE WHEN coalesce(c.function, '') <> '' THEN 'function `' || c.function || '`' ELSE 'code block in `' || c.path || '`' END || CASE WHEN coalesce(c.docstring, '') <> '' THEN ' with docstring ' || chr(39) || c.docstring || chr(39) ELSE '' END
|| ' across lines ' || c.first || '-' || c.last || '. ' || {_TAGC}), chr(10)) || chr(10) || chr(10) || 'The implementation in `' || retrieved[1].path || '` was read for its contract. ' || {_TAG1}"""


@query("fallback_answer", f"{_RUNS} SELECT run_id, {_FALLBACK} AS answer FROM r")
def _(spark, folder):
    return _runs(spark, folder).select("run_id", X.fallback_answer(F.col("retrieved")).alias("answer"))


@query(
    "context_prompt",
    f"""{_RUNS} SELECT run_id, 'Answer from the context only and end every statement with its citation tag.' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || array_to_string(list_transform(retrieved, lambda c, i: '--- CHUNK ' || i || ' --- ' || {_TAGC} || chr(10) || 'File: ' || c.path || ' (Lines ' || c.first || '-' || c.last || ')' || chr(10)
    || CASE WHEN coalesce(c.function, '') <> '' THEN 'Function: ' || c.function || chr(10) ELSE '' END || CASE WHEN coalesce(c.docstring, '') <> '' THEN 'Docstring: ' || c.docstring || chr(10) ELSE '' END || 'Code:' || chr(10) || '```python' || chr(10) || c.content || chr(10) || '```'), chr(10) || chr(10)) || chr(10) || chr(10) || 'QUERY:' || chr(10) || query AS prompt FROM r""",
)
def _(spark, folder):
    return _runs(spark, folder).select("run_id", X.context_prompt(F.col("query"), F.col("retrieved")).alias("prompt"))


@query(
    "rag_stats",
    f"""{WITH} SELECT count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, round(avg(length(content)), 4) AS avg_length FROM k""",
)
def _(spark, folder):
    return X.corpus_stats(chunks(spark, folder))


_ANSWERED = f"""{_Q}, {_TF}, {_IDF}, {_VEC}, {_QVEC}, {_DENSE}, {_QWORDS}, {_SPARSE}, {_HYBRID}, {_RERANK}, s AS (SELECT chunk_id, file_path AS path, start_line AS first, end_line AS last, function_name AS function, docstring, content FROM k),
ra AS (SELECT item_id AS run_id, list(s ORDER BY rr.rank) AS retrieved FROM rr JOIN s ON s.chunk_id = rr.chunk_id GROUP BY 1), r AS (SELECT run_id, query, {_FALLBACK} AS response, expected AS ground_truth, retrieved FROM ra JOIN q ON q.item_id = ra.run_id)"""


@query("rag_answers", f"{_ANSWERED}, {_STATS}, {_PARTS} SELECT run_id AS item_id, grounding_ratio, citation_compliance, retrieval_hit_rate, query_term_echo, ground_truth_coverage, composite FROM mx")
def _(spark, folder):
    """The whole way of a query: hybrid search, rerank, fallback answer, citation check, metrics."""
    return X.run_metrics(_corpus(spark, folder).answered(_queries(spark, folder), "item_id", "query", "expected"), ["item_id"], unicode=False, places=6)


@query(
    "minmax_normalize",
    f"""{_Q}, {_QWORDS}, {_SPARSE} SELECT item_id, chunk_id, round((score - min(score) OVER (PARTITION BY item_id)) / CASE WHEN max(score) OVER (PARTITION BY item_id) <> min(score) OVER (PARTITION BY item_id) THEN max(score) OVER (PARTITION BY item_id) - min(score) OVER (PARTITION BY item_id) ELSE 1 END, 6) AS score FROM sp""",
)
def _(spark, folder):
    return X.min_max(_sparse(spark, folder), "item_id", "score").select("item_id", "chunk_id", F.round("score", 6).alias("score"))


@query("recent_runs", f"{_RUNS}, {_STATS}, {_PARTS} SELECT run_id, composite FROM mx ORDER BY run_id DESC LIMIT 10")
def _(spark, folder):
    return X.run_metrics(_runs(spark, folder), ["run_id"], unicode=False, places=6).select("run_id", "composite").transform(X.recent, "run_id")
