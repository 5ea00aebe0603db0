"""Retrieval over chunks: sparse TF-IDF, term overlap, BM25, hybrid scores, reranking, ranks.

The index is one row per (chunk, term). Queries are a stated set; their terms join the index on the term. The query side
is broadcast when its counted rows stay under BROADCAST_ROWS, so a term that a third of all chunks hold moves nothing;
beyond that both sides shuffle and skewed terms are split by adaptive execution. Ranks keep k rows per query; the limit
is applied before the shuffle. Scores are rounded to nine places before they are compared, and the chunk id breaks ties,
so that results do not depend on the order of summation.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import columns as C
from plumbline.session import rows_at_most, written

BROADCAST_ROWS = 200_000
BLOCK_WORDS, BLOCK_VECTORS = 20_000, 2_000  # of a stated query set, that meet the rows of one pass
#: Words whose presence marks a contract.
CONTRACT = ("return", "returns", "raises", "raise", "param", "params", "mutates", "contract", "bcv")


def document_text(path: Column, function: Column, docstring: Column, content: Column) -> Column:
    """'{path} {function} {docstring} {content}' with nulls as empty."""
    return F.concat_ws(" ", *[C.or_empty(c) for c in (path, function, docstring, content)])


def term_counts(docs: DataFrame, key: str, text: str, unicode: bool = True) -> DataFrame:
    """(key, term, n, length): how often each term stands in each text, and the text's tokens."""
    toks = docs.select(key, C.tokens(F.col(text), unicode).alias("t")).withColumn("length", F.size("t"))
    return toks.select(key, "length", F.explode("t").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("n"))


def idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with ln((N + 1) / (df + 1)) + 1; n_docs is one row (n)."""
    total = n_docs.scalar()
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((total + 1) / (F.col("df") + 1)) + 1)


def tfidf(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): term frequency times idf, each text's vector of length 1; terms without idf are left out."""
    raw = counts.join(weights.select("term", "idf"), "term").select(key, "term", (F.col("n") / F.col("length") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


class Index:
    """Term counts, weights and unit vectors of a corpus, written to the shared folder and read by every search.

    docs: (key, text). The tables are made when first asked for; texts without terms have no rows.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, unicode: bool = True):
        self.key, self.unicode = key, unicode
        self.docs = docs
        self.counts = written(term_counts(docs, key, text, unicode), "counts")
        self.n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
        self._weights: DataFrame | None = None
        self._vectors: DataFrame | None = None

    @property
    def weights(self) -> DataFrame:
        if self._weights is None:
            self._weights = written(idf(self.counts, self.n_docs), "weights")
        return self._weights

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = written(tfidf(self.counts, self.weights, self.key), "vectors")
        return self._vectors

    def query_vectors(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        return written(tfidf(term_counts(queries, query, text, self.unicode), self.weights, query), "queries")


class Corpus:
    """Chunks and their index, held in the shared folder for all searches of a session.

    chunks: the columns of code_chunks; rows of one chunk_id count once. The chunks are read and reduced once, and each
    table of the index is made once, when a search first asks for it.
    """

    def __init__(self, chunks: DataFrame, unicode: bool = True):
        self.unicode = unicode
        self.chunks = written(chunks.dropDuplicates(["chunk_id"]), "chunks")
        self._index: Index | None = None

    @property
    def docs(self) -> DataFrame:
        return self.chunks.select("chunk_id", document_text(F.col("file_path"), F.col("function_name"), F.col("docstring"), F.col("content")).alias("text"), "content", "function_name", "docstring")

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(self.docs.select("chunk_id", "text"), "chunk_id", "text", self.unicode)
        return self._index

    def dense(self, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
        return dense_top(self.index.vectors, self.index.query_vectors(queries, query, text), self.chunks.select("chunk_id"), queries, "chunk_id", query, k)

    def sparse(self, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
        return top(overlap_scores(self.chunks.select("chunk_id", "content"), query_terms(queries, query, text, self.unicode), "chunk_id", "content", query), query, "chunk_id", k)

    def hybrid(self, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
        return hybrid_top(self.dense(queries, query, text, 2 * k), self.sparse(queries, query, text, 2 * k), query, "chunk_id", k)

    def reranked(self, queries: DataFrame, query: str, text: str, wide: int = 5, k: int = 3) -> DataFrame:
        """(query, key, score, rank) after the feature rerank. The few rows of the hybrid search are counted and, if small,
        broadcast to the chunks; so are the queries."""
        best = self.hybrid(queries, query, text, wide).select(query, "chunk_id", F.col("score").alias("initial"))
        asked = queries.select(query, F.col(text).alias("_query"))
        rows = self.docs.join(small_side(written(best, "best")), "chunk_id").join(small_side(asked), query)
        scored = rows.withColumn("score", feature_score(F.col("initial"), F.col("_query"), F.col("function_name"), F.col("docstring"), F.col("content"), self.unicode))
        return top(scored.select(query, "chunk_id", "score"), query, "chunk_id", k)

    def answered(self, queries: DataFrame, query: str, text: str, truth: str | None = None) -> DataFrame:
        """One run per query: (query, its text as "query", retrieved, response, ground_truth), the response the cited answer
        without a model. The whole way from the search to what run_metrics() takes."""
        held = self.chunks.select("chunk_id", chunk_struct().alias("c")).join(small_side(written(self.reranked(queries, query, text).select(query, "chunk_id", "rank"), "reranked")), "chunk_id")
        sets = held.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("retrieved"))
        asked = queries.select(query, F.col(text).alias("query"), (F.col(truth) if truth else F.lit(None).cast("string")).alias("ground_truth"))
        return sets.join(small_side(asked), query).select(query, "query", "retrieved", fallback_answer(F.col("retrieved")).alias("response"), "ground_truth")


def small_side(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if rows_at_most(df, BROADCAST_ROWS) else df


def dot_products(index: DataFrame, query_vectors: DataFrame, key: str, query: str) -> DataFrame:
    """(query, key, score) of the pairs that share a term.

    The index is spread by key; with the queries broadcast the sums by (query, key) then need no second shuffle, so what
    moves is the index and not its pairs with the queries.
    """
    q = query_vectors.select(query, "term", F.col("weight").alias("qw"))
    return index.repartition(key).join(small_side(q), "term").groupBy(query, key).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score"))


def top(scores: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best keys of each query with their rank from 1."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_top(index: DataFrame, query_vectors: DataFrame, docs: DataFrame, queries: DataFrame, key: str, query: str, k: int) -> DataFrame:
    """(query, key, score, rank): the k best by dot product. Keys without a common term score 0 and fill up, in the order of
    their ids; the first 2k ids suffice for that, so no query meets all keys."""
    scored = dot_products(index, query_vectors, key, query)
    first = docs.select(key).orderBy(key).limit(2 * k)
    fill = queries.select(query, F.explode(first.agg(F.collect_list(key)).scalar()).alias(key))
    every = scored.unionByName(fill.withColumn("score", F.lit(0.0))).groupBy(query, key).agg(F.max("score").alias("score"))
    return top(every, query, key, k)


def query_terms(queries: DataFrame, query: str, text: str, unicode: bool = True) -> DataFrame:
    """(query, term, n, length): the words of each query, how often, and how many there are in all."""
    toks = queries.select(query, C.words(F.col(text), unicode).alias("t")).withColumn("length", F.size("t"))
    return toks.select(query, "length", F.explode("t").alias("term")).groupBy(query, "length", "term").agg(F.count(F.lit(1)).alias("n"))


def overlap_scores(docs: DataFrame, terms: DataFrame, key: str, content: str, query: str) -> DataFrame:
    """(query, key, score > 0): the share of a query's words that stand in the content as substrings, in lower case.

    The distinct words of the stated queries are counted and tested in blocks of about BLOCK_WORDS: one array per block,
    against which each content is tested within its row. However many queries are asked, no array grows beyond that.
    """
    distinct = terms.select("term").distinct()
    blocks = -(-distinct.count() // BLOCK_WORDS) or 1
    parts = []
    for b in range(blocks):
        own = distinct.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) if blocks > 1 else distinct
        given = docs.select(key, F.lower(F.col(content)).alias("_text"), own.select(F.collect_list("term")).scalar().alias("_words"))
        # exploded as "outer": an inner explode brings a filter that would search every content twice
        parts.append(given.select(key, F.explode_outer(F.filter("_words", lambda t: F.contains(F.col("_text"), t))).alias("term")).filter("term is not null"))
    held = functools.reduce(DataFrame.unionAll, parts).repartition(key)
    return held.join(small_side(terms), "term").groupBy(query, key, "length").agg(F.sum("n").alias("hits")).select(query, key, F.round(F.col("hits") / F.greatest("length", F.lit(1)), 9).alias("score"))


def bm25_scores(counts: DataFrame, terms: DataFrame, n_docs: DataFrame, key: str, query: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query, key, score): Okapi BM25 with negative idf values lifted to epsilon times the mean, over each query's best."""
    total = n_docs.scalar()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("idf", F.log(total - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).scalar()
    weights = raw.select("term", F.when(F.col("idf") < 0, F.lit(epsilon) * mean).otherwise(F.col("idf")).alias("idf"))
    average = counts.select(key, "length").distinct().agg(F.avg("length")).scalar()
    norm = F.col("n") + k1 * (1 - b + b * F.col("length") / average)
    q = terms.select(query, "term", F.col("n").alias("qn")).join(weights, "term")
    per = counts.repartition(key).join(small_side(q), "term").groupBy(query, key).agg(F.sum(F.col("qn") * F.col("idf") * F.col("n") * (k1 + 1) / norm).alias("raw"))
    best = F.max("raw").over(Window.partitionBy(query))
    return per.select(query, key, F.round(F.col("raw") / F.when(best > 0, best).otherwise(1.0), 9).alias("score"))


def hybrid_top(dense: DataFrame, sparse: DataFrame, query: str, key: str, k: int, weight: float = 0.6) -> DataFrame:
    """(query, key, dense, sparse, score, rank): the k best by weight * dense + (1 - weight) * sparse, a missing score 0.

    `dense` and `sparse` hold the 2k best of each side. Of equals the better dense rank wins, then the sparse one.
    """
    d = dense.select(query, key, F.col("score").alias("dense"), F.col("rank").alias("dr"))
    s = sparse.select(query, key, F.col("score").alias("sparse"), F.col("rank").alias("sr"))
    both = d.join(s, [query, key], "full").na.fill(0.0, ["dense", "sparse"]).na.fill(2**31 - 1, ["dr", "sr"])
    scored = both.withColumn("score", F.round(weight * F.col("dense") + (1 - weight) * F.col("sparse"), 9))
    w = Window.partitionBy(query).orderBy(F.desc("score"), "dr", "sr", key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query, key, "dense", "sparse", "score", "rank")


def feature_score(initial: Column, query: Column, function: Column, docstring: Column, content: Column, unicode: bool = True) -> Column:
    """The rerank score in [0, 1]: initial score, term overlap, hits in name and documentation, contract words."""
    terms = F.array_distinct(C.words(query, unicode))
    held = F.array_distinct(C.words(content, unicode))
    overlap = F.size(F.array_intersect(terms, held)) / F.greatest(F.size(terms), F.lit(1))
    name = F.when((C.or_empty(function) != "") & F.contains(F.lower(query), F.lower(function)), 1.0).otherwise(0.0)
    doc = F.when((C.or_empty(docstring) != "") & F.exists(terms, lambda t: F.contains(F.lower(docstring), t)), 1.0).otherwise(0.0)
    contract = F.when(F.lower(C.or_empty(content)).rlike("|".join(CONTRACT)), 1.0).otherwise(0.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), initial))
    return F.round(0.30 * clamped + 0.30 * overlap + 0.25 * (0.6 * name + 0.4 * doc) + 0.15 * contract, 9)


def min_max(scores: DataFrame, query: str, score: str) -> DataFrame:
    """Scores of another model spread to [0, 1] per query; without a spread the divisor is 1."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn(score, (F.col(score) - low) / F.when(high != low, high - low).otherwise(1.0))


def scored_by(rows: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], query: str, text: str, score: str = "model_score") -> DataFrame:
    """rows plus the score of a model (a cross-encoder, say) for each (query, text), in batches on the executors.

    `scorer` takes a list of pairs and returns as many numbers; it must be importable on the executors. Nulls are empty
    texts. Spread the scores with min_max() and rank them with top().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(q or "", t or "") for q, t in zip(b.column(query).to_pylist(), b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(x) for x in scorer(pairs)] if pairs else [], pa.float64())], names=[*b.schema.names, score])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())]))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, query: str, key: str, depth: int = 3) -> DataFrame:
    """One row: share of queries with a relevant key at rank 1, within `depth`, and the mean reciprocal rank (0 beyond it).

    relevant: (query, key). Queries without any relevant key count as misses.
    """
    first = ranked.filter(F.col("rank") <= depth).join(relevant.select(query, key), [query, key], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))
    rows = relevant.select(query).distinct().join(first, query, "left")
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)), 6).alias("hit_1"), F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


def cosine_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int) -> DataFrame:
    """(query, key, score, rank): nearest vectors by cosine for a stated query set, against all rows.

    The queries are counted and taken in blocks of about BLOCK_VECTORS, each one array; every row meets a block within its
    own task, and k per query leave each partition, so pairs never move. Any number of queries can be asked.
    """
    blocks = -(-queries.count() // BLOCK_VECTORS) or 1
    if blocks > 1:
        parts = [queries.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) for b in range(blocks)]
        return functools.reduce(DataFrame.unionAll, [_cosine_block(vectors, key, vector, p, query, query_vector, k) for p in parts])
    return _cosine_block(vectors, key, vector, queries, query, query_vector, k)


def _cosine_block(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int) -> DataFrame:
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))
    held = queries.select(F.collect_list(F.struct(F.col(query).alias("q"), unit(F.col(query_vector)).alias("qv")))).scalar()
    rows = vectors.select(key, unit(F.col(vector)).alias("v")).select(key, "v", F.explode(held).alias("x"))
    dot = F.aggregate(F.zip_with("v", "x.qv", lambda a, b: a * b), F.lit(0.0), lambda a, y: a + y)
    scored = rows.select(F.col("x.q").alias(query), key, F.round(dot, 9).alias("score")).filter(F.col(query) != F.col(key))
    return top(scored, query, key, k)


# -- answers, citations, metrics -----------------------------------------------------------------------------------------
# A run is one row: query, response, retrieved array<struct<chunk_id, path, first, last, function, docstring, content>>.

#: Words that carry no meaning for grounding.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "to", "of", "and", "in", "for", "on", "with", "this", "that", "it")


def chunk_struct() -> Column:
    return F.struct("chunk_id", F.col("file_path").alias("path"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("function_name").alias("function"), "docstring", "content")


def _tag(c: Column) -> Column:
    return C.citation_tag(c["path"], c["first"], c["last"], c["chunk_id"])


def context_prompt(query: Column, retrieved: Column) -> Column:
    """The prompt of a query over its numbered chunks, each headed by its citation tag."""
    def block(c: Column, i: Column) -> Column:
        lines = F.concat(
            F.lit("File: "), c["path"], F.lit(" (Lines "), c["first"].cast("string"), F.lit("-"), c["last"].cast("string"), F.lit(")\n"), F.when(C.or_empty(c["function"]) != "", F.concat(F.lit("Function: "), c["function"], F.lit("\n"))).otherwise(""),
            F.when(C.or_empty(c["docstring"]) != "", F.concat(F.lit("Docstring: "), c["docstring"], F.lit("\n"))).otherwise(""), F.lit("Code:\n```python\n"), c["content"], F.lit("\n```"),
        )
        return F.concat(F.lit("--- CHUNK "), (i + 1).cast("string"), F.lit(" --- "), _tag(c), F.lit("\n"), lines)

    return F.concat(F.lit("Answer from the context only and end every statement with its citation tag.\n\nCONTEXT:\n"), F.array_join(F.transform(retrieved, block), "\n\n"), F.lit("\n\nQUERY:\n"), query)


def fallback_answer(retrieved: Column) -> Column:
    """A cited answer without a model: one finding per chunk. Null for an empty set."""
    def finding(c: Column) -> Column:
        what = F.when(C.or_empty(c["function"]) != "", F.concat(F.lit("function `"), c["function"], F.lit("`"))).otherwise(F.concat(F.lit("code block in `"), c["path"], F.lit("`")))
        doc = F.when(C.or_empty(c["docstring"]) != "", F.concat(F.lit(" with docstring '"), c["docstring"], F.lit("'"))).otherwise("")
        return F.concat(F.lit("- Extracted "), what, doc, F.lit(" across lines "), c["first"].cast("string"), F.lit("-"), c["last"].cast("string"), F.lit(". "), _tag(c))

    head = F.element_at(retrieved, 1)
    return F.when(F.size(retrieved) > 0, F.concat(F.lit("### Findings\n\n"), F.array_join(F.transform(retrieved, finding), "\n"), F.lit("\n\nThe implementation in `"), head["path"], F.lit("` was read for its contract. "), _tag(head)))


def valid_citation(citation: Column, retrieved: Column) -> Column:
    """Whether a citation names a retrieved chunk: by its id, or by a path that is, or is part of, the chunk's and a range of
    lines within it."""
    return F.exists(
        retrieved,
        lambda c: F.coalesce(c["chunk_id"] == citation["chunk_id"], F.lit(False)) | (F.contains(c["path"], citation["path"]) & (c["first"] <= citation["first"]) & (c["last"] >= citation["last"])),
    )


def answer_segments(response: Column) -> Column:
    """The answer as an array of (kind, value): texts between citation tags and the tags' labels, in order; empty texts are
    left out. A null answer has none."""
    tag = r"\[Source:\s*[^\]]+\]"
    texts, tags = F.split(C.or_empty(response), tag), F.regexp_extract_all(C.or_empty(response), F.lit(tag), F.lit(0))
    label = F.transform(tags, lambda t: F.struct(F.lit("citation").alias("kind"), F.regexp_replace(t, r"\[Source:\s*|\s*\]", "").alias("value")))
    text = F.transform(texts, lambda t: F.struct(F.lit("text").alias("kind"), t.alias("value")))
    woven = F.flatten(F.zip_with(text, label, lambda t, c: F.array_compact(F.array(t, c))))
    return F.filter(woven, lambda x: (x["kind"] == "citation") | (x["value"] != ""))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, their files, mean length of the contents; 0, 0 and null for an empty table."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file_path").alias("n_files"), F.round(F.avg(F.length("content")), 4).alias("avg_length"))


def recent(runs: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last n runs; the limit is applied before anything is shuffled."""
    return runs.orderBy(F.desc(order)).limit(n)


def uncited_paragraphs(response: Column) -> Column:
    paragraphs = F.transform(F.split(C.or_empty(response), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.size(F.filter(paragraphs, lambda p: (F.length(p) > 40) & ~p.startswith("#") & ~p.rlike(C.CITATION))).cast("bigint")


def injected(response: Column, retrieved: Column) -> tuple[Column, Column]:
    """(text, n): the response with the first chunk's tag after every line that has text, is no heading and has no tag; for
    responses without any tag and a set that is not empty, else unchanged with 0."""
    lines = F.split(C.or_empty(response), "\n")
    needs = lambda x: ~C.is_blank(x) & ~C.stripped(x).startswith("#") & ~x.rlike(C.CITATION)
    wanted = ~C.or_empty(response).rlike(C.CITATION) & (F.size(retrieved) > 0)
    tag = _tag(F.element_at(retrieved, 1))
    text = F.when(wanted, F.array_join(F.transform(lines, lambda x: F.when(needs(x), F.concat(x, F.lit(" "), tag)).otherwise(x)), "\n")).otherwise(C.or_empty(response))
    return text, F.when(wanted, F.size(F.filter(lines, needs))).otherwise(0).cast("bigint")


def citation_stats(runs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, total and valid citations, uncited paragraphs, rate, and whether the rate is at least 0.75 over some.
    Responses without a tag count the tags that injected() would add."""
    cites = C.citations(F.col("response"))
    rows = runs.withColumn("_c", cites).withColumn("_n", F.size("_c")).withColumn("_v", F.size(F.filter("_c", lambda c: valid_citation(c, F.col("retrieved"))))).withColumn("_i", injected(F.col("response"), F.col("retrieved"))[1])
    total, valid = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_i")).cast("bigint"), F.when(F.col("_n") > 0, F.col("_v")).otherwise(F.col("_i")).cast("bigint")
    out = rows.select(*keep, total.alias("total_citations"), valid.alias("valid_citations"), uncited_paragraphs(F.col("response")).alias("uncited_paragraphs"))
    rate = F.round(C.ratio(F.col("valid_citations"), F.col("total_citations")), 4)
    return out.select("*", rate.alias("compliance_rate"), ((C.ratio(F.col("valid_citations"), F.col("total_citations")) >= 0.75) & (F.col("total_citations") > 0)).alias("is_compliant"))


def _chunk_words(retrieved: Column, unicode: bool) -> Column:
    texts = F.transform(retrieved, lambda c: document_text(c["path"], c["function"], c["docstring"], c["content"]))
    return F.array_distinct(C.words(F.array_join(texts, " "), unicode))


def grounding(response: Column, retrieved: Column, unicode: bool = True) -> Column:
    """The share of sentences above 15 characters of whose meaningful words at least 40 % stand in the chunks; 1 without
    sentences, 0 for a blank response or an empty set."""
    sentences = F.filter(F.transform(F.split(C.or_empty(response), r"[.!?]\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 15)
    held = _chunk_words(retrieved, unicode)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def grounded(s: Column) -> Column:
        meant = F.array_except(F.array_distinct(C.words(s, unicode)), stop)
        return (F.size(meant) == 0) | (F.size(F.array_intersect(meant, held)) >= 0.4 * F.size(meant))

    n = F.size(sentences)
    return F.when(C.is_blank(response) | (F.size(retrieved) == 0), 0.0).when(n == 0, 1.0).otherwise(F.size(F.filter(sentences, grounded)) / F.greatest(n, F.lit(1)))


def hit_rate(query: Column, retrieved: Column, unicode: bool = True) -> Column:
    """The share of chunks that hold any word of the query as a substring; 0 for an empty set."""
    terms = F.array_distinct(C.words(query, unicode))
    hit = lambda c: F.exists(terms, lambda t: F.contains(F.lower(document_text(c["path"], c["function"], c["docstring"], c["content"])), t))
    return F.when(F.size(retrieved) == 0, 0.0).otherwise(F.size(F.filter(retrieved, hit)) / F.greatest(F.size(retrieved), F.lit(1)))


def coverage(truth: Column, retrieved: Column, unicode: bool = True) -> Column:
    """The share of the ground truth's words that stand in the contents; 1 without a ground truth, 0 for an empty set."""
    words = F.array_distinct(C.words(truth, unicode))
    held = F.array_distinct(C.words(F.array_join(F.transform(retrieved, lambda c: C.or_empty(c["content"])), " "), unicode))
    return F.when(C.or_empty(truth) == "", 1.0).when(F.size(retrieved) == 0, 0.0).otherwise(F.size(F.array_intersect(words, held)) / F.greatest(F.size(words), F.lit(1)))


def echo(query: Column, response: Column, unicode: bool = True) -> Column:
    """How much of the query's words the response repeats, with a bonus for its length; 0 for a blank response."""
    q, r = F.array_distinct(C.words(query, unicode)), F.array_distinct(C.words(response, unicode))
    overlap = F.size(F.array_intersect(q, r)) / F.greatest(F.size(q), F.lit(1))
    return F.when(C.is_blank(response), 0.0).otherwise(F.least(F.lit(1.0), 0.7 * overlap + 0.3 * F.least(F.lit(1.0), F.size(r) / 30.0)))


def run_metrics(runs: DataFrame, keep: list[str], unicode: bool = True, places: int = 4) -> DataFrame:
    """keep columns and the six metrics of each run, rounded to `places`."""
    stats = citation_stats(runs, [*keep, "query", "response", "retrieved", "ground_truth"])
    g, h, c, e = grounding(F.col("response"), F.col("retrieved"), unicode), hit_rate(F.col("query"), F.col("retrieved"), unicode), coverage(F.col("ground_truth"), F.col("retrieved"), unicode), echo(F.col("query"), F.col("response"), unicode)
    rows = stats.select(*keep, F.round(g, 9).alias("g"), F.col("compliance_rate").alias("c"), F.round(h, 9).alias("h"), F.round(e, 9).alias("e"), F.round(c, 9).alias("t"))
    overall = 0.30 * F.col("g") + 0.25 * F.col("c") + 0.20 * F.col("h") + 0.15 * F.col("e") + 0.10 * F.col("t")
    return rows.select(*keep, F.round("g", places).alias("grounding_ratio"), F.col("c").alias("citation_compliance"), F.round("h", places).alias("retrieval_hit_rate"), F.round("e", places).alias("query_term_echo"), F.round("t", places).alias("ground_truth_coverage"), F.round(F.round(overall, 9), places).alias("composite"))


def benchmark(metrics: DataFrame) -> DataFrame:
    """One row: the means of the six metrics and the number of runs; an empty table gives nulls and 0."""
    names = ("grounding_ratio", "citation_compliance", "retrieval_hit_rate", "query_term_echo", "ground_truth_coverage", "composite")
    return metrics.agg(F.count(F.lit(1)).alias("runs"), *[F.round(F.avg(n), 4).alias(f"avg_{n}") for n in names])
