"""Functions of the library that no query calls, or that a query only calls in part."""


import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import extract, graph, ingest, prompts, reports, retrieval, verify
from plumbline.sources import files, sinks
from plumbline.streaming import status


def test_functions_in_strings_do_not_count(spark):
    texts = [("a", 'def f():\n    """Example:\n\n    def g(x): ...\n    """\n\nclass C:\n    async def h(self):\n        pass\n', "python"), ("b", "def (", "python"), ("c", "x = 1\n", "python"), ("d", "const f = () => 1;\nfunction g() {}\n", "javascript"), ("e", None, None), ("f", "def f\nend\n", "ruby")]
    df = spark.createDataFrame(texts, "id string, source string, language string")
    got = {r.id: r.n for r in extract.all_function_counts(df, "id", "source", "language").collect()}
    assert got == {"a": 2, "b": 1, "c": 0, "d": 2, "e": 1, "f": 1}
    none = spark.createDataFrame([], "id string, analysis_id string")
    claims, violations = spark.createDataFrame([], "id string, function_id string"), spark.createDataFrame([], "claim_id string, outcome string")
    health = {r.analysis_id: r for r in reports.analysis_health(df, none, claims, violations, extract.all_function_counts(df, "id", "source", "language")).collect()}
    assert health["a"].functions == 2 and health["a"].coverage == 0 and health["c"].functions == 0 and health["c"].health == 0


def test_retries_wait_longer_each_time():
    slept, calls = [], []

    def fails(times):
        calls.append(1)
        if len(calls) <= times:
            raise OSError("busy")
        return "ok"

    assert prompts.retried(lambda: fails(3), 5, 10, sleep=slept.append) == "ok" and slept == [10, 20, 40]
    calls.clear(), slept.clear()
    with pytest.raises(OSError):
        prompts.retried(lambda: fails(9), 3, 1, sleep=slept.append)
    assert slept == [1, 2]
    with pytest.raises(KeyError, match="no provider"):
        prompts.PROVIDERS.require("none")


def test_polling_ends_with_a_terminal_status():
    seen = iter(["pending", "bce_running", "complete", "never read"])
    slept = []
    assert status.until_terminal(lambda: next(seen), 2, sleep=slept.append) == "complete" and slept == [2, 2]
    assert status.until_terminal(lambda: "pending", 2, limit=5, sleep=slept.append) == "pending"


def test_segments_of_an_answer(spark):
    rows = [(1, "One [Source: a.py:3-4 | ID: x] two.[Source: b.py:1]"), (2, ""), (3, None), (4, "[Source: a.py:1]"), (5, "plain")]
    got = {r.i: [tuple(x) for x in r.s] for r in spark.createDataFrame(rows, "i int, t string").select("i", retrieval.answer_segments(F.col("t")).alias("s")).collect()}
    assert got == {1: [("text", "One "), ("citation", "a.py:3-4 | ID: x"), ("text", " two."), ("citation", "b.py:1")], 2: [], 3: [], 4: [("citation", "a.py:1")], 5: [("text", "plain")]}


def test_a_models_scores(spark):
    rows = spark.createDataFrame([("q", "a", "one two"), ("q", "b", None), ("q", "c", "one")], "query string, key string, text string").coalesce(1)
    scored = retrieval.scored_by(rows, lambda pairs: [len(t) for _, t in pairs], "query", "text")
    got = {r.key: r.model_score for r in retrieval.min_max(scored, "query", "model_score").collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 3 / 7}


def test_query_sets_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5}") for i in range(40)], "chunk_id int, content string")
    terms = retrieval.query_terms(spark.createDataFrame([(i, f"word{i} other{i}") for i in range(9)], "item_id int, query string"), "item_id", "query")
    whole = sorted(map(tuple, retrieval.overlap_scores(docs, terms, "chunk_id", "content", "item_id").collect()))
    vectors = spark.createDataFrame([(i, [float(i % 3 + 1), float(i % 5), 1.0]) for i in range(60)], "vec_id int, e array<double>")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("e").alias("qe"))
    near = sorted(map(tuple, retrieval.cosine_top(vectors, "vec_id", "e", asked, "query_id", "qe", 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", 4)
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 7)
    assert sorted(map(tuple, retrieval.overlap_scores(docs, terms, "chunk_id", "content", "item_id").collect())) == whole
    assert sorted(map(tuple, retrieval.cosine_top(vectors, "vec_id", "e", asked, "query_id", "qe", 3).collect())) == near and len(near) == 180


def test_store_keeps_the_counters(spark, tmp_path):
    a = spark.createDataFrame([("a", 0, 0, 0, 0.0), ("b", 7, 7, 7, 0.5)], "id string, total_functions int, total_claims int, total_violations int, bcv_rate double")
    f = spark.createDataFrame([("f", "a", "g"), ("h", "a", "k")], "id string, analysis_id string, name string")
    c = spark.createDataFrame([("c1", "f", "Returns x"), ("c2", "f", "Raises y")], "id string, function_id string, raw_text string")
    kept = {r.id: r for r in sinks.store_functions(a, f, c, str(tmp_path)).collect()}
    assert (kept["a"].total_functions, kept["a"].total_claims) == (2, 2) and kept["b"].total_functions == 7
    results = spark.createDataFrame([("g", "Returns x", "fail"), ("g", "Raises y", "pass"), ("g", "unknown", "fail")], "function_name string, raw_text string, outcome string")
    done = sinks.store_results(a, f, c, results, str(tmp_path))
    got = {r.id: r for r in done.collect()}
    assert spark.read.parquet(str(tmp_path / "violations")).count() == 2 and got["a"].total_violations == 1 and got["a"].bcv_rate == 0.5
    sinks.upsert(a.select("id", "total_claims"), spark.createDataFrame([("a", 3), ("z", 1)], "id string, total_claims int"), "id", str(tmp_path / "next"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "next")).collect())) == [("a", 3), ("b", 7), ("z", 1)]


def test_log_readers_by_language(spark):
    assert verify.LOGS.keys() == ["go", "java", "javascript", "python", "rust", "typescript"]
    logs = spark.createDataFrame([("k", '[{"nodeid": "t::a", "outcome": "passed", "duration": 1.0}]')], "key string, log string")
    assert [r.nodeid for r in verify.text_results(logs, "key", "log", "python").collect()] == ["t::a"]
    with pytest.raises(KeyError, match="no log reader"):
        verify.text_results(logs, "key", "log", "cobol")


def test_sample_modes_and_nodes(spark):
    rows = extract.functions(files.sample(spark), "path", "source", "language").collect()
    assert [r.name for r in rows] == ["merged", "ratio", "flat"] and all(r.docstring for r in rows)
    names = spark.createDataFrame([("a.zip", "x"), ("a.py", ""), (None, "x = 1"), ("", " ")], "f string, s string")
    assert [r.m for r in names.select(ingest.upload_mode(F.col("f"), F.col("s")).alias("m")).collect()] == ["archive", "file", "paste", "nothing"]
    nodes = spark.createDataFrame([("a", "function:f:1", "function", "f"), ("a", "class:f:9", "class", "f"), ("b", "function:f:1", "function", "f")], "analysis_id string, node string, type string, name string")
    f = spark.createDataFrame([("1", "a", "f"), ("2", "a", "f")], "id string, analysis_id string, name string")
    c = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2")], "id string, function_id string")
    assert sorted((r.analysis_id, r.n_claims) for r in graph.nodes_with_claims(nodes, f, c).collect()) == [("a", 3), ("b", 0)]


def test_scope_removes_what_was_written(spark):
    with session.scope():
        df = session.written(spark.range(5).toDF("i"), "scoped")
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 5
    import os

    assert not os.path.exists(path)


def test_hot_keys_are_numbered_and_collected_in_parts(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i % 5}", i % 7, i) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, o int, id int")
    plain = sorted(map(tuple, reports.number_within(df, "key", ["o", "id"], "n").collect()))
    monkeypatch.setattr(reports, "HOT_ROWS", 10)
    assert sorted(map(tuple, reports.number_within(df, "key", ["o", "id"], "n", parts=8).collect())) == plain
    assert reports.number_within(df.limit(0), "key", ["o", "id"], "n").collect() == []
    claims = df.selectExpr("cast(id as string) id", "key as function_id", "o as source_line", "'RSV' category", "'s' subject", "'p' predicate_object", "cast(null as string) conditionality", "'r' raw_text")
    parts = reports.claims_in_parts(claims, most=50).collect()
    assert sum(len(r.claims) for r in parts) == 900 and max(len(r.claims) for r in parts) == 50
    hot = [c.source_line for r in sorted((r for r in parts if r.function_id == "hot"), key=lambda r: r.part_no) for c in r.claims]
    assert hot == sorted(hot) and len(hot) == 600
