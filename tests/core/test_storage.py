"""Sources, sinks and streams on files."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from plumbline.operators import reports
from plumbline.sources import files, sinks
from plumbline.streaming import ingestion, limits, status


def test_folders_and_archives(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "y.py").write_text("y" * 50)
    (tmp_path / "z.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.folder(spark, str(tmp_path), most=40).collect()}
    assert set(rows) == {"x.py", "y.py"} and rows["x.py"].source == "x = 1�\n" and rows["y.py"].error == "too large" and rows["y.py"].source is None
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("src/a.py", "a = 1")
        z.writestr("src/b.GO", "package b")
        z.writestr("__meta.py", "no")
        z.writestr("src/__pycache__/c.py", "no")
        z.writestr("src/d.md", "no")
        z.writestr("src/", "")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = files.archives(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.language, r.error) for r in got if r.path) == [("src/a.py", "python", None), ("src/b.GO", "go", None)]
    assert [r.error for r in got if r.archive.endswith("bad.zip")] == ["no archive"]
    assert [r.error for r in files.archives(spark, str(tmp_path), most_files=1).collect() if r.archive.endswith("ok.zip")] == ["too many files"]
    assert files.in_memory(spark, {"a.rs": "é"}).collect()[0].bytes == 2 and files.pasted(spark, "x").collect()[0].language == "python"


def _model(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("a", "f.py", "bedrock", "complete", 1, 2, 1, 0.5, "python", t, t), ("b", None, "bedrock", "pending", 0, 0, 0, 0.0, None, t, None)], "id string, filename string, llm_provider string, status string, total_functions int, total_claims int, total_violations int, bcv_rate double, language string, created_at timestamp, completed_at timestamp")
    f = spark.createDataFrame([("f", "a", 'na"me', None)], "id string, analysis_id string, name string, signature string")
    c = spark.createDataFrame([("c1", "f", "RSV", "s", "p", None, 3, "Returns, a list"), ("c2", "f", "CCV", "s", "p", "if x", 4, "linear")], "id string, function_id string, category string, subject string, predicate_object string, conditionality string, source_line int, raw_text string")
    v = spark.createDataFrame([("v1", "c1", "fail", "code", None, "1", "2", 5.0)], "id string, claim_id string, outcome string, test_code string, traceback string, expected string, actual string, execution_time_ms double")
    return a, f, c, v


def test_exports(spark, tmp_path):
    a, f, c, v = _model(spark)
    rows = reports.violation_rows(f, c, v)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    (r,) = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert (r.row_no, r.function_name, r.claim_text, r.has_test_code, r.has_traceback, r.analysis_id) == ("1", 'na"me', "Returns, a list", "yes", "no", "a")
    sinks.write_json(a, rows, str(tmp_path / "json"))
    made = {d["analysis"]["id"]: d for d in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "json")).collect())}
    assert made["a"]["summary"]["bcv_rate_percentage"] == "50.0%" and made["a"]["violations"][0]["claim_text"] == "Returns, a list" and made["b"]["analysis"]["language"] == "python" and made["b"]["violations"] is None
    sinks.write_text(a, rows, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).filter("value = 'RISK HIGH'").count() == 1
    pdf = sinks.pdf_report(a, rows, "a")
    assert b"VIOLATION #1" in pdf and b"RISK HIGH" in pdf
    counted = {x.id: x for x in reports.with_counters(a, f, c, v).collect()}
    assert (counted["a"].total_functions, counted["a"].total_claims, counted["a"].total_violations, counted["a"].bcv_rate) == (1, 2, 1, 1.0)
    sinks.append(v, str(tmp_path / "v"))
    sinks.append(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_ingestion_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x = 1\n")
    (tmp_path / "in/b.py").write_text("def (\n")
    (tmp_path / "in/c.txt").write_text("x")
    (tmp_path / "in/d.js").write_text(" \n")
    (tmp_path / "in/e.py").write_bytes(b"# " + b"x" * 5_000_000)
    (tmp_path / "in/f.bin").write_bytes(b"x" * 5_000_000)
    q = ingestion.watch(spark, str(tmp_path / "in"), str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert [(r.path.rsplit("/", 1)[1], r.source) for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [("a.py", "x = 1\n")]
    assert sorted((r.path.rsplit("/", 1)[1], r.error) for r in spark.read.parquet(str(tmp_path / "no")).collect()) == [("b.py", "syntax"), ("c.txt", "unsupported"), ("d.js", "empty"), ("e.py", "too large"), ("f.bin", "unsupported")]


def test_streams_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], i, t0 + dt.timedelta(seconds=4 * i), ("pending", "bce_running", "failed")[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, t timestamp, status string").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    limited = limits.rate_limited_stream(stream, "k", "t", "i", 30, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    limited.awaitTermination(120)
    got = {(r.k, r.i): r.accepted for r in spark.table("limited").collect()}
    assert got == {(r.k, r.i): r.accepted for r in limits.rate_limited(df, "k", "t", "i", 30, 2).collect()}
    last = status.latest_stream(stream, "k", "status", "t", "i").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    last.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest").collect()), key=str) == sorted(map(tuple, status.latest(df, "k", "status", "t", "i").collect()), key=str)
    steps = status.checked_steps(df.filter(F.col("k") == "a"), "k", "status", "t", "i").orderBy("i").collect()
    assert steps[0].legal and not all(s.legal for s in steps)
    assert status.transitions(spark).count() == 12
