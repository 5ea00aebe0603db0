"""Every core query runs on a small folder; where SQL says the same, results are equal in names, types and values."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canon(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    cursor = duck.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(kinds) == columns
    order = [list(kinds).index(c) for c in columns]
    assert rows == sorted((tuple(canon(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    for c, kind in df.dtypes:
        assert KINDS.get(kind, kinds[c]) == kinds[c], c


@pytest.mark.parametrize("name", ["violation_report", "stats_totals", "doc_health_overall", "claims_by_function", "export_json_report", "line_blocks", "dense_topk", "rate_limiter", "citation_compliance", "go_event_fold", "claims_union_dedupe", "code_graph", "cascade_survivors"])
def test_empty_tables(name, spark, tmp_path):
    for p in FOLDER.glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(tmp_path / p.name))
    rows = catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name == "stats_totals" else 0)
