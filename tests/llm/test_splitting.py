"""Pieces cover the text, keep the limit, overlap as stated, and carry right lines; the table equals a plain search."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import splitting as s


def check(text, limit, overlap):
    spans = s.spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    at, strength = s.places(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert 0 < b - a <= limit and a <= c <= b < d
        piece = text[a:b]
        tail = text[c:b]
        whole = piece.endswith("\n") and (a == 0 or text[a - 1] == "\n" or "\n" in piece[:-1])
        lines = [i for i in range(a, b) if (i == 0 or text[i - 1] == "\n") and b - i <= overlap] if whole else []
        assert tail == (text[min(lines) : b] if lines else piece[len(piece) - min(overlap, len(piece)) :])
    done = 0
    for (a, b) in spans[:-1]:
        inside = (at > done) & (at <= a + limit)
        if inside.any():
            best = strength[inside].max()
            assert b == at[inside][strength[inside] == best].max()
        else:
            assert b >= a + limit - 3 or b == done + 1
        done = b
    assert spans[-1][1] - spans[-1][0] <= limit


LINES = ["def f(a):", "    return 1", "", "\n", "class A:", "    def m(self):", "        x = 1", "}", "/** doc */", "public int f(int a) {", "word " * 12, "x" * 90, "é漢🚀" * 9, "line\r", "  ", "# note"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=60), st.integers(30, 200), st.integers(0, 25))
def test_pieces(parts, limit, overlap):
    text = "\n".join(parts)
    if len(text) > limit:
        check(text, limit, overlap)


def test_table_against_plain_search(monkeypatch):
    monkeypatch.setattr(s, "_STRETCH", 16)
    rng = random.Random(2)
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(1, 400), rng.randint(1, 80))))
        strength = np.array([rng.choice((10, 1000, 2000, 3000)) for _ in at])
        table = s.StrongestCut(at, strength)
        for _ in range(20):
            a = rng.randint(0, 400)
            b = rng.randint(a, 420)
            inside = [(v, p) for p, v in zip(at.tolist(), strength.tolist()) if a <= p <= b]
            assert table.query(a, b) == (max(inside)[1] if inside else None)


def test_prefers_functions():
    body = "    x = 1\n" * 20
    text = f"import a\n\n@deco\ndef f():\n{body}\n# about g\ndef g():\n{body}\ndef h():\n{body}"
    ends = [text[b:].split("\n")[0] for _, b in s.spans(text, 400, 0)[:-1]]
    assert ends == ["# about g", "def h():"]


def test_rejects_overlap_above_limit():
    with pytest.raises(ValueError):
        s.spans("abc", 10, 10)


def test_table_rows(spark):
    long = "".join(f"line {i} of the text\n" for i in range(300))
    rows = [("a", long, 10), ("b", "short", 1), ("c", None, 1), ("d", "", 1), ("e", "漢" * 2000, 1), ("f", "漢" * 2001, 1), ("g", long, None), (None, long, 1), ("a", long, 10), ("h", "x" * 300_000, 7)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, start_line int").selectExpr("*", "1 as piece_no", "'x' as key")
    got = s.split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {"a", "f", "g", "h", None}
    a = sorted({(r.piece_no, r.start_line, r.end_line, r.content, r.start_char) for r in got if r.chunk_id == "a"})
    assert a[0][1] == 10 and a[-1][2] == 309
    for _, first, last, content, offset in a:
        assert content.split("\n")[0] == f"line {first - 10} of the text" and last - first + 1 == content.count("\n")
        assert long[offset : offset + len(content)] == content
    assert all(r.start_line is None and r.end_line is None for r in got if r.chunk_id == "g")
    assert s.split_oversized(df.limit(0)).collect() == []


def test_short_pieces_only_where_nothing_else_keeps_the_code_whole():
    body = "    x = 1\n" * 12
    text = f"import a\nimport b\n\ndef f():\n{body}\ndef g():\n{body}\ndef h():\n{body}"
    assert {e - a < 100 for a, e in s.spans(text, 300, 0, 100)[:-1]} == {False}
    late = "import a\n\ndef f():\n" + "    x = 1\n" * 80  # one function, longer than the limit, behind its imports
    assert s.spans(late, 300, 0, 100)[0] == (0, 10)
    assert s.spans("word " + "x" * 500, 300, 0, 100)[0] == (0, 5)
    with pytest.raises(ValueError):
        s.spans(text, 100, 10, 101)


def test_time_grows_with_the_text():
    took = []
    for n in (60_000, 120_000):
        batch = pa.record_batch([["k"], ["x = 1 + 2 # a line\n" * n], [1]], names=["key", "content", "start_line"])
        began = time.perf_counter()
        (out,) = s._pieces(2000, 200, 500)([batch])
        took.append(time.perf_counter() - began)
        assert out.column("end_line")[-1].as_py() == n and out.column("start_line")[1].as_py() > 1
    assert took[1] < 2.5 * took[0] + 0.3
