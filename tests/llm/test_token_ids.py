"""Token ids: parts put together equal the whole, for any text and any cut."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import token_ids as t

ENC = t.encoding()
ALPHABET = ["a", "b", "the", "ing", "é", "ß", "漢", "字", "1", "23", "'", "'s", "'re", "!", "--", "…", " ", "  ", "\n", "\n\n", "\t", "🚀", "<|endoftext|>", "́", "Ω", "x" * 40, " " * 30, "=" * 50, "7" * 30]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60), st.integers(4, 40))
def test_leaves_equal_whole(parts, leaf):
    text = "".join(parts)
    assert "".join(x for x, _ in t.leaves(text, leaf)) == text
    assert t.encode_long(ENC, text, leaf) == ENC.encode_ordinary(text)


def test_unsplit_pieces():
    rng = random.Random(5)
    for kind in ("abcdefghijklmnop", "0123456789", "=-_*#/", "漢字かな混じり文", " ", "\n \t", "ab'", "éüö"):
        for n in (1, 255, 256, 300, 1500, 5000):
            text = "".join(rng.choice(kind) for _ in range(n))
            for around in (text, "x " + text, text + " y", "it's\n\n" + text + "\n\nok", "a\n" + text + "'s"):
                want = ENC.encode_ordinary(around)
                assert t.encode_text(ENC, around) == want
                assert t.encode_long(ENC, around, 100) == want


@pytest.mark.parametrize("leaf", [64, 32_768])
def test_corpus(spark, leaf):
    texts = [None, "", " ", "plain text, it's short", "<|endoftext|> is text", "w" * 700 + " " * 300 + "end", "Größe 漢字 " * 60]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(0, None, "again"), (None, "no id", "x")], "doc_id bigint, text string, ids string")
    got = t.encode_corpus(df, "doc_id", "text", leaf=leaf)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = "no id" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == (ENC.encode_ordinary(want) if want else [])


def test_empty_table(spark):
    assert t.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").collect() == []
