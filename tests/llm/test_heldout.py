"""Held-out passages: every shared span of 12 words is found, none shorter is reported."""

import random

import numpy as np

from plumbline.llm import heldout as h


def longest(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def brute(docs, items, least=12):
    return {(d, i, n) for d, t in docs for i, p in items if d is not None and i is not None and (n := longest(h.words_of(t), h.words_of(p))) >= least}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "été", "x1"]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(25)]
    items += [("same", items[3][1]), ("none", None), ("empty", ""), (None, items[0][1]), ("loop", "a b " * 20)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            p = h.words_of(rng.choice(items[:25])[1])
            n = rng.randint(8, 20)
            s = rng.randrange(max(1, len(p) - n))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [x.upper() for x in p[s : s + n]]
        docs.append((d, rng.choice([" ", ", ", "_", "\n"]).join(words)))
    docs += [(900, None), (901, ""), (902, "a b " * 30), (None, items[0][1]), (903, items[3][1] + "!"), (903, "again"), (904, items[1][1] * 200)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as fp", "1 as pos")
    held = spark.createDataFrame(items, "item_id string, passage string").selectExpr("*", "'x' as key")
    got = {tuple(r) for r in h.leaks(corpus, "doc_id", "text", held, "item_id", "passage").collect()}
    assert got == brute(docs, items)
    assert any(n == 12 for _, _, n in got)


def test_guarantee_of_the_window():
    rng = np.random.default_rng(1)
    for _ in range(300):
        span = rng.integers(0, 2**63, 12).astype(np.uint64)
        texts = [np.concatenate((rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64), span, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64))) for _ in range(2)]
        marks = [set(h.winnow(t, np.array([len(t)]), 6, 7)[1].tolist()) for t in texts]
        assert marks[0] & marks[1]


def test_empty_tables(spark):
    docs, held = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id string, passage string")
    some = spark.createDataFrame([(1, "a " * 20)], "doc_id bigint, text string")
    assert h.leaks(docs, "doc_id", "text", held, "item_id", "passage").collect() == []
    assert h.leaks(some, "doc_id", "text", held, "item_id", "passage").collect() == []
