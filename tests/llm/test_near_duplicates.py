"""The similarity join against brute force: random families, a hot family, copies, nulls, ties."""

import itertools
import random

import numpy as np
import pytest

from plumbline.llm import near_duplicates as n


def brute(rows, threshold, size):
    sets = {i: frozenset(zip(*[n.words_of(t)[k:] for k in range(size)])) for i, t in rows if i is not None}
    found = set()
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if both / (len(x) + len(y) - both) >= threshold:
            found.add((a, b))
    return found


def corpus(rng, hot):
    words = [f"w{i}" for i in range(900)]
    doc = lambda k: [rng.choice(words) for _ in range(k)]
    rows, base = [], doc(120)
    for i in range(hot):  # one family of near copies holds much of the table
        d = list(base)
        for _ in range(rng.randint(0, 11)):
            d[rng.randrange(len(d))] = rng.choice(words)
        rows.append((f"hot{i}", " ".join(d)))
    rows += [(f"copy{i}", " ".join(base).upper()) for i in range(hot // 3)]
    for f in range(40):
        b = doc(rng.randint(2, 160))
        for k in range(3):
            d = list(b)
            for _ in range(int(len(d) * rng.choice((0, 0.02, 0.05, 0.08)))):
                d[rng.randrange(len(d))] = rng.choice(words)
            rows.append((f"f{f}_{k}", " ".join(d)))
    return rows + [("null", None), ("empty", ""), ("blank", "  \n"), ("two", "only two"), (None, " ".join(base)), ("loop", "a b c " * 3000), ("loop2", "a b c " * 2999)]


def table(spark, rows):
    # the text in two columns; columns that clash with the join's own names
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "id string, source string, docstring string")
    return df.union(df.limit(25)).selectExpr("*", "1 as rid", "'x' as key", "2 as path")


def test_pairs_equal_brute_force(spark):
    rows = corpus(random.Random(11), 90)
    join = n.NearDuplicates(table(spark, rows), "id", ["source", "docstring"], 0.7, 3, bucket=12)
    got = [tuple(r) for r in n.expand_pairs(join.pairs(), join.members(), part=9).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert set(got) == brute([(i, (t or "") + " ") for i, t in rows], 0.7, 3)


def test_groups(spark):
    rows = corpus(random.Random(12), 20)
    join = n.NearDuplicates(table(spark, rows), "id", ["source", "docstring"], 0.7, 3)
    got = {r.id: r for r in n.groups(join).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute([(i, (t or "") + " ") for i, t in rows], 0.7, 3):
        parent[root(a)] = root(b)
    members = {}
    for i in got:
        members.setdefault(root(i), set()).add(i)
    for group in members.values():
        assert {got[i].group_id for i in group} == {min(got[i].class_id or i for i in group)}
    assert got["null"].class_id is None and got["null"].n_links == 0
    assert got["copy0"].class_id == got["copy1"].class_id


def test_default_is_five_words_and_point_eight():
    join = n.NearDuplicates.__init__.__defaults__
    assert join[:2] == (0.8, 5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, source string")
    join = n.NearDuplicates(df, "id", ["source"], 0.7, 3)
    assert n.expand_pairs(join.pairs(), join.members()).collect() == [] and n.groups(join).collect() == []


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.7, 0.9):
        hits = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(400 * share)).astype(np.uint64)
            rest = [rng.integers(0, 2**63, (400 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
            sets = [np.concatenate((both, r)) for r in rest]
            sig = n.minhashes(np.concatenate(sets), np.array([len(s) for s in sets]))
            hits.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(hits) - share) < 0.04


@pytest.mark.parametrize("target", [0.9, 0.99, 0.999])
def test_runs_reach_the_target(target):
    for depth in (1, 2, 3):
        runs = n.runs_for(target, 0.7, 2.0, depth)
        assert 1 - (1 - n.run_success(0.7, 2.0, depth)) ** runs >= target
        assert runs == 1 or 1 - (1 - n.run_success(0.7, 2.0, depth)) ** (runs - 1) < target


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    pairs, nodes = spark.createDataFrame(edges, "ra bigint, rb bigint"), spark.createDataFrame([(i,) for i in range(201)], "rid bigint")
    parent = list(range(201))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.rid: r.component for r in n.components(pairs, nodes).collect()} == {i: root(i) for i in range(201)}


@pytest.mark.parametrize("depth", [1, 3, 4, 8])
def test_runs_reach_the_target_over_the_agreeing_positions(depth):
    runs = n.runs_needed(0.999, 0.7, 2.0, depth)
    assert n.expected_recall(runs, 0.7, 2.0, depth) >= 0.999 > n.expected_recall(runs - 1, 0.7, 2.0, depth)
    assert runs >= n.runs_needed(0.999, 0.7, 2.0, 1)


def test_large_classes_and_dense_families_in_parts(spark):
    words = [f"w{k}" for k in range(40)]
    family = [" ".join([*words[:20], f"x{k}", *words[20:]]) for k in range(60)]  # all alike, all different
    rows = [(f"a{k:03}", " ".join(words)) for k in range(70)] + [(f"b{k:03}", t) for k, t in enumerate(family)] + [("z", "nothing like the others at all here")]
    df = spark.createDataFrame(rows, "id string, source string")
    join = n.NearDuplicates(df, "id", ["source"], 0.7, 3, bucket=8, dense_block=16)
    got = [tuple(r) for r in n.expand_pairs(join.pairs(), join.members(), part=9).collect()]
    assert len(got) == len(set(got)) and set(got) == set(brute(rows, 0.7, 3)) and len(got) > 8000
