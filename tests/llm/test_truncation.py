"""Cut values: how endings are read, and that limits in hidden units come out."""

import random

import pytest

from plumbline.llm import truncation as t

ENDINGS = [
    ("", t.COMPLETE), ("True", t.COMPLETE), ("12.5", t.EITHER), ("a new step", t.EITHER), ("ValueError is raised", t.EITHER), ("[1, 2]", t.COMPLETE), ("[0.40 0.83 ... 0.39]", t.COMPLETE), ("'playlist...'", t.COMPLETE), ("{}", t.COMPLETE),
    ("[1, 2", t.OPEN), ('{"a": [1, 2], "b"', t.OPEN), ("('a', 'b", t.OPEN), ("KeyError('no [ left')", t.COMPLETE), ("KeyError(\"no", t.OPEN), ("'it\\'s'", t.COMPLETE), ("'it\\'", t.OPEN), ("<Row object at 0x1>", t.COMPLETE), ("<Row obj", t.OPEN),
    ("Keeps the order of rows.", t.COMPLETE), ("Keeps the order of ro", t.OPEN), ("It was left behind!", t.COMPLETE), ("Keeps the order. Runs in O(n)", t.OPEN), ("Returns a copy of `inde`", t.OPEN), ("Keeps the order [truncated]", t.OPEN), ("Keeps the order…", t.OPEN),
    ("Keeps the order of rows. Gr�", t.OPEN), ("Keeps the order of ", t.OPEN), ("[1, 2, 3...", t.OPEN), ("'a' is not 'b'.", t.COMPLETE), ("返回新的列表。", t.COMPLETE), ("(see above) Keeps the order of rows.", t.COMPLETE), ('"""text"""', t.COMPLETE),
]


@pytest.mark.parametrize("value,want", ENDINGS)
def test_ending(value, want):
    assert t.ending(value) == want


def test_any_cut_of_a_literal_is_open():
    for whole in ("[1, (2, 'x]'), {'k': \"v)\"}]", "ValueError(\"it's [here\")", "{'a': [1, 2], 'b': 'c\\'d'}"):
        assert t.ending(whole) == t.COMPLETE
        for n in range(12, len(whole)):
            assert t.ending(whole[:n]) == t.OPEN, whole[:n]


def test_units(spark):
    v = 'a&<"\'\\\n\tü漢🚀\r\n'
    df = spark.createDataFrame([(v,)], "v string").select(*[c.alias(k) for k, c in t.units(t.F.col("v")).items()])
    import html
    import json

    got = df.collect()[0].asDict()
    assert got == {"characters": len(v), "utf8_bytes": len(v.encode()), "utf16_units": len(v.encode("utf-16-le")) // 2, "entity_escaped": len(html.escape(v).replace("&#x27;", "&#39;")), "json_escaped": len(json.dumps(v, ensure_ascii=False)) - 2, "json_ascii": len(json.dumps(v)) - 2, "crlf": len(v.replace("\r\n", "\n").replace("\n", "\r\n"))}


def test_hidden_limit(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        whole = " ".join(f"Größe {rng.randint(1, 99)} für Spalte statt {rng.randint(1, 99)}." for _ in range(rng.randint(1, 8)))
        rows.append((str(i), whole, whole.encode()[:120].decode(errors="ignore"), "w" * 120 if i % 100 == 0 else None))
    rows += [("0", *rows[0][1:]), ("x", "", " ", None), ("y", "k" * 100_000, None, "z" * 120)]
    df = spark.createDataFrame(rows, "id string, whole string, cut string, other string").selectExpr("*", "1 as size", "'q' as ending")
    join = t.Truncation(df, "id", ["whole", "cut", "other"])
    limits = {(r.field_name, r.unit, r.size) for r in join.limits().collect()}
    assert ("cut", "utf8_bytes", 120) in limits and not any(f != "cut" for f, _, _ in limits)
    want = {(i, "cut") for i, w, c, _ in rows if w and c and c != w and t.ending(c) == t.OPEN}
    got = [tuple(r) for r in join.cut().collect()]
    assert set(got) == want and len(got) == len(set(got))
    empty = t.Truncation(df.limit(0), "id", ["whole"])
    assert empty.cut().collect() == [] and empty.limits().collect() == []


def limited(spark, hot, ids):
    """Sentences cut at 60 characters and phrases of 60 that fill the limit; one value more in most rows."""
    rng = random.Random(3)
    rows = [(str(i), " ".join(f"Column {rng.randint(1, 99)} has {rng.randint(1, 99)} nulls." for _ in range(rng.randint(1, 6)))[:60]) for i in range(300)]
    rows += [("either", "Longphrase" + "x" * 50)] + [(ids(k), hot) for k in range(6000)]
    return t.Truncation(spark.createDataFrame(rows, "id string, v string"), "id", ["v"])


def test_a_whole_value_in_most_rows_hides_no_limit(spark):
    hot = "Keeps the order of rows and columns as they were delivered.."
    assert len(hot) == 60 and t.ending(hot) == t.COMPLETE
    found = limited(spark, hot, lambda k: f"h{k}")
    assert ("characters", 60) in {(r.unit, r.size) for r in found.limits().collect()}
    assert "either" in {r.id for r in found.cut().collect()}


@pytest.mark.parametrize("ids", [lambda k: f"h{k}", lambda k: "h"])
def test_a_cut_value_in_most_rows_makes_no_limit(spark, ids):
    found = limited(spark, "Keeps the order of rows and of colum", ids)
    limits = {(r.unit, r.size) for r in found.limits().collect()}
    assert ("characters", 60) in limits and not any(size == 36 for _, size in limits)
    assert ("h" if ids(1) == "h" else "h7") in {r.id for r in found.cut().collect()}


def test_only_the_limit_decides_phrases_and_numbers(spark):
    rng = random.Random(4)
    rows = [(str(i), " ".join(f"Column {rng.randint(1, 99)} has {rng.randint(1, 99)} nulls." for _ in range(rng.randint(1, 6)))[:60]) for i in range(300)]
    phrase, whole, number = "Longphrase" + "x" * 50, "Keeps the order of rows and columns as they were delivered..", "7" * 60
    rows += [("at", phrase), ("number", number), ("below", phrase[:58]), ("whole", whole), ("marked", "Keeps the order of rows and columns as they came in [truncated]")]
    found = t.Truncation(spark.createDataFrame(rows, "id string, v string"), "id", ["v"])
    assert [(r.unit, r.size) for r in found.limits().collect()] == [("characters", 60)]  # no echo in another unit
    cause = {r.id: r.cause for r in found.verdicts().collect()}
    assert [cause[k] for k in ("at", "number", "below", "whole", "marked")] == ["limit", "limit", None, None, "elsewhere"]
    assert {cause[str(i)] for i in range(300) if t.ending(rows[i][1]) == t.OPEN} == {"limit"}


def test_limits_in_two_units_and_before_a_mark_come_apart(spark):
    rng = random.Random(5)
    long = [" ".join(f"{rng.choice(['Größe', 'Column'])} {rng.randint(1, 9999)} hat statt {rng.randint(1, 9999)}." for _ in range(12)) for _ in range(900)]
    cut = [v[:100] for v in long[:300]] + [v.encode()[:100].decode(errors="ignore") for v in long[300:600]] + [v[:80] + rng.choice(["...", " [truncated]", "…"]) for v in long[600:]]
    found = t.Truncation(spark.createDataFrame(list(enumerate(cut)), "id int, v string"), "id", ["v"])
    assert {(r.unit, r.size) for r in found.limits().collect()} == {("characters", 100), ("utf8_bytes", 100), ("marked_characters", 80)}
