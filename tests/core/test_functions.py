"""Expressions and parsers on small inputs."""

import textwrap
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import codetext, pysource
from plumbline.functions import columns as C
from plumbline.functions.patterns import PATTERNS
from plumbline.operators import claims, extract, graph, ingest, prompts, reports, retrieval, verify
from plumbline.streaming import limits

SOURCE = textwrap.dedent(
    '''
    """Module text."""
    import os
    from json import loads


    class Base:
        """Base text."""

        def run(self, items, *rest, key=None, **more):
            helper(items)
            items.append(1)
            if key is None:
                raise ValueError("no key")
            elif rest:
                raise os.error
            return items


    class Child(Base):
        def stop(self):
            self.run([])


    async def helper(a: int, b: str = "x") -> list:
        """Helper text."""
        a[0] = 1
        a[1:2] = []
        b.name = 3
        a += 1

        def inner():
            raise KeyError

        return [a]
    '''
)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize("name,want", [("a.py", "python"), ("A.TSX", "typescript"), (".py", "python"), ("x/.js", "python"), ("a.b.rs", "rust"), ("a", "python"), ("", "python"), (None, "python"), ("dir.go/file", "python")])
def test_language(spark, name, want):
    assert one(spark, name, C.language_of) == want


def test_sanitizer(spark):
    text = "<SCRIPT>\nx\n</script><a onClick='x()' href=\"JavaScript :y\">ok</a><script"
    assert one(spark, text, C.sanitized) == "<a  href=\"y\">ok</a><script"
    assert one(spark, None, C.sanitized) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab c\n", max_size=30), min_size=1, max_size=8))
def test_wrap(spark, texts):
    def wrap(text, width=12):
        lines, line, n = [], [], 0
        for w in text.split():
            if n + len(w) + 1 <= width:
                line.append(w)
                n += len(w) + 1
            else:
                lines += [" ".join(line)] if line else []
                line, n = [w], len(w)
        return lines + [" ".join(line)] if line else lines or [""]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", C.wrapped(F.col("x"), 12).alias("y"))
    assert {r.i: r.y for r in df.collect()} == {i: wrap(t) for i, t in enumerate(texts)}


def test_python_functions():
    (f,) = pysource.functions(SOURCE, "m")
    assert (f["name"], f["qualified_name"], f["docstring"], f["return_annotation"]) == ("helper", "m.helper", "Helper text.", "list")
    assert f["signature"] == "async def helper(a: int, b: str='x') -> list"
    assert f["params"] == [{"name": "a", "annotation": "int", "default": None}, {"name": "b", "annotation": "str", "default": "'x'"}]
    assert [(m["target"], m["method"]) for m in f["mutation_patterns"]] == [("a", "item_assignment"), ("a", "slice_assignment"), ("b", "attribute_assignment"), ("a", "augmented_assignment")]
    assert [(r["exception_class"], r["condition"]) for r in f["raise_statements"]] == [("KeyError", None)]
    run = pysource.parsed(SOURCE).body[3].body[1]
    assert [(r["exception_class"], r["condition"]) for r in pysource.raises(run)] == [("ValueError", "key is None"), ("Exception", "rest")]
    assert [p["name"] for p in pysource.parameters(run)] == ["self", "items", "*rest", "key", "**more"]
    assert [(m["target"], m["method"]) for m in pysource.mutations(run)] == [("items", "append")]
    assert pysource.count_functions(SOURCE) == 4 and pysource.count_functions("def (") == 1 and pysource.functions("def (") == []


def test_graph_and_tree():
    nodes, edges = pysource.graph(SOURCE, "python")
    kinds = sorted(n["type"] for n in nodes)
    assert kinds == ["class", "class", "function", "import", "import", "method", "method", "module"]
    pairs = {(e["type"], e["source"].split(":")[1] if ":" in e["source"] else "module", e["target"].split(":")[1]) for e in edges}
    assert {("inherits", "Child", "Base"), ("calls", "Base.run", "helper"), ("calls", "Child.stop", "Base.run"), ("imports", "module", "os")} <= pairs
    assert pysource.graph("x", "go") == ([{"node": "module", "type": "module", "name": "source", "lineno": 1}], []) and pysource.graph("def (", "python") == ([], [])
    tree = pysource.documentation_tree(SOURCE)
    assert [(t["kind"], t["name"], t["parent"] is None) for t in tree] == [("class", "Base", True), ("method", "run", False), ("class", "Child", True), ("method", "stop", False), ("function", "helper", True)]


SAMPLES = {
    "javascript": ("/** Adds. */\nexport async function add(a, b = 1, ...rest) {\n  if (!a) {\n    throw new TypeError('x');\n  }\n}\n", ["a", "b", "rest"], None, "TypeError"),
    "typescript": ("/** Adds. */\nexport function add<T>(a: Map<string, T>, b?: number): Promise<T> {\n  throw new RangeError('x');\n}\n", ["a", "b"], "Promise<T>", "RangeError"),
    "java": ("class Calc {\n    /** Adds. */\n    @Override\n    public static List<String> add(final Map<String, Integer> a, int b) throws X {\n        throw new IllegalStateException();\n    }\n}\n", ["a", "b"], "List<String>", "IllegalStateException"),
    "go": ("package p\n\n// Adds.\nfunc (r *Calc) add(a, b int) (int, error) {\n\tpanic(\"x\")\n}\n", ["a", "b"], "(int, error)", "panic"),
    "rust": ("impl Calc {\n    /// Adds.\n    #[inline]\n    pub fn add(&self, a: Vec<(i32, i32)>, mut b: i32) -> Result<i32> {\n        panic!(\"x\");\n    }\n}\n", ["a", "b"], "Result<i32>", "panic"),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_brace_languages(language):
    text, names, returns, error = SAMPLES[language]
    (f,) = codetext.described(text, language)
    assert f["name"] == "add" and f["docstring"] == "Adds." and [p["name"] for p in f["params"]] == names and f["return_annotation"] == returns
    assert [r["exception_class"] for r in f["raise_statements"]] == [error]
    assert f["qualified_name"] == {"java": "Calc.add", "go": "Calc.add", "rust": "Calc::add"}.get(language, "add")
    assert codetext.syntax_error(text, language) is None
    assert codetext.syntax_error(text.replace("}", "", 1), language) is not None
    assert codetext.comments(text, language)[0]["function"] == "add"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.sampled_from(["python", "javascript", "typescript", "java", "go", "rust"]))
def test_parsers_never_raise(text, language):
    codetext.syntax_error(text, language)
    codetext.described(text, language)
    pysource.graph(text, language)
    verify.read_junit(text)
    verify.read_cargo(text)
    verify.test_code(text)


GOLDEN = [("Returns a list of items.", "RSV"), ("Returns None", "RSV"), ("value must be positive", "PCV"), ("x cannot be None", "PCV"), ("Does not modify the input", "SEV"), ("Sorts the data in-place", "SEV"), ("Raises ValueError if x is empty", "ECV"), ("Handles empty input.", "COV"), ("Runs in O(n) time", "CCV"), ("constant time", "CCV")]


def test_claim_patterns(spark):
    assert [sum(p.category == c for p in PATTERNS) for c in schema.CATEGORIES] == [10, 10, 8, 8, 6, 5]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(100, None), (101, ""), (102, "x should be empty"), (103, "Nothing here")], "id int, docstring string")
    rows = claims.documentation_claims(df, "id").collect()
    for i, (_, category) in enumerate(GOLDEN):
        assert category in {r.category for r in rows if r.id == i}
    assert not [r for r in rows if r.id in (100, 101, 103)] and not [r for r in rows if r.id == 102 and r.pattern_no == 20]
    raised = next(r for r in rows if r.id == 6 and r.pattern_no == 34)
    assert (raised.subject, raised.conditionality, raised.raw_text) == ("return", "x is empty", "Raises ValueError if x is empty")


def test_logs(spark):
    go = '{"Action":"run","Test":"A"}\nnoise\n{"Action":"output","Test":"A","Output":"x"}\n{"Action":"fail","Test":"A","Elapsed":0.5}\n{"Action":"pass"}\n'
    df = spark.createDataFrame([(1, go), (2, None), (3, "")], "k int, log string")
    assert [tuple(r) for r in verify.go_events(df, "k", "log").collect()] == [(1, "A", "failed", "x", "x", 0.5)]
    junit = verify.read_junit("│  ├─ a() ✔\n│  └─ b() ✘\n   boom\n   there\n\n")
    assert [(r["nodeid"], r["outcome"], r["traceback"]) for r in junit] == [("a()", "passed", None), ("b()", "failed", "   boom\n   there")]
    assert [r["nodeid"] for r in verify.read_junit("[ 2 tests successful ]\n[ 1 tests failed ]")] == ["test_1", "test_2", "test_failed_1"]
    cargo = verify.read_cargo("test t::a ... ok\ntest t::b ... FAILED\n\n---- t::b stdout ----\nboom\n\nfailures:\n    t::b\n")
    assert [(r["nodeid"], r["outcome"], r["traceback"]) for r in cargo] == [("t::a", "passed", None), ("t::b", "failed", "boom")]
    with pytest.raises(KeyError):
        verify.LOGS.require("cobol")


def test_answers():
    text = "Sure:\n```python\nimport os\nfrom x import y\nz = 1\ndef test_a():\n    assert y == 1\n\nprint(2)\n```"
    assert verify.test_code(text) == "import os\nfrom x import y\n\ndef test_a():\n    assert y == 1"
    assert verify.test_code("no test") is None and verify.test_code("def test_a(:") is None and verify.test_code(None) is None
    assert verify.test_code('package p\nimport "testing"\nfunc TestA(t *testing.T) { }', "gotest") and verify.test_code("func TestA()", "gotest") is None
    assert verify.test_name("def test_b():\n    pass") == "test_b" and verify.test_name(None, "jest", "s", "RSV") == "test_s_RSV"


def test_prompts_never_hold_the_body(spark):
    df = spark.createDataFrame([("RSV", "s", "returns 1", None, "def f()", "BODY"), ("SEV", "s", "p", "c", "def f()", "BODY")], "category string, subject string, predicate_object string, conditionality string, signature string, source string")
    rows = prompts.build(df, F.col("signature")).collect()
    assert all("BODY" not in r.user + r.system for r in rows) and "output_schema" in rows[0].user and "output_schema" not in rows[1].user

    calls = prompts.answers(prompts.build(df, F.col("signature")), lambda s, u, t: "ok", retries=2)
    assert [r.answer for r in calls.collect()] == ["ok", "ok"]


def test_ingest(spark):
    df = spark.createDataFrame([("p", "\n".join(map(str, range(45)))), ("e", ""), ("n", None), ("t", "a\n")], "path string, text string")
    rows = ingest.line_blocks(df, "path", "text").collect()
    assert sorted((r.path, r.start_line, r.end_line) for r in rows) == [("p", 1, 25), ("p", 21, 45), ("p", 41, 45), ("t", 1, 1)]


def test_numbered(spark):
    df = spark.createDataFrame([(f"t{i:03}",) for i in range(300)], "t string")
    assert [(r.t, r.place) for r in graph.numbered(df, "t", parts=7).orderBy("t").collect()] == [(f"t{i:03}", i) for i in range(300)]


def test_hybrid_ties(spark):
    d = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "b", 0.5, 2)], "query string, key string, score double, rank int")
    s = spark.createDataFrame([("q", "c", 0.75, 1), ("q", "b", 0.0, 2)], "query string, key string, score double, rank int")
    assert [(r.key, r.score) for r in retrieval.hybrid_top(d, s, "query", "key", 5).orderBy("rank").collect()] == [("a", 0.3), ("b", 0.3), ("c", 0.3)]


def test_rate_limiter_is_a_fold(spark):
    import datetime as dt
    import random

    rng = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), i, t0 + dt.timedelta(seconds=rng.randint(0, 400))) for i in range(120)] + [(None, 900, t0), ("a", 901, None)]
    want, held = {}, {}
    for k, i, t in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        kept = [u for u in held.get(k, []) if (t - u).total_seconds() < 30]
        want[i] = len(kept) < 3
        held[k] = kept + [t] * want[i]
    df = spark.createDataFrame(rows, "k string, i int, t timestamp")
    assert {r.i: r.accepted for r in limits.rate_limited(df, "k", "t", "i", 30, 3).collect()} == want


def test_requests_of_one_key_pass_by_in_linear_time(spark):
    took = []
    for n in (100_000, 200_000):
        df = spark.range(n).selectExpr("'k' as k", "id as i", "timestamp_micros(id * 1000) as t").coalesce(1)
        began = time.perf_counter()
        rows = limits.rate_limited(df, "k", "t", "i", 30, 5).groupBy("accepted").count().collect()
        took.append(time.perf_counter() - began)
        assert sum(r["count"] for r in rows) == n and {r.accepted: r["count"] for r in rows}[True] == 5 * -(-n // 30_000)
    assert took[1] < 2.5 * took[0] + 1


@pytest.mark.parametrize(
    "language,head,piece",
    [
        ("python", "", 'def f%d(a, b):\n    """Doc of it."""\n    return a\n\n'), ("python", "", "def f%d(a, b:\n    return 1\n"), ("javascript", "", "/** Doc. */\nfunction f%d(a) {\n  return a;\n}\n"),
        ("java", "class A {\n", "  /** Doc. */\n  public int f%d(int a) {\n    return a;\n  }\n"), ("java", "", "class A%d {\n  int f(int a) {\n    return a;\n  }\n}\n"), ("rust", "", "/// Doc.\npub fn f%d(a: u8) -> u8 {\n    a\n}\n"), ("go", "package p\n", "// F doc.\nfunc F%d(a int) int {\n\treturn a\n}\n"),
    ],
)
def test_time_grows_with_the_number_of_functions(language, head, piece):
    took = []
    for n in (2000, 8000):
        text = head + "".join(piece.replace("%d", str(i)) for i in range(n))
        began = time.perf_counter()
        assert len(codetext.described(text, language)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]  # four times the text; a quadratic search takes sixteen times as long


def test_a_parameter_list_of_any_length():
    text = "def f(\n" + "".join(f"    a{i}=({i}, '('),  # ( not open\n" for i in range(300)) + '):\n    """Says what it does."""\n    return 1\n\nx = 1\n'
    (f,) = codetext.functions(text, "python")
    assert f.documentation == "Says what it does." and f.end == 304
    text = "/** Says what it does. */\nfunction f(\n" + "".join(f"  a{i} = [{i}, ')'], // ) no\n" for i in range(300)) + ") {\n  return 1;\n}\nx();\n"
    (f,) = codetext.functions(text, "javascript")
    assert f.documentation == "Says what it does." and f.end == 305


def test_pdf():
    made = reports.text_to_pdf(["a (b) \\ c", "€ü"])
    assert made.startswith(b"%PDF-1.4") and made.endswith(b"%%EOF") and b"(a \\(b\\) \\\\ c) Tj T*" in made
    at = int(made.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert made[at:].startswith(b"xref\n0 6")
    for k in range(1, 6):
        offset = int(made[at:].split(b"\n")[k + 2][:10])
        assert made[offset:].startswith(b"%d 0 obj" % k)


def test_transitions():
    assert len(schema.TRANSITIONS) == 12 and ("rv_running", "complete") in schema.TRANSITIONS and ("complete", "failed") not in schema.TRANSITIONS
    assert extract.PARSERS.keys() == ["go", "java", "javascript", "python", "rust", "typescript"]
    with pytest.raises(KeyError):
        extract.PARSERS.require("cobol")
