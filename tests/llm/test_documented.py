"""Functions and their documentation: which comment is taken, where bodies end, what is trivial."""

import pytest

from plumbline.llm import documented as d

REAL = "Drop stale rows before the merge."
JS = "function loadRows(a, b) {\n  const s = '}';\n  return a;\n}"
CASES = [
    ("python", f'def f(a):\n    """{REAL}"""\n    return a\n', REAL),
    ("python", f"@staticmethod\ndef f(\n    a,\n    b: int = 3,\n) -> dict[str, int]:\n    # first\n    r'''{REAL}\n\n    More.\n    '''\n", REAL + "\n\nMore."),
    ("python", f'def f(a):\n    note = """{REAL}"""\n', None),
    ("python", f'def f(a):\n    def g():\n        """{REAL}"""\n    return g\n', None),
    ("python", f"# {REAL}\ndef f(a):\n    pass\n", None),
    ("python", f'def f(a):\n    f"""{REAL}"""\n', None),
    ("python", f'def f(): "{REAL}"\n', REAL),
    ("javascript", f"/**\n * {REAL}\n */\nexport async function f(a) {{\n}}", REAL),
    ("javascript", f"// {REAL}\nfunction f(a) {{\n}}", None),
    ("javascript", f"/* {REAL} */\nfunction f(a) {{\n}}", None),
    ("javascript", f"/** {REAL} */\n\nfunction f(a) {{\n}}", None),
    ("javascript", f"function f(a) {{\n  /** {REAL} */\n  const g = 1;\n}}", None),
    ("javascript", f"/** {REAL} */\nconst f = async (a) => {{\n}};", REAL),
    ("typescript", f"/** {REAL} */\nexport function f<T>(a: T): T {{\n}}", REAL),
    ("java", f"/**\n * {REAL}\n */\n@Override\n@Deprecated(since = \"1\")\npublic Object f(Object a) {{\n}}", REAL),
    ("go", f"// {REAL}\n// More.\nfunc (r *Row) f(a int) error {{\n}}", REAL + "\nMore."),
    ("go", f"// {REAL}\n//\n\nfunc f(a int) error {{\n}}", None),
    ("rust", f"/// {REAL}\n#[inline]\npub fn f(a: Rows) -> Result<Rows> {{\n}}", REAL),
    ("rust", f"// {REAL}\npub fn f(a: Rows) {{\n}}", None),
    ("ruby", f"# {REAL}\ndef f(a)\n  if a\n    1\n  end\nend\n", REAL),
]


@pytest.mark.parametrize("language,text,want", CASES)
def test_own_documentation(language, text, want):
    f = next(x for x in d.functions(text, language) if x.name == "f")
    assert f.documentation == want


def test_bodies_end():
    text = f"{JS}\nfunction next() {{ return 1; }}\n"
    a, b = d.functions(text, "javascript")
    assert (a.line, a.end, b.line, b.end) == (0, 4, 4, 5)
    text = "class A:\n    def f(self):\n        x = '''\ndef no(): pass\n'''\n\n        return x\n\n    def g(self):\n        pass\n"
    assert [(x.name, x.line, x.end) for x in d.functions(text, "python")] == [("f", 1, 7), ("g", 8, 10)]
    text = "def a(x)\n  [1].each do |y|\n    puts y\n  end\nend\n\ndef b\nend\n"
    assert [(x.name, x.line, x.end) for x in d.functions(text, "ruby")] == [("a", 0, 5), ("b", 6, 8)]


TRIVIAL = ["TODO", "tbd", "N/A", "???", "---------", "...", "", "Docstring.", "See base class.", "{@inheritDoc}", "Does stuff.", "Helper function.", "Getter.", "Internal use only.", "No description.", "@param rows\n@return", ":param rows:\n:return:", "Args:\n    rows:\n\nReturns:", "load_rows()", "The load_rows function.", "Load the rows.", "Loads rows.", "TODO: document this\nLoad the rows.", "Keeps order", "This function has not been documented yet.", "Generated from template 71; changes will be lost.", "Documentation pending, see ticket 9959."]


@pytest.mark.parametrize("text", TRIVIAL)
def test_trivial(text):
    assert d.is_trivial(text, "load_rows")


@pytest.mark.parametrize("text", ["Load rows older than the cut.", "Oldest goes out first.", "@param rows the rows to settle before the merge", "Never blocks.\n\nTODO: say more about locks. Returns early when closed.", "Helper function. Keeps the order of keys stable.", "返回新的列表，并且不修改输入的参数。"])
def test_real(text):
    assert not d.is_trivial(text, "load_rows")


def test_tables(spark):
    rows = [
        ("a", "f", "def f(a)", f'def f(a):\n    """{REAL}"""\n    return a', None), ("b", "f", "def f(a)", f'def f(a):\n    """{REAL}"""\n    return a', "TODO"),
        ("c", "f", None, None, REAL), ("d", None, None, None, None), ("e", "f", "", "", ""), ("f", "f", "def f(a)", "def f(a):\n    pass", f'"""{REAL}\n    """'),
        ("a", "f", "def f(a)", f'def f(a):\n    """{REAL}"""\n    return a', None), ("g", "f", "def f()", "def f():\n    '''" + "word " * 50_000 + "'''", "  "),
    ]
    df = spark.createDataFrame(rows, "id string, name string, signature string, source string, docstring string").selectExpr("*", "1 as code", "'x' as key")
    got = d.documented(df).collect()
    assert sorted(r.id for r in got) == ["a", "a", "c", "f", "g"]
    a = next(r for r in got if r.id == "a")
    assert (a.language, a.signature, a.description, a.code) == ("python", "def f(a)", REAL, "def f(a):\n    return a")
    assert sorted(r.id for r in d.documented(df, with_code=False).collect()) == ["a", "a", "c", "f", "g"]
    assert d.documented(df.limit(0)).collect() == []
    files = spark.createDataFrame([("x", f"/** {REAL} */\n{JS}\n", "JavaScript"), ("y", None, "python"), ("z", "text", "cobol"), ("w", "", None)], "id string, text string, language string")
    (row,) = d.documented_in_files(files, "id", "text", "language").collect()
    assert (row.id, row.name, row.lineno, row.description, row.code) == ("x", "loadRows", 2, REAL, JS)
