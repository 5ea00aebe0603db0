"""Extraction from sources whose contents are known: one template per language, filled from the rows of part.

What each template holds was written down by hand below it; SQL fills the same words into that list. So the parsers are
compared, column by column, with results that no parser made.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import claims, extract, verify
from plumbline.plans.catalogue import query
from plumbline.sources.tables import table

# "zzw" is replaced by the first word of the part's name and 90909 by its key.
SOURCES = {
    "python": '''import zzw_tools
from os import path


def zzw_total(items: list, start: int = 90909) -> int:
    """Returns an int.

    A line with def inside() in it.
    """
    if not items:
        raise ValueError("none")
    items.append(start)
    return helper(items)


def helper(items, *rest):
    raise KeyError(90909)


class Box:
    """Holds zzw."""

    def put(self, value):
        self.value = value
        helper([value])
''',
    "javascript": """// not documentation
/** Adds zzw up. */
function zzwTotal(items, start = 90909) {
  if (!items) {
    throw new RangeError("none");
  }
  return items.length + start;
}

class Box {
  put(value) {
    return value;
  }
}
""",
    "typescript": """/**
 * Adds zzw up.
 * Twice.
 */
export function zzwTotal(items: string[], start?: number): number {
  return items.length + 90909;
}
""",
    "java": """class Box {
  /** Puts zzw in. */
  @Override
  public int put(String name, final int count) throws Exception {
    if (count < 90909) {
      throw new IllegalStateException("low");
    }
    return count;
  }
}
""",
    "go": """package box

// Put takes zzw.
func (b *Box) Put(name string, count int) error {
	if count < 90909 {
		panic("low")
	}
	return nil
}

func free(a, b int) int {
	return a
}
""",
    "rust": """impl Box {
    /// Puts zzw in.
    #[inline]
    pub fn put(&mut self, name: &str, count: u32) -> Result<u32, String> {
        if count < 90909 {
            panic!("low");
        }
        Ok(count)
    }
}
""",
}
LANGUAGES = list(SOURCES)
BROKEN = 7  # every so many parts' texts get an open bracket behind them, for the check of the syntax only

# (language, name, qualified name, first line, last line, signature, documentation, parameters, return type, raised, changed)
FUNCTIONS = [
    ("python", "zzw_total", "zzw_total", 5, 13, "def zzw_total(items: list, start: int=90909) -> int", "Returns an int.\n\nA line with def inside() in it.", "items:list=;start:int=90909", "int", "ValueError@11:not items", "items.append@12"),
    ("python", "helper", "helper", 16, 17, "def helper(items, *rest)", None, "items:=;*rest:=", None, "KeyError@17:", ""),
    ("javascript", "zzwTotal", "zzwTotal", 3, 8, "function zzwTotal(items, start = 90909)", "Adds zzw up.", "items:=;start:=90909", None, "RangeError@5:!items", ""),
    ("javascript", "put", "Box.put", 11, 13, "put(value)", None, "value:=", None, "", ""),
    ("typescript", "zzwTotal", "zzwTotal", 5, 7, "export function zzwTotal(items: string[], start?: number): number", "Adds zzw up.\nTwice.", "items:string[]=;start:number=", "number", "", ""),
    ("java", "put", "Box.put", 4, 9, "public int put(String name, final int count) throws Exception", "Puts zzw in.", "name:String=;count:int=", "int", "IllegalStateException@6:count < 90909", ""),
    ("go", "Put", "Box.Put", 4, 9, "func (b *Box) Put(name string, count int) error", "Put takes zzw.", "name:string=;count:int=", "error", "panic@6:count < 90909", ""),
    ("go", "free", "free", 11, 13, "func free(a, b int) int", None, "a:int=;b:int=", "int", "", ""),
    ("rust", "put", "Box::put", 4, 9, "pub fn put(&mut self, name: &str, count: u32) -> Result<u32, String>", "Puts zzw in.", "name:&str=;count:u32=", "Result<u32, String>", "panic@6:count < 90909", ""),
]
# (language, text, first line, last line, function)
COMMENTS = [
    ("python", "Returns an int.\n\nA line with def inside() in it.", 6, 9, "zzw_total"), ("javascript", "Adds zzw up.", 2, 2, "zzwTotal"), ("typescript", "Adds zzw up.\nTwice.", 1, 4, "zzwTotal"), ("java", "Puts zzw in.", 2, 2, "put"), ("go", "Put takes zzw.", 3, 3, "Put"), ("rust", "Puts zzw in.", 2, 2, "put"),
]
# (language, node, parent, kind, name, signature, documentation, line)
TREE = [
    ("python", "function:zzw_total:5", None, "function", "zzw_total", "zzw_total(items: list, start: int=90909) -> int", "Returns an int.\n\nA line with def inside() in it.", 5),
    ("python", "function:helper:16", None, "function", "helper", "helper(items, *rest)", None, 16), ("python", "class:Box:20", None, "class", "Box", None, "Holds zzw.", 20), ("python", "method:Box.put:23", "class:Box:20", "method", "put", "put(self, value)", None, 23),
]
# (language, node, type, name, line)
NODES = [
    ("python", "module", "module", "module", 1), ("python", "import:os:0", "import", "os", 0), ("python", "import:zzw_tools:0", "import", "zzw_tools", 0), ("python", "function:zzw_total:5", "function", "zzw_total", 5), ("python", "function:helper:16", "function", "helper", 16),
    ("python", "class:Box:20", "class", "Box", 20), ("python", "method:Box.put:23", "method", "put", 23), *[(language, "module", "module", "source", 1) for language in LANGUAGES[1:]],
]
# (language, source, target, type)
EDGES = [
    ("python", "module", "import:os:0", "imports"), ("python", "module", "import:zzw_tools:0", "imports"), ("python", "module", "function:zzw_total:5", "contains"), ("python", "module", "function:helper:16", "contains"), ("python", "module", "class:Box:20", "contains"),
    ("python", "class:Box:20", "method:Box.put:23", "has_method"), ("python", "function:zzw_total:5", "function:helper:16", "calls"), ("python", "method:Box.put:23", "function:helper:16", "calls"),
]
# (language, functions at any depth, by the rule of its language; documented functions; their claims)
COUNTS = [("python", 3, 1, 4), ("javascript", 1, 1, 1), ("typescript", 1, 1, 0), ("java", 1, 1, 1), ("go", 1, 1, 1), ("rust", 1, 1, 1)]
# (framework, code, whether its validator takes it)
TESTS = [
    ("pytest", "def test_zzw():\n    assert 1 == 90909", True), ("pytest", "def test_zzw(:\n    pass", False), ("jest", "test('zzw', () => { expect(1).toBe(90909); });", True), ("jest", "const zzw = 90909;", False), ("jest", "it('zzw', () => {", False),
    ("gotest", 'import "testing"\n\nfunc TestZzw(t *testing.T) { _ = 90909 }', True), ("gotest", "func TestZzw(t *testing.T) {}", False), ("junit", "class ZzwTest { @Test void zzw() {} }", True), ("junit", "class ZzwTest { void zzw() {} }", False),
    ("cargotest", "#[test]\nfn zzw() { assert_eq!(1, 90909); }", True), ("cargotest", "fn zzw() {}", False), ("unknown", "zzw", False),
]


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def _sql(rows: list[tuple], columns: str, where: str = "true", extra: str = "") -> str:
    """The rows with the words of each part whose language is theirs."""
    names = columns.split()
    texts = {n for n, *values in zip(names, *[r[1:] for r in rows]) if any(isinstance(v, str) for v in values)}
    said = ", ".join((f"replace(replace({n}, 'zzw', word), '90909', k::VARCHAR) AS {n}" if n in texts else n) for n in names)
    values = ", ".join("(" + ", ".join(_quoted(v) for v in r) + ")" for r in rows)
    return f"WITH p AS (SELECT p_partkey AS k, regexp_extract(p_name, '^[a-z]+', 0) AS word, ({LANGUAGES})[(p_partkey % {len(LANGUAGES)} + 1)::INT] AS language FROM part), x AS (SELECT * FROM (VALUES {values}) t(language, {', '.join(names)})) SELECT k AS id, {said}{extra} FROM p JOIN x USING (language) WHERE {where}"


def _fill(column):
    return F.replace(F.replace(column, F.lit("zzw"), F.col("word")), F.lit("90909"), F.col("id").cast("string"))


def _files(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_name", "^[a-z]+", 0).alias("word"))
    place = (F.pmod(F.col("id"), F.lit(len(LANGUAGES))) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), place)
    return p.select("id", pick(LANGUAGES).alias("language"), _fill(pick(SOURCES.values())).alias("source"))


def _functions(spark, folder):
    return extract.functions(_files(spark, folder), "id", "source", "language")


def _text(parts, f):
    return F.array_join(F.transform(parts, f), ";")


@query("known_functions", _sql(FUNCTIONS, "name qualified_name lineno end_line signature docstring params return_annotation raises mutations"))
def _(spark, folder):
    blank = lambda c: F.coalesce(c, F.lit(""))
    return _functions(spark, folder).select(
        "id", "name", "qualified_name", "lineno", "end_line", "signature", "docstring", _text("params", lambda p: F.concat(p["name"], F.lit(":"), blank(p["annotation"]), F.lit("="), blank(p["default"]))).alias("params"), "return_annotation",
        _text("raise_statements", lambda r: F.concat(r["exception_class"], F.lit("@"), r["lineno"].cast("string"), F.lit(":"), blank(r["condition"]))).alias("raises"), _text("mutation_patterns", lambda m: F.concat(m["target"], F.lit("."), m["method"], F.lit("@"), m["line"].cast("string"))).alias("mutations"),
    )


@query("known_comments", _sql(COMMENTS, "text start_line end_line function"))
def _(spark, folder):
    return extract.comments(_files(spark, folder), "id", "source", "language").select("id", "text", "start_line", "end_line", "function")


@query("known_syntax", f"SELECT p_partkey AS id, p_partkey % {BROKEN} <> 0 AS valid FROM part")
def _(spark, folder):
    broken = F.when(F.pmod(F.col("id"), F.lit(BROKEN)) == 0, F.concat("source", F.lit("("))).otherwise(F.col("source"))
    return extract.syntax(_files(spark, folder).withColumn("source", broken), "id", "source", "language").select("id", "valid")


@query("known_tree", _sql(TREE, "node parent kind name signature docstring lineno"))
def _(spark, folder):
    return extract.documentation_tree(_files(spark, folder).filter("language = 'python'"), "id", "source")


@query("known_graph_nodes", _sql(NODES, "node type name lineno"))
def _(spark, folder):
    return extract.graph_nodes(_files(spark, folder), "id", "source", "language").select("id", "node", "type", "name", "lineno")


@query("known_graph_edges", _sql(EDGES, "source target type"))
def _(spark, folder):
    return extract.graph_edges(_files(spark, folder), "id", "source", "language").select("id", "source", "target", "type")


@query("known_chunks", _sql([("python", "zzw_total", 5, 13, "Returns an int.\n\nA line with def inside() in it."), ("python", "helper", 16, 17, None), ("python", "put", 23, 25, None)], "function_name start_line end_line docstring", extra=", left(md5(k || '.py:' || start_line || ':' || replace(function_name, 'zzw', word)), 12) AS chunk_id, 'function' AS chunk_type"))
def _(spark, folder):
    files = _files(spark, folder).filter("language = 'python'").select("id", F.concat(F.col("id").cast("string"), F.lit(".py")).alias("path"), "source")
    rows = extract.retrieval_chunks(files, "path", "source")
    return rows.select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("id"), "function_name", "start_line", "end_line", "docstring", "chunk_id", "chunk_type")


@query("known_counts", _sql([(a, b) for a, b, _, _ in COUNTS], "n").replace("k AS id, n FROM", "k AS id, n::BIGINT AS n FROM"))
def _(spark, folder):
    return extract.all_function_counts(_files(spark, folder), "id", "source", "language")


@query("known_store", _sql([(a, c, d) for a, _, c, d in COUNTS], "total_functions total_claims").replace("total_functions, total_claims FROM p", "total_functions::BIGINT AS total_functions, total_claims::BIGINT AS total_claims FROM p"))
def _(spark, folder):
    """Extraction as stored: the documented functions of each text and their claims of both tracks, each once."""
    rows = _functions(spark, folder).filter("docstring <> ''").withColumnRenamed("id", "file").withColumn("id", F.concat_ws(":", F.col("file").cast("string"), "qualified_name"))
    both = claims.merged(claims.syntax_claims(rows, "id"), claims.documentation_claims(rows, "id"), "id")
    per = both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("id", "file").join(per, "id", "left").groupBy(F.col("file").alias("id")).agg(F.count(F.lit(1)).alias("total_functions"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_claims"))


_TESTS = ", ".join("(" + ", ".join(_quoted(v) for v in (i, *t)) + ")" for i, t in enumerate(TESTS))


@query("known_test_syntax", f"SELECT p_partkey AS id, framework, valid FROM part JOIN (VALUES {_TESTS}) t(i, framework, code, valid) ON i = p_partkey % {len(TESTS)}")
def _(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_name", "^[a-z]+", 0).alias("word"))
    place = (F.pmod(F.col("id"), F.lit(len(TESTS))) + 1).cast("int")
    rows = p.withColumn("framework", F.element_at(F.array(*[F.lit(t[0]) for t in TESTS]), place)).withColumn("code", _fill(F.element_at(F.array(*[F.lit(t[1]) for t in TESTS]), place)))
    return verify.syntax_checks(rows, ["id", "framework"], "code", "framework").select("id", "framework", "valid")


@query("known_answers", f"SELECT p_partkey AS id, 'import zz' || chr(10) || chr(10) || 'def test_' || regexp_extract(p_name, '^[a-z]+', 0) || '():' || chr(10) || '    assert f(' || p_partkey || ') == 1' AS test_code, 'test_' || regexp_extract(p_name, '^[a-z]+', 0) AS test_name FROM part WHERE p_partkey % {BROKEN} <> 0")
def _(spark, folder):
    """Answers of a model: talk around a fenced block with an import, two tests (the first counts) and other code; every
    BROKEN-th answer holds none."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_name", "^[a-z]+", 0).alias("word"))
    full = "Here it is.\n```python\nimport zz\nLIMIT = 3\n\ndef test_zzw():\n    assert f(90909) == 1\n\ndef test_other():\n    pass\n```\nDone."
    text = F.when(F.pmod(F.col("id"), F.lit(BROKEN)) == 0, "I cannot write a test for zzw.").otherwise(full)
    rows = p.select("id", _fill(text).alias("answer"), F.lit("s").alias("subject"), F.lit("RSV").alias("category"))
    return verify.synthesized(rows, ["id"], "answer")
