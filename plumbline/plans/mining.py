"""Functions, claims, comments, chunks and trees mined from source."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.patterns import PATTERNS, group_number
from plumbline.operators import claims, extract
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, model
from plumbline.sources.tables import table

# Documentation with known phrases, built from the star schema in both engines; ASCII, one phrase a line.
_PHRASES = [
    "Returns a list of {w} items.", "Returns None", "{w} must be a positive number", "{w} should be a list, tuple", "{w} cannot be empty.", "expects {w} to be a str", "Does not modify the {w}", "Sorts the {w} in-place. Returns a new {w}",
    "Raises ValueError if {w} is None.", "Throws a KeyError", "raises TypeError for invalid {w}", "Handles the case where {w} is missing.", "Supports {w}, and more.", "Runs in O(n log n) time", "space complexity is O({w})", "No side effects; a pure function.",
    "accepts {w} as input", "Constant time.", "Mutates the {w}. {w} must not be None", "Returns self", "modifies {w} in place", "{w} is required to be a dict", "Processes {w}", "returns an int", "Works with {w}, {w}.", "{w} must be of type int",
]
_WORD = "regexp_extract(p_name, '^[a-z]+', 0)"


def _docs(spark, folder):
    p = table(spark, folder, "part")
    word = F.regexp_extract("p_name", "^[a-z]+", 0)
    picks = [F.element_at(F.array(*[F.lit(x) for x in _PHRASES]), (F.pmod(F.col("p_partkey") * k, F.lit(len(_PHRASES))) + 1).cast("int")) for k in (1, 5, 7)]
    return p.select(F.col("p_partkey").alias("id"), F.replace(F.concat_ws("\n", *picks), F.lit("{w}"), word).alias("docstring"))


_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _PHRASES) + "]"
_N = len(_PHRASES)
_DOCS = f"d AS (SELECT p_partkey AS id, replace(concat_ws(chr(10), " + ", ".join(f"({_LIST})[((p_partkey * {k}) % {_N} + 1)::INT]" for k in (1, 5, 7)) + f"), '{{w}}', {_WORD}) AS docstring FROM part)"


def _sql(categories: tuple[str, ...], source: str = "d", key: str = "id") -> str:
    parts = []
    for p in PATTERNS:
        if p.category not in categories:
            continue
        g = {n: group_number(p.regex, n) for n in ("subject", "object", "condition")}
        regex = p.regex.replace("(?P<subject>", "(").replace("(?P<object>", "(").replace("(?P<condition>", "(").replace("'", "''")
        pick = lambda n, g=g, regex=regex: f"regexp_extract_all(docstring, '{regex}', {g[n]})" if g[n] else "NULL::VARCHAR[]"
        parts.append(f"SELECT {key} AS id, {p.number} AS pattern_no, '{p.category}' AS category, '{p.name.replace('_', ' ')}' AS title, {str(p.must).lower()} AS must, unnest(regexp_extract_all(docstring, '{regex}', 0)) AS raw, unnest({pick('subject')}) AS s, unnest({pick('object')}) AS o, unnest({pick('condition')}) AS k, unnest(range(len(regexp_extract_all(docstring, '{regex}', 0)))) AS match_no FROM {source} WHERE docstring <> ''")
    return (
        "m AS (" + " UNION ALL ".join(parts) + "), q AS (SELECT id, pattern_no::INT AS pattern_no, category, coalesce(nullif(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), ''), 'return') AS subject, CASE WHEN regexp_replace(coalesce(o, ''), '^\\s+|\\s+$', '', 'g') <> '' THEN title || ': ' || regexp_replace(o, '^\\s+|\\s+$', '', 'g') WHEN regexp_replace(coalesce(s, ''), '^\\s+|\\s+$', '', 'g') <> '' THEN title || ': ' || regexp_replace(s, '^\\s+|\\s+$', '', 'g') ELSE title END AS predicate_object, "
        "nullif(regexp_replace(regexp_replace(coalesce(k, ''), '^\\s+|\\s+$', '', 'g'), '\\.+$', ''), '') AS conditionality, match_no::INT AS match_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS raw_text, must FROM m), "
        "cl AS (SELECT id, pattern_no, category, subject, predicate_object, conditionality, match_no, raw_text FROM q WHERE raw_text <> '' AND (NOT must OR regexp_matches(lower(raw_text), '\\bmust\\b')))"
    )


def _register(category: str) -> None:
    @query(f"claims_{category.lower()}", f"WITH {_DOCS}, {_sql((category,))} SELECT * FROM cl")
    def _(spark, folder):
        return claims.documentation_claims(_docs(spark, folder), "id", categories=(category,), unicode=False)


for _category in ("RSV", "PCV", "SEV", "ECV", "COV", "CCV"):
    _register(_category)


@query("claims_of_functions", f"{WITH}, {_sql(('RSV', 'PCV', 'SEV', 'ECV', 'COV', 'CCV'), 'f')} SELECT category, pattern_no, count(*) AS n, count(DISTINCT id) AS n_functions FROM cl GROUP BY ALL")
def _(spark, folder):
    found = claims.documentation_claims(model(spark, folder).functions, "id", unicode=False)
    return found.groupBy("category", "pattern_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_functions"))


_SYNTAX = """sy AS (SELECT f.id, category, subject, predicate_object, conditionality, source_line, raw_text, place FROM f, LATERAL (SELECT 'ECV' AS category, r.exception_class AS subject, 'raises ' || r.exception_class AS predicate_object, r.condition AS conditionality, r.lineno AS source_line,
'raises ' || r.exception_class || coalesce(' if ' || nullif(r.condition, ''), '') AS raw_text, i - 1 AS place FROM (SELECT unnest(raise_statements) AS r, unnest(range(1, len(raise_statements) + 1)) AS i)
UNION ALL SELECT 'SEV', m.target, 'modifies ' || m.target || ' via ' || m.method, NULL, m.line, 'modifies ' || m.target || ' via ' || m.method, coalesce(len(raise_statements), 0) + j - 1 FROM (SELECT unnest(mutation_patterns) AS m, unnest(range(1, len(mutation_patterns) + 1)) AS j)))"""


@query("ast_track_claims", f"{WITH}, {_SYNTAX} SELECT id, category, subject, predicate_object, conditionality, source_line, raw_text, place::INT AS place FROM sy")
def _(spark, folder):
    return claims.syntax_claims(model(spark, folder).functions, "id")


@query(
    "claims_union_dedupe",
    f"""{WITH}, {_SYNTAX}, {_sql(('RSV', 'PCV', 'SEV', 'ECV', 'COV', 'CCV'), 'f')}, u AS (SELECT id, category, subject, predicate_object, conditionality, raw_text, 0 AS track, 0 AS pattern_no, place AS match_no FROM sy UNION ALL
    SELECT id, category, subject, predicate_object, conditionality, raw_text, 1, pattern_no, match_no FROM cl) SELECT id, category, subject, predicate_object, conditionality, raw_text, track::INT AS track FROM u QUALIFY row_number() OVER (PARTITION BY id, category, subject, predicate_object ORDER BY track, pattern_no, match_no) = 1""",
)
def _(spark, folder):
    f = model(spark, folder).functions
    both = claims.merged(claims.syntax_claims(f, "id"), claims.documentation_claims(f, "id", unicode=False), "id")
    return both.select("id", "category", "subject", "predicate_object", "conditionality", "raw_text", "track")


@query("claim_source_line", f"{WITH}, x AS (SELECT c.id, docstring, c.raw_text, lineno FROM c JOIN f ON f.id = c.function_id WHERE docstring IS NOT NULL) SELECT id, (lineno + len(string_split(left(docstring, greatest(instr(docstring, raw_text) - 1, 0)), chr(10))) - 1)::BIGINT AS line FROM x")
def _(spark, folder):
    m = model(spark, folder)
    f = m.functions.select(F.col("id").alias("function_id"), "docstring", "lineno").filter("docstring is not null")
    return m.claims.join(f, "function_id").select("id", claims.line_of(F.col("docstring"), F.col("raw_text"), F.col("lineno")).alias("line"))


# -- parsers: rows only ------------------------------------------------------------------------------------------------


def _files(spark, folder):
    return model(spark, folder).analyses.select("id", "filename", "source_code", "language")


# The table of functions knows them too; its texts may begin with decorators, and those of CRLF files keep their ends.
_DEFS = f"""{WITH}, g AS (SELECT f.*, string_split(replace(source, chr(13), ''), chr(10)) AS l FROM f JOIN a ON a.id = f.analysis_id WHERE language = 'python'), h AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '^(async )?def ')), true) AS i FROM g),
y AS (SELECT id AS function_id, analysis_id AS id, name, (lineno + i - 1)::INT AS lineno, (lineno + len(l) - 1)::INT AS end_line, l[i:] AS body, return_annotation FROM h)"""


@query("python_functions", f"{_DEFS} SELECT id, name, lineno, end_line, array_to_string(body, chr(10)) AS source, return_annotation FROM y")
def _(spark, folder):
    return extract.functions(_files(spark, folder).filter("language = 'python'"), "id", "source_code", "language").select("id", "name", "lineno", "end_line", "source", "return_annotation")


@query(
    "python_raises",
    f"""{_DEFS}, z AS (SELECT id, name, lineno, unnest(body) AS x, unnest(range(len(body))) AS j, unnest(list_prepend('', body)) AS above FROM y)
    SELECT id, name, lineno, regexp_extract(x, '^\\s+raise (\\w+)', 1) AS exception_class, nullif(regexp_extract(above, '^\\s+if (.*):$', 1), '') AS condition, (lineno + j)::INT AS line FROM z WHERE regexp_matches(x, '^\\s+raise \\w+')""",
)
def _(spark, folder):
    rows = extract.functions(_files(spark, folder).filter("language = 'python'"), "id", "source_code", "language")
    return rows.select("id", "name", "lineno", F.explode("raise_statements").alias("r")).select("id", "name", "lineno", "r.exception_class", "r.condition", F.col("r.lineno").alias("line"))


@query("python_mutations")
def _(spark, folder):
    rows = extract.functions(_files(spark, folder).filter("language = 'python'"), "id", "source_code", "language")
    return rows.select("id", "name", "lineno", F.explode("mutation_patterns").alias("m")).select("id", "name", "lineno", "m.target", "m.method", "m.line")


@query("brace_language_functions")
def _(spark, folder):
    return extract.functions(_files(spark, folder).filter("language <> 'python'"), "id", "source_code", "language")


@query("doc_comments")
def _(spark, folder):
    return extract.comments(_files(spark, folder), "id", "source_code", "language")


@query("syntax_validate")
def _(spark, folder):
    return extract.syntax(_files(spark, folder), "id", "source_code", "language")


@query("doc_tree")
def _(spark, folder):
    return extract.documentation_tree(_files(spark, folder).filter("language = 'python'"), "id", "source_code")


@query("retrieval_chunks")
def _(spark, folder):
    return extract.retrieval_chunks(_files(spark, folder), "filename", "source_code")


@query("function_count_python", f"""{WITH} SELECT id, len(regexp_extract_all(regexp_replace(source_code, '\"\"\"[\\s\\S]*?\"\"\"', '', 'g'), '(?m)^[ \\t]*(?:async[ \\t]+)?def[ \\t]+\\w+[ \\t]*\\(')) AS n FROM a WHERE language = 'python'""")
def _(spark, folder):
    return extract.function_counts(_files(spark, folder), "id", "source_code", "language")


@query("bce_store")
def _(spark, folder):
    """Extraction as stored: functions with documentation, their claims, and the counters of their analyses."""
    rows = extract.functions(_files(spark, folder), "id", "source_code", "language").filter("docstring <> ''")
    keyed = rows.withColumnRenamed("id", "analysis_id").withColumn("id", F.md5(F.concat_ws(":", "analysis_id", "qualified_name", F.col("lineno").cast("string"))))
    both = claims.merged(claims.syntax_claims(keyed, "id"), claims.documentation_claims(keyed, "id"), "id")
    per = both.join(keyed.select("id", "analysis_id"), "id").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total_claims"))
    return keyed.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total_functions")).join(per, "analysis_id", "left").na.fill(0, ["total_claims"])


