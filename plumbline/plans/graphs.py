"""Graphs: edges of the star schema stand for calls where SQL is to compare; the code graphs of the files themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import extract, graph
from plumbline.plans.catalogue import query
from plumbline.plans.common import WITH, model
from plumbline.sources.tables import table


def _edges(spark, folder):
    return table(spark, folder, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))


_E = "e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


@query("graph_edges_semi", f"WITH {_E}, n AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size <= 25) SELECT source, target FROM e WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)")
def _(spark, folder):
    nodes = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).union(table(spark, folder, "part").filter("p_size <= 25").select(F.concat(F.lit("p"), "p_partkey")))
    return graph.known_edges(_edges(spark, folder), nodes).select("source", "target")


@query("one_hop_neighbors", f"WITH {_E} SELECT DISTINCT target AS node FROM (SELECT source, target FROM e UNION ALL SELECT target, source FROM e) x WHERE source IN ('s1', 'p2', 'p3')")
def _(spark, folder):
    start = table(spark, folder, "supplier").filter("s_suppkey = 1").select(F.lit("s1").alias("node")).union(table(spark, folder, "part").filter("p_partkey in (2, 3)").select(F.concat(F.lit("p"), "p_partkey")))
    return graph.neighbours(_edges(spark, folder), start)


@query("call_edges_distinct", "WITH c AS (SELECT l_suppkey AS caller, p_name AS callee_name FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT p_name AS callee_name, max(p_partkey) AS callee FROM part GROUP BY 1) SELECT DISTINCT caller, callee FROM c JOIN n USING (callee_name) WHERE caller <> callee")
def _(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_name")
    calls = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").select("caller", F.col("p_name").alias("callee_name"))
    return graph.call_edges(calls, p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("node")))


@query(
    "graph_claim_violation_nodes",
    f"""{WITH} SELECT 'claim:' || c.id AS node, 'claim' AS type, CASE WHEN length(raw_text) > 50 THEN left(raw_text, 50) || '...' ELSE raw_text END AS name FROM c JOIN f ON f.id = c.function_id UNION ALL SELECT 'violation:' || v.id, 'violation', outcome FROM v JOIN c ON c.id = v.claim_id JOIN f ON f.id = c.function_id WHERE outcome = 'fail'""",
)
def _(spark, folder):
    m = model(spark, folder)
    return graph.claim_nodes(m.functions, m.claims, m.violations)[0]


@query("graph_claim_violation_edges", f"{WITH} SELECT 'function:' || c.function_id AS source, 'claim:' || c.id AS target, 'has_claim' AS type FROM c JOIN f ON f.id = c.function_id UNION ALL SELECT 'claim:' || v.claim_id, 'violation:' || v.id, 'has_violation' FROM v JOIN c ON c.id = v.claim_id JOIN f ON f.id = c.function_id WHERE outcome = 'fail'")
def _(spark, folder):
    m = model(spark, folder)
    return graph.claim_nodes(m.functions, m.claims, m.violations)[1]


def _files(spark, folder):
    return model(spark, folder).analyses.select("id", "source_code", "language")


@query("code_graph")
def _(spark, folder):
    return extract.graph_edges(_files(spark, folder), "id", "source_code", "language")


@query("code_graph_nodes")
def _(spark, folder):
    return extract.graph_nodes(_files(spark, folder), "id", "source_code", "language")


@query(
    "code_graph_with_claims",
    f"""{WITH}, g AS (SELECT f.*, list_position(list_transform(string_split(source, chr(10)), lambda x: regexp_matches(x, '^(async )?def ')), true) AS i FROM f JOIN a ON a.id = f.analysis_id WHERE language = 'python'),
    n AS (SELECT f.analysis_id, f.name, count(c.id) AS n_claims FROM f LEFT JOIN c ON c.function_id = f.id GROUP BY 1, 2) SELECT analysis_id, 'function:' || name || ':' || (lineno + i - 1) AS node, name, n_claims FROM g JOIN n USING (analysis_id, name)""",
)
def _(spark, folder):
    """Nodes of the files by name with the functions of the model that bear it: how many claims hang on each."""
    m = model(spark, folder)
    nodes = extract.graph_nodes(_files(spark, folder), "id", "source_code", "language").withColumnRenamed("id", "analysis_id")
    return graph.nodes_with_claims(nodes, m.functions, m.claims)
