"""Node and edge tables: calls resolved by name, edges between known nodes, neighbours, claims attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import cut
from plumbline.session import written


def call_edges(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(caller, callee) distinct, without loops. calls: (caller, callee_name); names: (name, node), of several nodes of a
    name the greatest counts. Names are reduced to one node before the join, so it cannot multiply rows."""
    known = names.groupBy(F.col("name").alias("callee_name")).agg(F.max("node").alias("callee"))
    return calls.join(known, "callee_name").filter("caller <> callee").select("caller", "callee").distinct()


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (source, target, ...) both of whose ends are among the nodes (node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): the distinct ends of edges that touch a node of start (node), in either direction; start itself only where
    an edge leads back to it."""
    both = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.join(start.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("node")).distinct()


def claim_nodes(functions: DataFrame, claims: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claims and failed tests: claim nodes with their text cut at 50 characters, violation nodes, and the
    edges has_claim and has_violation."""
    c = claims.join(functions.select(F.col("id").alias("function_id")), "function_id", "left_semi")
    v = violations.filter("outcome = 'fail'").join(c.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    nodes = c.select(F.concat(F.lit("claim:"), "id").alias("node"), F.lit("claim").alias("type"), cut(F.col("raw_text"), 50).alias("name")).union(v.select(F.concat(F.lit("violation:"), "id"), F.lit("violation"), F.col("outcome")))
    edges = c.select(F.concat(F.lit("function:"), "function_id").alias("source"), F.concat(F.lit("claim:"), "id").alias("target"), F.lit("has_claim").alias("type")).union(
        v.select(F.concat(F.lit("claim:"), "claim_id"), F.concat(F.lit("violation:"), "id"), F.lit("has_violation"))
    )
    return nodes, edges


def nodes_with_claims(nodes: DataFrame, functions: DataFrame, claims: DataFrame) -> DataFrame:
    """(analysis_id, node, name, n_claims): function and method nodes of the files with the claims of the model's functions
    of that name in the same analysis; 0 where there is none. nodes: (analysis_id, node, type, name). Claims are summed
    by function and name before they meet the nodes, so the join does not multiply."""
    per = claims.groupBy(F.col("function_id").alias("id")).agg(F.count(F.lit(1)).alias("n_claims"))
    named = functions.select("id", "analysis_id", "name").join(per, "id", "left").groupBy("analysis_id", "name").agg(F.sum("n_claims").alias("n_claims"))
    own = nodes.filter("type in ('function', 'method')").select("analysis_id", "node", "name")
    return own.join(named, ["analysis_id", "name"], "left").select("analysis_id", "node", "name", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def numbered(df: DataFrame, order: str, name: str = "place", parts: int = 64) -> DataFrame:
    """df with a global number from 0 in the order of a column, without a single task that sees all rows: ranges are sorted
    apart, and each adds the counts of the ranges before it. Values of the column are distinct."""
    sorted_ = written(df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row per range
    w = Window.partitionBy("_p").orderBy(order)
    joined = sorted_.withColumn("_i", F.row_number().over(w) - 1).join(F.broadcast(before), "_p")
    return joined.select(*df.columns, (F.col("_i") + F.col("_before")).cast("bigint").alias(name))
