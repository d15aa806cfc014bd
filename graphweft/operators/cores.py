"""p-functions of nodes restricted to a subset, and generalized cores by peeling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime


def _within(edges: DataFrame, subset: DataFrame, node: str, other: str) -> DataFrame:
    inside = subset.select(F.col("node").alias("_o"))
    return edges.join(inside, F.col(other) == F.col("_o"), "left_semi").select(F.col(node).alias("node"), "w")


def _figure(rows: DataFrame, subset: DataFrame, agg) -> DataFrame:
    got = rows.groupBy("node").agg(agg.alias("p"))
    return subset.select("node").join(got, "node", "left").select("node", F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("p"))


def p_in(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """(node, p): in-edges from nodes of the subset."""
    return _figure(_within(edges, subset, "dst", "src"), subset, F.count(F.lit(1)))


def p_out(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """(node, p): out-edges to nodes of the subset."""
    return _figure(_within(edges, subset, "src", "dst"), subset, F.count(F.lit(1)))


def p_degree(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """(node, p): in- and out-edges within the subset."""
    return _figure(_within(edges, subset, "src", "dst").unionByName(_within(edges, subset, "dst", "src")), subset, F.count(F.lit(1)))


def p_weight(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """(node, p): weight of in- and out-edges within the subset."""
    return _figure(_within(edges, subset, "src", "dst").unionByName(_within(edges, subset, "dst", "src")), subset, F.sum("w"))


def p_core(edges: DataFrame, nodes: DataFrame, least: float, p: Callable[[DataFrame, DataFrame], DataFrame] = p_degree) -> DataFrame:
    """(node): the greatest subset in which every node has p >= ``least``; nodes below are peeled, and their edges with them,
    until none is left to peel."""
    left, n, work = nodes.select("node"), nodes.count(), edges
    while True:
        before, left = left, runtime.materialize(p(work, left).filter(F.col("p") >= least).select("node"), "core")
        now = left.count()
        if now == n:
            return left
        n = now
        inner = work.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
        outer, work = work, runtime.materialize(inner.select("src", "dst", "w"), "core_edges")
        if outer is not edges:
            runtime.discard(outer)
            runtime.discard(before)
