"""Matrix operations on edge tables: self-loops, row sums, products, power series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.model import Graph


def self_loop_augmented(g: Graph) -> DataFrame:
    """Edges and a loop of weight 1 at every node."""
    return g.edges.unionByName(g.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))


def row_normalised(edges: DataFrame) -> DataFrame:
    """Weights divided by the sum of their row; rows whose sum isn't positive stay. Sums are added map-side, so a row of
    any number of entries costs as much as others; the join leaves a hub's entries to the engine's splitting of skew."""
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    return edges.join(total, "src").select("src", "dst", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(F.col("w")).alias("w"))


def strength(edges: DataFrame) -> DataFrame:
    """(node, d): row sum and column sum of each node together."""
    ends = F.explode(F.array("src", "dst")).alias("node")
    return edges.select(ends, "w").groupBy("node").agg(F.sum("w").alias("d"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product of two edge tables."""
    left, right = a.select("src", F.col("dst").alias("k"), F.col("w").alias("wa")), b.select(F.col("src").alias("k"), "dst", F.col("w").alias("wb"))
    return left.join(right, "k").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def adamic_adar(edges: DataFrame) -> DataFrame:
    """A D^-1 A with D the strengths: the sum over common neighbours of weight products over the neighbour's strength.
    A strength that isn't above 0 is an error when rows are read."""
    share = F.when(F.col("d") > 0, F.col("w") / F.col("d")).otherwise(F.raise_error(F.concat(F.lit("strength not above 0 at node "), F.col("node").cast("string"))).cast("double"))
    scaled = edges.join(strength(edges), edges.src == F.col("node")).select("src", "dst", share.alias("w"))
    return product(edges, scaled)


def one_minus(edges: DataFrame, nodes: DataFrame, beta: float) -> DataFrame:
    """I - beta A with the diagonal of A left out."""
    off = edges.filter("src <> dst").select("src", "dst", (F.col("w") * F.lit(-beta)).alias("w"))
    return off.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))


def power_series(edges: DataFrame, factor: float, terms: int, start: int = 1) -> DataFrame:
    """Sum over k from ``start`` to ``terms`` of factor^k A^k, for graphs whose powers stay small."""
    term, total = edges.select("src", "dst", (F.col("w") * F.lit(factor)).alias("w")), None
    for k in range(1, terms + 1):
        if k > 1:
            nxt = product(term, edges)
            term = runtime.materialize(nxt.select("src", "dst", (F.col("w") * F.lit(factor)).alias("w")), "term")
        if k >= start:
            total = term if total is None else total.unionByName(term)
    return total.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def katz(edges: DataFrame, beta: float, terms: int) -> DataFrame:
    """Truncated Katz index."""
    return power_series(edges, beta, terms)


def rooted_pagerank(g: Graph, alpha: float, steps: int, roots: DataFrame | None = None) -> DataFrame:
    """(node, rank): ``steps`` rounds of x <- (1 - alpha) r + alpha P'x from the root distribution r, uniform by default.

    A vector iteration: each round shuffles edges once, whatever the degrees. A node without out-edges keeps nothing.
    """
    p = runtime.materialize(row_normalised(g.edges), "transitions")
    if roots is None:
        n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
        roots = g.nodes.join(F.broadcast(n)).select("node", (F.lit(1.0) / F.col("n")).alias("r"))  # n is one row
    roots = runtime.materialize(roots, "roots")
    x = roots.select("node", F.col("r").alias("rank"))
    for _ in range(steps):
        flow = p.join(x, p.src == x.node).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("into"))
        x = runtime.materialize(roots.join(flow, roots.node == flow.dst, "left").select("node", (F.lit(1 - alpha) * F.col("r") + F.lit(alpha) * F.coalesce("into", F.lit(0.0))).alias("rank")), "rank")
    return x
