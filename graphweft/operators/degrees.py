"""Degrees, their histogram and quantiles, and samples of nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import functions as gf
from graphweft.model import Graph
from graphweft.operators import skewed_keys

QUANTILES = (*[round(0.05 * i, 2) for i in range(1, 20)], 0.99, 0.999)


def degrees(g: Graph) -> DataFrame:
    """(node, d_in, d_out) over distinct edges, nodes without edges included."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")
    there = g.edges.select(ends).select("x.*").unionByName(g.nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return there.groupBy("node").agg(F.sum("i").alias("d_in"), F.sum("o").alias("d_out"))


def histogram(g: Graph) -> DataFrame:
    """(degree, nodes) of d_in + d_out."""
    return degrees(g).groupBy((F.col("d_in") + F.col("d_out")).alias("degree")).agg(F.count(F.lit(1)).alias("nodes"))


def in_degree_quantiles(g: Graph, qs: Sequence[float] = QUANTILES) -> DataFrame:
    """(q, d_in): exact, from the histogram of in-degrees."""
    w = skewed_keys.weigh(degrees(g).select(F.lit(0).alias("k"), "d_in"), ["k"], "d_in")
    return skewed_keys.percentiles(w, ["k"], qs).select("q", F.col("value").alias("d_in"))


def sample_uniform(nodes: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return nodes.filter(gf.uniform(F.lit(seed), "node") < fraction)


def sample_by_degree(g: Graph, n: int, seed: int = 0) -> DataFrame:
    """n distinct nodes, drawn with weight d_in + d_out without replacement, by the least exponential clocks."""
    d = degrees(g).select("node", (F.col("d_in") + F.col("d_out")).alias("degree")).filter("degree > 0")
    return d.orderBy(-F.log(gf.uniform(F.lit(seed), "node")) / F.col("degree"), "node").limit(n).select("node", "degree")
