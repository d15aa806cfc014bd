"""How well an embedding keeps a decomposition: nearest neighbours in the embedding against the blocks of the graph.

A neighbour table (node, neighbour, distance, rank) stands for the index of an embedding; it is stored and loaded like any
table (:mod:`graphweft.sources.store`). A node counts with its min(neighbours, degree) nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.model import Embedding, Graph
from graphweft.operators import density, sketch
from graphweft.operators.density import BLOCK_QUANTILES


def neighbour_index(e: Embedding, k: int) -> DataFrame:
    """(node, neighbour, distance, rank): the k nearest nodes of every node of an undirected sketch, exactly."""
    dim = e.vectors.select(F.size("vec")).first()[0]
    return runtime.materialize(sketch.nearest_of(e.vectors, e.vectors.select("node"), dim, k), "index")


def counted(index: DataFrame, edges: DataFrame) -> DataFrame:
    """The index up to each node's degree in ``edges`` (both directions)."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return index.join(degree, "node").filter("rank <= degree").select("node", "neighbour", "distance")


def block_check(near: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """(block, n, mean, mean_in, mean_out, min_in_block, fraction_out, kl, degree) of each block: distances to counted
    neighbours in blocks up to its own and beyond, and the divergence of its neighbours' blocks from those of its edges."""
    pairs = near.select(F.col("node").alias("src"), F.col("neighbour").alias("dst"))
    embedded, original = density.transitions(pairs, member), density.transitions(edges.select("src", "dst"), member)
    out = density.in_out_stats(near, member).join(density.fraction_out(embedded).withColumnRenamed("fraction", "fraction_out"), "block")
    out = out.join(density.transition_kl(embedded, original), "block")
    return out.join(density.block_degrees(edges, member), "block")


def quantiles(values: DataFrame, value: Column, name: str, qs=BLOCK_QUANTILES) -> DataFrame:
    """(q, name) over a row a block."""
    at = F.array(*[F.lit(q) for q in qs])
    return values.select(value.alias("v")).filter("v is not null").agg(F.percentile("v", at).alias("v")).select(F.posexplode(F.arrays_zip(at.alias("q"), F.col("v"))).alias("k", "x")).select(F.col("x.q").alias("q"), F.col("x.v").alias(name))


def kl_quantiles(check: DataFrame, qs=BLOCK_QUANTILES) -> DataFrame:
    """(q, kl); blocks whose divergence is infinite count as such."""
    return quantiles(check, F.col("kl"), "kl", qs)


def weighted_ratio(check: DataFrame) -> DataFrame:
    """(ratio): mean of mean_in / mean_out weighted by block degree, without the last block, which has no edge out."""
    last = check.agg(F.max("block").alias("last"))
    r = check.join(F.broadcast(last)).filter("block < last and mean_out > 0 and mean_in is not null")  # last is one row
    return r.agg((F.sum(F.col("degree") * F.col("mean_in") / F.col("mean_out")) / F.sum("degree")).alias("ratio"))


def community_evaluation(lengths: DataFrame, community: DataFrame, qs=(0.05, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """(figure, value) over communities with inner and outer edges: quantiles of mean_in / mean_out, its mean plain and
    weighted by size, and the number of communities where it is 1 or more. ``lengths`` (community, mean_in, mean_out)."""
    size = community.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    r = runtime.materialize(lengths.filter("mean_out > 0 and mean_in is not null").join(size, "community").select("size", (F.col("mean_in") / F.col("mean_out")).alias("ratio")), "ratios")
    whole = r.agg(F.avg("ratio").alias("mean"), (F.sum(F.col("ratio") * F.col("size")) / F.sum("size")).alias("weighted_mean"), F.count(F.when(F.col("ratio") >= 1, 1)).cast("double").alias("not_below_one"), F.count(F.lit(1)).cast("double").alias("communities"))
    parts = whole.unpivot([], ["mean", "weighted_mean", "not_below_one", "communities"], "figure", "value")
    return parts.unionByName(quantiles(r, F.col("ratio"), "value", qs).select(F.concat(F.lit("q"), F.col("q")).alias("figure"), "value"))


# A decomposition (node, block) as stored


def block_starts(member: DataFrame) -> DataFrame:
    """(block, start, size): the place of each block's first node when nodes are in order of block."""
    sizes = density.block_sizes(member)
    upto = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))  # a row a block
    return sizes.select("block", (upto - F.col("size")).alias("start"), "size")


def summary(member: DataFrame) -> DataFrame:
    """(blocks, nodes, mean_size)."""
    return density.block_sizes(member).agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("nodes"), F.avg("size").alias("mean_size"))


def block_points(member: DataFrame, block: int) -> DataFrame:
    """(node) of one block."""
    return member.filter(F.col("block") == block).select("node")


def densest_block(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, block) of the given nodes; blocks are disjoint, so a node's block is the densest it is in."""
    return member.join(nodes.select("node"), "node", "left_semi")


def community_blocks(community: DataFrame, member: DataFrame) -> DataFrame:
    """(community, block, n, share): how many nodes of each community lie in each block, and n for 200 nodes of the block."""
    n = community.join(member, "node").groupBy("community", "block").agg(F.count(F.lit(1)).alias("n"))
    return n.join(density.block_sizes(member), "block").select("community", "block", "n", (F.col("n") * 200 / F.col("size")).alias("share"))


def community_block_range(community: DataFrame, member: DataFrame) -> DataFrame:
    """(community, first, last): the range of blocks that its nodes lie in."""
    return community.join(member, "node").groupBy("community").agg(F.min("block").alias("first"), F.max("block").alias("last"))


@dataclass(frozen=True)
class Analysis:
    member: DataFrame
    index: DataFrame
    check: DataFrame


def analyse(g: Graph, e: Embedding, member: DataFrame | None = None, index: DataFrame | None = None, steps: int = 500, k: int | None = None) -> Analysis:
    """Decomposition and index, unless given, and the check of all blocks. ``k`` is the mean block size, at most 64, by default."""
    if member is None:
        member = density.decompose(g, steps)[0]
    if index is None:
        k = k or max(1, min(int(summary(member).first().mean_size or 1), 64))
        index = neighbour_index(e, k)
    edges = runtime.materialize(g.edges.select("src", "dst", "w"), "edges")
    return Analysis(member, index, runtime.materialize(block_check(runtime.materialize(counted(index, edges), "counted"), edges, member), "check"))
