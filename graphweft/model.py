"""Graphs, embeddings and parameters as data frames with a few facts about them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft import functions as gf

OUT, IN, INOUT = 0, 1, 2


@dataclass(frozen=True)
class Graph:
    """``edges`` (src, dst, w): distinct ordered pairs without self-loops, both directions if not ``directed``.
    ``nodes`` (node): every node, also those with self-loops only."""

    edges: DataFrame
    nodes: DataFrame
    directed: bool

    def transposed(self) -> Graph:
        return Graph(transpose(self.edges), self.nodes, self.directed)


@dataclass(frozen=True)
class Embedding:
    """``vectors`` (node, vec) of an undirected graph, or (node, source, target) of a directed one."""

    vectors: DataFrame
    distance: Callable[[Column, Column], Column]
    symmetric: bool
    kind: str = "sketch"

    def pair_distances(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (src, dst) with ``distance``; pairs without a vector are left out."""
        cols = ["vec"] if self.symmetric else ["source", "target"]
        a = self.vectors.select(F.col("node").alias("src"), *[F.col(c).alias(f"{c}_a") for c in cols])
        b = self.vectors.select(F.col("node").alias("dst"), *[F.col(c).alias(f"{c}_b") for c in cols])
        joined = pairs.join(a, "src").join(b, "dst")
        if self.symmetric:
            d = self.distance(F.col("vec_a"), F.col("vec_b"))
        else:
            d = gf.directed_distance(self.distance, *[F.col(f"{c}_{s}") for s in "ab" for c in ("source", "target")])
        return joined.withColumn("distance", d).select(*pairs.columns, "distance")


def ranks_of(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rank) of the given nodes in an index (node, rank)."""
    return index.join(nodes.select("node").distinct(), "node", "left_semi")


def nodes_at(index: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, rank) of the given ranks."""
    return index.join(ranks.select("rank").distinct(), "rank", "left_semi").select("node", "rank")


@dataclass(frozen=True)
class SketchParams:
    dim: int = 16
    decay: float = 0.2
    hops: int = 2
    symmetric: bool = True


@dataclass(frozen=True)
class HopeParams:
    """``method``: ADA, RPR or KATZ; ``rank`` with ``nbiter``, or ``epsil`` with ``maxrank``."""

    method: str = "ADA"
    rank: int = 20
    nbiter: int = 5
    epsil: float | None = None
    maxrank: int = 100
    blockiter: int = 3
    alpha: float = 0.5
    beta: float = 0.01


@dataclass(frozen=True)
class ValidationParams:
    delete_fraction: float = 0.15
    nbpass: int = 1
    symmetric: bool = True
    centric: bool = False
    seeds: tuple[int, ...] = field(default=(0,))


def usable_rows(rows: DataFrame) -> DataFrame:
    """Edge rows with both ends and a positive weight; a missing weight is 1, NaN and weights not above 0 are damage."""
    good = "src is not null and dst is not null and (w is null or (w > 0 and not isnan(w)))"
    return rows.filter(good).withColumn("w", F.coalesce("w", F.lit(1.0)))


def build(rows: DataFrame, directed: bool = True) -> Graph:
    """Rows (src, dst, w) to a graph: repeated edges add up, self-loops go but their nodes stay."""
    r = usable_rows(rows)
    nodes = r.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    edges = r.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return Graph(edges if directed else symmetrise(edges), nodes, directed)


def transpose(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", *more)


def symmetrise(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")
    return edges.select(both, "w").groupBy("x.src", "x.dst").agg(F.sum("w").alias("w"))


def last_weight(rows: DataFrame, order: str) -> DataFrame:
    """Repeated edges keep the weight of their last row."""
    return usable_rows(rows).groupBy("src", "dst").agg(F.max_by("w", order).alias("w"))


def index_nodes(rows: DataFrame, order: str, blocks: int = 256) -> DataFrame:
    """(node, rank) by first appearance in ``order`` (source before target), ranked in blocks of the range of ``order``."""
    from pyspark.sql import Window

    seen = usable_rows(rows).select(F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col(order) * 2).alias("at")), F.struct(F.col("dst").alias("node"), (F.col(order) * 2 + 1).alias("at")))).alias("x"))
    first = seen.groupBy("x.node").agg(F.min("x.at").alias("at"))
    span = first.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    placed = first.join(F.broadcast(span)).withColumn("block", F.floor((F.col("at") - F.col("lo")) * blocks / (F.col("hi") - F.col("lo") + 1)).cast("int"))  # span is one row
    n = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("block", (F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # at most ``blocks`` rows
    inside = F.row_number().over(Window.partitionBy("block").orderBy("at"))
    return placed.withColumn("inside", inside).join(before, "block").select("node", (F.col("before") + F.col("inside") - 1).cast("long").alias("rank"))
