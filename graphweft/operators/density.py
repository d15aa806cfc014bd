"""Density-friendly decomposition: load balancing, isotonic regression, stable blocks, and figures of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft import runtime
from graphweft.model import Graph

BLOCK_QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
CLOSE = 1e-6  # loads so near are equal


def half_edges(g: Graph) -> DataFrame:
    """(src, dst, w): each pair of linked nodes once, src < dst, with its summed weight."""
    pairs = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    total = pairs.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return total if g.directed else total.withColumn("w", F.col("w") / 2)


def start_split(edges: DataFrame) -> DataFrame:
    """(src, dst, w, a, b): half of each edge's weight to either end."""
    return edges.select("src", "dst", "w", (F.col("w") / 2).alias("a"), (F.col("w") / 2).alias("b"))


def loads(alpha: DataFrame) -> DataFrame:
    """(node, load): what the edges give each node."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("a").alias("v")), F.struct(F.col("dst").alias("node"), F.col("b").alias("v")))).alias("x")
    return alpha.select(ends).groupBy("x.node").agg(F.sum("x.v").alias("load"))


def balance_step(alpha: DataFrame, t: int) -> DataFrame:
    """One synchronous step: each edge moves towards giving all to the end of smaller load, by 2 / (2 + t)."""
    gamma = 2.0 / (2.0 + t)
    r = loads(alpha).withColumn("load", F.round("load", 9))
    ra, rb = r.select(F.col("node").alias("src"), F.col("load").alias("ra")), r.select(F.col("node").alias("dst"), F.col("load").alias("rb"))
    seen = alpha.join(ra, "src").join(rb, "dst")

    def moved(old: str, mine: str, other: str):
        goal = F.when(F.col(mine) < F.col(other), F.col("w")).when(F.col(mine) > F.col(other), F.lit(0.0)).otherwise(F.col(old))
        return (F.lit(1 - gamma) * F.col(old) + F.lit(gamma) * goal).alias(old)

    return seen.select("src", "dst", "w", moved("a", "ra", "rb"), moved("b", "rb", "ra"))


def balance(edges: DataFrame, steps: int, first: int = 1) -> DataFrame:
    """The split after ``steps`` steps; lineage is cut after each, and the split before it deleted."""
    alpha = runtime.materialize(start_split(edges), "split")
    for t in range(first, first + steps):
        before, alpha = alpha, runtime.materialize(balance_step(alpha, t), "split")
        runtime.discard(before)
    return alpha


def tentative_density(alpha: DataFrame) -> DataFrame:
    """(node, y): each edge's whole weight to the end that has the larger part, ties to the target."""
    gainer = F.when(F.col("a") > F.col("b"), F.col("src")).otherwise(F.col("dst")).alias("node")
    got = alpha.select(gainer, "w").groupBy("node").agg(F.sum("w").alias("y"))
    nodes = alpha.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(got, "node", "left").select("node", F.coalesce("y", F.lit(0.0)).alias("y"))


@dataclass
class Block:
    """A pooled block: points first to last in order of x, its centroid and weight."""

    first: int
    last: int
    x: float
    y: float
    w: float


class Isotonic:
    """Pool-adjacent-violators over weighted points; blocks and interpolation between their centroids."""

    def __init__(self, x, y, w=None, ascending: bool = True, close: float = 1e-6):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(x):
            raise ValueError("no points")
        w = np.ones(len(x)) if w is None else np.asarray(w, float)
        self.order = np.argsort(x, kind="stable")
        self.ascending, self.blocks = ascending, []
        self.centre = (float((x * w).sum() / w.sum()), float((y * w).sum() / w.sum()))
        sign = 1 if ascending else -1
        for i, p in enumerate(self.order):
            b = Block(i, i, float(x[p]), float(y[p]), float(w[p]))
            # A point at the x of the one before it belongs to its block; then blocks out of order are pooled.
            if self.blocks and x[p] - x[self.order[i - 1]] <= close:
                b = self._pool(self.blocks.pop(), b)
            while self.blocks and sign * (b.y - self.blocks[-1].y) <= 0:
                b = self._pool(self.blocks.pop(), b)
            self.blocks.append(b)

    @staticmethod
    def _pool(p: Block, q: Block) -> Block:
        w = p.w + q.w
        return Block(p.first, q.last, (p.x * p.w + q.x * q.w) / w, (p.y * p.w + q.y * q.w) / w, w)

    def block_of(self, point: int) -> int:
        """The block of a point, by its place in the input."""
        place = int(np.flatnonzero(self.order == point)[0])
        return next(k for k, b in enumerate(self.blocks) if b.first <= place <= b.last)

    def __call__(self, x: float) -> float:
        """Linear between centroids; left of the first along its line to the common centroid, right of the last along the last two."""
        bs = self.blocks
        for b in bs:
            if b.x == x:
                return b.y
        if len(bs) == 1:
            return bs[0].y
        k = int(np.searchsorted([b.x for b in bs], x))
        if k == 0:
            (x1, y1), (x2, y2) = (bs[0].x, bs[0].y), self.centre
        else:
            k = min(k, len(bs) - 1)
            (x1, y1), (x2, y2) = (bs[k - 1].x, bs[k - 1].y), (bs[k].x, bs[k].y)
        return y1 + (y2 - y1) * (x - x1) / (x2 - x1)


def _tied(points: list[tuple]) -> list[tuple]:
    """Points (lo, hi, n, total) in decreasing load, those within ``CLOSE`` of the one before made one with it."""
    out = []
    for lo, hi, n, total in points:
        if out and out[-1][0] - hi <= CLOSE:
            _, hi, m, more = out.pop()
            n, total = n + m, total + more
        out.append((lo, hi, n, total))
    return out


def _mean(n: int, total: float) -> float:
    return total / n


def _settled(v: float) -> float:
    """``v`` to nine decimals, below 1 to nine digits: up to some millions, what is left does not depend on the order of adding."""
    return round(v, 9) if abs(v) >= 1 else float(f"{v:.9g}")


def _settled_mean(n: int, total: float) -> float:
    return _settled(_settled(total) / n)


def _pooled(points: list[tuple], mean: Callable[[int, float], float] = _mean) -> list[tuple]:
    """Adjacent points (lo, hi, n, total) pooled until their means strictly decrease."""
    out = []
    for lo, hi, n, total in points:
        while out and mean(n, total) >= mean(*out[-1][2:]):
            _, hi, m, more = out.pop()
            n, total = n + m, total + more
        out.append((lo, hi, n, total))
    return out


def _pool_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a range of loads. Its first and last ties may go on in the ranges beside it, so they aren't pooled here."""
    points = _tied([(x, x, n, y) for b in batches for x, n, y in zip(*(c.to_pylist() for c in b.columns))])
    kept = points[:1] + _pooled(points[1:-1]) + points[1:][-1:]
    cols = list(zip(*kept)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.float64(), pa.int64(), pa.float64()))], names=["lo", "hi", "n", "total"])


def blocks_of_density(density: DataFrame) -> DataFrame:
    """(block, lo, hi, n, y): the decreasing isotonic regression of density over nodes in decreasing load, exactly.

    Only loads within ``CLOSE`` of each other are one point. Points are pooled inside ranges of loads, then the blocks
    left of all ranges on the driver: contiguous runs may be pooled first, the regression stays the same. There
    means that are equal to nine decimals (below 1, nine digits) are one block, and y comes from the total so rounded.
    ``density`` (node, load, y).
    """
    spark = density.sparkSession
    runtime.ship(spark)
    points = density.groupBy("load").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    ranges = points.repartitionByRange(F.desc("load")).sortWithinPartitions(F.desc("load"))
    rows = ranges.mapInArrow(_pool_range, "lo double, hi double, n long, total double").collect()
    fit = _pooled(_tied(sorted(map(tuple, rows), key=lambda r: -r[1])), _settled_mean)
    return spark.createDataFrame([(k, lo, hi, n, _settled(total) / n) for k, (lo, hi, n, total) in enumerate(fit)], "block int, lo double, hi double, n long, y double")


def node_blocks(density: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, block) by the least loads of the blocks, looked up for whole batches."""
    spark = density.sparkSession
    runtime.ship(spark)
    least = spark.sparkContext.broadcast(np.array([-r.lo for r in blocks.orderBy("block").select("lo").collect()]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(least.value, -b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32())], names=["node", "block"])

    return density.select("node", "load").mapInArrow(place, T.StructType([density.schema["node"], T.StructField("block", T.IntegerType())]))


def stable_prefixes(alpha: DataFrame, member: DataFrame) -> DataFrame:
    """(block, stable): whether the union of the blocks up to this one is stable.

    Cross edges give their whole weight to the outer end; the union is stable if the least load inside still exceeds
    the greatest outside. All prefixes are judged at once: an edge between blocks i < j moves for prefixes i .. j - 1,
    so a node's load is constant over spans of prefixes, as many as it has neighbour blocks.
    """
    r = loads(alpha)
    ba, bb = member.select(F.col("node").alias("src"), F.col("block").alias("ia")), member.select(F.col("node").alias("dst"), F.col("block").alias("ib"))
    cross = runtime.materialize(alpha.join(ba, "src").join(bb, "dst").filter("ia <> ib"), "cross")
    last = member.agg(F.max("block")).first()[0]
    if last is None:
        return alpha.sparkSession.createDataFrame([], "block int, stable boolean")
    inner = F.col("ia") < F.col("ib")

    def side(inside: bool) -> DataFrame:
        """(node, at, moved): what the edges to the blocks ``at`` move away from a node, or to it."""
        near, far = ("src", "dst"), ("dst", "src")
        node, other = near if inside else far
        cols = (F.when(inner, F.col(node)).otherwise(F.col(other)).alias("node"), F.greatest("ia", "ib").alias("to"), F.least("ia", "ib").alias("from"), F.when(inner, F.col("a")).otherwise(F.col("b")).alias("moved"))
        return cross.select(*cols).groupBy("node", F.col("to" if inside else "from").alias("at")).agg(F.sum("moved").alias("moved"))

    placed = r.join(member, "node")
    order = Window.partitionBy("node").orderBy("at")  # at most a row a block
    # Inside: from its own block on, a node lacks what goes to blocks beyond the prefix; a step at each of those blocks.
    lost = side(True)
    steps = lost.withColumn("nxt", F.lead("at").over(order)).withColumn("beyond", F.coalesce(F.sum("moved").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    first = lost.groupBy("node").agg(F.min("at").alias("at"), F.sum("moved").alias("all"))
    inside = placed.join(first, "node", "left").select(F.col("block").alias("lo"), F.coalesce(F.col("at") - 1, F.lit(last)).alias("hi"), (F.col("load") - F.coalesce("all", F.lit(0.0))).alias("v"))
    inside = inside.unionByName(placed.join(steps, "node").select(F.col("at").alias("lo"), F.coalesce(F.col("nxt") - 1, F.lit(last)).alias("hi"), (F.col("load") - F.col("beyond")).alias("v")))
    # Outside: before its own block, a node has what comes from the blocks of the prefix.
    gained = side(False)
    steps = gained.withColumn("nxt", F.lead("at").over(order)).withColumn("upto", F.sum("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = gained.groupBy("node").agg(F.min("at").alias("at"))
    outside = placed.join(begin, "node", "left").select(F.lit(0).alias("lo"), (F.coalesce("at", "block") - 1).alias("hi"), F.col("load").alias("v"))
    outside = outside.unionByName(placed.join(steps, "node").select(F.col("at").alias("lo"), (F.coalesce("nxt", "block") - 1).alias("hi"), (F.col("load") + F.col("upto")).alias("v")))

    def by_prefix(spans: DataFrame, figure, best, none: float) -> np.ndarray:
        """The least or greatest of the spans over each prefix. Any span is two of a power of two, so at most a row per
        block and power is left, and each power is handed down to its halves."""
        long = F.length(F.bin(F.col("hi") - F.col("lo") + 1)) - 1
        cells = spans.filter("lo <= hi").select(long.alias("level"), "lo", "hi", "v").select("level", F.explode(F.array(F.col("lo"), F.expr("hi + 1 - shiftleft(1, level)"))).alias("at"), "v")
        rows = cells.groupBy("level", "at").agg(figure("v").alias("v")).collect()
        v = np.full((int(last + 1).bit_length(), last + 1), none)
        for r in rows:
            v[r.level, r["at"]] = r.v
        for level in range(len(v) - 1, 0, -1):
            half = 1 << (level - 1)
            v[level - 1] = best(v[level - 1], v[level])
            v[level - 1, half:] = best(v[level - 1, half:], v[level, :-half])
        return v[0]

    low, high = by_prefix(inside, F.min, np.minimum, np.inf), by_prefix(outside, F.max, np.maximum, -np.inf)
    return alpha.sparkSession.createDataFrame([(k, bool(low[k] > high[k])) for k in range(last + 1)], "block int, stable boolean")


def merge_unstable(member: DataFrame, stable: DataFrame) -> DataFrame:
    """(node, block): blocks up to the next stable prefix become one; trailing blocks join the last."""
    starts = stable.withColumn("new", F.lag("stable").over(Window.orderBy("block")))  # one row a block
    merged = starts.withColumn("stable_block", F.sum(F.when(F.col("new"), 1).otherwise(0)).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    return member.join(F.broadcast(merged.select("block", "stable_block")), "block").select("node", F.col("stable_block").cast("int").alias("block"))


def decompose(g: Graph, steps: int = 20) -> tuple[DataFrame, DataFrame]:
    """(node, block) of the stable decomposition, densest first, and the balanced split."""
    alpha = balance(half_edges(g), steps)
    density = runtime.materialize(loads(alpha).join(tentative_density(alpha), "node"), "density")
    member = runtime.materialize(node_blocks(density, blocks_of_density(density)), "blocks")
    return runtime.materialize(merge_unstable(member, stable_prefixes(alpha, member)), "stable"), alpha


# Figures of a decomposition (node, block)


def block_sizes(member: DataFrame) -> DataFrame:
    return member.groupBy("block").agg(F.count(F.lit(1)).alias("size"))


def node_block_degrees(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(node, block, degree): rows of ``edges`` (both directions) at each node of the decomposition."""
    d = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return member.join(d, "node", "left").select("node", "block", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def block_degrees(edges: DataFrame, member: DataFrame) -> DataFrame:
    return node_block_degrees(edges, member).groupBy("block").agg(F.sum("degree").alias("degree"))


def block_degree_quantiles(edges: DataFrame, member: DataFrame, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """(block, q, degree): exact, from counts per block and degree."""
    from graphweft.operators import skewed_keys

    w = skewed_keys.weigh(node_block_degrees(edges, member), ["block"], "degree")
    return skewed_keys.percentiles(w, ["block"], qs).select("block", "q", F.col("value").alias("degree"))


def _crossings(edges: DataFrame, member: DataFrame) -> DataFrame:
    a, b = member.select(F.col("node").alias("src"), F.col("block").alias("i")), member.select(F.col("node").alias("dst"), F.col("block").alias("j"))
    return edges.join(a, "src").join(b, "dst")


def transitions(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(i, j, n, p): edges from block to block and their share of the row."""
    n = _crossings(edges, member).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


def fraction_out(transition: DataFrame) -> DataFrame:
    """(block, fraction): the share of edges that lead to later blocks."""
    return transition.groupBy(F.col("i").alias("block")).agg(F.sum(F.when(F.col("j") > F.col("i"), F.col("p")).otherwise(0.0)).alias("fraction"))


def transition_kl(p: DataFrame, q: DataFrame) -> DataFrame:
    """(block, kl): divergence of the rows of p from those of q; infinite where q lacks a transition of p."""
    both = p.filter("p > 0").select("i", "j", "p").join(q.select("i", "j", F.col("p").alias("q")), ["i", "j"], "left")
    term = F.when(F.coalesce("q", F.lit(0.0)) > 0, F.col("p") * F.log(F.col("p") / F.col("q"))).otherwise(F.lit(float("inf")))
    return both.groupBy(F.col("i").alias("block")).agg(F.sum(term).alias("kl"))


def in_out_stats(neighbours: DataFrame, member: DataFrame) -> DataFrame:
    """(block, n, mean, mean_in, mean_out, min_in_block) over ranked neighbours (node, neighbour, distance)."""
    pairs = _crossings(neighbours.select(F.col("node").alias("src"), F.col("neighbour").alias("dst"), "distance"), member)
    d = F.col("distance")
    return pairs.groupBy(F.col("i").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.avg(F.when(F.col("j") <= F.col("i"), d)).alias("mean_in"), F.avg(F.when(F.col("j") > F.col("i"), d)).alias("mean_out"), F.min(F.when((F.col("j") == F.col("i")) & (d > 0), d)).alias("min_in_block"))


def ratio_quantiles(stats: DataFrame, qs=BLOCK_QUANTILES) -> DataFrame:
    """(q, ratio) of mean_in over mean_out; blocks without one of them don't count."""
    r = stats.filter("mean_out > 0 and mean_in is not null").select((F.col("mean_in") / F.col("mean_out")).alias("r"))
    return r.agg(F.percentile("r", F.array(*[F.lit(q) for q in qs])).alias("v")).select(F.posexplode("v").alias("k", "ratio")).select(F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("k") + 1).alias("q"), "ratio")  # one row a block


def community_in_out(edges: DataFrame, distances: DataFrame, community: DataFrame) -> DataFrame:
    """(community, mean_in, mean_out): mean length of edges inside and across the border of each community."""
    long = edges.join(distances, ["src", "dst"])
    inside = community.select(F.col("node").alias("src"), "community").join(long, "src")
    there = community.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    seen = inside.join(there, (inside.dst == there.dst) & (inside.community == F.col("other")), "left").drop(there.dst)
    d = F.col("distance")
    return seen.groupBy("community").agg(F.avg(F.when(F.col("other").isNotNull(), d)).alias("mean_in"), F.avg(F.when(F.col("other").isNull(), d)).alias("mean_out"))
