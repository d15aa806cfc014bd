"""Figures of single nodes against all others: nearest nodes and counts of nearer nodes for a sample of nodes.

The sample is bounded (``SAMPLE`` nodes on average), so its vectors are broadcast and every other node is met once, in
Arrow batches, for any kind of embedding: sketches or dense vectors, undirected or directed. What leaves a task is a few
rows a sampled node, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.model import Embedding
from graphweft.operators.degrees import sample_uniform

SAMPLE, ROWS = 2000, 1024


def draw(nodes: DataFrame, count: int, size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(node): about ``size`` of the ``count`` nodes, by hash."""
    return runtime.materialize(sample_uniform(nodes, min(1.0, size / max(count, 1)), seed), "sample")


def _apart(a: np.ndarray, b: np.ndarray, sketch: bool) -> np.ndarray:
    if not sketch:
        return 1.0 - a @ b.T
    same = np.zeros((len(a), len(b)), np.int32)
    for s in range(a.shape[1]):
        same += a[:, s, None] == b[None, :, s]
    return 1.0 - same / a.shape[1]


def _distances(asked: list[np.ndarray], there: list[np.ndarray], sketch: bool) -> np.ndarray:
    """As :meth:`Embedding.pair_distances`, the sample being the source, to nine digits."""
    if len(asked) == 1:
        return np.round(_apart(asked[0], there[0], sketch), 9)
    (s, t), (u, v) = asked, there
    return np.round((_apart(s, u, sketch) + _apart(t, v, sketch) + _apart(s, v, sketch)) / 3.0, 9)


class _Asked:
    def __init__(self, e: Embedding, sample: DataFrame):
        self.cols = ["vec"] if e.symmetric else ["source", "target"]
        self.sketch = e.kind == "sketch"
        rows = e.vectors.join(sample.select("node"), "node", "left_semi").orderBy("node").collect()  # the sample
        self.nodes = np.array([r.node for r in rows], np.int64)
        self.vecs = [np.array([r[c] for r in rows]) for c in self.cols]

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Node ids and their distances from each sampled node; a node is never compared with itself."""
        for batch in batches:
            ids = np.asarray(batch.column(0))
            parts = [np.asarray(batch.column(1 + i).flatten()).reshape(len(ids), -1) for i in range(len(self.cols))]
            for i in range(0, len(ids), ROWS):
                d = _distances(self.vecs, [p[i : i + ROWS] for p in parts], self.sketch)
                d[self.nodes[:, None] == ids[None, i : i + ROWS]] = np.inf
                yield ids[i : i + ROWS], d


def _nearest(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    asked, want, farthest = given.value
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(want)
    for ids, d in asked.batches(batches):
        for q, k in enumerate(want.tolist()):
            dist, names = np.concatenate((kept[q][0], d[q])), np.concatenate((kept[q][1], ids))
            if len(dist) > k:
                cut = np.partition(dist, k - 1)[k - 1]
                near = np.flatnonzero(dist <= cut)
                near = near[np.lexsort((names[near], dist[near]))[:k]]
            else:
                near = slice(None)
            kept[q] = (dist[near], names[near])
    dist, names = (np.concatenate([x[i] for x in kept]) if kept else np.zeros(0) for i in (0, 1))
    q = np.repeat(asked.nodes, [len(x[0]) for x in kept])
    ok = dist < farthest
    yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(names[ok].astype(np.int64)), pa.array(dist[ok])], names=["node", "neighbour", "distance"])


def nearest(e: Embedding, sample: DataFrame, k: int, more: DataFrame | None = None, farthest: float = np.inf) -> DataFrame:
    """(node, neighbour, distance): per task each sampled node's k nearest nodes, and ``more`` (node, n) beyond them;
    nodes at ``farthest`` or beyond are nobody's nearest."""
    spark = e.vectors.sparkSession
    runtime.ship(spark)
    asked = _Asked(e, sample)
    extra = {r.node: r.n for r in more.collect()} if more is not None else {}  # a row a sampled node
    given = spark.sparkContext.broadcast((asked, np.array([k + extra.get(v, 0) for v in asked.nodes.tolist()], np.int64), farthest))
    return e.vectors.select("node", *asked.cols).mapInArrow(lambda b: _nearest(b, given), "node long, neighbour long, distance double")


def _counts(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    asked, at = given.value
    below, equal = [np.zeros(len(t), np.int64) for t in at], [np.zeros(len(t), np.int64) for t in at]
    for _, d in asked.batches(batches):
        for q, t in enumerate(at):
            if len(t):
                x = np.sort(d[q])
                lo, hi = np.searchsorted(x, t, "left"), np.searchsorted(x, t, "right")
                below[q] += lo
                equal[q] += hi - lo
    q = np.repeat(asked.nodes, [len(t) for t in at])
    cols = (pa.array(q), *(pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in ((at, float), (below, np.int64), (equal, np.int64))))
    yield pa.RecordBatch.from_arrays(list(cols), names=["node", "distance", "below", "equal"])


def counts(e: Embedding, sample: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(node, distance, below, equal): how many nodes are nearer to a sampled node than each of its ``thresholds``
    (node, distance), and how many are just there."""
    spark = e.vectors.sparkSession
    runtime.ship(spark)
    asked = _Asked(e, sample)
    rows = thresholds.groupBy("node").agg(F.sort_array(F.collect_set("distance")).alias("at")).collect()  # deleted neighbours of the sample
    at = {r.node: np.array(r["at"]) for r in rows}
    given = spark.sparkContext.broadcast((asked, [at.get(v, np.zeros(0)) for v in asked.nodes.tolist()]))
    parts = e.vectors.select("node", *asked.cols).mapInArrow(lambda b: _counts(b, given), "node long, distance double, below long, equal long")
    return parts.groupBy("node", "distance").agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"))


def _ends(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """(node, neighbour): the pairs (src, dst) from both ends, of sampled nodes, once each."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour")))).alias("x")
    return pairs.select(both).select("x.*").filter("node <> neighbour").join(sample.select("node"), "node", "left_semi").distinct()


def _split_ends(split: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and deleted neighbours of the sample; a pair with an edge in either set of a directed graph counts as train."""
    train = _ends(split.filter("not deleted"), sample)
    return train, _ends(split.filter("deleted"), sample).join(train, ["node", "neighbour"], "left_anti")


def vcmpr(e: Embedding, split: DataFrame, sample: DataFrame, k: int = 10) -> DataFrame:
    """(node, found, precision): deleted neighbours among each sampled node's k nearest that aren't train neighbours.

    Nodes without a deleted edge are left out; precision is found over min(number of deleted, k). Sketches without a
    common slot are at the greatest distance and are nobody's nearest.
    """
    train, gone = _split_ends(split, sample)
    train, gone = runtime.materialize(train, "train"), runtime.materialize(gone, "gone")
    asked = gone.groupBy("node").agg(F.count(F.lit(1)).alias("n_deleted"))
    near = nearest(e, asked, k, train.groupBy("node").agg(F.count(F.lit(1)).alias("n")), 1.0 if e.kind == "sketch" else np.inf)
    place = F.row_number().over(Window.partitionBy("node").orderBy("distance", "neighbour"))
    best = near.join(train, ["node", "neighbour"], "left_anti").withColumn("place", place).filter(F.col("place") <= k)
    found = best.join(gone, ["node", "neighbour"], "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("found"))
    return asked.join(found, "node", "left").select("node", F.coalesce("found", F.lit(0)).cast("long").alias("found"), (F.coalesce("found", F.lit(0)) / F.least("n_deleted", F.lit(k))).alias("precision"))


def centric_auc(e: Embedding, split: DataFrame, count: int, sample: DataFrame, mode: str = "average") -> DataFrame:
    """(node, auc, degree): for each deleted neighbour the share of other nodes, train and deleted neighbours aside, that
    are farther, ties half. ``mode`` "last" keeps the farthest neighbour's figure instead of the average."""
    train, gone = _split_ends(split, sample)
    train, gone = runtime.materialize(train, "train"), runtime.materialize(gone, "gone")

    def lengths(pairs: DataFrame) -> DataFrame:
        apart = e.pair_distances(pairs.select(F.col("node").alias("src"), F.col("neighbour").alias("dst")))
        return apart.select(F.col("src").alias("node"), F.round("distance", 9).alias("distance"))

    own = lengths(train).select("node", "distance", F.lit(0).alias("hit")).unionByName(lengths(gone).select("node", "distance", F.lit(1).alias("hit")))
    level = runtime.materialize(own.groupBy("node", "distance").agg(F.count(F.lit(1)).alias("own"), F.sum("hit").alias("hits")), "levels")
    upto = Window.partitionBy("node").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)  # the neighbours of a sampled node
    level = level.withColumn("own_below", F.coalesce(F.sum("own").over(upto), F.lit(0))).filter("hits > 0")
    all_ = counts(e, sample, level.select("node", "distance"))
    degree = train.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    deleted = gone.groupBy("node").agg(F.count(F.lit(1)).alias("n_deleted"))
    base = deleted.join(degree, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), (F.lit(count) - 1 - F.coalesce("degree", F.lit(0)) - F.col("n_deleted")).alias("total"))
    seen = level.join(all_, ["node", "distance"]).join(base, "node")
    nearer = F.col("below") - F.col("own_below") + (F.col("equal") - F.col("own")) / 2
    scored = seen.select("node", "degree", "distance", "hits", F.coalesce(F.try_divide(F.col("total") - nearer, F.col("total")), F.lit(0.5)).alias("score"))
    figure = F.max_by("score", "distance") if mode == "last" else F.sum(F.col("score") * F.col("hits")) / F.sum("hits")
    return scored.groupBy("node", "degree").agg(figure.alias("auc"))
