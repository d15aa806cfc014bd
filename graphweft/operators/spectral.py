"""Spectral embeddings: randomised SVD of edge tables by distributed products, and a generalized SVD of small matrices.

Only blocks of nodes x rank numbers are dense. They live as tables (node, v ARRAY), are multiplied by edge tables in
the JVM and by small matrices in numpy, batch by batch; the driver sees rank x rank matrices only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import functions as gf
from graphweft import runtime
from graphweft.model import Embedding, Graph, HopeParams, transpose
from graphweft.operators import normalize


PROBES = 16


def multiply(edges: DataFrame, block: DataFrame, k: int, width: int = 32) -> DataFrame:
    """(node, v): the edge table times a block of k columns, ``width`` sums at a time."""
    joined = edges.join(block.select(F.col("node").alias("dst"), "v"), "dst")
    out = None
    for lo in range(0, k, width):
        sums = joined.groupBy("src").agg(*[F.sum(F.col("w") * F.col("v")[i]).alias(f"x{i}") for i in range(lo, min(k, lo + width))])
        out = sums if out is None else out.join(sums, "src")
    return out.select(F.col("src").alias("node"), F.array(*[f"x{i}" for i in range(k)]).alias("v"))


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).reshape(-1, k)


def gram(block: DataFrame, k: int) -> np.ndarray:
    """B'B, a k x k matrix: one partial product a partition, added by cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for b in batches:
            x = _matrix(b, k)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(g.ravel())], names=["cell", "g"])

    runtime.ship(block.sparkSession)
    g = np.zeros(k * k)
    for r in block.select("v").mapInArrow(partial, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect():  # k * k rows
        g[r.cell] = r.g
    return g.reshape(k, k)


def turn(block: DataFrame, m: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    k, n = m.shape

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b, k) @ m
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * n, pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], names=["node", "v"])

    runtime.ship(block.sparkSession)
    return block.select("node", "v").mapInArrow(turned, f"node {dict(block.dtypes)['node']}, v array<double>")


def orthonormal(block: DataFrame, k: int, name: str = "block") -> tuple[DataFrame, int]:
    """Orthonormal columns with the span of the block, by its Gram matrix twice over; dependent columns drop out."""
    for _ in range(2):
        block = runtime.materialize(block, name)
        val, vec = np.linalg.eigh(gram(block, k))
        keep = val > max(val.max(), 0) * 1e-13
        if not keep.any():
            return block.limit(0), 0
        block, k = turn(block, vec[:, keep] / np.sqrt(val[keep])), int(keep.sum())
    return runtime.materialize(block, name), k


Product = Callable[[DataFrame, int], DataFrame]


def products(edges: DataFrame) -> tuple[Product, Product]:
    """The edge table and its transpose as products with blocks."""
    edges = runtime.materialize(edges, "matrix")
    return lambda x, k: multiply(edges, x, k), lambda x, k: multiply(transpose(edges), x, k)


def _plus(x: DataFrame, y: DataFrame, a: float, b: float) -> DataFrame:
    """a x + b y of two blocks; a node that one of them lacks has zeros there."""
    both = x.join(y.withColumnRenamed("v", "_v"), "node", "full")
    total = F.zip_with("v", "_v", lambda p, q: F.lit(a) * p + F.lit(b) * q)
    alone = F.transform(F.coalesce("v", "_v"), lambda p: p * F.when(F.col("v").isNotNull(), F.lit(a)).otherwise(F.lit(b)))
    return both.select("node", F.when(F.col("v").isNotNull() & F.col("_v").isNotNull(), total).otherwise(alone).alias("v"))


def hope_products(g: Graph, p: HopeParams) -> tuple[Product, Product]:
    """The proximity matrix and its transpose as sparse products in turn, never written out, so a hub costs its edges
    only: A D^-1 A for ADA; (1 - alpha) times the sum of (alpha P)^k for RPR and the sum of (beta A)^k for KATZ, to the power ``nbiter``."""
    if p.method == "ADA":
        fore, back = products(g.edges)
        d = runtime.materialize(normalize.strength(g.edges).filter("d > 0"), "strengths")

        def through(first: Product, second: Product) -> Product:
            def run(x: DataFrame, k: int) -> DataFrame:
                y = runtime.materialize(first(x, k), "product").join(d, "node").select("node", F.transform("v", lambda v: v / F.col("d")).alias("v"))
                return second(y, k)

            return run

        return through(fore, fore), through(back, back)
    if p.method not in ("RPR", "KATZ"):
        raise ValueError(f"no such method: {p.method}")
    fore, back = products(normalize.row_normalised(g.edges) if p.method == "RPR" else g.edges)
    factor = p.alpha if p.method == "RPR" else p.beta

    def series(once: Product) -> Product:
        def run(x: DataFrame, k: int) -> DataFrame:
            x = runtime.materialize(x, "series")
            y = x
            for _ in range(p.nbiter - (p.method == "KATZ")):
                y = runtime.materialize(_plus(x, once(y, k), 1.0, factor), "series")
            last, scale = (y, 1 - p.alpha) if p.method == "RPR" else (once(y, k), p.beta)
            return last.select("node", F.transform("v", lambda v: v * F.lit(scale)).alias("v"))

        return run

    return series(fore), series(back)


def randomised_svd(edges: DataFrame | tuple[Product, Product], nodes: DataFrame, rank: int, nbiter: int = 3, extra: int = 8, seed: int = 0) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(sigma, U, V) of an edge table, or of a matrix given by its products: randomised range finder with ``nbiter`` power iterations."""
    k = rank + extra
    fore, back = edges if isinstance(edges, tuple) else products(edges)
    start = nodes.select("node", F.array(*[F.sqrt(-2 * F.log(gf.uniform(F.lit(f"a{seed}"), "node", F.lit(i)))) * F.cos(2 * np.pi * gf.uniform(F.lit(f"b{seed}"), "node", F.lit(i))) for i in range(k)]).alias("v"))
    q, r = orthonormal(fore(start, k), k, "range")
    for _ in range(nbiter):
        z, rz = orthonormal(back(q, r), r, "range")
        q, r = orthonormal(fore(z, rz), rz, "range")
    # B = Q'A; B' = A'Q has the Gram matrix BB' = W S^2 W'.
    bt = runtime.materialize(back(q, r), "small")
    val, vec = np.linalg.eigh(gram(bt, r))
    top = np.argsort(-val)[:rank]
    top = top[val[top] > max(val.max(), 0) * 1e-14]
    sigma = np.sqrt(val[top])
    return sigma, turn(q, vec[:, top]), turn(bt, vec[:, top] / sigma)


def adaptive_svd(edges: DataFrame | tuple[Product, Product], nodes: DataFrame, epsil: float, maxrank: int, blockiter: int, step: int = 16, seed: int = 0) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Rank doubles from ``step`` until the part outside the range is at most ``epsil`` of the matrix's norm, or ``maxrank``.

    The part outside is estimated by random vectors: the norm of M x less that of its projection, ``PROBES`` of them."""
    fore, back = edges if isinstance(edges, tuple) else products(edges)
    probe = nodes.select("node", F.array(*[F.when(gf.uniform(F.lit(f"p{seed}"), "node", F.lit(i)) < 0.5, -1.0).otherwise(1.0) for i in range(PROBES)]).alias("v"))
    whole = float(np.trace(gram(runtime.materialize(fore(probe, PROBES), "probe"), PROBES))) / PROBES
    rank = min(step, maxrank)
    while True:
        sigma, u, v = randomised_svd((fore, back), nodes, rank, blockiter, seed=seed)
        rest = max(0.0, whole - float((sigma**2).sum())) ** 0.5
        if rest <= epsil * whole**0.5 or rank >= maxrank or len(sigma) < rank:
            return sigma, u, v
        rank = min(2 * rank, maxrank)


def _scaled(sigma: np.ndarray, u: DataFrame, v: DataFrame, scale: np.ndarray) -> DataFrame:
    """(node, source, target): scaled singular vectors, zeros where a side has no entry."""
    s, t = turn(u, np.diag(scale)), turn(v, np.diag(scale))
    zero = F.array(*[F.lit(0.0)] * len(scale))
    both = s.withColumnRenamed("v", "source").join(t.withColumnRenamed("v", "target"), "node", "full")
    return both.select("node", F.coalesce("source", zero).alias("source"), F.coalesce("target", zero).alias("target"))


def hope_matrix(g: Graph, p: HopeParams) -> DataFrame:
    """The proximity matrix written out, for small graphs: ADA Adamic-Adar, RPR truncated rooted PageRank, KATZ truncated Katz."""
    if p.method == "ADA":
        return normalize.adamic_adar(g.edges)
    if p.method == "RPR":
        loops = g.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
        series = normalize.power_series(normalize.row_normalised(g.edges), p.alpha, p.nbiter).unionByName(loops)
        return series.groupBy("src", "dst").agg((F.sum("w") * F.lit(1 - p.alpha)).alias("w"))
    if p.method == "KATZ":
        return normalize.katz(g.edges, p.beta, p.nbiter)
    raise ValueError(f"no such method: {p.method}")


def hope(g: Graph, p: HopeParams = HopeParams()) -> tuple[Embedding, np.ndarray]:
    """Source and target vectors sqrt(sigma) U, sqrt(sigma) V, so that their dot product approximates the proximity; sigma."""
    m = hope_products(g, p)
    if p.epsil is not None:
        sigma, u, v = adaptive_svd(m, g.nodes, p.epsil, p.maxrank, p.blockiter)
    else:
        sigma, u, v = randomised_svd(m, g.nodes, p.rank, p.nbiter)
    return Embedding(_scaled(sigma, u, v, np.sqrt(sigma)), gf.dot_distance, False, "hope"), sigma


@dataclass(frozen=True)
class Gsvd:
    """A = U diag(c) X', B = V diag(s) X' with c^2 + s^2 = 1, quotients c / s decreasing, infinite ones first."""

    u: np.ndarray
    v: np.ndarray
    c: np.ndarray
    s: np.ndarray
    x: np.ndarray

    @property
    def k(self) -> int:
        """Number of directions that only A has."""
        return int((self.s < 1e-10).sum())

    @property
    def l(self) -> int:  # noqa: E743
        return len(self.c) - self.k


def gsvd(a: np.ndarray, b: np.ndarray) -> Gsvd:
    """Generalized SVD of small matrices with as many columns: SVD of the stacked pair, then of its upper part."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    q, d, wt = np.linalg.svd(np.vstack((a, b)), full_matrices=False)
    r = int((d > d.max() * max(a.shape[0] + b.shape[0], a.shape[1]) * np.finfo(float).eps).sum())
    q1, q2 = q[: len(a), :r], q[len(a) :, :r]
    u, c, zt = np.linalg.svd(q1, full_matrices=True)
    c = np.concatenate((np.minimum(c, 1.0), np.zeros(r - len(c))))
    vs = q2 @ zt.T
    s = np.linalg.norm(vs, axis=0)
    v = np.where(s > 1e-12, vs / np.maximum(s, 1e-300), 0.0)
    u = np.hstack((u, np.zeros((len(a), max(0, r - u.shape[1])))))[:, :r]
    return Gsvd(u, v, c, s, (wt[:r].T * d[:r]) @ zt.T)


def hope_by_gsvd(g: Graph, p: HopeParams, most: int = 2000) -> tuple[Embedding, np.ndarray]:
    """HOPE of a graph of at most ``most`` nodes from the generalized SVD of the pair (Ml', Mg'), proximity Mg^-1 Ml, in
    full: KATZ has Mg = I - beta A, Ml = beta A; RPR has Mg = I - alpha P, Ml = (1 - alpha) I. Quotients are in decreasing
    order, NaN last; the pairs of the first ``rank`` of them are kept."""
    nodes = [r.node for r in g.nodes.orderBy("node").limit(most + 1).collect()]
    if len(nodes) > most:
        raise ValueError(f"more than {most} nodes")
    at, a = {v: i for i, v in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for r in (normalize.row_normalised(g.edges) if p.method == "RPR" else g.edges).collect():  # at most ``most`` squared
        a[at[r.src], at[r.dst]] += r.w
    eye = np.eye(len(nodes))
    ml, mg = {"KATZ": (p.beta * a, eye - p.beta * a), "RPR": ((1 - p.alpha) * eye, eye - p.alpha * a)}[p.method]
    d = gsvd(ml.T, mg.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma = d.c / d.s
    order = np.argsort(np.where(np.isnan(sigma), np.inf, -sigma), kind="stable")[: p.rank]
    scale = np.sqrt(sigma[order])
    source, target = d.v[:, order] * scale, d.u[:, order] * scale
    rows = [(v, source[i].tolist(), target[i].tolist()) for i, v in enumerate(nodes)]
    return Embedding(g.nodes.sparkSession.createDataFrame(rows, "node long, source array<double>, target array<double>"), gf.dot_distance, False, "hope"), decreasing_nan_last(sigma)[: p.rank]


def approximate_gsvd(a: np.ndarray, b: np.ndarray, rank: int, seed: int = 0) -> Gsvd:
    """Each matrix is first reduced to the range of its product with a random one."""
    rng = np.random.default_rng(seed)

    def reduced(m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, float)
        q = np.linalg.qr(m @ rng.standard_normal((m.shape[1], min(rank + 4, m.shape[1]))))[0]
        return q.T @ m

    return gsvd(reduced(a), reduced(b))


def gsvd_residual(a: np.ndarray, b: np.ndarray, g: Gsvd) -> float:
    """Largest relative error of the two reconstructions."""
    ra = np.linalg.norm(a - (g.u * g.c) @ g.x.T) / max(np.linalg.norm(a), 1e-300)
    return max(ra, np.linalg.norm(b - (g.v * g.s) @ g.x.T) / max(np.linalg.norm(b), 1e-300))


def decreasing_nan_last(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, float)
    return np.concatenate((np.sort(v[~np.isnan(v)])[::-1], v[np.isnan(v)]))


def is_orthonormal(u: np.ndarray, tolerance: float = 1e-5) -> bool:
    return bool(np.abs(u.T @ u - np.eye(u.shape[1])).max(initial=0) < tolerance)
