"""The k most similar vectors of every vector, by a hierarchical k-means tree with best-bin-first traversal.

A tree of two levels is fitted on a sample of at most ``SAMPLE`` vectors a field; every vector is indexed in it. A query
takes bins from a priority queue, nearest centroid first: a popped inner node puts its leaves into the queue, a popped
leaf is visited. As a node leaves the queue before its leaves enter it, a leaf's turn is the larger of the two
distances, which is computed for a whole batch at once. A pair is met if either of the two visits the other's leaf, and
counts for both. The number of leaves to visit is widened until calibration queries, compared with all vectors by brute
force, reach the wanted recall.

Leaves of an inner node are packed into cells of about ``ROWS`` vectors; a larger leaf is cut into blocks. A vector goes
to the cell of its leaf once, and as a query to other cells that hold leaves it visits. Of vectors of equal direction only the
k + 1 least ids are compared; the rest get their neighbours from these, so a group of copies of any size stays cheap.

Defined results: vectors that are null, of another dimension, not finite or all zero take no part; repeated rows of an
id are one; ties of equal vectors go to the smaller id (of vectors of one direction and other lengths, whose cosines differ by
rounding only, any); a vector is never its own neighbour; a field without vectors has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft import runtime

SAMPLE, LEAF, PER_LEAF, QUERIES, ROWS = 200_000, 256, 48, 1000, 20_000
OUT = "field string, id long, neighbour long, cosine double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable vectors, and these as unit vectors."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)).astype(bool)
    rows = np.flatnonzero(fits)
    flat = column.filter(pa.array(fits)).flatten()
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan"))).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    top = np.abs(x).max(axis=1, initial=0)
    odd = ~(np.isfinite(norm) & (norm > 1e-150)) & np.isfinite(top) & (top > 0)  # squares leave the range
    if odd.any():
        x = x.copy()
        x[odd] /= top[odd, None]
        norm[odd] = np.sqrt(np.einsum("ij,ij->i", x[odd], x[odd]))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def _directions(batches: Iterator[pa.RecordBatch], dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """A hash of the direction, to five digits, of each usable vector, with the row or alone. Vectors so near differ in no
    cosine that is told apart here."""
    odd = np.random.default_rng(1).integers(1, 1 << 62, dim, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        rows, x = _matrix(batch.column(1), dim)
        with np.errstate(over="ignore"):
            h = (np.rint(x * 1e5).astype(np.int64).astype(np.uint64) * odd).sum(axis=1)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = pa.array(h.astype(np.int64))
        if whole:
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), h], names=["id", "vec", "h"])
        else:
            yield pa.RecordBatch.from_arrays([h], names=["h"])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 12) -> np.ndarray:
    """Centres of at most k clusters."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(turns):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros(c.shape)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


class Tree:
    """Centres of inner nodes and of leaves, and each leaf's inner node."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.inner = _kmeans(x, math.ceil(math.sqrt(leaves)), rng)
        near = np.argmin(self._apart(x, self.inner), axis=1)
        parts, owner = [], []
        for i in range(len(self.inner)):
            own = x[near == i]
            c = _kmeans(own, max(1, round(leaves * len(own) / len(x))), rng) if len(own) else self.inner[i : i + 1]
            parts.append(c)
            owner += [i] * len(c)
        self.leaf, self.owner = np.concatenate(parts), np.array(owner)

    @staticmethod
    def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c * c).sum(1) - 2 * (x @ c.T)

    def turns(self, x: np.ndarray) -> np.ndarray:
        """The key by which each leaf leaves the priority queue."""
        return np.maximum(self._apart(x, self.leaf), self._apart(x, self.inner)[:, self.owner])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the first to be visited."""
        return np.concatenate([np.argmin(self.turns(x[i : i + 4096]), axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _pack(tree: Tree, x: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Each leaf's cell and each cell's number of blocks, by the sample's share of the leaves."""
    rows = np.bincount(tree.home(x), minlength=len(tree.leaf)) / len(x) * total
    cell, blocks, filled, last = np.zeros(len(rows), np.int64), [], 0.0, -1
    for f in range(len(rows)):
        if last != tree.owner[f] or filled + rows[f] > ROWS:
            blocks.append(1)
            filled, last = 0.0, tree.owner[f]
        cell[f] = len(blocks) - 1
        filled += rows[f]
        blocks[-1] = max(blocks[-1], math.ceil(rows[f] / ROWS))
    return cell, np.array(blocks)


def _true(batches: Iterator[pa.RecordBatch], given, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Per partition, each calibration query's best by brute force: (q, cosine, turn, id), ``turn`` being the number of leaves
    that the query, or else the other vector, visits before the leaf of the other."""
    queries, own, tree = given.value
    n = len(queries)
    score, ids, kept = np.full((n, 0), -2, np.float32), np.zeros((n, 0), np.int64), np.zeros((n, 0, dim), np.float32)
    for batch in batches:
        rows, x = _matrix(batch.column(1), dim)
        node = np.asarray(batch.column(0))[rows]
        for i in range(0, len(x), 4096):
            s = queries @ x[i : i + 4096].T
            s[own[:, None] == node[None, i : i + 4096]] = -2
            far = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            score = np.concatenate((score, np.take_along_axis(s, far, 1)), 1)
            ids, kept = np.concatenate((ids, node[i + far]), 1), np.concatenate((kept, x[i + far]), 1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, ids, kept = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1), np.take_along_axis(kept, top[:, :, None], 1)
    turns = tree.turns(queries)
    home, q = np.argmin(turns, axis=1), np.repeat(np.arange(n), score.shape[1])
    flat, there = kept.reshape(-1, dim), score.ravel() > -2
    turn = np.zeros(len(q), np.int64)
    for i in range(0, len(q), 4096):
        other, mine = tree.turns(flat[i : i + 4096]), q[i : i + 4096]
        at = np.arange(len(mine))
        back = (other < other[at, home[mine]][:, None]).sum(1)
        goal = turns[mine, np.argmin(other, axis=1)]
        turn[i : i + 4096] = np.minimum(back, (turns[mine] < goal[:, None]).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(q[there]), pa.array(score.ravel()[there].astype(np.float64)), pa.array(turn[there]), pa.array(ids.ravel()[there])], names=["q", "cosine", "turn", "id"])


def calibrate(vectors: DataFrame, tree: Tree, queries: np.ndarray, own: np.ndarray, dim: int, k: int, recall: float, least: float) -> int:
    """Number of leaves to visit so that the queries find the share ``recall`` of their k nearest of cosine ``least``."""
    spark = vectors.sparkSession
    if len(tree.leaf) == 1 or not len(queries):
        return 1
    given = spark.sparkContext.broadcast((queries, own, tree))
    best = vectors.mapInArrow(lambda b: _true(b, given, dim, k), "q long, cosine double, turn long, id long").distinct()
    ranked = best.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "turn")), asc=False), 1, k).alias("top")).select("q", F.explode("top").alias("t")).filter(F.col("t.cosine") >= least)
    turn = np.sort(ranked.select("t.turn").toPandas()["turn"].to_numpy())  # k rows a query
    return int(turn[min(len(turn) - 1, math.ceil(recall * len(turn)) - 1)]) + 1 if len(turn) else 1


def _route(batches: Iterator[pa.RecordBatch], given, dim: int, visits: int) -> Iterator[pa.RecordBatch]:
    """Each vector in its cell and block, and as a query in the others that it visits."""
    tree, cell_of, blocks = given.value
    for batch in batches:
        rows, vectors = _matrix(batch.column(1), dim)
        every = np.asarray(batch.column(0))[rows]
        for i in range(0, len(rows), 4096):
            ids, x = every[i : i + 4096], vectors[i : i + 4096]
            turns = tree.turns(x)
            v = min(visits, turns.shape[1])
            leaves = np.argpartition(turns, v - 1, axis=1)[:, :v].ravel()
            home = np.argmin(turns, axis=1)
            who, cells = np.repeat(np.arange(len(ids)), v), cell_of[leaves]
            place = np.lexsort((leaves, cells, who))
            who, cells, leaves = who[place], cells[place], leaves[place]
            cut = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (cells[1:] != cells[:-1]))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(leaves)), pa.int32()), pa.array(leaves, pa.int32()))
            who, cells = who[cut], cells[cut]
            n = blocks[cells]
            rep = np.repeat(np.arange(len(who)), n)
            block = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            who, cells = who[rep], cells[rep]
            query = (cell_of[home[who]] != cells) | (block != (ids[who] & np.int64(0x7FFFFFFF)) % n[rep])
            raw = pa.py_buffer(np.ascontiguousarray(x[who]).tobytes())
            vec = pa.Array.from_buffers(pa.binary(4 * dim), len(who), [None, raw]).cast(pa.binary())
            cols = (pa.array(cells, pa.int32()), pa.array(block, pa.int32()), pa.array(query), pa.array(ids[who], pa.int64()), pa.array(home[who], pa.int32()), lists.take(pa.array(rep)), vec)
            yield pa.RecordBatch.from_arrays(list(cols), names=["cell", "block", "query", "id", "leaf", "leaves", "vec"])


_ROUTED = "cell int, block int, query boolean, id long, leaf int, leaves array<int>, vec binary"


def _visit(table: pa.Table, k: int, least: float) -> pa.Table:
    """Answers of one block of a cell: for each query the best k of the block's vectors in the leaves it visits."""
    table = table.combine_chunks()
    ids, query, leaf = (np.asarray(table.column(c)) for c in ("id", "query", "leaf"))
    vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(len(ids), -1)
    lists = table.column("leaves").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    asked, n = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
    who = np.repeat(np.arange(len(ids)), n)
    # Distinct vectors of the block, each with its k + 1 least ids.
    data = np.flatnonzero(~query)
    key = np.ascontiguousarray(vec[data]).view(np.dtype((np.void, 4 * vec.shape[1]))).ravel()
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    by = np.lexsort((ids[data], group))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (group[by][1:] != group[by][:-1]) | (ids[data[by]][1:] != ids[data[by]][:-1])
    by = by[fresh]
    begin = np.searchsorted(group[by], np.arange(len(first) + 1))
    x, x_leaf = vec[data[first]], leaf[data[first]]
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Of a later leaf no worse answer is needed, for a query or for a vector of the block; one of the best may be itself.
    kth, kth_x = np.full(len(ids), least - 1e-6, np.float32), np.full(len(x), least - 1e-6, np.float32)
    for f in np.unique(x_leaf).tolist():
        own, ask = np.flatnonzero(x_leaf == f), who[asked == f]
        for i in range(0, len(ask), 2048):
            a = ask[i : i + 2048]
            s = vec[a] @ x[own].T
            if s.shape[1] > k:
                kth[a] = np.maximum(kth[a], np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1])
            if s.shape[0] > k:
                kth_x[own] = np.maximum(kth_x[own], np.partition(s, s.shape[0] - k - 1, axis=0)[s.shape[0] - k - 1])
            r, c = np.nonzero((s >= kth[a][:, None]) | (s >= kth_x[own][None, :]))
            got.append((a[r], own[c], s[r, c]))
    q = np.concatenate([g[0] for g in got]) if got else np.zeros(0, int)
    d = np.concatenate([g[1] for g in got]) if got else np.zeros(0, int)
    s = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.float32)
    member = np.minimum(begin[d + 1] - begin[d], k + 1) if len(d) else np.zeros(0, int)
    rep = np.repeat(np.arange(len(d)), member)
    row = data[by[np.repeat(begin[d] if len(d) else d, member) + np.arange(len(rep)) - np.repeat(np.cumsum(member) - member, member)]] if len(d) else d
    # Each pair counts for both; the few best by the fast product are scored once more, alike wherever they meet.
    me, other, score = np.concatenate((q[rep], row)), np.concatenate((row, q[rep])), np.concatenate((s[rep], s[rep]))

    def ranked(score: np.ndarray, most: int) -> np.ndarray:
        order = np.lexsort((ids[other], -score, ids[me]))
        mine = ids[me[order]]
        return order[np.arange(len(order)) - np.searchsorted(mine, mine) < most]

    pair = np.lexsort((-score, ids[other], ids[me]))
    once = np.ones(len(pair), bool)
    once[1:] = (ids[me[pair]][1:] != ids[me[pair]][:-1]) | (ids[other[pair]][1:] != ids[other[pair]][:-1])
    pair = pair[once & (ids[me[pair]] != ids[other[pair]])]
    me, other, score = me[pair], other[pair], score[pair]
    top = ranked(score, k + 3)
    me, other = me[top], other[top]
    exact = np.concatenate([np.einsum("ij,ij->i", vec[me[i : i + 65536]].astype(np.float64), vec[other[i : i + 65536]].astype(np.float64)) for i in range(0, len(me), 65536)]) if len(me) else np.zeros(0)
    top = ranked(exact, k)
    top = top[exact[top] >= least - 1e-6]
    return pa.table({"id": ids[me[top]], "neighbour": ids[other[top]], "cosine": np.minimum(exact[top], 1.0)})


def nearest(df: DataFrame, field: str, id: str, vector: str, dim: int, k: int = 5, recall: float = 0.93, least: float = -1.0, seed: int = 0) -> DataFrame:
    """(field, id, neighbour, cosine): the k most similar vectors of each, those of cosine at least ``least``.

    The wanted ``recall`` is over the neighbours that ``least`` admits. Sample and calibration queries are bounded by
    ``SAMPLE`` and ``QUERIES``; everything else covers all rows. Below 3000 vectors or so the tree knows its queries.
    """
    spark = df.sparkSession
    runtime.ship(spark)
    vectors = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") == dim))
    hashes = vectors.mapInArrow(lambda b: _directions(b, dim, False), "h long")
    hot = runtime.materialize(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select("h"), "copies")  # 8 bytes a vector
    rest = None
    if not hot.isEmpty():
        kept = f"id long, vec {dict(vectors.dtypes)['vec']}, h long"
        vectors, rest = _thin(vectors.mapInArrow(lambda b: _directions(b, dim, True), kept), hot, k)
    total = vectors.count()
    wanted = QUERIES + min(SAMPLE, PER_LEAF * (total // LEAF + 1))
    share = min(1.0, 1.1 * wanted / max(total, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) <= int(share * 1_000_000)).limit(2 * wanted).select("id", "vec").toArrow().combine_chunks()
    rows, x = _matrix(drawn.column("vec").combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float32())), dim)
    if not len(x):
        return spark.createDataFrame([], OUT)
    own = np.asarray(drawn.column("id"))[rows]
    # Queries from all over the table, which the tree isn't fitted on, as it would know them better than others.
    pick = np.argsort(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    pick, fit = pick[:QUERIES], pick[QUERIES:] if len(pick) > 2 * QUERIES else pick
    tree = Tree(x[fit], max(1, min(total // LEAF, len(fit) // PER_LEAF)), seed)
    visits = calibrate(vectors.select("id", "vec"), tree, x[pick], own[pick], dim, k, recall, least)
    given = spark.sparkContext.broadcast((tree, *_pack(tree, x, total)))
    routed = vectors.select("id", "vec").mapInArrow(lambda b: _route(b, given, dim, visits), _ROUTED)
    found = routed.groupBy("cell", "block").applyInArrow(lambda t: _visit(t, k, least), "id long, neighbour long, cosine double")
    in_order = F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "neighbour")))  # at most k of a block
    best = found.groupBy("id").agg(F.slice(in_order, 1, k).alias("top")).select("id", F.explode("top").alias("t")).select("id", "t.neighbour", (-F.col("t.far")).alias("cosine"))
    if rest is not None:
        best = best.unionByName(rest)
    return best.select(F.lit(field).alias("field"), "id", "neighbour", "cosine")


def _thin(hashed: DataFrame, hot: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The vectors without all but the k + 1 least ids of each hot copy, and (id, neighbour, cosine) of those left out."""
    members = runtime.materialize(hashed.join(hot, "h", "left_semi").select("h", "id").distinct(), "members")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    low = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    heads = runtime.materialize(low.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).filter(F.col("r") <= k + 1).select("h", "id", "r"), "heads")
    few = hashed.join(heads.select("h", "id"), ["h", "id"], "left_semi").groupBy("h", "id").agg(F.first("vec").alias("vec"))
    kept = runtime.materialize(hashed.join(hot, "h", "left_anti").select("id", "vec").unionByName(few.select("id", "vec")), "thinned")
    left = members.join(heads, ["h", "id"], "left_anti")
    rest = left.join(heads.filter(F.col("r") <= k).select("h", F.col("id").alias("neighbour")), "h").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    return kept, rest
