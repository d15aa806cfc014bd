"""Held-out evaluation passages inside a corpus, by latent semantic retrieval and exact checks.

Words are maximal runs of Unicode letters and numbers in lower case. The evaluation items are a stated query set, taken
in blocks of ``BLOCK`` characters; a block's words are the terms, so everything that reaches the driver or is broadcast
is bounded by a block. One scan of the corpus keeps the places where ``LEAST`` of ``WINDOW`` consecutive words are
terms; no other place can hold a run of an item's words. Passages are windows of ``WINDOW`` words at every ``STRIDE``-th
word of a document and at every word of an item. A randomised SVD of the TF-IDF passages (two passes over the kept
places, summed by term across the cluster) gives latent vectors; each distinct passage is held against all item
passages by cosine. A run of ``RUN`` = WINDOW + STRIDE - 1 common words always holds one aligned window, whose latent
vector equals that of the item's window, so no such run is missed at any cosine threshold below 1. Candidates are then
checked by longest common subsequence, which gives the longest common run too, and by the item's key terms (its rarest).

Defined results: null and empty texts and items are never found; repeated rows of a document give one result; an item
shorter than a window is one passage, filled up with blanks, and found only where ``LEAST`` words of a window are item
words; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.llm import text_units as tu

WINDOW, STRIDE, LEAST, RUN = 8, 5, 6, 12
RANK, COSINE, SAME, BLOCK, CHARS = 48, 0.95, 0.9999, 2_000_000, 4_000_000
SCHEMA = "doc_id long, item_id long, longest_run int, lcs_words int, coverage double, key_share double"


def words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All words as written, and the text of each."""
    joined, codes, ends = tu.join(texts)
    cls = tu.classes(False)[codes]
    inside = cls <= tu.NUMBER
    inside[ends] = False
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    a, b = edge[::2], edge[1::2]
    return [joined[i:j] for i, j in zip(a.tolist(), b.tolist())], np.searchsorted(ends, a)


def _keep(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, term) of documents with a place dense in terms; a word that is no term has -1."""
    vocab = vocabulary.value
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in tu.slices(np.fromiter(map(len, texts), np.int64, len(texts)), CHARS):
            ws, at = words(texts[lo:hi])
            ids = {w: vocab.get(w.lower(), -1) for w in set(ws)}
            term = np.fromiter(map(ids.__getitem__, ws), np.int32, len(ws))
            if len(term) < WINDOW:
                continue
            upto = np.concatenate(([0], np.cumsum(term >= 0)))
            dense = (upto[WINDOW:] - upto[:-WINDOW] >= LEAST) & (at[WINDOW - 1 :] == at[: len(at) - WINDOW + 1])
            step = np.zeros(len(term) + 1, np.int32)
            starts = np.flatnonzero(dense)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + WINDOW, -1)
            keep = np.cumsum(step[:-1]) > 0
            if not keep.any():
                continue
            first = np.searchsorted(at, np.arange(hi - lo))
            pos = np.arange(len(term)) - first[at]
            n = np.bincount(at[keep], minlength=hi - lo)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(pos[keep], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(term[keep], pa.int32()))], names=["doc_id", "pos", "term"])
            yield out.filter(pa.array(n > 0))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, positions and rows of a batch of kept places."""
    pos, term = batch.column("pos"), batch.column("term")
    n = np.asarray(term.value_lengths())
    return np.asarray(term.flatten()), np.asarray(pos.flatten()), np.repeat(np.arange(len(n)), n)


def _windows(term: np.ndarray, pos: np.ndarray, row: np.ndarray, size: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Aligned windows as rows of term ids (``size`` for no term), and their begins."""
    if len(term) < WINDOW:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, np.int64)
    last = len(term) - WINDOW + 1
    upto = np.concatenate(([0], np.cumsum(term >= 0)))
    at = np.flatnonzero((pos[:last] % stride == 0) & (pos[WINDOW - 1 :] == pos[:last] + WINDOW - 1) & (row[WINDOW - 1 :] == row[:last]) & (upto[WINDOW:] - upto[:-WINDOW] >= LEAST))
    w = term[at[:, None] + np.arange(WINDOW)]
    return np.where(w < 0, size, w), at


def _distinct(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, each row's number among them, and how often each occurs."""
    view = np.ascontiguousarray(w.astype(np.int32)).view(np.dtype((np.void, 4 * WINDOW))).ravel()
    _, first, inverse, count = np.unique(view, return_index=True, return_inverse=True, return_counts=True)
    return w[first], inverse, count


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen, total = np.zeros(size + 1, np.int64), 0
    for batch in batches:
        w, _ = _windows(*_flat(batch), size)
        total += len(w)
        w = np.sort(w, axis=1)
        fresh = np.ones(w.shape, bool)
        fresh[:, 1:] = w[:, 1:] != w[:, :-1]
        seen += np.bincount(w[fresh], minlength=size + 1)
    seen[size] = total  # not a term: the number of windows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["term", "n"])


def _project(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of the terms' rows; the last row of ``basis`` is zero."""
    out = basis[w[:, 0]].copy()
    for j in range(1, WINDOW):
        out += basis[w[:, j]]
    return out


def _range_pass(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    """A'(A X) of the partition's passages A, by term. ``given``: idf by term and X, both with a zero row at the end."""
    idf, x = given.value
    size = len(idf) - 1
    z = np.zeros((size + 1, x.shape[1]))
    weighted = x * idf[:, None]
    for batch in batches:
        w, _, n = _distinct(_windows(*_flat(batch), size)[0])
        y = _project(w, weighted) * n[:, None]
        flat = w.ravel()
        for c in range(x.shape[1]):
            z[:, c] += np.bincount(flat, np.repeat(y[:, c], WINDOW), minlength=size + 1)
    z *= idf[:, None]
    at = np.flatnonzero(np.abs(z).max(1) > 0)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(z[at, c].astype(np.float32)) for c in range(x.shape[1]))], names=["term", *(f"z{c}" for c in range(x.shape[1]))])


def _sum_by_term(kept: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One distributed product A'(A X): partial sums per partition, summed by term in the JVM; terms x rank come back."""
    spark, k = kept.sparkSession, x.shape[1]
    given = spark.sparkContext.broadcast((idf, np.vstack((x, np.zeros((1, k))))))
    cols = [f"z{c}" for c in range(k)]
    rows = kept.mapInArrow(lambda b: _range_pass(b, given), "term int, " + ", ".join(f"{c} float" for c in cols)).groupBy("term").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
    z = np.zeros(x.shape)
    z[np.asarray(rows.column("term"))] = np.column_stack([np.asarray(rows.column(c)) for c in cols])
    return z


def _lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Longest common subsequence and longest common run of two sequences of terms; -1 equals nothing."""
    prev, run, best = np.zeros(len(b) + 1, np.int32), np.zeros(len(b) + 1, np.int32), 0
    for t in a.tolist():
        same = (b == t) & (b >= 0)
        now = prev.copy()
        now[1:] = np.maximum(prev[1:], prev[:-1] + same)
        prev = np.maximum.accumulate(now)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        run[0] = 0
        best = max(best, int(run.max()))
    return int(prev[-1]), best


def _have_run(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sequences of terms have a run of RUN in common: diagonals of equal terms, doubled."""
    same, n = (a[:, None] == b[None, :]) & (b >= 0), 1
    while n < RUN and same.size:
        step = min(n, RUN - n)
        same, n = same[:-step, :-step] & same[step:, step:], n + step
    return bool(same.any())


class _Items:
    """A block's items: terms, latent windows, key terms."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray, basis: np.ndarray):
        size = len(idf) - 1
        self.ids, self.terms = [i for i, _ in items], [t for _, t in items]
        w, own = [], []
        for k, t in enumerate(self.terms):
            padded = np.append(t, np.full(max(0, WINDOW - len(t)), size))
            for s in range(len(padded) - WINDOW + 1):
                w.append(padded[s : s + WINDOW])
                own.append(k)
        self.size = size
        self.windows, inverse, _ = _distinct(np.array(w, np.int32).reshape(-1, WINDOW))
        self.owners: list[set[int]] = [set() for _ in self.windows]
        for i, k in zip(inverse.tolist(), own):
            self.owners[i].add(k)
        self.basis = basis * idf[:, None]
        self.latent = self.unit(self.windows)
        self.bags = [set(t.tolist()) for t in self.terms]
        self.holds = np.zeros((len(self.terms), size + 1), bool)  # by term; the last, also met as -1, is none
        for k, t in enumerate(self.terms):
            self.holds[k, t] = True
        self.keys = [{x for x in t.tolist() if idf[x] >= np.quantile(idf[t], 0.6)} for t in self.terms]

    def unit(self, w: np.ndarray) -> np.ndarray:
        x = _project(w, self.basis)
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def hits(self, w: np.ndarray) -> list[tuple[int, int, bool]]:
        """Rows of ``w`` and item windows whose latent cosine is at least COSINE, and whether their vectors are the same."""
        x, out = self.unit(w), []
        for i in range(0, len(x), 2048):
            s = x[i : i + 2048] @ self.latent.T
            r, c = np.nonzero(s >= COSINE)
            out += zip((r + i).tolist(), c.tolist(), (s[r, c] >= SAME).tolist())
        return out


def _search(batches: Iterator[pa.RecordBatch], given, coverage: float, keys: float) -> Iterator[pa.RecordBatch]:
    """Candidates by latent cosine, then the checks: a pair needs a run of RUN words, or ``coverage`` and ``keys``.

    A run holds a window of the item, so only pairs with a window of the same latent vector can have one.
    """
    items: _Items = given.value
    for batch in batches:
        term, pos, row = _flat(batch)
        w, at = _windows(term, pos, row, items.size)
        distinct, inverse, _ = _distinct(w)
        near: dict[int, set[tuple[int, bool]]] = defaultdict(set)
        for i, j, same in items.hits(distinct):
            near[i] |= {(k, same) for k in items.owners[j]}
        pairs: dict[int, set[tuple[int, bool]]] = defaultdict(set)
        for d, i in zip(row[at].tolist(), inverse.tolist()):
            if i in near:
                pairs[d] |= near[i]
        first, out = np.searchsorted(row, np.arange(len(batch) + 1)), []
        ids = batch.column("doc_id").to_pylist()
        for d, found in pairs.items():
            t, p = term[first[d] : first[d + 1]], pos[first[d] : first[d + 1]]
            here, gapped = set(t.tolist()), np.insert(t, np.flatnonzero(np.diff(p) != 1) + 1, -1)
            for k in {k for k, _ in found}:
                own, share = items.terms[k], len(items.keys[k] & here) / max(1, len(items.keys[k]))
                like = share >= keys and len(items.bags[k] & here) >= coverage * len(items.bags[k]) / 2
                if not like and (k, True) not in found:
                    continue
                b = np.where(items.holds[k][gapped], gapped, -1)  # other words only part
                b = b[(b >= 0) | np.append(True, b[:-1] >= 0)]
                if not like and not _have_run(own, b):
                    continue
                lcs, longest = _lcs(own, b)
                if longest >= RUN or (share >= keys and lcs >= coverage * len(own)):
                    out.append((ids[d], items.ids[k], longest, lcs, lcs / len(own), share))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "longest_run", "lcs_words", "coverage", "key_share"])


def leaks(docs: DataFrame, items: DataFrame, coverage: float = 0.5, keys: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Runs and paraphrases (see :data:`SCHEMA`): candidates with a run of RUN words in common, or with ``coverage`` of the
    item's words in order and ``keys`` of its key terms."""
    spark = docs.sparkSession
    runtime.ship(spark)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("length(text) > 0 and item_id is not null")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK))
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about BLOCK characters
        found = _block(picked, [(r.item_id, r.text) for r in rows], coverage, keys)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("longest_run", "lcs_words", "coverage", "key_share")])


def _block(docs: DataFrame, rows: list[tuple[int, str]], coverage: float, keys: float) -> DataFrame:
    spark = docs.sparkSession
    ws, at = words([t for _, t in rows])
    vocab: dict[str, int] = {}
    term = np.array([vocab.setdefault(w.lower(), len(vocab)) for w in ws], np.int32)
    items = [(i, term[at == k]) for k, (i, _) in enumerate(rows) if (at == k).any()]
    if not items:
        return spark.createDataFrame([], SCHEMA)
    size = len(vocab)
    vocabulary = spark.sparkContext.broadcast(vocab)
    kept = runtime.materialize(docs.mapInArrow(lambda b: _keep(b, vocabulary), "doc_id long, pos array<int>, term array<int>"), "kept")
    counts = dict(kept.mapInArrow(lambda b: _frequencies(b, size), "term int, n long").groupBy("term").agg(F.sum("n")).collect())  # one row a term
    total = counts.pop(size, 0)
    if not total:
        return spark.createDataFrame([], SCHEMA)
    idf = np.zeros(size + 1)
    idf[list(counts)] = np.log(1 + total / np.array(list(counts.values())))
    k = min(RANK, max(1, len(counts)))
    x = np.linalg.qr(_sum_by_term(kept, idf, np.random.default_rng(7).standard_normal((size, k))))[0]
    # x spans the leading right singular vectors; one more product gives the singular values within it.
    val, vec = np.linalg.eigh((lambda g: (g + g.T) / 2)(x.T @ _sum_by_term(kept, idf, x)))
    basis = np.vstack(((x @ vec) / np.sqrt(np.maximum(val, val.max() * 1e-9)), np.zeros((1, k))))
    given = spark.sparkContext.broadcast(_Items(items, idf, basis))
    return kept.mapInArrow(lambda b: _search(b, given, coverage, keys), SCHEMA)


def found(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, item_id): a run of at least RUN consecutive words in common."""
    return leaks(docs, items, **columns).filter(F.col("longest_run") >= RUN).select("doc_id", "item_id")
