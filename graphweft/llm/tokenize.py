"""Encoding of a corpus with a byte-level BPE tokenizer, by merge replay over a vocabulary of words.

A batch of documents is cut into words in numpy, by the public pattern of byte-level BPE. The new words of the batch
form one corpus: an inverted index leads from each token pair to its positions, merges are replayed in rank order, each
touching only the neighbours of its positions. Words already encoded by the same Python worker are looked up, so a
task's work on merges follows its vocabulary, not its text. No shuffle and no join; memory is bounded by
``WORDS`` words and ``CHARS`` characters at a time (a longer single text is taken alone, whole).

Defined results: null and empty texts have an empty list; a blank text has the ids of its blanks; strings of special
tokens in a text are ordinary text; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.llm import text_units as tu

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CHARS, WORDS = 2_000_000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in plain}
    names.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)})
    return [names[b] for b in range(256)]


def word_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a word of the public pattern begins; each end character is a word of its own."""
    cls = tu.classes()[codes]
    cls[ends] = tu.END
    change = np.empty(len(cls), bool)
    change[0], change[1:] = True, cls[1:] != cls[:-1]
    blank = codes == 32
    blank[ends] = False
    start = np.zeros(len(cls) + 1, bool)
    begins = np.flatnonzero(change & (cls != tu.SPACE))
    joins = (begins > 0) & blank[begins - 1] & (cls[begins] != tu.END)
    start[begins - joins] = True
    start[np.flatnonzero(change & (cls == tu.SPACE))] = True
    after = np.flatnonzero(change[1:] & (cls[:-1] == tu.SPACE)) + 1
    start[after[cls[after] != tu.END] - 1] = True
    start[ends] = True
    start[ends + 1] = True
    at = np.flatnonzero((codes == 39) & start[:-1])  # contractions: an apostrophe at a word's begin
    padded = np.append(codes, [0, 0])
    one, two = padded[at + 1], padded[at + 2]
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 2
    size[(one == ord("l")) & (two == ord("l"))] = 2
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    start[at + 1 + size] = start[at + 1 + size] | (cls[np.minimum(at + 1 + size, len(cls) - 1)] == tu.LETTER)
    return start[:-1]


class Encoder:
    """A tokenizer file's merges and the words encoded so far."""

    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: left id << 20 | right id -> rank; by rank: left, right and merged id
        self.rank: dict[int, int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for r, (a, b) in enumerate(pairs):
            x = (vocab[a], vocab[b], vocab[a + b])
            self.rank.setdefault(x[0] << 20 | x[1], r)
            self.merge.append(x)
        self.byte = [vocab[s] for s in byte_symbols()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)  # entry 0: no ids

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and each word's number of ids."""
        rank, merge, byte = self.rank, self.merge, self.byte
        sym: list[int] = [-1]
        lengths = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            sym += [byte[b] for b in raw]
            sym.append(-1)
            lengths.append(len(raw) + 1)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        where: dict[int, list[int]] = {}
        for p in range(1, len(sym) - 1):
            if sym[p] >= 0 and sym[p + 1] >= 0 and (r := rank.get(sym[p] << 20 | sym[p + 1])) is not None:
                where.setdefault(r, []).append(p)
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b, new = merge[r]
            places = where.pop(r)
            if a == b:
                places.sort()
            for p in places:
                q = nxt[p]
                if sym[p] != a or sym[q] != b:
                    continue
                n, o = nxt[q], prv[p]
                sym[p], sym[q], nxt[p], prv[n] = new, -2, n, p
                if (s := sym[o]) >= 0 and (k := rank.get(s << 20 | new)) is not None:
                    if k in where:
                        where[k].append(o)
                    else:
                        where[k] = [o]
                        heapq.heappush(queue, k)
                if (s := sym[n]) >= 0 and (k := rank.get(new << 20 | s)) is not None:
                    if k in where:
                        where[k].append(p)
                    else:
                        where[k] = [p]
                        heapq.heappush(queue, k)
        flat = np.array(sym[1:], np.int64)
        there = flat >= 0
        ends = np.cumsum(lengths)
        upto = np.concatenate(([0], np.cumsum(there)))
        return flat[there].astype(np.int32), upto[ends] - upto[ends - np.array(lengths)]

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > WORDS:
            self.forget()
        ids, sizes = self.replay(words)
        base = len(self.first)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, ids))
        self.known.update(zip(words, range(base, base + len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and each text's number of ids."""
        joined, codes, ends = tu.join(texts)
        at = np.flatnonzero(word_starts(codes, ends))
        cut = at.tolist()
        words = list(map(joined.__getitem__, map(slice, cut, cut[1:] + [len(joined)])))
        new = set(words).difference(self.known)
        if new:
            size = len(self.known)
            self._learn(sorted(new))
            if len(self.known) < size + len(new):  # the pool was emptied first
                self._learn(sorted(set(words).difference(self.known)))
        entry = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        is_end = np.zeros(len(codes), bool)
        is_end[ends] = True
        entry[is_end[at]] = 0
        n, first = self.size[entry], self.first[entry]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(first - (upto - n), n) + np.arange(upto[-1])] if len(n) else self.flat[:0]
        return ids, np.diff(upto[np.searchsorted(at, ends)], prepend=0)


_encoders: dict[int, Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    key = hash(file.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(file.value)
    encoder = _encoders[key]
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in tu.slices(sizes, CHARS):
            ids, n = encoder.encode(texts[a:b])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every row. ``tokenizer``: path of a public byte-level BPE file, of fixed size; its bytes are broadcast."""
    spark = docs.sparkSession
    runtime.ship(spark)
    with open(tokenizer, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: _encode(batches, file), "doc_id long, ids array<int>")
