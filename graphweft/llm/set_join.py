"""All pairs of sets with Jaccard similarity at or above a threshold, exactly, by pigeonhole partitioning.

Two sets of sizes s <= l that reach the threshold differ in at most H(s, l) tokens. For each class of lengths the token
universe is split by hash into segments. The longer set is indexed by each of its segments, whole (W) and with one token
left out (D). The shorter one gives each segment 0, 1 or 2 units, H + 1 in all, so that by the pigeonhole principle some
segment differs by fewer tokens than its units: 1 unit asks for an equal segment, 2 units also for one with a single
token more or less. Units go where they cost least by the frequencies of the segment's tokens, so that empty segments
and those of tokens known to very many sets stay unasked. Signatures are sums of token hashes, made in numpy for whole
batches; those that no two sets have stay in their task as far as a filter of fixed size can tell; candidates are verified on
the full sets.

Defined results: nulls inside a set and repeats don't count; null and empty sets take no part; repeated rows of a record
are one; equal sets are joined once and their records expanded from the result; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime

#: Lengths a and b of a class have b <= RATIO * a; segments beyond the least number; tokens in that share of sets are hot.
RATIO, SPARE, HOT = 1.3, 2, 1 / 2000
#: The filter of shared signatures has 2 ** FILTER bits, whatever the number of sets, and is put together in chunks of CHUNK.
FILTER, CHUNK = 28, 65536
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def most_apart(s: int, l: int, t: float) -> int:  # noqa: E741
    """Most tokens by which sets of sizes s and l with Jaccard >= t can differ; negative if none can."""
    need = math.ceil(t / (1 + t) * (s + l) - 1e-9)
    return s + l - 2 * need if need <= min(s, l) else -1


def class_of(length: int) -> tuple[int, int]:
    """Bounds of the class of a length."""
    a = 1
    while True:
        b = max(a, int(a * RATIO))
        if length <= b:
            return a, b
        a = b + 1


@functools.cache
def _layout(b: int, t: float) -> int:
    """Number of segments of the class that ends at b."""
    return (most_apart(b, b, t) + 2) // 2 + SPARE


@functools.cache
def _classes_for(s: int, t: float) -> tuple[tuple[int, int], ...]:
    """(end of class, H) of the classes that hold lengths a set of size s can match as the shorter one."""
    out, l = [], s  # noqa: E741
    longest = int(s / t + 1e-9)
    while l <= longest:
        _, b = class_of(l)
        apart = max(most_apart(s, x, t) for x in range(l, min(b, longest) + 1))
        if apart >= 0:
            out.append((b, apart))
        l = b + 1  # noqa: E741
    return tuple(out)


def _segments(tok: np.ndarray, rec: np.ndarray, n: int, b: int, t: float, space: np.ndarray):
    """Token hashes, their cells (record x segment), and each cell's sum of hashes with its place hashed in."""
    m = _layout(b, t)
    with np.errstate(over="ignore"):
        h = _mix(tok.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        cell = rec * m + (_mix(h + np.uint64(b)) % np.uint64(m)).astype(np.int64)
        total = _mix(np.repeat(space.astype(np.uint64), m) * np.uint64(1 << 40) + np.uint64(b << 16) + np.tile(np.arange(m, dtype=np.uint64), n))
        np.add.at(total, cell, h)
    return m, h, cell, total


def _whole(x: np.ndarray) -> np.ndarray:
    return _mix(x).astype(np.int64)


def _less(x: np.ndarray) -> np.ndarray:
    return _mix(x ^ np.uint64(0xD1B54A32D192ED03)).astype(np.int64)


def _parity(tok: np.ndarray, rec: np.ndarray, n: int) -> np.ndarray:
    """64 parity bits of each set. Each token by which two sets differ changes one bit, so they differ in no more bits."""
    bits = np.zeros(n, np.uint64)
    np.bitwise_xor.at(bits, rec, np.uint64(1) << (_mix(tok.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(63)))
    return bits.astype(np.int64)


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sid, space, toks = (batch.column(c) for c in ("h1", "space", "toks"))
    size = np.asarray(toks.value_lengths()).astype(np.int64)
    return np.asarray(sid), np.asarray(space), size, np.asarray(toks.flatten()), np.repeat(np.arange(len(size)), size)


def _place(key: np.ndarray) -> np.ndarray:
    """The bit of a signature in the filter."""
    return (_mix(key.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - FILTER)).astype(np.int64)


def _touched(batches: Iterator[pa.RecordBatch], t: float, hot) -> Iterator[pa.RecordBatch]:
    """(chunk, at, again, asked): per task the places in the filter that its sets index or ask for, whether two sets do, and
    whether one asks."""
    once, twice, wanted = (np.zeros(1 << (FILTER - 3), np.uint8) for _ in range(3))
    for batch in batches:
        pos, rec = [], []
        for asks, make in ((False, lambda b: _index(b, t)), (True, lambda b: _probe(b, t, hot))):
            for out, r in make([batch]):
                pos.append(_place(out))
                rec.append(r)
                if asks:
                    np.bitwise_or.at(wanted, pos[-1] >> 3, np.uint8(1) << (pos[-1] & 7).astype(np.uint8))
        if not pos:
            continue
        place, who = np.concatenate(pos), np.concatenate(rec)
        pair = np.unique(place * np.int64(len(batch)) + who)  # a set's own places once each
        place, n = np.unique(pair // len(batch), return_counts=True)
        byte, bit = place >> 3, (np.uint8(1) << (place & 7).astype(np.uint8))
        again = (n > 1) | ((once[byte] & bit) > 0)
        np.bitwise_or.at(once, byte, bit)
        np.bitwise_or.at(twice, byte[again], bit[again])
    seen = np.flatnonzero(once)
    place = (seen[:, None] * 8 + np.arange(8))[np.unpackbits(once[seen], bitorder="little").reshape(-1, 8) > 0]
    again, asked = ((x[place >> 3] >> (place & 7).astype(np.uint8)) & 1 for x in (twice, wanted))
    cut = np.searchsorted(place, np.arange(0, (1 << FILTER) + 1, CHUNK))
    for c in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        a, b = cut[c], cut[c + 1]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([(place[a:b] - c * CHUNK).astype(np.uint16).tobytes()], pa.binary()), *(pa.array([np.packbits(x[a:b]).tobytes()], pa.binary()) for x in (again, asked))], names=["chunk", "at", "again", "asked"])


def _shared(table: pa.Table) -> pa.Table:
    """(chunk, bits): the places of a chunk that two sets or more touch and one of them asks for."""
    n, wanted = np.zeros(CHUNK, np.int32), np.zeros(CHUNK, bool)
    for at, again, asked in zip(*(table.column(c).to_pylist() for c in ("at", "again", "asked"))):
        place = np.frombuffer(at, np.uint16)
        n[place] += 1 + np.unpackbits(np.frombuffer(again, np.uint8))[: len(place)]
        wanted[place] |= np.unpackbits(np.frombuffer(asked, np.uint8))[: len(place)] > 0
    return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "bits": pa.array([np.packbits((n > 1) & wanted, bitorder="little").tobytes()], pa.binary())})


def _shared_places(sets: DataFrame, t: float, hot) -> bytes:
    """A filter of fixed size, 2 ** (FILTER - 3) bytes (here compressed) at any number of sets: bits of signatures that more than one set has and one of them asks for.

    What it lets through by chance only costs a shuffled row; the more sets there are, the less it holds back."""
    rows = sets.mapInArrow(lambda b: _touched(b, t, hot), "chunk int, at binary, again binary, asked binary").groupBy("chunk").applyInArrow(_shared, "chunk int, bits binary").collect()
    out = np.zeros(1 << (FILTER - 3), np.uint8)
    for r in rows:
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return zlib.compress(out.tobytes(), 1)


def _rows(batches: Iterator[pa.RecordBatch], make, shared) -> Iterator[pa.RecordBatch]:
    """Signature rows of the sets whose bits in the filter are set."""
    bits_of = np.frombuffer(zlib.decompress(shared.value), np.uint8)
    for batch in batches:
        sid, _, size, tok, rec = _batch(batch)
        parity = _parity(tok, rec, len(size))
        parts = []
        for key, r in make([batch]):
            place = _place(key)
            keep = (bits_of[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            parts.append((key[keep], r[keep]))
        yield from _emit(parts, sid, size, parity)


def _emit(parts: list[tuple[np.ndarray, np.ndarray]], sid: np.ndarray, size: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for key, rec in parts:
        for i in range(0, len(key), 100_000):
            k, r = key[i : i + 100_000], rec[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sid[r]), pa.array(size[r].astype(np.int32)), pa.array(bits[r])], names=["key", "sid", "len", "bits"])


def _pick(tok: np.ndarray, rec: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the records of ``own`` and the place of each one's record among them."""
    place = np.full(int(rec.max()) + 1 if len(rec) else 0, -1)
    place = np.full(max(len(place), int(own.max()) + 1 if len(own) else 0), -1)
    place[own] = np.arange(len(own))
    at = place[rec]
    return tok[at >= 0], at[at >= 0]


Signatures = Iterator[tuple[np.ndarray, np.ndarray]]


def _index(batches: Iterator[pa.RecordBatch], t: float) -> Signatures:
    """Keys that the sets are indexed by, and the place in the batch of each one's set."""
    for batch in batches:
        _, space, size, tok, rec = _batch(batch)
        ends = np.array([class_of(x)[1] for x in range(1, int(size.max(initial=0)) + 1)])[size - 1] if len(size) else size
        for b in np.unique(ends).tolist():
            own = np.flatnonzero(ends == b)
            tk, rc = _pick(tok, rec, own)
            m, h, cell, total = _segments(tk, rc, len(own), b, t, space[own])
            with np.errstate(over="ignore"):
                yield _whole(total), np.repeat(own, m)
                yield _less(total[cell] - h), own[rc]


def _probe(batches: Iterator[pa.RecordBatch], t: float, hot) -> Signatures:
    """Keys that the sets ask for."""
    tokens, share, rare = hot.value
    for batch in batches:
        _, space, size, tok, rec = _batch(batch)
        at = np.minimum(np.searchsorted(tokens, tok), max(len(tokens) - 1, 0))
        cost = np.where(tokens[at] == tok, share[at], rare) if len(tokens) else np.full(len(tok), rare)
        log = np.log(cost)
        wanted: dict[tuple[int, int], list[int]] = {}
        for s in np.unique(size).tolist():
            for b, apart in _classes_for(s, t):
                wanted.setdefault((b, apart), []).append(s)
        for (b, apart), sizes in wanted.items():
            own = np.flatnonzero(np.isin(size, sizes))
            tk, rc = _pick(tok, rec, own)
            lg, _ = _pick(log, rec, own)
            m, h, cell, total = _segments(tk, rc, len(own), b, t, space[own])
            weight = np.zeros(len(total))
            np.add.at(weight, cell, lg)
            weight = np.exp(weight)  # share of sets with at least the segment's tokens
            count = np.bincount(cell, minlength=len(total))
            without = np.zeros(len(total))
            np.add.at(without, cell, np.exp(np.log(np.maximum(weight[cell], 1e-300)) - lg))
            one = weight + 1e-9
            two = np.maximum(one, 2 * weight + without + 1e-9 * (1 + count))
            marginal = np.concatenate((one.reshape(-1, m), two.reshape(-1, m)), axis=1)
            units = np.argsort(marginal, axis=1, kind="stable")[:, : apart + 1]
            e = np.zeros((len(own), m), np.int8)
            np.add.at(e, (np.repeat(np.arange(len(own)), units.shape[1]), units.ravel() % m), 1)
            e = e.ravel()
            who = np.repeat(own, m)
            asked = np.flatnonzero(e >= 1)
            both = np.flatnonzero(e == 2)
            deep = np.flatnonzero(e[cell] == 2)
            with np.errstate(over="ignore"):
                yield _whole(total[asked]), who[asked]
                yield _less(total[both]), who[both]
                yield _whole(total[cell[deep]] - h[deep]), own[rc[deep]]


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(h1_a, h2_a, h1_b, h2_b) of distinct sets (space, h1, h2, toks) of one space that reach ``threshold``."""
    spark = sets.sparkSession
    runtime.ship(spark)
    total = sets.count()
    # At most mean set size / HOT tokens reach this share.
    hot = sorted((r.t, r.n / max(total, 1)) for r in sets.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2.0, HOT * total)).collect())
    given = spark.sparkContext.broadcast((np.array([t for t, _ in hot], np.int64), np.array([x for _, x in hot]), max(HOT, 2 / max(total, 2)) / 4))
    schema = "key long, sid long, len int, bits long"
    source = sets.select("space", "h1", "toks")
    shared = spark.sparkContext.broadcast(_shared_places(source, threshold, given))
    index = source.mapInArrow(lambda b: _rows(b, lambda x: _index(x, threshold), shared), schema).alias("i")
    probe = source.mapInArrow(lambda b: _rows(b, lambda x: _probe(x, threshold, given), shared), schema).alias("p")
    both = F.col("p.len") + F.col("i.len")
    apart = both - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * both - F.lit(1e-9))
    fits = (F.bit_count(F.col("p.bits").bitwiseXOR(F.col("i.bits"))) <= apart) & (F.col("p.len") <= F.col("i.len")) & (F.col("i.len") * F.lit(threshold) <= F.col("p.len") + F.lit(1e-9)) & ((F.col("p.len") < F.col("i.len")) | (F.col("p.sid") < F.col("i.sid")))
    pairs = probe.join(index, (F.col("p.key") == F.col("i.key")) & fits).select(F.col("p.sid").alias("h1_a"), F.col("i.sid").alias("h1_b")).distinct()
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("space", "h1", "h2", "toks")]) for s in "ab")
    common = F.size(F.array_intersect("toks_a", "toks_b"))
    alike = common / (F.size("toks_a") + F.size("toks_b") - common) >= F.lit(threshold)
    return pairs.join(a, "h1_a").join(b, "h1_b").filter((F.col("space_a") == F.col("space_b")) & alike).select("space_a", "h1_a", "h2_a", "h1_b", "h2_b")


def prepare(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(space, field, id, h1, h2) of every record that takes part, and the distinct sets (space, h1, h2, toks).

    ``records``: space INT (only sets of one space are compared), field, id, toks. A set is known by two 64-bit hashes.
    """
    clean = records.withColumn("toks", F.array_sort(F.array_distinct(F.filter("toks", lambda x: x.isNotNull()))))
    once = clean.filter(F.col("id").isNotNull() & (F.size("toks") > 0)).groupBy("space", "field", "id").agg(F.max("toks").alias("toks"))
    hashed = runtime.materialize(once.select("space", "field", "id", F.xxhash64("toks").alias("h1"), F.xxhash64(F.lit(7), "toks", F.size("toks")).alias("h2"), "toks"), "sets")
    return hashed.drop("toks"), runtime.materialize(hashed.groupBy("space", "h1", "h2").agg(F.first("toks").alias("toks")), "distinct")


def similar_records(records: DataFrame, threshold: float) -> DataFrame:
    """(field_a, id_a, field_b, id_b), id_a < id_b: all pairs of records, copies of a set expanded."""
    members, sets = prepare(records)
    linked = similar_sets(sets, threshold)
    a = members.select(F.col("space").alias("space_a"), F.col("h1").alias("h1_a"), F.col("h2").alias("h2_a"), F.col("field").alias("f1"), F.col("id").alias("n1"))
    b = members.select(F.col("h1").alias("h1_b"), F.col("h2").alias("h2_b"), F.col("space").alias("space_b"), F.col("field").alias("f2"), F.col("id").alias("n2"))
    # Only sets of several records expand among themselves.
    copied = members.groupBy("space", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("space", "h1", "h2")
    equal = copied.select(F.col("space").alias("space_a"), *[F.col(h).alias(f"{h}_{s}") for s in "ab" for h in ("h1", "h2")])
    out = linked.unionByName(equal).join(a, ["space_a", "h1_a", "h2_a"]).withColumnRenamed("space_a", "space_b").join(b, ["space_b", "h1_b", "h2_b"])
    same = (F.col("h1_a") == F.col("h1_b")) & (F.col("h2_a") == F.col("h2_b"))
    out = out.filter(~same | (F.col("n1") < F.col("n2"))).filter("n1 <> n2")
    first = F.col("n1") < F.col("n2")
    return out.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(c) for x, y, c in (("f1", "f2", "field_a"), ("n1", "n2", "id_a"), ("f2", "f1", "field_b"), ("n2", "n1", "id_b"))])


def links_per_record(records: DataFrame, threshold: float) -> DataFrame:
    """(field, id, class_id, copies, links): each record once, with the least record of its equal sets, their number, and
    the number of other sets that are similar to its own."""
    members, sets = prepare(records)
    linked = similar_sets(sets, threshold)
    ends = linked.select(F.col("space_a").alias("space"), F.explode(F.array(F.struct(F.col("h1_a").alias("h1"), F.col("h2_a").alias("h2")), F.struct(F.col("h1_b").alias("h1"), F.col("h2_b").alias("h2")))).alias("x")).select("space", "x.h1", "x.h2")
    counts = ends.groupBy("space", "h1", "h2").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("space", "h1", "h2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    per_set = classes.join(counts, ["space", "h1", "h2"], "left")
    return members.join(per_set, ["space", "h1", "h2"]).select("field", "id", "class_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
