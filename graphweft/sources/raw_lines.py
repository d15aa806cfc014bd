"""Delimited lines to typed records and reasoned rejects, by structural indexing.

A batch of lines is one byte buffer. A mask of its quotes and the parity of the running quote count tell which
separators are real; counts and digit checks over whole columns of fields then decide each record. No Python
statement runs per byte or per field, but for the text of labels and weights.

Defined results: a null line is a reject (``null line``); empty lines, lines of spaces and tabs, and comments give no
row at all; a null or unknown feed is a reject; repeated lines give one row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime

#: feed -> separator, number of fields
FEEDS = {"eu_node": (" ", 2), "ppi_node": ("\t", 2), "eweight": (",", 4)}
MAX_NUM, MAX_LABEL = 4294967295, 255
WEIGHT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SCHEMA = "line_id long, feed string, ok boolean, reason string, num long, node_label int, src long, dst long, edge_label string, weight float"
_ARROW = pa.schema([("line_id", pa.int64()), ("feed", pa.string()), ("ok", pa.bool_()), ("reason", pa.string()), ("num", pa.int64()), ("node_label", pa.int32()), ("src", pa.int64()), ("dst", pa.int64()), ("edge_label", pa.string()), ("weight", pa.float32())])


class _Index:
    """The structural index of a buffer of records."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, sep: np.ndarray):
        self.data, self.start, self.end = data, start, end
        n, size = len(start), len(data)
        rec = np.repeat(np.arange(n), np.diff(np.append(start, size)))
        quote = data == 34
        before = np.concatenate(([0], np.cumsum(quote)))
        inside = ((before[1:] - before[start][rec]) & 1).astype(bool)
        within = np.arange(size) < end[rec]
        delim = (data == sep[rec]) & ~inside & within
        opens, closes = np.flatnonzero(quote & inside & within), np.flatnonzero(quote & ~inside & within)
        prev, nxt = np.maximum(opens - 1, 0), np.minimum(closes + 1, max(size - 1, 0))
        good_open = (opens == start[rec[opens]]) | delim[prev] | (quote[prev] & ~inside[prev])
        good_close = (closes + 1 == end[rec[closes]]) | delim[nxt] | (quote[nxt] & (rec[nxt] == rec[closes]))
        self.broken = np.bincount(np.concatenate((rec[opens[~good_open]], rec[closes[~good_close]])), minlength=n) > 0
        self.broken |= ((before[end] - before[start]) & 1) == 1
        self.at = np.flatnonzero(delim)
        self.fields = np.bincount(rec[self.at], minlength=n) + 1
        self.first_delim = np.concatenate(([0], np.cumsum(self.fields - 1)))[:-1]
        digit = (data >= 48) & (data <= 57)
        self.other = np.concatenate(([0], np.cumsum(~digit)))
        self.nonzero = np.append(np.flatnonzero(data != 48), size)
        blank = (data == 32) | (data == 9)
        self.full = np.concatenate(([0], np.cumsum(~blank)))

    def column(self, rows: np.ndarray, j: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without enclosing quotes) of field j of k, and whether it was enclosed."""
        s = self.start[rows] if j == 0 else self.at[self.first_delim[rows] + j - 1] + 1
        e = self.end[rows] if j == k - 1 else self.at[self.first_delim[rows] + j]
        q = (e - s >= 2) & (self.data[np.minimum(s, len(self.data) - 1)] == 34)
        return s + q, e - q, q

    def number(self, s: np.ndarray, e: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, whether it is digits only, whether it is in range."""
        digits = (e > s) & (self.other[e] == self.other[s])
        first = np.minimum(self.nonzero[np.searchsorted(self.nonzero, s)], e)
        v = np.zeros(len(s), np.int64)
        for k in range(10):
            at = first + k
            v = np.where(at < e, v * 10 + self.data[np.minimum(at, len(self.data) - 1)] - 48, v)
        return v, digits, digits & (e - first <= 10) & (v <= most)


def _texts(raw: bytes, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]


def parse_batch(line_id: pa.Array, feed: pa.Array, line: pa.Array) -> pa.RecordBatch:
    """Arrow columns in, typed records and rejects out (see :data:`SCHEMA`)."""
    n = len(line)
    null = np.asarray(line.is_null())
    binary = pc.fill_null(line, "").cast(pa.large_string()).cast(pa.large_binary())
    raw = b"".join(binary.to_pylist()) + b"\n"  # one byte more: an empty buffer needs no special case
    data = np.frombuffer(raw, np.uint8)
    size = np.asarray(pc.binary_length(binary)).astype(np.int64) if n else np.zeros(0, np.int64)
    start = np.concatenate(([0], np.cumsum(size)))[:-1].astype(np.int64)
    end = start + size
    end = end - ((size > 0) & (data[np.maximum(end - 1, 0)] == 13))
    kind = np.asarray(pc.fill_null(pc.index_in(feed, pa.array(list(FEEDS))), -1)).astype(np.int64)
    seps = np.array([ord(s) for s, _ in FEEDS.values()] + [0], np.uint8)
    ix = _Index(data, np.append(start, len(data) - 1), np.append(end, len(data) - 1), np.append(seps[kind], 0).astype(np.uint8))
    head = data[start] if n else np.zeros(0, np.uint8)
    skip = ~null & ((ix.full[end] == ix.full[start]) | ((end > start) & ((head == 35) | (head == 37))))
    reason = np.full(n, None, object)

    def reject(rows: np.ndarray, why: str) -> None:
        rows = rows[reason[rows] == None]  # noqa: E711
        reason[rows] = why

    every = np.arange(n)
    reject(every[null], "null line")
    reject(every[kind < 0], "unknown feed")
    reject(every[ix.broken[:n]], "broken quoting")
    num, src, dst = (np.zeros(n, np.int64) for _ in range(3))
    label, weight = np.zeros(n, np.int32), np.ones(n, np.float32)
    text = np.full(n, None, object)
    for code, (_, k) in enumerate(FEEDS.values()):
        own = every[(kind == code) & ~skip & ~null & ~ix.broken[:n]]
        reject(own[ix.fields[own] != k], "wrong column count")
        own = own[ix.fields[own] == k]
        if k == 2:
            for j, (name, into, most) in enumerate((("num", num, MAX_NUM), ("label", label, MAX_LABEL))):
                s, e, _ = ix.column(own, j, k)
                v, digits, fits = ix.number(s, e, most)
                into[own] = np.where(fits, v, 0)
                reject(own[~digits], f"{name} is not a number")
                reject(own[~fits], f"{name} out of range")
            continue
        for j, (name, into) in enumerate((("src", src), ("dst", dst))):
            s, e, _ = ix.column(own, j, k)
            into[own], digits, fits = ix.number(s, e, MAX_NUM)
            reject(own[~digits], f"{name} is not a number")
            reject(own[~fits], f"{name} out of range")
        s, e, q = ix.column(own, 2, k)
        text[own] = [x.replace(b'""', b'"').decode() if y else x.decode() for x, y in zip(_texts(raw, s, e), q.tolist())]
        s, e, _ = ix.column(own, 3, k)
        filled = own[e > s]
        given = pa.array(_texts(raw, s[e > s], e[e > s]), pa.binary())
        fine = np.asarray(pc.match_substring_regex(given, WEIGHT)).astype(bool) if len(filled) else np.zeros(0, bool)
        reject(filled[~fine], "weight is not a number")
        with np.errstate(over="ignore", under="ignore"):
            v = np.array([float(x) for x in given.filter(pa.array(fine)).to_pylist()], np.float64).astype(np.float32)
        weight[filled[fine]] = v
        reject(filled[fine][~(np.isfinite(v) & (v > 0))], "weight out of range")
    good = np.array([x is None for x in reason], bool)
    node, edge = good & (kind < 2), good & (kind == 2)
    keep = pa.array(~skip)

    def column(values: np.ndarray, there: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(values, kind, mask=~there)

    cols = [line_id, feed, pa.array(good), pa.array(reason.tolist(), pa.string()), column(num, node, pa.int64()), column(label, node, pa.int32()), column(src, edge, pa.int64()), column(dst, edge, pa.int64()), column(text, edge, pa.string()), column(weight, edge, pa.float32())]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW).filter(keep)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield parse_batch(b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), b.column(2).cast(pa.string()))


def parse_lines(df: DataFrame, line_id: str = "line_id", feed: str = "feed", line: str = "raw") -> DataFrame:
    """One row per record: ``ok`` with its typed fields, or not with the ``reason``. No shuffle."""
    runtime.ship(df.sparkSession)
    return df.select(F.col(line_id).cast("long").alias("line_id"), F.col(feed).cast("string").alias("feed"), F.col(line).cast("string").alias("raw")).mapInArrow(_parse, SCHEMA)


def rejects(parsed: DataFrame) -> DataFrame:
    """Failing lines with the reason."""
    return parsed.filter(~F.col("ok")).select("line_id", "feed", "reason")


def nodes(parsed: DataFrame, feed: str) -> DataFrame:
    """Typed node records of ``eu_node`` or ``ppi_node``."""
    return parsed.filter(F.col("ok") & (F.col("feed") == feed)).select("line_id", "num", F.col("node_label").alias("label"))


def edges(parsed: DataFrame) -> DataFrame:
    """Typed edges of ``eweight``."""
    return parsed.filter(F.col("ok") & (F.col("feed") == "eweight")).select("line_id", "src", "dst", F.col("edge_label").alias("label"), "weight")
