"""Exact nearest vectors of a stated query set, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime

BLOCK = 4096


def _top(batches: Iterator[pa.RecordBatch], given, k: int) -> Iterator[pa.RecordBatch]:
    ids, queries = given.value
    dim = queries.shape[1]
    for batch in batches:
        n = np.asarray(batch.column(1).value_lengths().fill_null(-1))
        rows = np.flatnonzero(n == dim)
        x = np.asarray(batch.column(1).take(pa.array(rows)).flatten().cast(pa.float64())).reshape(-1, dim)
        norm = np.linalg.norm(x, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        x, own = x[ok] / norm[ok, None], np.asarray(batch.column(0))[rows[ok]]
        if not len(x):
            continue
        s = queries @ x.T
        s[ids[:, None] == own[None, :]] = -9
        best = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
        q, at, score = np.repeat(ids, best.shape[1]), best.ravel(), np.take_along_axis(s, best, 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(q[score > -9]), pa.array(own[at][score > -9]), pa.array(score[score > -9])], names=["id", "neighbour", "cosine"])


def nearest_to(df: DataFrame, queries: DataFrame, id: str, vector: str, k: int) -> DataFrame:
    """(id, neighbour, cosine, rank): the k rows of ``df`` most similar to each row of ``queries``; null, zero and odd-sized vectors aside."""
    spark = df.sparkSession
    runtime.ship(spark)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("size(v) > 0 and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x))")
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        for dim in sorted({len(r.v) for r in block}):
            q = np.array([r.v for r in block if len(r.v) == dim])
            given = spark.sparkContext.broadcast((np.array([r.id for r in block if len(r.v) == dim]), q / np.linalg.norm(q, axis=1, keepdims=True)))
            part = rows.mapInArrow(lambda x, given=given: _top(x, given, k), "id long, neighbour long, cosine double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, rank int")
    order = F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "neighbour")))  # at most k a batch of rows
    best = out.groupBy("id").agg(F.slice(order, 1, k).alias("top")).select("id", F.posexplode("top").alias("at", "t"))
    return best.select("id", "t.neighbour", (-F.col("t.far")).alias("cosine"), (F.col("at") + 1).alias("rank"))
