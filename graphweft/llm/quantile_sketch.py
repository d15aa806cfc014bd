"""Percentiles of large numeric columns with guaranteed relative error, from mergeable logarithmic bucket counts.

A value v falls into bucket ceil(ln|v| / ln g) of its sign, with g = (1 + error) / (1 - error); zero has a bucket of its
own. A sketch is a table of counts by key and bucket, so sketches of partitions, days or loads combine by adding counts
of matching buckets. The value 2 g^i / (g + 1) reported for bucket i is within ``error`` of every value in it, relatively.
Everything stays in JVM expressions; counts are added map-side before any shuffle, and a key of any number of rows has
at most some thousand buckets per sign.

Defined results: nulls and NaN don't count; infinities have the outermost buckets and come out as infinities; a key
without values has no row; percentile q is the value at rank floor(q * (n - 1)); empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INFINITE = 1 << 30


def gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def _bucket(v: Column, error: float) -> Column:
    size = F.abs(v)
    i = F.ceil(F.log(size) / F.lit(math.log(gamma(error)))).cast("int")
    return F.when(v == 0, F.lit(0)).when(size == float("inf"), F.lit(INFINITE)).otherwise(i)


def sketch(df: DataFrame, keys: Sequence[str], values: Sequence[str], error: float = 0.01) -> DataFrame:
    """(keys, field, sign, bucket, n): the sketch of each of ``values`` by ``keys``, in one pass."""
    fields = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")
    v = F.col("x.v")
    long = df.select(*keys, fields).filter(v.isNotNull() & ~F.isnan(v))
    return long.groupBy(*keys, F.col("x.field").alias("field"), F.signum(v).cast("int").alias("sign"), _bucket(v, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the counts of sketches over ``keys`` (a subset of their keys)."""
    return sketches.groupBy(*keys, "field", "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float], error: float = 0.01) -> DataFrame:
    """(keys, field, q, n, value) of merged sketches made with the same ``error``."""
    g = gamma(error)
    size = F.when(F.col("bucket") == INFINITE, F.lit(float("inf"))).otherwise(F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket").cast("double")))
    per_key = Window.partitionBy(*keys, "field")
    order = per_key.orderBy("sign", F.col("sign") * F.col("bucket"))
    counted = sketches.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(per_key))
    wanted = counted.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("rank", F.floor(F.col("q") * (F.col("total") - 1)))
    hit = wanted.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.select(*keys, "field", "q", F.col("total").alias("n"), F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * size).alias("value"))


def store(sketches: DataFrame, path: str, part: str = "part") -> None:
    """Adds sketches to a stored table, in a folder for each value of ``part`` (a day, a load): a part that is stored
    again replaces its old counts, the others stay, and no row is read again."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored sketches; a filter on the part reads only its folders."""
    return spark.read.parquet(path)


def significant(v: Column, digits: int = 9) -> Column:
    """``v`` to so many significant decimal digits, which moves it by less than any relative error bound."""
    return F.when(F.abs(v) < float("inf"), F.format_string(f"%.{digits - 1}e", v).cast("double")).otherwise(v)


def one_per_key(df: DataFrame, key: Sequence[str], loaded: str = "loaded_at") -> DataFrame:
    """Rows of a key that were delivered again are one record: of each column the earliest value that isn't null or NaN.

    All is found by hashing, without a sort of the rows: strings outside the key take part by their hash and are looked
    up again in the table of distinct strings.
    """
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if kinds[c] == "string" and c not in key]
    coded = df.withColumns({c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in names})

    def earliest(c: str) -> Column:
        there = F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull()
        return F.coalesce(F.min_by(c, F.when(there, F.col(loaded))), F.max(F.when(there, F.col(c)))).alias(c)  # else of rows without a time

    out = coded.groupBy(*key).agg(*[earliest(c) for c in df.columns if c not in key and c != loaded], F.min(loaded).alias(loaded))
    for c in names:
        texts = df.filter(F.col(c).isNotNull()).select(F.col(c).alias("_text")).distinct().select("_text", F.xxhash64("_text").alias(c))
        out = out.join(texts, c, "left").drop(c).withColumnRenamed("_text", c)
    return out
