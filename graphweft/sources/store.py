"""Embeddings, decompositions and neighbour tables on disk: Parquet with a small JSON header."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphweft import functions as gf
from graphweft.model import Embedding

VERSION = 1


@dataclass(frozen=True)
class Output:
    """Where and how to write: ``name`` is a folder, ``format`` parquet or json."""

    name: str = "embedding"
    format: str = "parquet"

    def __post_init__(self):
        if self.format not in ("parquet", "json"):
            raise ValueError(f"no such format: {self.format}")


def _write_header(spark: SparkSession, out: Output, header: dict) -> None:
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.name}/header")


def read_header(spark: SparkSession, name: str) -> dict:
    header = json.loads(spark.read.text(f"{name}/header").first().value)
    if header.get("version") != VERSION:
        raise ValueError(f"version {header.get('version')} isn't {VERSION}")
    return header


def dump_embedding(e: Embedding, out: Output = Output()) -> None:
    """Vectors and the header: version, symmetry, kind, type, dimension, number of vectors."""
    spark = e.vectors.sparkSession
    e.vectors.write.mode("overwrite").format(out.format).save(f"{out.name}/vectors")
    written = spark.read.format(out.format).schema(e.vectors.schema).load(f"{out.name}/vectors")
    vec = "vec" if e.symmetric else "source"
    row = written.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    kind = dict(e.vectors.dtypes)[vec]
    _write_header(spark, out, {"version": VERSION, "symmetric": e.symmetric, "kind": e.kind, "type": kind, "schema": e.vectors.schema.jsonValue(), "dimension": row[1] or 0, "nbdata": row[0], "format": out.format})


def load_embedding(spark: SparkSession, name: str, expect: str | None = None) -> Embedding:
    """The embedding written by :func:`dump_embedding`; ``expect``: its vectors' type, another one is an error."""
    h = read_header(spark, name)
    if expect is not None and h["type"] != expect:
        raise ValueError(f"vectors are {h['type']}, not {expect}")
    vectors = spark.read.format(h["format"]).schema(StructType.fromJson(h["schema"])).load(f"{name}/vectors")
    return Embedding(vectors, gf.positional_distance if h["kind"] == "sketch" else gf.dot_distance, h["symmetric"], h["kind"])


def dump_table(df: DataFrame, out: Output) -> None:
    """A decomposition, block statistics, block check or neighbour table."""
    df.write.mode("overwrite").format(out.format).save(f"{out.name}/table")
    _write_header(df.sparkSession, out, {"version": VERSION, "format": out.format, "schema": df.schema.jsonValue()})


def load_table(spark: SparkSession, name: str) -> DataFrame:
    h = read_header(spark, name)
    return spark.read.format(h["format"]).schema(StructType.fromJson(h["schema"])).load(f"{name}/table")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with multiplicity; empty if they are equal."""
    cols = a.columns
    one = a.withColumn("side", F.lit("a")).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    two = b.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_m"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    both = one.alias("a").join(two.alias("b"), cond, "full")
    return both.filter(F.coalesce("_n", F.lit(0)) != F.coalesce("_m", F.lit(0))).select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in cols])
