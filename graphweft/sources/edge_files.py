"""Text files of edges, labels and communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.model import Graph, build

DELIMITERS = ("\t", ",", " ", ";")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of data with a number that grows along each file; comment lines (# or %) and blank ones out."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return lines.withColumn("value", F.regexp_replace("value", "\r$", "")).filter(~F.col("value").rlike("^[#%]") & (F.trim("value") != ""))


def header_lines(spark: SparkSession, path: str) -> int:
    """Number of lines before the first that doesn't begin with # or %."""
    n = 0
    for r in spark.read.text(path).toLocalIterator(prefetchPartitions=False):
        if not r.value.startswith(("#", "%")):
            break
        n += 1
    return n


def probe_delimiter(spark: SparkSession, path: str, delimiters: Sequence[str] = DELIMITERS) -> str:
    """The first delimiter by which the first line of data begins with two numbers of nodes."""
    first = _lines(spark, path).first()
    for d in delimiters:
        fields = first.value.strip().split(d) if first is not None else []
        if len(fields) >= 2 and all(f.strip().isdecimal() for f in fields[:2]):
            return d
    raise ValueError(f"no delimiter of {delimiters!r} fits {path}")


def read_edges(spark: SparkSession, path: str, delimiter: str | None = None, strict: bool = True) -> DataFrame:
    """(src, dst, w, line_no): the third field is the weight where lines have exactly three, else 1.

    ``strict``: another number of fields than the first line's is an error when the rows are read.
    """
    delimiter = probe_delimiter(spark, path) if delimiter is None else delimiter
    lines = _lines(spark, path)
    first = lines.first()
    n = len(first.value.strip().split(delimiter)) if first is not None else 2
    if n < 2:
        raise ValueError(f"lines of {path} have fewer than two fields")
    f = F.split(F.trim("value"), "\\Q" + delimiter + "\\E")
    if strict:
        lines = lines.withColumn("value", F.when(F.size(f) == n, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("another number of fields: "), F.col("value")))))
    w = F.get(f, F.lit(2)).cast("double") if n == 3 else F.lit(1.0)
    return lines.select(F.get(f, F.lit(0)).cast("long").alias("src"), F.get(f, F.lit(1)).cast("long").alias("dst"), w.alias("w"), "line_no")


def load_graph(spark: SparkSession, path: str, directed: bool, delimiter: str | None = None) -> Graph:
    """Edges of a file as a graph: repeated edges add up, self-loops go but their nodes stay."""
    return build(read_edges(spark, path, delimiter), directed)


def read_labels(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(node, label) of a file with one pair a line."""
    rows = read_edges(spark, path, delimiter)
    return rows.select(F.col("src").alias("node"), F.col("dst").alias("label"))


def load_labelled_graph(spark: SparkSession, edges: str, labels: str, directed: bool, delimiter: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, dst, w, label) of the edges, in both directions if not ``directed``, (node) of all nodes and (node, label) of the
    labels of those nodes, as :func:`graphweft.operators.labelled.embed_labelled` takes them. Edges have no labels of their own;
    label 0, which stands for none there, becomes one more than the greatest."""
    e = read_labelled_network(spark, edges, directed, delimiter)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    both = e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "label"))
    given = read_labels(spark, labels, delimiter).distinct()
    fresh = given.agg((F.max("label") + 1).alias("fresh"))
    named = given.join(F.broadcast(fresh)).select("node", F.when(F.col("label") == 0, F.col("fresh")).otherwise(F.col("label")).cast("string").alias("label"))  # fresh is one row
    return both, nodes, named.join(nodes, "node", "left_semi")


def read_labelled_network(spark: SparkSession, edges: str, directed: bool, delimiter: str | None = None, header: bool = False) -> DataFrame:
    """(src, dst, w, label): edges of weight 1 without labels, once each; of an undirected network once per pair of ends."""
    rows = read_edges(spark, edges, delimiter)
    if header:
        rows = rows.filter(F.col("line_no") > F.lit(rows.agg(F.min("line_no")).first()[0]))
    ends = ("src", "dst") if directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return rows.select(*ends).distinct().select("src", "dst", F.lit(1.0).alias("w"), F.lit(None).cast("string").alias("label"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """(community, node): one community a line, nodes separated by tabs; communities are numbered by their line."""
    lines = spark.read.text(path).withColumn("community", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return lines.select("community", F.explode(F.split("value", "\t")).alias("node")).select("community", F.col("node").cast("long").alias("node")).filter("node is not null")
