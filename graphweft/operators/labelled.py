"""Sketches of labelled graphs and whole-graph signatures.

``labels`` (node, label): any number of labels a node; ``edges`` (src, dst, w, label): parallel edges allowed, the label
may be null. A hop of a node gathers, over its edges, the neighbours' labels by edge weight, their (node label, edge
label) pairs where the edge has a label, and the items of the neighbours' previous signatures by w * decay / slots; the
signature is drawn from these. Before the first hop every slot holds the default label. A node without edges keeps the
default in both signatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.model import SketchParams
from graphweft.operators.sketch import signatures

DEFAULT = "0"


def _hop(edges: DataFrame, labels: DataFrame, sketch: DataFrame, p: SketchParams, paired: bool) -> DataFrame:
    """(src, item, w) of one hop."""
    lab = labels.select(F.col("node").alias("dst"), F.col("label").alias("nlabel"))
    seen = edges.join(lab, "dst")
    item = F.concat_ws("|", "nlabel", "label") if paired else F.col("nlabel")
    near = (seen.filter("label is not null") if paired else seen).select("src", item.alias("item"), "w")
    items = sketch.select(F.col("node").alias("dst"), F.explode("vec").alias("item")).groupBy("dst", "item").agg(F.count(F.lit(1)).alias("n"))
    far = edges.join(items, "dst").select("src", "item", (F.col("w") * F.lit(p.decay / p.dim) * F.col("n")).alias("w"))
    return near.unionByName(far).groupBy("src", "item").agg(F.sum("w").alias("w"))


def embed_labelled(edges: DataFrame, nodes: DataFrame, labels: DataFrame, p: SketchParams = SketchParams(), paired: bool = False) -> DataFrame:
    """(node, vec) over labels, or over (node label, edge label) pairs; out-edges of ``edges`` are followed."""
    edges = runtime.materialize(edges.filter("src <> dst"), "edges")
    blank = F.array_repeat(F.lit(DEFAULT), p.dim)
    sketch = nodes.select("node", blank.alias("vec"))
    for _ in range(p.hops):
        drawn = signatures(_hop(edges, labels, sketch, p, paired), ["src"], p.dim)
        sketch = runtime.materialize(nodes.join(drawn, nodes.node == drawn.src, "left").select("node", F.coalesce("vec", blank).alias("vec")), "sketch")
    return sketch


def graph_signature(sketches: list[DataFrame], dim: int, size: int) -> DataFrame:
    """(slot, label): the weighted min-hash of the labels of all node sketches, by number of occurrences."""
    every = None
    for s in sketches:
        one = s.select(F.explode("vec").alias("item"))
        every = one if every is None else every.unionByName(one)
    counts = every.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("w")).select(F.lit(0).alias("g"), "item", "w")
    drawn = signatures(counts, ["g"], size)
    return drawn.select(F.posexplode("vec").alias("slot", "label"))


def relabel_zero(labels: DataFrame, fresh: str) -> DataFrame:
    """Label 0 is reserved for the default: it becomes ``fresh``."""
    return labels.withColumn("label", F.when(F.col("label") == 0, F.lit(int(fresh))).otherwise(F.col("label")))


def multi_labels(labels: DataFrame) -> DataFrame:
    """(node, labels): distinct labels of each node in order, 0 replaced by one more than the greatest label."""
    top = labels.agg((F.max("label") + 1).alias("fresh"))
    clean = labels.join(F.broadcast(top)).select("node", F.when(F.col("label") == 0, F.col("fresh")).otherwise(F.col("label")).alias("label"))  # top is one row
    return clean.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))
