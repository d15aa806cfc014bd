"""Link prediction over several passes: each pass deletes edges by its own seed, embeds what is left and scores it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.model import Embedding, Graph, index_nodes
from graphweft.operators import link_prediction as lp
from graphweft.operators import node_centric, sketch


def node_ranks(g: Graph) -> DataFrame:
    """(node, rank) in order of id."""
    return runtime.materialize(index_nodes(g.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"), F.col("node").alias("at")), "at"), "ranks")


def one_pass(g: Graph, embed: Callable[[Graph], Embedding], fraction: float, seed: int, ranks: DataFrame, count: int, precision: bool = False, centric: bool = False, draws: int = 10_000) -> dict[str, float]:
    """Figures of one pass: auc; precision and recall of the 50 nearest pairs (undirected sketches, whose nearest pairs come
    from a join); vcmpr, centric_auc and its correlation with the degree, averaged over a sample of nodes, for any embedding."""
    split = runtime.materialize(lp.split_edges(g, fraction, seed), "split")
    e = embed(lp.train_graph(g, split))
    e = Embedding(runtime.materialize(e.vectors, "trained"), e.distance, e.symmetric, e.kind)
    out = {"auc": lp.auc(split.filter("deleted"), lp.sample_non_edges(g, draws, ranks, count, seed), e).first().auc}
    if precision and e.symmetric and e.kind == "sketch":
        dim = e.vectors.select(F.size("vec")).first()[0]
        got = lp.precision(sketch.top_pairs(e.vectors, dim, 50, split.filter("not deleted")), split, 50).first()
        out |= {"precision": got.precision, "recall": got.recall}
    if centric:
        sample = node_centric.draw(g.nodes, count, seed=seed)
        out["vcmpr"] = node_centric.vcmpr(e, split, sample).agg(F.avg("precision")).first()[0]
        row = node_centric.centric_auc(e, split, count, sample).agg(F.avg("auc").alias("auc"), F.corr("degree", "auc").alias("corr")).first()
        out |= {"centric_auc": row.auc, "centric_corr": row["corr"]}
    runtime.discard(e.vectors)
    return out


def validate(g: Graph, embed: Callable[[Graph], Embedding], fraction: float, passes: int, precision: bool = False, centric: bool = False) -> DataFrame:
    """(figure, mean, error, passes): mean and standard error of each figure over the passes."""
    spark = g.edges.sparkSession
    count, ranks = g.nodes.count(), node_ranks(g)
    rows = [(seed, k, None if v is None else float(v)) for seed in range(passes) for k, v in one_pass(g, embed, fraction, seed, ranks, count, precision, centric).items()]
    figures = spark.createDataFrame(rows, "seed int, figure string, value double")
    return figures.groupBy("figure").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("error"), F.count("value").alias("passes"))
