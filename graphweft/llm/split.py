"""Train, validation and test splits that keep related records together.

Records that share a key are linked in two levels (to the least record of a salted part of the key's rows, these to the
least of the key), so no task holds a key's rows. Borůvka contraction then finds the connected groups: each component
takes its minimum outgoing link, the taken links join the persisted spanning forest, components are contracted along
them, until no link leaves a component. The roots are stratified by band of group size and dealt to the splits
systematically, in an order drawn by hash; positions come from counts per hash bucket, so no task ranks a stratum.

Defined results: rows with a null id or key are no part of a group; a record alone is its own group; a record under
several keys joins their groups; repeated rows of a record are one; an empty table gives an empty result; the split
depends only on ids, keys and ``seed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft import runtime


def star_links(records: DataFrame, key: Sequence[str], id: str = "id", salts: int = 32) -> DataFrame:
    """(a, b), a < b: links that connect all records of each key; a record hangs on at most one other per key and level."""
    whole = records.filter(" and ".join(f"`{c}` is not null" for c in [id, *key]))
    hashed = whole.select(*key, F.col(id).alias("id"), F.pmod(F.xxhash64(id), F.lit(salts)).alias("salt"), F.xxhash64(*key).alias("h"))
    # Most keys have one record: they leave on 8 bytes each, before anything wider is shuffled.
    often = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("h")
    shared = runtime.materialize(hashed.join(often, "h", "left_semi").drop("h"), "shared")
    low = runtime.materialize(shared.groupBy(*key, "salt").agg(F.min("id").alias("low")), "low")
    top = low.groupBy(*key).agg(F.min("low").alias("top"))
    within = shared.join(low, [*key, "salt"]).filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    across = low.join(top, list(key)).filter("low <> top").select(F.col("top").alias("a"), F.col("low").alias("b"))
    return within.unionByName(across)


def _contract(pick: DataFrame) -> DataFrame:
    """(c, p): each component and the root of its tree of taken links, by pointer jumping."""
    # Two components that took the same link point at each other; the lesser of them is the root.
    back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
    parent = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
    point = runtime.materialize(pick.join(back, "to").select("c", parent.alias("p")), "point")
    while True:
        up = point.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        before, jumped = point, runtime.materialize(point.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "point")
        point = jumped.select("c", "p")
        runtime.discard(before)
        if jumped.filter("moved").isEmpty():
            return point


def forest(links: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all linked nodes and (a, b), the persisted spanning forest of the links.

    Links are ordered by their two ends. The number of components that still have a link at least halves each round,
    so the bound on rounds is never reached below 2 ** rounds nodes.
    """
    ends = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    work = runtime.materialize(ends.distinct().select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b"), "links")
    labels, taken = work.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), work.select("a", "b").limit(0)
    for turn in range(rounds):
        both = work.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to")))).alias("x"), "a", "b")
        pick = runtime.materialize(both.groupBy("x.c").agg(F.min(F.struct("a", "b", "x.to")).alias("m")).select("c", "m.to", "m.a", "m.b"), "pick")
        if pick.isEmpty():
            return runtime.materialize(labels, "labels"), runtime.materialize(taken, "forest")
        point = _contract(pick)
        taken = taken.unionByName(pick.select("a", "b").distinct())
        if turn == 0:
            labels = point.select(F.col("c").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(point.select(F.col("c").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        a, b = point.select(F.col("c").alias("ca"), F.col("p").alias("pa")), point.select(F.col("c").alias("cb"), F.col("p").alias("pb"))
        before, work = work, runtime.materialize(work.join(a, "ca").join(b, "cb").filter("pa <> pb").select(F.col("pa").alias("ca"), F.col("pb").alias("cb"), "a", "b"), "links")
        runtime.discard(before)
    raise RuntimeError("links left after the last round")


def groups(records: DataFrame, keys: Sequence[Sequence[str]], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(node, root) of records connected with another by any of ``keys``, root the least id of the group; and the forest."""
    links = None
    for key in keys:
        own = star_links(records, key, id)
        links = own if links is None else links.unionByName(own)
    labels, tree = forest(links)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root")), tree


def deal(roots: DataFrame, stratum: Sequence[str], size: str, held_out: str, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """``roots`` (column ``root``) with ``split``: in each stratum, ordered by size band and hash, groups are dealt evenly.

    ``held_out`` names the column with the share for validation and test together, half each. As each band gets its
    share of groups whose sizes differ by less than two times, the shares of rows follow.
    """
    n = buckets or max(16, roots.count() // 50_000)
    h = F.xxhash64("root", F.lit(seed))
    bucket = F.pmod(F.shiftrightunsigned("_h", 20), F.lit(n)).cast("int")
    r = roots.withColumn("_band", F.floor(F.log2(F.col(size).cast("double"))).cast("int")).withColumn("_h", h).withColumn("_bucket", bucket)
    upto = Window.partitionBy(*stratum).orderBy("_band", "_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = r.groupBy(*stratum, "_band", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*stratum, "_band", "_bucket", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*stratum, "_band", "_bucket").orderBy("_h", "root"))
    at = F.col("_before") + inside

    def dealt(position: Column) -> Column:
        return F.floor(position * F.col(held_out) + F.lit(0.5))

    placed = r.join(before, [*stratum, "_band", "_bucket"]).withColumn("_at", at)
    split = F.when(dealt(F.col("_at")) == dealt(F.col("_at") - 1), F.lit("train")).when(F.pmod(dealt(F.col("_at")), F.lit(2)) == 1, F.lit("validation")).otherwise(F.lit("test"))
    return placed.withColumn("split", split).drop("_band", "_h", "_bucket", "_before", "_at")
