"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first counted per (key, value), so a key of any number of rows becomes its distinct values with weights; the
work of a hot key is spread over the hash of its values. Counts, distinct counts and modes then need one partial
aggregation of weighted values. Percentiles rank weighted values inside nested cells of the value, so no task holds a key.

Values are numbers. Defined results: rows with a null key are left out; null values are counted by ``rows`` but are no value; NaN is one
value above all others; ties of the mode go to the smallest value; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft import runtime

#: Width of the outer cells as a logarithm, parts of a cell, most levels of cells.
_STEP, SPLIT, DEPTH = 0.02, 1024, 6


def weigh(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, weight): each distinct value of each key once with its number of rows."""
    there = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    return there.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def profile(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows, n_distinct, mode, mode_rows) from weighted values."""
    real = F.col("value").isNotNull()
    best = F.max(F.when(real, F.struct("weight", (-F.col("value")).alias("neg")))).alias("best")
    out = weighted.groupBy(*keys).agg(F.sum("weight").alias("rows"), F.count("value").alias("n_distinct"), best)
    return out.select(*keys, "rows", "n_distinct", (-F.col("best.neg")).alias("mode"), F.coalesce("best.weight", F.lit(0)).cast("long").alias("mode_rows"))


def _cells(value: Column, depth: int) -> list[Column]:
    """Nested cells of a number, by rule: its signed logarithmic bucket, then ``SPLIT`` equal parts of that, parts of
    these, and so on. Cells of a level are in order of value; six levels tell any two doubles apart."""
    v = value.cast("double")
    size = F.abs(v)
    i = F.ceil(F.log(size) / F.lit(_STEP))
    cells = [F.when(v == 0, F.lit(0)).when(size == float("inf"), F.signum(v) * F.lit(1 << 20)).otherwise(F.signum(v) * (i + F.lit(1 << 18))).cast("long")]
    lo, width = F.exp((i - 1) * F.lit(_STEP)), F.exp(i * F.lit(_STEP)) - F.exp((i - 1) * F.lit(_STEP))
    rest = F.when((v == 0) | (size == float("inf")), F.lit(0.0)).otherwise(F.least(F.greatest(F.coalesce(F.try_divide(size - lo, width), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    rest = F.when(v < 0, F.lit(1.0) - rest).otherwise(rest)
    for _ in range(1, depth):
        part = F.least(F.floor(rest * SPLIT), F.lit(SPLIT - 1)).cast("long")
        cells.append(part)
        rest = rest * SPLIT - part
    return cells


def percentiles(weighted: DataFrame, keys: Sequence[str], qs: Sequence[float], limit: int = 100_000) -> DataFrame:
    """(keys, q, value): exact lower percentiles, the value at rank floor(q * (rows - 1)), of weighted values.

    Weights are summed per cell of the value, which needs no look at the key's other values; the cell that holds a rank
    is found from the sums, and only its values are ranked. A wanted cell with more than ``limit`` distinct values is cut
    into smaller ones first, so neither a key nor a narrow range of it is brought to one task.
    """
    keys = list(keys)
    w = weighted.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    rows = w.groupBy(*keys).agg(F.sum("weight").alias("_rows"))
    wanted = rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).select(*keys, "q", F.floor(F.col("q") * (F.col("_rows") - 1)).alias("_rank"))
    inside: list[str] = []
    for depth in range(1, DEPTH + 1):
        cell, within = f"_c{depth}", inside
        celled = w.withColumns({f"_c{d + 1}": c for d, c in enumerate(_cells(F.col("value"), depth))})
        if within:
            celled = celled.join(wanted.select(*keys, *within).distinct(), [*keys, *within], "left_semi")
        sums = celled.groupBy(*keys, *within, cell).agg(F.sum("weight").alias("_in"), F.count(F.lit(1)).alias("_values"))
        upto = F.sum("_in").over(Window.partitionBy(*keys, *within).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))  # a row a cell
        placed = sums.withColumn("_upto", upto).join(wanted.select(*keys, *within, "q", "_rank"), [*keys, *within]).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_in")))
        inside = [*within, cell]
        wanted = runtime.materialize(placed.select(*keys, *inside, "q", (F.col("_rank") - F.col("_upto") + F.col("_in")).alias("_rank"), "_values"), "wanted")
        if (wanted.agg(F.max("_values")).first()[0] or 0) <= limit:
            break
    ranks = F.sum("weight").over(Window.partitionBy(*keys, *inside).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = celled.join(wanted.select(*keys, *inside).distinct(), [*keys, *inside], "left_semi").withColumn("_upto", ranks)
    hit = ranked.join(wanted.drop("_values"), [*keys, *inside]).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("weight")))
    return hit.select(*keys, "q", "value")


def _ends(edges: DataFrame) -> DataFrame:
    """Pairs of the graph with their number of rows; null ends and self-loops out."""
    return weigh(edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst"), ["src"], "dst").select("src", F.col("value").alias("dst"), "weight")


def _sides(edges: DataFrame) -> DataFrame:
    """(side, node, value, weight): pairs seen from both ends."""
    seen = F.explode(F.array(F.struct(F.lit("d_out").alias("side"), F.col("src").alias("node"), F.col("dst").alias("value")), F.struct(F.lit("d_in").alias("side"), F.col("dst").alias("node"), F.col("src").alias("value"))))
    return _ends(edges).select("weight", seen.alias("x")).select("x.side", "x.node", "x.value", "weight")


def degree_profile(edges: DataFrame) -> DataFrame:
    """(node, d_in, d_out, n_in, n_out, top_in, top_out): rows, distinct neighbours and the commonest neighbour of each side."""
    p = profile(_sides(edges), ["side", "node"])

    def of(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))

    zero = F.lit(0).cast("long")
    return p.groupBy("node").agg(*[F.coalesce(of(s, c), zero).alias(a) for s, c, a in (("d_in", "rows", "d_in"), ("d_out", "rows", "d_out"), ("d_in", "n_distinct", "n_in"), ("d_out", "n_distinct", "n_out"))], of("d_in", "mode").alias("top_in"), of("d_out", "mode").alias("top_out"))


def heavy_nodes(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, node): nodes whose degree is at least ``share`` of all rows of ``edges``."""
    total = edges.agg(F.count(F.lit(1)).alias("total"))
    degree = _sides(edges).groupBy("side", "node").agg(F.sum("weight").alias("degree"))
    return degree.join(F.broadcast(total), F.col("degree") >= F.col("total") * F.lit(share)).select("side", "node")  # total is one row
