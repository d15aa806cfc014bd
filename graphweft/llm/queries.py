"""Queries of the training-data problems, and SQL where it can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import runtime
from graphweft.llm import encoding_repair, eval_leakage, quantile_sketch, set_join, split, tokenize, vector_knn
from graphweft.operators import skewed_keys
from graphweft.runtime import table


def _sketch_sets(spark: SparkSession, d: str) -> DataFrame:
    """Space 0: sketches and sketches_out, compared within and with each other; space 1: sketches_in."""
    sym, asym = table(spark, d, "node_sketch"), table(spark, d, "node_sketch_asym")
    parts = [src.select(F.lit(space).alias("space"), F.lit(f).alias("field"), F.col("node").alias("id"), F.col(f).alias("toks")) for src, f, space in ((sym, "sketches", 0), (asym, "sketches_out", 0), (asym, "sketches_in", 1))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = set_join.similar_records(_sketch_sets(spark, d), 0.6)
    kind = F.when(F.col("field_a") != F.col("field_b"), "sym_out").when(F.col("field_a") == "sketches", "sym").when(F.col("field_a") == "sketches_out", "out").otherwise("in")
    return pairs.select(kind.alias("kind"), F.col("id_a").alias("node_a"), F.col("id_b").alias("node_b"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return set_join.links_per_record(_sketch_sets(spark, d), 0.6)


def _each_field(spark: SparkSession, d: str, **options) -> DataFrame:
    out = None
    for t, f in (("embedded", "data"), ("embedded_asym", "source"), ("embedded_asym", "target")):
        own = vector_knn.nearest(table(spark, d, t), f, "node", f, 48, **options)
        out = own if out is None else out.unionByName(own)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of cosine 0.9 or more among the 5 nearest; the bound is passed down, so only leaves that can hold them are visited."""
    n = _each_field(spark, d, recall=1.0, least=0.9).filter("cosine >= 0.9")
    return n.select("field", F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of every vector."""
    return _each_field(spark, d, recall=0.93)


def _linked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of graphs with a usable setting: edge_id, graph, delete_fraction and the link's ends as ``symetric`` has them."""
    usable = table(spark, d, "validation_params").filter("delete_fraction > 0 and delete_fraction < 1 and symetric is not null")
    setting = usable.groupBy("graph").agg(F.max("delete_fraction").alias("delete_fraction"), F.max("symetric").alias("symetric"))
    e = table(spark, d, "edge_list").filter("src is not null and dst is not null").select("edge_id", "graph", "src", "dst").join(setting, "graph")
    ends = [F.when(F.col("symetric"), f("src", "dst")).otherwise(F.col(c)).alias(a) for f, c, a in ((F.least, "src", "a"), (F.greatest, "dst", "b"))]
    return e.select("edge_id", "graph", "delete_fraction", *ends)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    labels, _ = split.groups(_linked_rows(spark, d), [["graph", "a", "b"]], "edge_id")
    return labels.filter("node <> root").select(F.col("root").alias("edge_id_a"), F.col("node").alias("edge_id_b"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d).select("edge_id", "graph", "split")


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the graphs that take part with ends a, b, root of their group and split."""
    rows = runtime.materialize(_linked_rows(spark, d), "linked")
    labels, _ = split.groups(rows, [["graph", "a", "b"]], "edge_id")
    rooted = runtime.materialize(rows.join(labels, rows.edge_id == labels.node, "left").select("edge_id", "graph", "delete_fraction", "a", "b", F.coalesce("root", "edge_id").alias("root")), "rooted")
    dealt = split.deal(rooted.groupBy("graph", "delete_fraction", "root").agg(F.count(F.lit(1)).alias("size")), ["graph"], "size", "delete_fraction")
    return rooted.join(dealt.select("root", "split"), "root")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per graph: rows, links, links in more than one split, and whether the held-out rows are within 2 % of all rows, or one row, of ``delete_fraction``."""
    rows = runtime.materialize(_dealt(spark, d), "dealt")
    links = rows.groupBy("graph", "a", "b").agg(F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).cast("int").alias("broken"), F.count(F.when(F.col("split") != "train", 1)).alias("held"), F.max("delete_fraction").alias("f"))
    per = links.groupBy("graph").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("links"), F.sum("broken").alias("broken"), F.sum("held").alias("held"), F.max("f").alias("f"))
    return per.select("graph", "rows", "links", "broken", (F.abs(F.col("held") - F.col("f") * F.col("rows")) <= F.greatest(F.lit(1.0), F.col("rows") * 0.02)).alias("close"))


P6_QS = [0.5, 0.9, 0.95, 0.99]


def _degree_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Partial results by load day; repeated rows count once."""
    once = quantile_sketch.one_per_key(table(spark, d, "node_degree").select("snap_id", "node", "graph", "d_in", "d_out", "loaded_at"), ["snap_id", "node"])
    return quantile_sketch.sketch(once.withColumn("day", F.to_date("loaded_at")), ["graph", "snap_id", "day"], ["d_in", "d_out"])


def _block_sketch(spark: SparkSession, d: str) -> DataFrame:
    once = quantile_sketch.one_per_key(table(spark, d, "block_stat").select("run_id", "blocnum", "graph", "mean_dist", "loaded_at"), ["run_id", "blocnum"])
    return quantile_sketch.sketch(once.withColumn("day", F.to_date("loaded_at")), ["graph", "run_id", "day"], ["mean_dist"])


def _p6(sketch, keys: list[str]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _p6_result(quantile_sketch.merge(sketch(spark, d), keys), keys)

    return query


def _p6_result(merged: DataFrame, keys: list[str]) -> DataFrame:
    out = quantile_sketch.percentiles(merged, keys, P6_QS)
    return out.select(*keys, "field", "q", "n", quantile_sketch.significant(F.col("value")).alias("value"))


def p6_degree_from_store(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per graph from stored sketches: one folder a load day, combined without a look at the rows."""
    path = runtime.scratch(spark, "sketches")
    quantile_sketch.store(_degree_sketch(spark, d), path, "day")
    return _p6_result(quantile_sketch.merge(quantile_sketch.load(spark, path), ["graph"]), ["graph"])


def p6_error_bound(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the sketches against the exact ones of the same ranks: (field, checked, beyond the bound of 1 %)."""
    once = quantile_sketch.one_per_key(table(spark, d, "node_degree").select("snap_id", "node", "graph", "d_in", "d_out", "loaded_at"), ["snap_id", "node"])
    dist = quantile_sketch.one_per_key(table(spark, d, "block_stat").select("run_id", "blocnum", "graph", "mean_dist", "loaded_at"), ["run_id", "blocnum"])
    parts = [once.select("graph", F.col("snap_id").alias("part"), F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in ("d_in", "d_out")]
    parts.append(dist.select("graph", F.col("run_id").alias("part"), F.lit("mean_dist").alias("field"), F.col("mean_dist").alias("v")))
    long = runtime.materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("field", "kind"), "values")
    out = None
    for keys in (["kind", "graph", "part"], ["kind", "graph"]):
        exact = skewed_keys.percentiles(skewed_keys.weigh(long, keys, "v"), keys, P6_QS).withColumnRenamed("value", "exact")
        near = quantile_sketch.percentiles(quantile_sketch.sketch(long, keys, ["v"]), keys, P6_QS)
        both = exact.join(near, [*keys, "q"], "full").select(F.col("kind").alias("field"), (F.abs(F.col("value") - F.col("exact")) <= F.abs(F.col("exact")) * 0.01 * (1 + 1e-9)).alias("within"))
        out = both if out is None else out.unionByName(both)
    return out.groupBy("field").agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(F.coalesce("within", F.lit(False)), None).otherwise(1)).alias("beyond"))


p6_degree_by_snapshot, p6_degree_by_graph = _p6(_degree_sketch, ["graph", "snap_id"]), _p6(_degree_sketch, ["graph"])
p6_distance_by_run, p6_distance_by_graph = _p6(_block_sketch, ["graph", "run_id"]), _p6(_block_sketch, ["graph"])


def _p6_sql(source: str, keys: str, fields: list[str]) -> str:
    """The same buckets in SQL, error 0.01."""
    long = " union all ".join(f"select {keys}, '{f}' field, {f}::double v from once" for f in fields)
    return f"""with once as ({source}), x as (select * from ({long}) where v is not null and not isnan(v)),
    b as (select {keys}, field, sign(v)::int s, case when v = 0 then 0 else ceil(ln(nullif(abs(v), 0)) / ln(1.01 / 0.99))::int end k, count(*) n from x group by all),
    c as (select *, sum(n) over (partition by {keys}, field order by s, s * k) upto, sum(n) over (partition by {keys}, field) total from b),
    q as (select unnest([0.5, 0.9, 0.95, 0.99])::double q)
    select {keys}, field, q, total::bigint n, format('{{:.8e}}', case when s = 0 then 0.0 else s * 2 / (1.01 / 0.99 + 1) * pow(1.01 / 0.99, k) end)::double as value
    from c, q where floor(q * (total - 1)) < upto and floor(q * (total - 1)) >= upto - n"""


_DEGREE_ONCE = "select snap_id, node, min(graph) graph, max(d_in) d_in, max(d_out) d_out from node_degree group by snap_id, node"
_BLOCK_ONCE = "select run_id, blocnum, min(graph) graph, max(case when isnan(mean_dist) then null else mean_dist end) mean_dist from block_stat group by run_id, blocnum"


def _bound_sql() -> str:
    levels = [f"select distinct 'd_in' f, graph, {p} part from o where d_in is not null union all select distinct 'd_out', graph, {p} from o where d_out is not null union all select distinct 'mean_dist', graph, {r} from b where mean_dist is not null" for p, r in (("snap_id", "run_id"), ("null", "null"))]
    return f"with o as ({_DEGREE_ONCE}), b as ({_BLOCK_ONCE}), k as ({' union all '.join(levels)}) select f field, count(*) * 4 checked, 0::bigint beyond from k group by f"


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leakage.found(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return eval_leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.found(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.restore(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p4_found": p4_found, "p4_knn": p4_knn, "p5_found": p5_found, "p5_split": p5_split, "p5_shares": p5_shares, "p6_degree_by_snapshot": p6_degree_by_snapshot, "p6_degree_by_graph": p6_degree_by_graph, "p6_distance_by_run": p6_distance_by_run, "p6_distance_by_graph": p6_distance_by_graph, "p6_degree_from_store": p6_degree_from_store, "p6_error_bound": p6_error_bound, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_restored": p9_restored}
_VECTORS = "v as materialized (" + " union all ".join(f"select '{f}' field, node, any_value({f})::double[] v from {t} where len({f}) = 48 and len(list_filter({f}, lambda x: isfinite(x))) = 48 and list_max(list_transform({f}, lambda x: abs(x))) > 0 group by node" for t, f in (("embedded", "data"), ("embedded_asym", "source"), ("embedded_asym", "target"))) + ")"
_GRAMS = "{0} as materialized (select distinct {1}, array_to_string(w[k : k + 11], ' ') g from (select {1}, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) w from {2}), unnest(range(1, len(w) - 10)) t(k))"
SQL: dict[str, str] = {
    "p2_links": """with r as (select 0 s, 'sketches' field, node id, list_sort(list_filter(list_distinct(any_value(sketches)), lambda x: x is not null)) t from node_sketch group by node
    union all select 0, 'sketches_out', node, list_sort(list_filter(list_distinct(any_value(sketches_out)), lambda x: x is not null)) from node_sketch_asym group by node
    union all select 1, 'sketches_in', node, list_sort(list_filter(list_distinct(any_value(sketches_in)), lambda x: x is not null)) from node_sketch_asym group by node),
    c as materialized (select s, t, len(t) n, min(id) class_id, count(*) copies, row_number() over () k from r where len(t) > 0 group by s, t), x as materialized (select s, k, n, unnest(t) v from c),
    p as (select a.k, b.k k2 from x a join x b on a.s = b.s and a.v = b.v and a.k <> b.k group by a.k, b.k, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.6), l as (select k, count(*) links from p group by k)
    select field, id, class_id, copies, coalesce(links, 0) links from r join c using (s, t) left join l using (k)""",
    "p4_found": f"""with {_VECTORS}, k as (select field, id, neighbour, c from (select a.field, a.node id, b.node neighbour, list_cosine_similarity(a.v, b.v) c, row_number() over (partition by a.field, a.node order by list_cosine_similarity(a.v, b.v) desc, b.node) r from v a join v b on a.field = b.field and a.node <> b.node) where r <= 5 and c >= 0.9)
    select distinct field, least(id, neighbour) node_a, greatest(id, neighbour) node_b from k""",
    "p8_found": f"with {_GRAMS.format('dg', 'doc_id', 'documents')}, {_GRAMS.format('ig', 'item_id', 'eval_item')} select distinct doc_id, item_id from dg join ig using (g)",
    "p2_found": """with r as (select 0 s, 'sym' f, node, list_distinct(any_value(sketches)) t from node_sketch group by node
    union all select 0, 'out', node, list_distinct(any_value(sketches_out)) from node_sketch_asym group by node
    union all select 1, 'in', node, list_distinct(any_value(sketches_in)) from node_sketch_asym group by node),
    k as materialized (select s, f, node, len(t) n, t from r where len(t) > 0), x as materialized (select s, f, node, n, unnest(t) v from k)
    select case when a.f = b.f then a.f else 'sym_out' end kind, a.node node_a, b.node node_b from x a join x b on a.s = b.s and a.v = b.v and a.node < b.node
    and a.n >= 0.6 * b.n and b.n >= 0.6 * a.n group by a.f, b.f, a.node, b.node, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.6""",
    "p5_found": """with s as (select graph, bool_or(symetric) y from validation_params where delete_fraction > 0 and delete_fraction < 1 and symetric is not null group by graph),
    e as (select edge_id, graph, case when y then least(src, dst) else src end a, case when y then greatest(src, dst) else dst end b from edge_list join s using (graph) where src is not null and dst is not null),
    m as (select edge_id, min(edge_id) over (partition by graph, a, b) k from e) select k edge_id_a, edge_id edge_id_b from m where k <> edge_id""",
    "p5_shares": """with s as (select graph, bool_or(symetric) y from validation_params where delete_fraction > 0 and delete_fraction < 1 and symetric is not null group by graph),
    e as (select graph, case when y then least(src, dst) else src end a, case when y then greatest(src, dst) else dst end b from edge_list join s using (graph) where src is not null and dst is not null)
    select graph, sum(n)::bigint as rows, count(*) links, 0::bigint broken, true as close from (select graph, a, b, count(*) n from e group by all) group by graph""",
    "p6_degree_by_snapshot": _p6_sql(_DEGREE_ONCE, "graph, snap_id", ["d_in", "d_out"]),
    "p6_degree_by_graph": _p6_sql(_DEGREE_ONCE, "graph", ["d_in", "d_out"]),
    "p6_degree_from_store": _p6_sql(_DEGREE_ONCE, "graph", ["d_in", "d_out"]),
    "p6_error_bound": _bound_sql(),
    "p6_distance_by_run": _p6_sql(_BLOCK_ONCE, "graph, run_id", ["mean_dist"]),
    "p6_distance_by_graph": _p6_sql(_BLOCK_ONCE, "graph", ["mean_dist"]),
}
