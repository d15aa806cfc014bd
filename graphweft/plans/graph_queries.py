"""Queries of the graph operators over whole tables, with SQL for the same results.

Graph fixtures: E, all rows of edge_list with both ends and a usable weight, directed; S, the same in both directions;
NAT, supplier nation to customer nation by lineitems. Communities of a node are the graphs it occurs in; its block is
its band of degree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft import functions as gf
from graphweft import model, runtime
from graphweft.model import Graph, HopeParams, SketchParams
from graphweft.operators import cores, degrees, dense, density, density_analysis, labelled, node_centric, normalize, sketch, spectral
from graphweft.operators import link_prediction as lp
from graphweft.plans import preparation
from graphweft.runtime import table
from graphweft.sources import edge_files, raw_lines, store

P = SketchParams(16, 0.2, 2)
KNN, SKIP = 5, 0.2
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Fixtures


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_list").select("src", "dst", "w", "edge_id", "graph", "label")


def graph(spark: SparkSession, d: str, directed: bool = True) -> Graph:
    return model.build(rows(spark, d), directed)


def nations(spark: SparkSession, d: str) -> Graph:
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    w = j.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    w = runtime.materialize(w, "nations")
    nodes = w.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return Graph(w, nodes, True)


def communities(spark: SparkSession, d: str) -> DataFrame:
    r = model.usable_rows(rows(spark, d))
    return r.select(F.explode(F.array("src", "dst")).alias("node"), F.col("graph").alias("community")).distinct()


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Bands of degree, densest first: 64 less the bits of d_in + d_out."""
    return degrees.degrees(graph(spark, d)).select("node", (F.lit(64) - F.length(F.bin(F.col("d_in") + F.col("d_out")))).alias("block"))


def _u(x: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {x})), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


R = "r as (select src, dst, coalesce(w, 1.0) w, edge_id, graph, label from edge_list where src is not null and dst is not null and (w is null or (w > 0 and not isnan(w))))"
N = "n as (select src node from r union select dst from r)"
E = "e as (select src, dst, sum(w) w from r where src <> dst group by src, dst)"
S = "s as (select src, dst, sum(w) w from (select src, dst, w from e union all select dst, src, w from e) group by src, dst)"
CO = "co as (select distinct unnest([src, dst]) node, graph community from r)"
DG = "md as (select node, count(*) dg from (select src node from e union all select dst from e) group by node)"
MB = f"{DG}, mb as (select n.node, (64 - length(bin(coalesce(dg, 0))))::int block from n left join md using (node))"
NAT = "w as (select s_nationkey::bigint src, c_nationkey::bigint dst, count(*)::double w from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all)"
BASE = f"with {R}, {N}, {E}, {S}"


def _clocks(items: str, slots: int, text: bool = False) -> str:
    """(item, slot, key) of a query for the items, in the same integer arithmetic as the races."""
    x, y = [f"('0x' || substr(md5(item), {at}, 7))::bigint" if text else f"((item & {gf.PRIME}) * {a} + ((item >> 31) % {gf.PRIME}) * {b} + {b}) % {gf.PRIME}" for at, a, b in zip((1, 8), gf.SEED_A, gf.SEED_B)]
    h = f"select item, slot, (x * ((slot + 1) * {gf.SLOT} % {gf.PRIME}) + y) % {gf.PRIME} h from (select item, {x} x, {y} y from ({items})), (select unnest(range({slots})) slot)"
    return f"select item, slot, -ln(((xor(h, h >> 15) * {gf.STIR} % {gf.PRIME}) + (h + 0.5::double) / {gf.PRIME}) / {gf.PRIME}) key from ({h})"


def _sketch_sql(edges: str, tag: str, hops: int, nodes: str = "n", dim: int = 16) -> str:
    """CTEs <tag>0 .. <tag>hops (node, slot, v) of the sketch of an edge CTE."""
    out = [f"{tag}k as materialized ({_clocks(f'select node item from {nodes}', dim)})", f"{tag}a as materialized (select src, dst, w from {edges} union all select node, node, 1.0 from {nodes})", f"{tag}0 as materialized (select src node, slot, arg_min(dst, key / w) v from {tag}a join {tag}k on item = dst group by src, slot)"]
    for h in range(1, hops + 1):
        out.append(f"{tag}c{h} as materialized (select src, item, sum(w) w from (select src, dst item, w from {tag}a union all select a.src, p.v, a.w * (0.2 / {dim}) * c from {tag}a a join (select node, v, count(*) c from {tag}{h - 1} group by node, v) p on p.node = a.dst) group by src, item)")
        out.append(f"{tag}{h} as materialized (select src node, slot, arg_min(item, key / w) v from {tag}c{h} join {tag}k using (item) group by src, slot)")
    return ", ".join(out)


SK = BASE + ", " + _sketch_sql("s", "h", 2)
PAIRS = "pr as (select a.node node_a, b.node node_b, count(*) / 16.0 similarity from h2 a join h2 b on a.slot = b.slot and a.v = b.v and a.node < b.node group by all having count(*) >= 15)"
NEAR = "nb as (select * from (select *, row_number() over (partition by node order by distance, neighbour) k from (select a.node, b.node neighbour, 1 - count(*) filter (a.v = b.v) / 16.0 distance from h2 a join h2 b on a.slot = b.slot and a.node <> b.node where a.node % 50 = 0 group by a.node, b.node)) where k <= 5)"


# Loading and normalisation


@query(f"with {R}, {E} select src, dst, round(w, 6) w from e")
def edges_weighted(spark, d):
    return rounded(graph(spark, d).edges, "w")


@query(f"{BASE} select src, dst, round(w, 6) w from s")
def edges_symmetrised(spark, d):
    return rounded(graph(spark, d, False).edges, "w")


@query(f"with {R} select src, dst, arg_max(w, edge_id) w from r group by src, dst")
def edges_last_weight(spark, d):
    return model.last_weight(rows(spark, d), "edge_id")


@query(f"with {R} select src node, count(*) n from r where src = dst group by src")
def self_loops(spark, d):
    return model.usable_rows(rows(spark, d)).filter("src = dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))


RANK = "rk as (select node, row_number() over (order by min(seen)) - 1 rank from (select src node, edge_id * 2 seen from r union all select dst, edge_id * 2 + 1 from r) group by node)"


@query(f"with {R}, {RANK} select * from rk")
def node_index(spark, d):
    return model.index_nodes(rows(spark, d), "edge_id")


DEG = "dg as (select node, coalesce(i, 0) d_in, coalesce(o, 0) d_out from n left join (select dst, count(*) i from e group by dst) on dst = node left join (select src, count(*) o from e group by src) on src = node)"


@query(f"with {R}, {N}, {E}, {DEG} select * from dg")
def degrees_in_out(spark, d):
    return degrees.degrees(graph(spark, d))


@query(f"with {R}, {N}, {E}, {DEG} select d_in + d_out degree, count(*) nodes from dg group by 1")
def degree_histogram(spark, d):
    return degrees.histogram(graph(spark, d))


@query(f"""with {R}, {N}, {E}, {DEG}, o as (select d_in, row_number() over (order by d_in) - 1 k, count(*) over () c from dg),
q as (select unnest({list(degrees.QUANTILES)})::double q) select q, d_in from o, q where k = floor(q * (c - 1))""")
def degree_quantiles(spark, d):
    return degrees.in_degree_quantiles(graph(spark, d))


@query(f"with {R}, {N}, {E} select src, dst, round(w, 6) w from e union all select node, node, 1.0 from n")
def self_loop_augmented(spark, d):
    return rounded(normalize.self_loop_augmented(graph(spark, d)), "w")


@query(f"with {R}, {E} select dst src, src dst, round(w, 6) w from e")
def transpose(spark, d):
    return rounded(model.transpose(graph(spark, d).edges), "w")


@query(f"with {R}, {E} select src, dst, round(w / sum(w) over (partition by src), 6) w from e")
def row_normalised(spark, d):
    return rounded(normalize.row_normalised(graph(spark, d).edges), "w")


@query(f"with {R}, {N}, {E} select src, dst, round(-0.1 * w, 6) w from e union all select node, node, 1.0 from n")
def one_minus_beta_a(spark, d):
    g = graph(spark, d)
    return rounded(normalize.one_minus(g.edges, g.nodes, 0.1), "w")


_PR = "".join(f", x{k} as (select node, 0.15 / (select count(*) from n) + 0.85 * coalesce(f, 0) v from n left join (select dst, sum(w * v) f from p join x{k - 1} on src = node group by dst) on dst = node)" for k in (1, 2, 3))


@query(f"with {R}, {N}, {E}, p as (select src, dst, w / sum(w) over (partition by src) w from e), x0 as (select node, 1.0::double / (select count(*) from n) v from n){_PR} select node, round(v, 9) rank from x3")
def rooted_pagerank_k3(spark, d):
    return rounded(normalize.rooted_pagerank(graph(spark, d), 0.85, 3), "rank", digits=9)


AA = "st as (select node, sum(w) d from (select src node, w from w union all select dst, w from w) group by node), aa as (select a.src, b.dst, sum(a.w * (b.w / d)) w from w a join w b on a.dst = b.src join st on node = b.src group by all)"


@query(f"with {NAT}, {AA} select src, dst, round(w, 6) w from aa")
def adamic_adar(spark, d):
    return rounded(normalize.adamic_adar(nations(spark, d).edges), "w")


@query(f"with {NAT}, {AA} select src, dst, round(w, 6) w from aa order by aa.w desc, src, dst limit 50")
def adamic_adar_topk(spark, d):
    return rounded(normalize.adamic_adar(nations(spark, d).edges).orderBy(F.desc("w"), "src", "dst").limit(50), "w")


@query(f"""with {NAT}, p as (select src, dst, w / sum(w) over (partition by src) w from w), a as (select src, dst, 0.1 * w w from p),
b as (select a.src, p.dst, 0.1 * sum(a.w * p.w) w from a join p on a.dst = p.src group by all), c as (select b.src, p.dst, 0.1 * sum(b.w * p.w) w from b join p on b.dst = p.src group by all)
select src, dst, round(sum(w), 6) w from (select * from a union all select * from b union all select * from c) group by src, dst""")
def katz_k3(spark, d):
    return rounded(normalize.katz(normalize.row_normalised(nations(spark, d).edges), 0.1, 3), "w")


# Sketches


@query(f"{BASE}, {_sketch_sql('s', 'h', 0)} select node, slot::int slot, v as value from h0")
def sketch_init(spark, d):
    return sketch.long_form(sketch.embed(graph(spark, d, False), SketchParams(16, 0.2, 0)).vectors)


@query(f"{BASE}, {_sketch_sql('s', 'h', 1)} select node, slot::int slot, v as value from h1")
def sketch_hop1(spark, d):
    return sketch.long_form(sketch.embed(graph(spark, d, False), SketchParams(16, 0.2, 1)).vectors)


@query(f"{SK} select node, slot::int slot, v as value from h2")
def sketch_hop2(spark, d):
    return sketch.long_form(sketch.embed(graph(spark, d, False), P).vectors)


@query(f"{SK} select node, list(v order by slot) vec from h2 group by node")
def sketch_vectors(spark, d):
    return sketch.embed(graph(spark, d, False), P).vectors


def _near(spark, d) -> DataFrame:
    v = sketch.embed(graph(spark, d, False), P).vectors
    return sketch.nearest_of(v, v.filter("node % 50 = 0"), P.dim, KNN)


@query(f"""{SK}, v as (select l, min(node) c, count(*) n from (select node, list(v order by slot) l from h2 group by node) group by l), x as (select h2.*, n from h2 join v on c = node)
select a.node class_a, b.node class_b, a.n copies_a, b.n copies_b, count(*) / 16.0 similarity from x a join x b on a.slot = b.slot and a.v = b.v and a.node < b.node group by all having count(*) >= 15""")
def sketch_similar_classes(spark, d):
    return sketch.similar_classes(sketch.embed(graph(spark, d, False), P).vectors, P.dim, 15 / 16)


@query(f"{SK}, {NEAR} select node, neighbour, distance, k::int rank from nb")
def sketch_knn(spark, d):
    """Queries are the nodes whose id is divisible by 50, against all nodes."""
    return _near(spark, d)


D40 = SketchParams(40, 0.2, 2)


@query(f"{BASE}, {_sketch_sql('s', 'h', 2, dim=40)} select node, slot::int slot, v as value from h2")
def sketch_dim40(spark, d):
    """More slots than one pass takes."""
    return sketch.long_form(sketch.embed(graph(spark, d, False), D40).vectors)


@query()
def sketch_dim200_hop5(spark, d):
    """The size of embedding that the figures of large graphs are given for; (node, number of distinct items)."""
    v = sketch.embed(graph(spark, d, False), SketchParams(200, 0.2, 5)).vectors
    return v.select("node", F.size(F.array_distinct("vec")).alias("items"))


def _directed(spark, d):
    return sketch.embed_directed(graph(spark, d), P)


DSK = f"with {R}, {N}, {E}, t as (select dst src, src dst, w from e), {_sketch_sql('e', 'h', 2)}, {_sketch_sql('t', 'g', 2)}"


@query(f"{DSK} select node, slot::int slot, v as value from h2")
def dsketch_source(spark, d):
    return sketch.long_form(_directed(spark, d).vectors, "source")


@query(f"{DSK} select node, slot::int slot, v as value from g2")
def dsketch_target(spark, d):
    return sketch.long_form(_directed(spark, d).vectors, "target")


@query(f"""{DSK}, z as (select h2.node, h2.slot, h2.v s, g2.v t from h2 join g2 using (node, slot))
select src, dst, round((3 - (count(*) filter (a.s = b.s) + count(*) filter (a.t = b.t) + count(*) filter (a.s = b.t)) / 16.0) / 3, 6) distance
from e join z a on a.node = src join z b on b.node = dst and a.slot = b.slot group by src, dst""")
def dsketch_distance(spark, d):
    return rounded(_directed(spark, d).pair_distances(graph(spark, d).edges.select("src", "dst")), "distance")


# Labelled graphs


def _labelled(spark, d, directed=False):
    r = model.usable_rows(rows(spark, d))
    nodes = r.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = communities(spark, d).withColumnRenamed("community", "label")
    e = r.filter("src <> dst").select("src", "dst", "w", "label")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "label"))
    return e, nodes, labels


def _labelled_sql(edges: str, item: str, where: str, tag: str = "l") -> str:
    out = ["lab as materialized (select distinct unnest([src, dst]) node, graph nlabel from r)", f"{tag}e as materialized ({edges})"]
    items = "select distinct nlabel item from lab" if item == "nlabel" else f"select distinct {item} item from {tag}e le join lab on lab.node = le.dst where {where}"
    out.append(f"{tag}i as materialized (select item from ({items}) union select '0')")
    out.append(f"{tag}k as materialized ({_clocks(f'select item from {tag}i', 16, True)})")
    out.append(f"{tag}0 as materialized (select node, slot, '0' v from n, (select unnest(range(16)) slot))")
    for h in (1, 2):
        out.append(f"{tag}c{h} as materialized (select src, item, sum(w) w from (select le.src, {item} item, le.w from {tag}e le join lab on lab.node = le.dst where {where} union all select le.src, p.v, le.w * (0.2 / 16) * c from {tag}e le join (select node, v, count(*) c from {tag}{h - 1} group by node, v) p on p.node = le.dst) group by src, item)")
        out.append(f"{tag}{h} as materialized (select z.node, z.slot, coalesce(y.v, '0') v from {tag}0 z left join (select src, slot, arg_min(item, key / w) v from {tag}c{h} join {tag}k using (item) group by src, slot) y on y.src = z.node and y.slot = z.slot)")
    return ", ".join(out)


_BOTH = "select src, dst, w, label from r where src <> dst union all select dst, src, w, label from r where src <> dst"
_SIG = ", c as (select v item, count(*)::double w from {} group by v), k as (select slot, item, key / w key from (" + _clocks("select item from c", 32, True) + ") join c using (item)) select slot::int slot, arg_min(item, key) as label from k group by slot"
LN = f"with {R}, {N}, " + _labelled_sql(_BOTH, "nlabel", "true")
LNE = f"with {R}, {N}, " + _labelled_sql(_BOTH, "concat_ws('|', nlabel, label)", "label is not null")
LD = f"with {R}, {N}, " + _labelled_sql("select src, dst, w, label from r where src <> dst", "nlabel", "true")


@query(f"{LN} select node, slot::int slot, v as value from l2")
def labelled_sketch_n(spark, d):
    return sketch.long_form(labelled.embed_labelled(*_labelled(spark, d), P))


@query(f"{LNE} select node, slot::int slot, v as value from l2")
def labelled_sketch_ne(spark, d):
    return sketch.long_form(labelled.embed_labelled(*_labelled(spark, d), P, paired=True))


@query(f"{LD} select node, slot::int slot, v as value from l2")
def labelled_sketch_directed(spark, d):
    return sketch.long_form(labelled.embed_labelled(*_labelled(spark, d, True), P))


_IN = "select dst src, src dst, w, label from r where src <> dst"
_PAIR = ("concat_ws('|', nlabel, label)", "label is not null")


def _incoming(spark, d):
    e, nodes, labels = _labelled(spark, d, True)
    return model.transpose(e, "label"), nodes, labels


@query(f"with {R}, {N}, " + _labelled_sql(_IN, "nlabel", "true") + " select node, slot::int slot, v as value from l2")
def labelled_sketch_in(spark, d):
    return sketch.long_form(labelled.embed_labelled(*_incoming(spark, d), P))


@query(f"with {R}, {N}, " + _labelled_sql(_IN, *_PAIR) + " select node, slot::int slot, v as value from l2")
def labelled_sketch_in_paired(spark, d):
    return sketch.long_form(labelled.embed_labelled(*_incoming(spark, d), P, paired=True))


@query(f"with {R}, {N}, " + _labelled_sql("select src, dst, w, label from r where src <> dst", "nlabel", "true") + ", " + _labelled_sql(_IN, "nlabel", "true", "g").split("), ", 1)[1] + ", lg as (select v from l2 union all select v from g2)" + _SIG.format("lg"))
def graph_signature_directed(spark, d):
    """Labels of the sketches of out-edges and of in-edges together."""
    return labelled.graph_signature([labelled.embed_labelled(*_labelled(spark, d, True), P), labelled.embed_labelled(*_incoming(spark, d), P)], P.dim, 32)


@query(LN + _SIG.format("l2"))
def graph_signature_n(spark, d):
    return labelled.graph_signature([labelled.embed_labelled(*_labelled(spark, d), P)], P.dim, 32)


@query(LNE + _SIG.format("l2"))
def graph_signature_ne(spark, d):
    return labelled.graph_signature([labelled.embed_labelled(*_labelled(spark, d), P, paired=True)], P.dim, 32)


def _node_labels(spark, d, feed):
    return raw_lines.nodes(raw_lines.parse_lines(table(spark, d, "raw_line")), feed).select(F.col("num").alias("node"), "label")


@query(preparation._SQL + "select a::bigint node, case when b::int = 0 then 42 else b::int end as label, count(*) n from i where ok and feed = 'eu_node' group by all")
def label_relabel(spark, d):
    return labelled.relabel_zero(_node_labels(spark, d, "eu_node"), "42").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))


@query(preparation._SQL + ", p as (select a::bigint node, b::int b from i where ok and feed = 'ppi_node') select node, list(distinct l order by l) labels from (select node, case when b = 0 then (select max(b) + 1 from p) else b end l from p) group by node")
def multi_label_nodes(spark, d):
    return labelled.multi_labels(_node_labels(spark, d, "ppi_node"))


# Dense vectors


@query("""with x as (select vec_id, embedding::double[] v from embeddings), c as (select q.vec_id id, x.vec_id neighbour, list_cosine_similarity(q.v, x.v) c, list_inner_product(q.v, x.v) p from x q, x where q.vec_id % 50 = 0 and q.vec_id <> x.vec_id),
k as (select *, row_number() over (partition by id order by c desc, neighbour) rank from c) select id, neighbour, rank::int rank, round(1 - c, 6) cosine_distance, round(1 - p, 6) dot_distance from k where rank <= 5""")
def dense_knn(spark, d):
    x = table(spark, d, "embeddings")
    near = dense.nearest_to(x, x.filter("vec_id % 50 = 0"), "vec_id", "embedding", KNN)
    a, b = x.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")), x.select(F.col("vec_id").alias("neighbour"), F.col("embedding").alias("b"))
    j = near.join(a, "id").join(b, "neighbour")
    return j.select("id", "neighbour", "rank", F.round(gf.cosine_distance("a", "b"), 6).alias("cosine_distance"), F.round(gf.dot_distance("a", "b"), 6).alias("dot_distance"))


# Link prediction


def _split_sql(source: str, seed: int = 0) -> str:
    return f"""d as (select src, dst, w, {_u(f"'{seed}', src, dst")} u, {_u(f"'keep{seed}', src, dst")} h from {source}),
lo as (select node, min(h) least from (select src node, h from d union all select dst, h from d) group by node),
sp as (select src, dst, w, u < {SKIP} and h <> a.least and h <> b.least deleted from d join lo a on a.node = src join lo b on b.node = dst)"""


SYM = f"{BASE}, sh as (select * from s where src < dst), {_split_sql('sh')}"


def _split(spark, d, directed=False):
    g = graph(spark, d, directed)
    return g, lp.split_edges(g, SKIP)


@query(f"{SYM} select src, dst, round(w, 6) w, deleted from sp")
def edge_split_sym(spark, d):
    return rounded(_split(spark, d)[1], "w")


@query(f"with {R}, {E}, {_split_sql('e')} select src, dst, round(w, 6) w, deleted from sp")
def edge_split_asym(spark, d):
    return rounded(_split(spark, d, True)[1], "w")


@query(f"{SYM}, k as (select distinct unnest([src, dst]) node from sp where not deleted) select count(*) n from (select distinct unnest([src, dst]) node from sp) where node not in (select node from k)")
def split_no_isolated(spark, d):
    s = _split(spark, d)[1]
    ends = F.explode(F.array("src", "dst")).alias("node")
    return s.select(ends).distinct().join(s.filter("not deleted").select(ends).distinct(), "node", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def _trained(spark, d):
    g, s = _split(spark, d)
    s = runtime.materialize(s, "split")
    return g, s, sketch.embed(lp.train_graph(g, s), P)


def _sampled(spark, d):
    g, s, e = _trained(spark, d)
    n = g.nodes.count()
    return s, n, e, node_centric.draw(g.nodes, n)


TRAIN = f"{SYM}, ts as (select src, dst, w from sp where not deleted union all select dst, src, w from sp where not deleted), {_sketch_sql('ts', 'h', 2)}"
_DIST = "select round(1 - count(*) filter (a.v = b.v) / 16.0, 9) dist from {} p join h2 a on a.node = p.src join h2 b on b.node = p.dst and a.slot = b.slot group by p.src, p.dst{}"
_DRAW = f"floor({_u(chr(39) + 'ra0' + chr(39) + ', i')} * (select count(*) from n))::bigint ra, floor({_u(chr(39) + 'rb0' + chr(39) + ', i')} * (select count(*) from n))::bigint rb"


@query(f"""{TRAIN}, {RANK}, dr as (select i, {_DRAW} from (select unnest(range(20000)) i)), ne as (select i, a.node src, b.node dst from dr join rk a on a.rank = ra join rk b on b.rank = rb where a.node <> b.node and not exists (from s where s.src = a.node and s.dst = b.node)),
dd as ({_DIST.format("(select * from sp where deleted)", "")}), dn as ({_DIST.format("ne", ", p.i")}),
g as (select dist, sum(x)::double nd, sum(y)::double nn from (select dist, 1 x, 0 y from dd union all select dist, 0, 1 from dn) group by dist),
c as (select *, coalesce(sum(nn) over (order by dist rows between 1 following and unbounded following), 0) later from g)
select round(sum(nd * (later + nn / 2)) / (sum(nd) * sum(nn)), 9) auc, sum(nd)::bigint n_deleted, sum(nn)::bigint n_non from c""")
def auc_sampled(spark, d):
    g, s, e = _trained(spark, d)
    ranks = runtime.materialize(model.index_nodes(rows(spark, d), "edge_id"), "ranks")
    return rounded(lp.auc(s.filter("deleted"), lp.sample_non_edges(g, 20_000, ranks, ranks.count()), e), "auc", digits=9)


@query(f"""{TRAIN}, {PAIRS}, b as (select * from pr where not exists (from sp where not deleted and src = node_a and dst = node_b) order by similarity desc, node_a, node_b limit 50),
h as (select count(*) found, count(*) filter (exists (from sp where deleted and src = node_a and dst = node_b)) hits from b), x as (select count(*) n from sp where deleted)
select found, hits, round(hits / greatest(found, 1), 9) as "precision", round(hits / greatest(least(n, found), 1), 9) recall from h, x""")
def precision_at_50(spark, d):
    _, s, e = _trained(spark, d)
    return rounded(lp.precision(sketch.top_pairs(e.vectors, P.dim, 50, s.filter("not deleted")), s, 50), "precision", "recall", digits=9)


_NEAR2K = f"""sm as (select node from n where {_u("'0', node")} < least(1.0, 2000.0 / (select count(*) from n))), q as (select a.node, b.node neighbour, round(1 - count(*) / 16.0, 9) dist from h2 a join h2 b on a.slot = b.slot and a.v = b.v and a.node <> b.node where a.node in (select node from sm) group by all),
tr as (select src node, dst nb from sp where not deleted union select dst, src from sp where not deleted), go as (select src node, dst nb from sp where deleted union select dst, src from sp where deleted), ak as (select node, count(*) nd from go where node in (select node from sm) group by node),
fr as (select q.*, exists (from go where go.node = q.node and nb = neighbour) gone from q join ak using (node) where not exists (from tr where tr.node = q.node and nb = neighbour))"""


@query(f"""{TRAIN}, {_NEAR2K}, p as (select *, row_number() over (partition by node order by dist, neighbour) k from fr), f as (select node, count(*) found from p where k <= 10 and gone group by node)
select ak.node, coalesce(found, 0) found, round(coalesce(found, 0) / least(nd, 10), 9) as "precision" from ak left join f using (node)""")
def vcmpr_at_10(spark, d):
    s, _, e, sample = _sampled(spark, d)
    return rounded(node_centric.vcmpr(e, s, sample, 10), "precision", digits=9)


_CENTRIC = f"""{_NEAR2K}, dt as (select node, count(*) degree from tr group by node), pd as (select node, dist, count(*) filter (not gone) others, count(*) filter (gone) hits from fr group by all), kn as (select node, sum(others) known, sum(hits) kh from pd group by node),
rn as (select *, sum(others) over (partition by node order by dist) - others / 2 nearer from pd), bs as (select ak.node, nd, coalesce(degree, 0) degree, (select count(*) from n) - 1 - coalesce(degree, 0) - nd total, coalesce(known, 0) known, nd - coalesce(kh, 0) missing from ak left join dt using (node) left join kn using (node)),
sc as (select node, degree, hits, 1 - nearer / total score from rn join bs using (node) where hits > 0 union all select node, degree, missing, 1 - (known + (total - known) / 2) / total from bs where missing > 0), ca as (select node, degree::bigint degree, sum(score * hits) / sum(hits) auc from sc group by all)"""


@query(f"{TRAIN}, {_CENTRIC} select node, degree, round(auc, 9) auc from ca")
def centric_auc(spark, d):
    s, n, e, sample = _sampled(spark, d)
    return rounded(node_centric.centric_auc(e, s, n, sample), "auc", digits=9)


@query(f"{TRAIN}, {_CENTRIC} select round(corr(degree, auc), 6) corr, count(*) n from ca")
def centric_auc_corr(spark, d):
    s, n, e, sample = _sampled(spark, d)
    return node_centric.centric_auc(e, s, n, sample).agg(F.round(F.corr("degree", "auc"), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


@query(f"with {R}, {N} select node from n where {_u(chr(39) + '0' + chr(39) + ', node')} < 0.1")
def sample_uniform(spark, d):
    return degrees.sample_uniform(graph(spark, d).nodes, 0.1)


@query(f"with {R}, {N}, {E}, {DEG} select node, d_in + d_out degree from dg where d_in + d_out > 0 order by -ln({_u(chr(39) + '0' + chr(39) + ', node')}) / (d_in + d_out), node limit 100")
def sample_by_degree(spark, d):
    return degrees.sample_by_degree(graph(spark, d), 100)


# Decomposition


def _fw_sql(steps: int) -> str:
    out = ["f0 as (select least(src, dst) src, greatest(src, dst) dst, sum(w) w, sum(w) / 2 a, sum(w) / 2 b from e group by 1, 2)"]
    for t in range(1, steps + 1):
        g = f"({2.0 / (2.0 + t)!r})"
        k = f"({1 - 2.0 / (2.0 + t)!r})"
        out.append(f"q{t} as (select node, round(sum(v), 9) load from (select src node, a v from f{t - 1} union all select dst, b from f{t - 1}) group by node)")
        out.append(f"f{t} as (select src, dst, w, {k} * a + {g} * case when x.load < y.load then w when x.load > y.load then 0 else a end a, {k} * b + {g} * case when y.load < x.load then w when y.load > x.load then 0 else b end b from f{t - 1} join q{t} x on x.node = src join q{t} y on y.node = dst)")
    return ", ".join(out)


def _fw(spark, d, steps):
    return density.balance(density.half_edges(graph(spark, d)), steps)


def _fw_query(steps: int):
    def run(spark, d):
        return rounded(_fw(spark, d, steps), "w", "a", "b")

    run.__name__ = f"fw_step{steps}" if steps else "fw_init"
    return query(f"with {R}, {E}, {_fw_sql(steps)} select src, dst, round(w, 6) w, round(a, 6) a, round(b, 6) b from f{steps}")(run)


fw_init, fw_step1, fw_step3 = map(_fw_query, (0, 1, 3))


@query(f"with {R}, {E}, {_fw_sql(3)}, y as (select node, sum(w) y from (select src node, 0.0 w from f3 union all select dst, 0.0 from f3 union all select case when a > b then src else dst end, w from f3) group by node) select node, round(y, 6) y from y")
def tentative_density(spark, d):
    return rounded(density.tentative_density(_fw(spark, d, 3)), "y")


def _isotonic_sql(steps: int) -> str:
    """CTEs ib (block, lo, hi, n, y) by the min-max form of the regression, and nk (node, block, load)."""
    return f"""{_fw_sql(steps).replace(" as (", " as materialized (")}, ld as materialized (select node, sum(v) load from (select src node, a v from f{steps} union all select dst, b from f{steps}) group by node),
dy as materialized (select node, sum(w) y from (select src node, 0.0 w from f{steps} union all select dst, 0.0 from f{steps} union all select case when a > b then src else dst end, w from f{steps}) group by node),
p0 as (select node, load, y, coalesce(lag(load) over (order by load desc, node) - load > 1e-6, true) fresh from ld join dy using (node)), p1 as materialized (select node, load, y, sum(fresh::int) over (order by load desc, node) k from p0),
p2 as materialized (select k, min(load) lo, max(load) hi, count(*) n, sum(y) y from p1 group by k), p3 as materialized (select k, sum(n) over (order by k) sn, sum(y) over (order by k) sy from p2),
av as (select a.k a, b.k b, (b.sy - coalesce(c.sy, 0)) / (b.sn - coalesce(c.sn, 0)) m from p2 a join p3 b on b.k >= a.k left join p3 c on c.k = a.k - 1), mx as (select a, b, max(m) over (partition by a order by b desc) m from av),
ft as materialized (select b k, round(min(m), 9) f from mx group by b), ib as materialized (select (row_number() over (order by f desc) - 1)::int block, min(lo) lo, max(hi) hi, sum(n)::bigint n, sum(y) / sum(n) y, min(k) k0, max(k) k1 from p2 join ft using (k) group by f),
nk as materialized (select node, load, block from p1 join ib on k between k0 and k1)"""


@query(f"with {R}, {E}, {_isotonic_sql(10)} select block, round(lo, 5) lo, round(hi, 5) hi, n, round(y, 5) y from ib")
def isotonic_blocks(spark, d):
    a = _fw(spark, d, 10)
    b = density.blocks_of_density(runtime.materialize(density.loads(a).join(density.tentative_density(a), "node"), "density"))
    # To 11 digits first: a value halfway between two of 5 digits must not fall to either side by its last bits.
    return rounded(rounded(b, "lo", "hi", "y", digits=11), "lo", "hi", "y", digits=5)


@query(f"""with {R}, {E}, {_isotonic_sql(10)}, ce as materialized (select case when x.block < y.block then src else dst end n1, case when x.block < y.block then dst else src end n2, least(x.block, y.block) i, greatest(x.block, y.block) j, case when x.block < y.block then a else b end mv from f10 join nk x on x.node = src join nk y on y.node = dst where x.block <> y.block),
mo as (select k, n1 node, -sum(mv) mv from ce, unnest(range(i, j)) t(k) group by k, n1 union all select k, n2, sum(mv) from ce, unnest(range(i, j)) t(k) group by k, n2), kk as (select block k from ib),
rl as (select kk.k, nk.block <= kk.k inside, load + coalesce(mv, 0) load from kk cross join nk left join mo on mo.k = kk.k and mo.node = nk.node), sb as (select k, coalesce(min(load) filter (inside) > coalesce(max(load) filter (not inside), '-infinity'::double), false) stable from rl group by k),
sn as (select a.k block, (select count(*) from sb b where b.k < a.k and b.stable)::int stable_block from sb a) select node, stable_block as block from nk join sn using (block)""")
def stable_blocks(spark, d):
    return density.decompose(graph(spark, d), 10)[0]


@query(f"with {R}, {N}, {E}, {MB} select block, count(*) size from mb group by block")
def block_sizes(spark, d):
    return density.block_sizes(blocks(spark, d))


@query(f"{BASE}, {MB} select block, count(src) degree from mb left join s on src = node group by block")
def block_degree(spark, d):
    return density.block_degrees(graph(spark, d, False).edges, blocks(spark, d))


@query(f"""{BASE}, {MB}, k as (select block, node, count(src) degree from mb left join s on src = node group by all), o as (select *, row_number() over (partition by block order by degree) - 1 r, count(*) over (partition by block) c from k), q as (select unnest([0.25, 0.5, 0.75])::double q)
select block, q, degree from o, q where r = floor(q * (c - 1))""")
def block_degree_quantiles(spark, d):
    return density.block_degree_quantiles(graph(spark, d, False).edges, blocks(spark, d))


def _t_sql(edges: str, tag: str) -> str:
    return f"{tag} as (select a.block i, b.block j, count(*) n, count(*) / sum(count(*)) over (partition by a.block) p from {edges} join mb a on a.node = src join mb b on b.node = dst group by a.block, b.block)"


@query(f"with {R}, {N}, {E}, {MB}, {_t_sql('e', 't')} select i, j, n, round(p, 9) p from t")
def block_transition(spark, d):
    return rounded(density.transitions(graph(spark, d).edges, blocks(spark, d)), "p", digits=9)


@query(f"with {R}, {N}, {E}, {MB}, {_t_sql('e', 't')} select i block, round(sum(case when j > i then p else 0 end), 9) fraction from t group by i")
def block_fraction_out(spark, d):
    return rounded(density.fraction_out(density.transitions(graph(spark, d).edges, blocks(spark, d))), "fraction", digits=9)


@query(f"with {R}, {N}, {E}, {MB}, z as (select dst src, src dst from e), {_t_sql('e', 't')}, {_t_sql('z', 'u')} select t.i block, round(sum(case when coalesce(u.p, 0) > 0 then t.p * ln(t.p / u.p) else 'infinity'::double end), 9) kl from t left join u on t.i = u.i and t.j = u.j group by t.i")
def transition_kl(spark, d):
    e, m = graph(spark, d).edges, blocks(spark, d)
    return rounded(density.transition_kl(density.transitions(e, m), density.transitions(model.transpose(e), m)), "kl", digits=9)


INDEX = """pc as materialized (select a.node, b.node neighbour, count(*) c from h2 a join h2 b on a.slot = b.slot and a.v = b.v and a.node <> b.node group by a.node, b.node),
lw as materialized (select node from n order by node limit 300), pl as (select a.node, b.node neighbour, count(*) filter (a.v = b.v) c from h2 a join h2 b on a.slot = b.slot and a.node <> b.node where b.node in (from lw) group by a.node, b.node),
ix as materialized (select * from (select node, neighbour, 1 - c / 16.0 distance, row_number() over (partition by node order by c desc, neighbour) k from (select * from pc union select * from pl)) where k <= 8),
gd as (select src node, count(*) degree from s group by src), nb as materialized (select node, neighbour, distance from ix join gd using (node) where k <= degree)"""
CHECK = f"""{SK}, {MB}, {INDEX}, {_t_sql('(select node src, neighbour dst from nb)', 't')}, {_t_sql('s', 'u')},
st as (select a.block, count(*) n, avg(distance) mean, avg(case when b.block <= a.block then distance end) mean_in, avg(case when b.block > a.block then distance end) mean_out, min(case when a.block = b.block and distance > 0 then distance end) min_in_block from nb join mb a on a.node = nb.node join mb b on b.node = neighbour group by a.block),
kl as (select t.i block, sum(case when coalesce(u.p, 0) > 0 then t.p * ln(t.p / u.p) else 'infinity'::double end) kl, sum(case when t.j > t.i then t.p else 0 end) fraction_out from t left join u on t.i = u.i and t.j = u.j group by t.i),
bd as (select block, count(src) degree from mb left join s on src = node group by block), ck as (select * from st join kl using (block) join bd using (block))"""


def _check(spark, d):
    """Blocks are given, so only neighbours and figures are computed."""
    g = graph(spark, d, False)
    return density_analysis.analyse(g, sketch.embed(g, P), runtime.materialize(blocks(spark, d), "blocks"), k=8)


@query(f"{SK}, {INDEX} select node, neighbour, distance, k::int rank from ix")
def neighbour_index(spark, d):
    return density_analysis.neighbour_index(sketch.embed(graph(spark, d, False), P), 8)


@query(f"{CHECK} select block, n, round(mean, 9) mean, round(mean_in, 9) mean_in, round(mean_out, 9) mean_out, min_in_block, round(fraction_out, 9) fraction_out, round(kl, 9) kl, degree from ck")
def block_in_out_stats(spark, d):
    return rounded(_check(spark, d).check, "mean", "mean_in", "mean_out", "fraction_out", "kl", digits=9)


@query(f"{CHECK}, v as (select quantile_cont(mean_in / mean_out, {list(density.BLOCK_QUANTILES)}) v from ck where mean_out > 0 and mean_in is not null) select unnest({list(density.BLOCK_QUANTILES)})::double q, round(unnest(v), 9) ratio from v")
def block_ratio_quantiles(spark, d):
    return rounded(density.ratio_quantiles(_check(spark, d).check), "ratio", digits=9)


@query(f"{CHECK} select round(sum(degree * mean_in / mean_out) / sum(degree), 9) ratio from ck where block < (select max(block) from ck) and mean_out > 0 and mean_in is not null")
def block_ratio_weighted(spark, d):
    return rounded(density_analysis.weighted_ratio(_check(spark, d).check), "ratio", digits=9)


@query(f"{CHECK}, v as (select quantile_cont(kl, {list(density.BLOCK_QUANTILES)}) v from ck) select unnest({list(density.BLOCK_QUANTILES)})::double q, round(unnest(v), 9) kl from v")
def block_kl_quantiles(spark, d):
    return rounded(density_analysis.kl_quantiles(_check(spark, d).check), "kl", digits=9)


@query("select 0::bigint n")
def density_analysis_stored(spark, d):
    """Decomposition, embedding, index and check are computed, stored and loaded; the check of what was loaded is the same."""
    g, at = graph(spark, d, False), runtime.scratch(spark, "analysis")
    e = sketch.embed(g, P)
    done = density_analysis.analyse(g, e, steps=10, k=8)
    store.dump_embedding(e, store.Output(f"{at}/embedding"))
    for name, t in (("blocks", done.member), ("index", done.index), ("check", done.check)):
        store.dump_table(t, store.Output(f"{at}/{name}"))
    again = density_analysis.analyse(g, store.load_embedding(spark, f"{at}/embedding"), store.load_table(spark, f"{at}/blocks"), store.load_table(spark, f"{at}/index"))
    cols = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in done.check.dtypes]
    return store.differences(store.load_table(spark, f"{at}/check").select(*cols), again.check.select(*cols)).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {R}, {N}, {E}, {MB} select block, (sum(count(*)) over (order by block) - count(*))::bigint as start, count(*) size from mb group by block")
def block_starts(spark, d):
    return density_analysis.block_starts(blocks(spark, d))


@query(f"with {R}, {N}, {E}, {MB} select count(distinct block) blocks, count(*) nodes, round(count(*) / count(distinct block), 9) mean_size from mb")
def decomposition_summary(spark, d):
    return rounded(density_analysis.summary(blocks(spark, d)), "mean_size", digits=9)


@query(f"with {R}, {N}, {E}, {CO}, {MB}, z as (select block, count(*) size from mb group by block) select community, block, count(*) n, round(count(*) * 200 / any_value(size), 9) as share from co join mb using (node) join z using (block) group by community, block")
def community_blocks(spark, d):
    return rounded(density_analysis.community_blocks(communities(spark, d), blocks(spark, d)), "share", digits=9)


@query(f"with {R}, {N}, {E}, {CO}, {MB} select community, min(block) as first, max(block) as last from co join mb using (node) group by community")
def community_block_range(spark, d):
    return density_analysis.community_block_range(communities(spark, d), blocks(spark, d))


_CQ = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]


@query(f"""{SK}, co as (select distinct unnest([src, dst]) node, label community from r where label is not null), ds as (select e.src, e.dst, 1 - count(*) filter (a.v = b.v) / 16.0 distance from e join h2 a on a.node = e.src join h2 b on b.node = e.dst and a.slot = b.slot group by all),
cl as (select c.community, avg(case when o.node is not null then distance end) / nullif(avg(case when o.node is null then distance end), 0) ratio from ds join co c on c.node = ds.src left join co o on o.node = ds.dst and o.community = c.community group by c.community),
cr as (select ratio, size from cl join (select community, count(*) size from co group by community) using (community) where ratio is not null),
v as (select quantile_cont(ratio, {_CQ}) v from cr), f as (select 'mean' figure, avg(ratio) x from cr union all select 'weighted_mean', sum(ratio * size) / sum(size) from cr union all select 'not_below_one', count(*) filter (ratio >= 1) from cr union all select 'communities', count(*) from cr union all select 'q' || unnest({_CQ})::double, unnest(v) from v)
select figure, round(x::double, 9) as value from f""")
def community_evaluation(spark, d):
    """Communities are the nodes at edges of a label; nodes of different graphs have no edges."""
    e = graph(spark, d).edges.select("src", "dst")
    dist = sketch.embed(graph(spark, d, False), P).pair_distances(e)
    labels = model.usable_rows(rows(spark, d)).filter("label is not null").select(F.explode(F.array("src", "dst")).alias("node"), F.col("label").alias("community"))
    co = runtime.materialize(labels.distinct(), "communities")
    return rounded(density_analysis.community_evaluation(density.community_in_out(e, dist, co), co), "value", digits=9)


@query(f"""{SK}, {CO}, ds as (select e.src, e.dst, 1 - count(*) filter (a.v = b.v) / 16.0 distance from e join h2 a on a.node = e.src join h2 b on b.node = e.dst and a.slot = b.slot group by all)
select c.community, round(avg(case when o.node is not null then distance end), 9) mean_in, round(avg(case when o.node is null then distance end), 9) mean_out from ds join co c on c.node = ds.src left join co o on o.node = ds.dst and o.community = c.community group by c.community""")
def community_in_out(spark, d):
    e = graph(spark, d).edges.select("src", "dst")
    dist = sketch.embed(graph(spark, d, False), P).pair_distances(e)
    return rounded(density.community_in_out(e, dist, communities(spark, d)), "mean_in", "mean_out", digits=9)


# Cores


def _subset(spark, d):
    return communities(spark, d).filter("community = 'follow_a'").select("node")


def _p_query(name: str, f, sql: str):
    def run(spark, d):
        return rounded(f(graph(spark, d).edges, runtime.materialize(_subset(spark, d), "subset")), "p")

    run.__name__ = name
    return query(f"with {R}, {E}, {CO}, sb as (select node from co where community = 'follow_a') select node, round(coalesce(p, 0), 6)::double p from sb left join ({sql}) x on x.k = node")(run)


_p_query("pfun_in", cores.p_in, "select dst k, count(*) p from e where src in (select node from sb) group by dst")
_p_query("pfun_out", cores.p_out, "select src k, count(*) p from e where dst in (select node from sb) group by src")
_ENDS = "select k, {} p from (select src k, w from e where dst in (select node from sb) union all select dst, w from e where src in (select node from sb)) group by k"
_p_query("pfun_degree", cores.p_degree, _ENDS.format("count(*)"))
_p_query("pfun_weight", cores.p_weight, _ENDS.format("sum(w)"))

_PEEL = "".join(f", k{t} as (select node from (select src node from e where src in (from k{t - 1}) and dst in (from k{t - 1}) union all select dst from e where src in (from k{t - 1}) and dst in (from k{t - 1})) group by node having count(*) >= 5)" for t in range(1, 31))


@query(f"with {R}, {N}, {E}, k0 as (select node from n){_PEEL} select node from k30")
def kcore_peel(spark, d):
    g = graph(spark, d)
    return cores.p_core(runtime.materialize(g.edges, "edges"), g.nodes, 5)


# Spectral


@query(f"with {NAT}, {AA} select src, dst, round(w, 3) w from aa")
def hope_ada_dot(spark, d):
    g = nations(spark, d)
    e, _ = spectral.hope(g, HopeParams("ADA", rank=25, nbiter=3))
    v = runtime.materialize(e.vectors, "hope")
    all_pairs = normalize.adamic_adar(g.edges).select("src", "dst")
    a, b = v.select(F.col("node").alias("src"), "source"), v.select(F.col("node").alias("dst"), "target")
    return all_pairs.join(a, "src").join(b, "dst").select("src", "dst", F.round(gf.dot("source", "target"), 3).alias("w"))


def _spectrum(spark, sigma):
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "k int, sigma double")


@query()
def hope_sparse_spectrum(spark, d):
    """Singular values of the weighted adjacency of the whole edge list: products only, no dense matrix of nodes."""
    g = graph(spark, d)
    return _spectrum(spark, spectral.randomised_svd(g.edges, g.nodes, 6, nbiter=2, extra=4)[0])


def _hope_query(method: str):
    p = HopeParams(method, rank=8, nbiter=2, alpha=0.5, beta=0.001)

    def run(spark, d):
        e, sigma = spectral.hope(graph(spark, d), p)
        v = runtime.materialize(e.vectors, "hope")
        g = spectral.gram(v.select(F.col("source").alias("v")), len(sigma)), spectral.gram(v.select(F.col("target").alias("v")), len(sigma))
        far = [float(abs(m - np.diag(sigma)).max() / max(sigma.max(), 1e-300)) for m in g]
        return spark.createDataFrame([(len(sigma), bool((np.diff(sigma) <= 1e-9 * sigma.max()).all()), max(far) < 1e-6)], "rank int, decreasing boolean, orthogonal boolean")

    run.__name__ = f"hope_{method.lower()}_edges"
    run.__doc__ = f"""{method} embedding of the whole edge list by products; its vectors are orthogonal with the singular values as squared lengths."""
    return query("select 8::int as rank, true as decreasing, true as orthogonal")(run)


hope_ada_edges, hope_rpr_edges, hope_katz_edges = map(_hope_query, ("ADA", "RPR", "KATZ"))

_KZ = "t1 as materialized (select src, dst, 0.1 * w / sum(w) over (partition by src) w from w)" + "".join(f", t{k} as materialized (select a.src, b.dst, sum(a.w * b.w) w from t{k - 1} a join t1 b on a.dst = b.src group by all)" for k in range(2, 13))


@query(f"with {NAT}, {_KZ}, z as (" + " union all ".join(f"select * from t{k}" for k in range(1, 13)) + ") select src, dst, round(sum(w), 6) w from z group by src, dst")
def hope_katz_gsvd(spark, d):
    """The Katz index from the generalized SVD of the graph of nations, against its series."""
    g = nations(spark, d)
    g = Graph(normalize.row_normalised(g.edges), g.nodes, True)
    e, _ = spectral.hope_by_gsvd(g, HopeParams("KATZ", rank=25, beta=0.1))
    v = runtime.materialize(e.vectors, "hope")
    a, b = v.select(F.col("node").alias("src"), "source"), v.select(F.col("node").alias("dst"), "target")
    pairs = g.edges.select("src", "dst")
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", F.round(gf.dot("source", "target"), 6).alias("w"))


# Text files: a table is written as text, read again and loaded


def _as_text(spark, d, cols: str, sep: str, where: str = "true") -> str:
    path = runtime.scratch(spark, "text")
    model.usable_rows(rows(spark, d)).filter(where).selectExpr(f"concat_ws('{sep}', {cols}) value").write.text(path)
    return path


@query(f"with {R}, {E} select src, dst, round(w, 6) w from e")
def text_edges(spark, d):
    """Three fields, weighted."""
    return rounded(edge_files.load_graph(spark, _as_text(spark, d, "src, dst, w", ","), True).edges, "w")


@query(f"with {R}, u as (select src, dst, count(*)::double w from r where src <> dst group by all) select src, dst, sum(w) w from (select src, dst, w from u union all select dst, src, w from u) group by src, dst")
def text_edges_unweighted(spark, d):
    """Two fields, each line of weight 1, undirected."""
    return edge_files.load_graph(spark, _as_text(spark, d, "src, dst", "\t"), False).edges


@query(f"with {R} select distinct least(src, dst) src, greatest(src, dst) dst, 1.0::double w, null::varchar as label from r")
def text_labelled_network(spark, d):
    return edge_files.read_labelled_network(spark, _as_text(spark, d, "src, dst", " "), False)


@query(preparation._SQL + "select a::bigint node, b::bigint as label, count(*) n from i where ok and feed = 'eu_node' group by all")
def text_labels(spark, d):
    path = runtime.scratch(spark, "text")
    _node_labels(spark, d, "eu_node").selectExpr("concat_ws(' ', node, label) value").write.text(path)
    return edge_files.read_labels(spark, path).groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))


# Round trips


@query("select 0::bigint n")
def embedding_roundtrip(spark, d):
    at = runtime.scratch(spark, "embedding")
    e = sketch.embed(graph(spark, d, False), P)
    store.dump_embedding(e, store.Output(at))
    return store.differences(e.vectors, store.load_embedding(spark, at, "array<bigint>").vectors).agg(F.count(F.lit(1)).alias("n"))


@query("select 0::bigint n")
def decomposition_roundtrip(spark, d):
    at = runtime.scratch(spark, "blocks")
    b = runtime.materialize(blocks(spark, d), "blocks")
    store.dump_table(b, store.Output(at, "json"))
    return store.differences(b, store.load_table(spark, at)).agg(F.count(F.lit(1)).alias("n"))
