"""Queries of the general data-preparation problems: failing rows and skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import skewed_keys
from graphweft.runtime import table
from graphweft.sources import raw_lines


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines.rejects(raw_lines.parse_lines(table(spark, d, "raw_line"))).select("line_id")


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines.parse_lines(table(spark, d, "raw_line")).filter("ok").drop("ok", "reason")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines.rejects(raw_lines.parse_lines(table(spark, d, "raw_line")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.heavy_nodes(table(spark, d, "edge_list"))


def p3_degrees(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.degree_profile(table(spark, d, "edge_list"))


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    """Exact weight percentiles per graph, half of whose rows are one graph's."""
    e = table(spark, d, "edge_list").filter("w > 0 and not isnan(w)").select("graph", "w")
    return skewed_keys.percentiles(skewed_keys.weigh(e, ["graph"], "w"), ["graph"], [0.5, 0.9, 0.99]).select("graph", F.col("q"), F.col("value").alias("w"))


_NUM = '([0-9]+|"[0-9]+")'
_W = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_E = rf'{_NUM},{_NUM},([^",]*|"(?:[^"]|"")*"),(|""|{_W}|"{_W}")'


def _fits(x: str, most: int) -> str:
    return f"(length(ltrim({x}, '0')) <= 10 and coalesce(try_cast(nullif(ltrim({x}, '0'), '') as bigint), 0) <= {most})"


_SQL = f"""
with t as (select line_id, feed, case when raw like '%' || chr(13) then left(raw, length(raw) - 1) else raw end l from raw_line),
f as (select *, case feed when 'eu_node' then '{_NUM} {_NUM}' when 'ppi_node' then '{_NUM}' || chr(9) || '{_NUM}' else '{_E}' end rx from t
      where l is null or not (regexp_full_match(l, '[ ' || chr(9) || ']*') or l like '#%' or l like '%' || chr(37) and false or left(l, 1) = chr(37))),
g as (select line_id, feed, l, case when feed in ('eu_node', 'ppi_node', 'eweight') then coalesce(regexp_full_match(l, rx, 's'), false) else false end shape,
      replace(regexp_extract(l, '^(?:' || rx || ')$', 1, 's'), '"', '') a, replace(regexp_extract(l, '^(?:' || rx || ')$', 2, 's'), '"', '') b,
      case when feed = 'eweight' then regexp_extract(l, '^(?:' || rx || ')$', 3, 's') end c,
      case when feed = 'eweight' then replace(regexp_extract(l, '^(?:' || rx || ')$', 4, 's'), '"', '') end w from f),
h as (select *, case when w = '' then 1.0::float else try_cast(ltrim(w, '+') as float) end wf from g),
i as (select *, shape and {_fits("a", 4294967295)} and case when feed = 'eweight' then {_fits("b", 4294967295)} and coalesce(wf > 0 and isfinite(wf), false) else {_fits("b", 255)} end ok from h)
"""
QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p1_reasons": p1_reasons, "p3_found": p3_found, "p3_degrees": p3_degrees, "p3_weights": p3_weights}
SQL = {
    "p1_found": _SQL + "select line_id from i where ok is not true",
    "p1_valid": _SQL
    + """select line_id, feed, case when feed <> 'eweight' then a::bigint end num, case when feed <> 'eweight' then b::int end node_label,
    case when feed = 'eweight' then a::bigint end src, case when feed = 'eweight' then b::bigint end dst,
    case when feed = 'eweight' then case when left(c, 1) = '"' then replace(c[2:-2], '""', '"') else c end end edge_label,
    case when feed = 'eweight' then wf end weight from i where ok""",
    "p3_found": """with e as (select src, dst from edge_list where src <> dst), n as (select count(*) * 0.01 least from edge_list)
    select 'd_out' side, src node from e, n group by src, least having count(*) >= least union all select 'd_in', dst from e, n group by dst, least having count(*) >= least""",
    "p3_degrees": """with e as (select src, dst, count(*) c from edge_list where src <> dst group by all),
    o as (select src node, sum(c)::bigint d_out, count(*) n_out, arg_min(dst, {'a': -c, 'b': dst}) top_out from e group by src),
    i as (select dst node, sum(c)::bigint d_in, count(*) n_in, arg_min(src, {'a': -c, 'b': src}) top_in from e group by dst)
    select node, coalesce(d_in, 0) d_in, coalesce(d_out, 0) d_out, coalesce(n_in, 0) n_in, coalesce(n_out, 0) n_out, top_in, top_out from o full join i using (node)""",
    "p3_weights": """with e as (select graph, w, row_number() over (partition by graph order by w) - 1 r, count(*) over (partition by graph) n from edge_list where w > 0 and not isnan(w)),
    q as (select unnest([0.5, 0.9, 0.99])::double q) select graph, q, w from e, q where r = floor(q * (n - 1))""",
}
