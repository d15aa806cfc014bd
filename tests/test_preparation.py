import pytest

from graphweft.operators import skewed_keys
from graphweft.sources import raw_lines

GOOD = [("eu_node", "1 2"), ("eu_node", '"007" "0255"\r'), ("eu_node", "4294967295 0"), ("ppi_node", '5\t"9"'), ("eweight", '1,2,,'), ("eweight", '1,2,"a,""b""",.5'), ("eweight", "1,2,x y,+5.e-1"), ("eweight", '1,2,"","1"'), ("eweight", '1,2,"""",1e38')]
BAD = [("eu_node", None), ("eu_node", "1  2"), ("eu_node", "1 2 "), ("eu_node", "1\t2"), ("eu_node", '"1 2'), ("eu_node", '1"" 2'), ("eu_node", "4294967296 1"), ("eu_node", "1 256"), ("eu_node", "٣ 1"), ("eu_node", " 1 2"), ("ppi_node", "1 2"), ("eweight", "1,2,x"), ("eweight", "1,2,x,0"), ("eweight", "1,2,x,-1"), ("eweight", "1,2,x,nan"), ("eweight", "1,2,x,1e39"), ("eweight", "1,2,x,1e-60"), ("eweight", "1,2,x,1 "), ("eweight", '1,2,"a"b,1'), ("eweight", '1,2,a"b,1'), ("eweight", "1,2,x,."), ("eweight", ",2,x,1"), ("eweight", "-1,2,x,1"), ("odd", "1 2"), (None, "1 2")]
NONE = [("eu_node", ""), ("eu_node", " \t "), ("ppi_node", "#1\t2"), ("eweight", "%"), ("eweight", "\r"), (None, "# x")]


def rows(spark, lines):
    df = spark.createDataFrame([(i, f, r, "x", 0) for i, (f, r) in enumerate(lines)], "line_id long, feed string, raw string, reason string, ok int")
    return raw_lines.parse_lines(df).collect()


def test_lines(spark):
    out = {r.line_id: r for r in rows(spark, GOOD + BAD + NONE)}
    assert sorted(out) == list(range(len(GOOD) + len(BAD)))
    assert [out[i].ok for i in sorted(out)] == [True] * len(GOOD) + [False] * len(BAD)
    assert all((r.reason is None) == r.ok for r in out.values())
    assert (out[1].num, out[1].node_label) == (7, 255)
    assert out[5].edge_label == 'a,"b"' and out[5].weight == 0.5
    assert out[4].edge_label == "" and out[4].weight == 1.0 and out[7].edge_label == "" and out[8].edge_label == '"'


def test_lines_empty_and_long(spark):
    assert rows(spark, []) == []
    assert [r.ok for r in rows(spark, [("eweight", "1,2," + "y" * 300000 + ",1"), ("eu_node", "0" * 100000 + "1 1")])] == [True, True]


def test_profile_and_percentiles(spark):
    data = [(1, float(i % 7)) for i in range(1000)] + [(2, None), (2, 3.0), (None, 1.0), (3, float("nan"))]
    df = spark.createDataFrame(data, "k int, v double")
    w = skewed_keys.weigh(df, ["k"], "v")
    p = {r.k: r for r in skewed_keys.profile(w, ["k"]).collect()}
    assert (p[1].rows, p[1].n_distinct, p[1].mode, p[1].mode_rows) == (1000, 7, 0.0, 143)
    assert (p[2].rows, p[2].n_distinct, p[2].mode) == (2, 1, 3.0) and None not in p
    vals = sorted(v for k, v in data if k == 1)
    got = {(r.k, r.q): r.value for r in skewed_keys.percentiles(w, ["k"], [0.0, 0.3, 0.5, 0.99, 1.0], limit=1).collect()}
    assert {q: got[1, q] for q in (0.0, 0.3, 0.5, 0.99, 1.0)} == {q: vals[int(q * 999)] for q in (0.0, 0.3, 0.5, 0.99, 1.0)}
    assert got[2, 0.5] == 3.0 and (3, 0.5) not in got


@pytest.mark.parametrize("limit", [1, 40, 100_000])
def test_percentiles_of_narrow_and_wide_values(spark, limit):
    near = [1e6 + i * 1e-7 for i in range(500)]
    wide = [s * 10.0**e for s in (-1, 1) for e in range(-300, 300, 7)] + [0.0, float("inf"), -float("inf"), 5e-324]
    data = [("near", v) for v in near] + [("wide", v) for v in wide] + [("nan", float("nan"))]
    w = skewed_keys.weigh(spark.createDataFrame(data, "k string, v double"), ["k"], "v")
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.k, r.q): r.value for r in skewed_keys.percentiles(w, ["k"], qs, limit).collect()}
    assert got == {(k, q): sorted(v)[int(q * (len(v) - 1))] for k, v in (("near", near), ("wide", wide)) for q in qs}


@pytest.mark.parametrize("n", [0, 300])
def test_degrees(spark, n):
    e = [(0 if i % 3 else i, i % 5) for i in range(n)] + [(None, 1), (2, None)] * bool(n)
    df = spark.createDataFrame(e, "src long, dst long")
    got = {r.node: (r.d_in, r.d_out, r.n_in, r.n_out) for r in skewed_keys.degree_profile(df).collect()}
    real = [(a, b) for a, b in e if a is not None and b is not None and a != b]
    want = {v: (sum(b == v for a, b in real), sum(a == v for a, b in real), len({a for a, b in real if b == v}), len({b for a, b in real if a == v})) for p in real for v in p}
    assert got == want
    heavy = {(r.side, r.node) for r in skewed_keys.heavy_nodes(df, 0.1).collect()}
    assert heavy == {(s, v) for v, d in want.items() for s, x in (("d_in", d[0]), ("d_out", d[1])) if x >= 0.1 * len(e) and x}
