import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft import functions as gf
from graphweft import model, runtime
from graphweft.model import Graph, HopeParams, SketchParams
from graphweft.operators import cores, degrees, dense, labelled, node_centric, normalize, sketch, spectral
from graphweft.operators import link_prediction as lp
from graphweft.plans import graph_queries

TOY = [(1, 2, 1.0), (2, 3, 2.0), (1, 3, None), (3, 4, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 7, 1.0), (7, 4, 1.0), (1, 2, 3.0), (8, 8, 1.0), (None, 1, 1.0), (2, None, 1.0), (5, 1, float("nan")), (5, 1, -1.0)]


def toy(spark, directed=True):
    return model.build(spark.createDataFrame([(*r, i, "x") for i, r in enumerate(TOY)], "src long, dst long, w double, edge_id long, other string"), directed)


def edges_of(df):
    return {(r.src, r.dst): round(r.w, 9) for r in df.collect()}


def test_build(spark):
    g = toy(spark)
    assert edges_of(g.edges) == {(1, 2): 4.0, (2, 3): 2.0, (1, 3): 1.0, (3, 4): 1.0, (4, 5): 1.0, (5, 6): 1.0, (6, 7): 1.0, (7, 4): 1.0}
    assert {r.node for r in g.nodes.collect()} == set(range(1, 9))
    s = edges_of(toy(spark, False).edges)
    assert len(s) == 16 and all(s[b, a] == w for (a, b), w in s.items())


def test_build_empty(spark):
    g = model.build(spark.createDataFrame([], "src long, dst long, w double"))
    assert g.edges.count() == g.nodes.count() == 0
    assert sketch.embed(g, SketchParams(4, 0.2, 1)).vectors.collect() == []


def test_degrees(spark):
    d = {r.node: (r.d_in, r.d_out) for r in degrees.degrees(toy(spark)).collect()}
    assert d[3] == (2, 1) and d[8] == (0, 0) and d[4] == (2, 1)
    assert {r.degree: r.nodes for r in degrees.histogram(toy(spark)).collect()}[0] == 1
    assert len(degrees.sample_by_degree(toy(spark), 3).collect()) == 3


def test_row_normalised_values(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 4, 2.0), (1, 2, 3.0), (2, 1, 1.0), (3, 1, 2.0), (3, 3, 4.0)], "src long, dst long, w double")
    got = edges_of(normalize.row_normalised(m))
    assert got[0, 0] == round(1 / 3, 9) and got[0, 4] == round(2 / 3, 9) and got[3, 1] == round(1 / 3, 9)


def test_distances(spark):
    r = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 3, 8], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<int>, b array<int>, x array<double>, y array<double>, z array<double>").select(gf.positional_distance("a", "b"), gf.cosine_distance("x", "y"), gf.cosine_distance("x", "z"), gf.dot_distance("y", "y")).first()
    assert r[0] == 0.5 and abs(r[1] - (1 - 0.5**0.5)) < 1e-12 and r[2] == 1.0 and r[3] == -1.0


def test_sketch_of_isolated_node_is_itself_and_twins_agree(spark):
    rows = [(i, h, 1.0) for i in (1, 2) for h in range(10, 40)] + [(50, 50, 1.0)]
    g = model.build(spark.createDataFrame(rows, "src long, dst long, w double"), False)
    v = {r.node: r.vec for r in sketch.embed(g, SketchParams(20, 0.2, 2)).vectors.collect()}
    assert v[50] == [50] * 20 and sum(a == b for a, b in zip(v[1], v[2])) >= 16 and len(v[1]) == 20


def test_sketch_estimates_weighted_jaccard(spark):
    a, b = {i: 1.0 + i % 3 for i in range(30)}, {i: 1.0 + i % 3 for i in range(10, 40)}
    m = 256
    w = spark.createDataFrame([(n, i, x) for n, s in ((0, a), (1, b)) for i, x in s.items()], "src long, item long, w double")
    v = {r.src: r.vec for r in sketch.signatures(w, ["src"], m).collect()}
    # Probability Jaccard: sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i).
    both = set(a) | set(b)
    j = sum(1 / sum(max(a.get(k, 0) / a[i], b.get(k, 0) / b[i]) for k in both) for i in set(a) & set(b))
    got = sum(x == y for x, y in zip(v[0], v[1])) / m
    assert abs(got - j) < 4 * (j * (1 - j) / m) ** 0.5


def test_similar_pairs_are_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 6, (150, 12))
    v[:40, :] = v[0]
    v[:40, 0] = rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, vec array<long>")
    for least in (0.5, 0.75, 1.0):
        got = {(r.node_a, r.node_b): r.similarity for r in sketch.similar_pairs(df, 12, least).collect()}
        same = {(i, j): (v[i] == v[j]).mean() for i in range(150) for j in range(i + 1, 150)}
        assert got == {k: s for k, s in same.items() if s >= least - 1e-9}


def test_directed_distance(spark):
    g = toy(spark)
    e = sketch.embed_directed(g, SketchParams(16, 0.2, 1, False))
    v = {r.node: r for r in e.vectors.collect()}
    share = lambda a, b: 1 - sum(x == y for x, y in zip(a, b)) / 16
    for r in e.pair_distances(g.edges.select("src", "dst")).collect():
        a, b = v[r.src], v[r.dst]
        assert abs(r.distance - (share(a.source, b.source) + share(a.target, b.target) + share(a.source, b.target)) / 3) < 1e-12


def test_labelled_default_for_nodes_without_out_edges(spark):
    e = spark.createDataFrame([(1, 2, 1.0, "k"), (1, 3, 1.0, None), (4, 4, 1.0, "k")], "src long, dst long, w double, label string")
    nodes, labels = spark.createDataFrame([(i,) for i in range(1, 5)], "node long"), spark.createDataFrame([(2, "a"), (3, "b"), (3, "c")], "node long, label string")
    n = {r.node: r.vec for r in labelled.embed_labelled(e, nodes, labels, SketchParams(8, 0.2, 1)).collect()}
    assert n[2] == n[3] == n[4] == ["0"] * 8 and set(n[1]) <= {"a", "b", "c", "0"}
    ne = {r.node: r.vec for r in labelled.embed_labelled(e, nodes, labels, SketchParams(8, 0.2, 1), paired=True).collect()}
    assert set(ne[1]) <= {"a|k", "0"} and ne[4] == ["0"] * 8


def test_split_isolates_no_node(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 60, (300, 2))]
    for directed in (True, False):
        g = model.build(spark.createDataFrame(rows, "src long, dst long, w double"), directed)
        s = lp.split_edges(g, 0.4).collect()
        assert {x for r in s for x in (r.src, r.dst)} == {x for r in s if not r.deleted for x in (r.src, r.dst)}
        assert 0.1 < np.mean([r.deleted for r in s]) < 0.45
    with pytest.raises(ValueError):
        lp.split_edges(g, 1.0)


def test_auc_and_centric_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.integers(0, 3, 6).tolist() for i in range(40)}
    e = model.Embedding(spark.createDataFrame(list(v.items()), "node long, vec array<long>"), gf.positional_distance, True)
    dist = lambda a, b: 1 - np.mean([x == y for x, y in zip(v[a], v[b])])
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    rng.shuffle(pairs)
    gone, train, non = [tuple(map(int, p)) for p in pairs[:30]], [tuple(map(int, p)) for p in pairs[30:90]], [tuple(map(int, p)) for p in pairs[90:200]]
    frame = lambda ps: spark.createDataFrame(ps, "src long, dst long")
    want = np.mean([(dist(*d) < dist(*n) - 1e-9) + 0.5 * (abs(dist(*d) - dist(*n)) < 1e-9) for d in gone for n in non])
    assert abs(lp.auc(frame(gone), frame(non), e).first().auc - want) < 1e-9
    split = spark.createDataFrame([(a, b, 1.0, True) for a, b in gone] + [(a, b, 1.0, False) for a, b in train], "src long, dst long, w double, deleted boolean")
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    got = {r.node: r.auc for r in node_centric.centric_auc(e, split, 40, nodes).collect()}
    adj = lambda ps, i: {b if a == i else a for a, b in ps if i in (a, b)}
    for i, auc in got.items():
        d, others = adj(gone, i), [j for j in range(40) if j != i and j not in adj(train, i) and j not in adj(gone, i)]
        scores = [np.mean([(dist(i, j) > dist(i, x) + 1e-9) + 0.5 * (abs(dist(i, j) - dist(i, x)) < 1e-9) for j in others]) for x in d]
        assert abs(auc - np.mean(scores)) < 1e-9
    assert set(got) == {x for p in gone for x in p}
    last = {r.node: r.auc for r in node_centric.centric_auc(e, split, 40, nodes, "last").collect()}
    for i in last:
        x = max(adj(gone, i), key=lambda j: dist(i, j))
        others = [j for j in range(40) if j != i and j not in adj(train, i) and j not in adj(gone, i)]
        assert abs(last[i] - np.mean([(dist(i, j) > dist(i, x) + 1e-9) + 0.5 * (abs(dist(i, j) - dist(i, x)) < 1e-9) for j in others])) < 1e-9
    found = {r.node: r.found for r in node_centric.vcmpr(e, split, nodes, 5).collect()}
    for i, n in found.items():
        c = sorted((j for j in range(40) if j != i and j not in adj(train, i) and dist(i, j) < 1), key=lambda j: (round(dist(i, j), 9), j))[:5]
        assert n == len(set(c) & adj(gone, i))


def test_centric_figures_of_dense_directed_vectors(spark):
    rng = np.random.default_rng(2)
    s, t = rng.standard_normal((30, 4)), rng.standard_normal((30, 4))
    e = model.Embedding(spark.createDataFrame([(i, s[i].tolist(), t[i].tolist()) for i in range(30)], "node long, source array<double>, target array<double>"), gf.dot_distance, False, "hope")
    dist = lambda a, b: round((3 - s[a] @ s[b] - t[a] @ t[b] - s[a] @ t[b]) / 3, 9)
    edges = [(i, (i * 7 + 3) % 30, 1.0, i % 3 == 0) for i in range(30) if i != (i * 7 + 3) % 30]
    split, nodes = spark.createDataFrame(edges, "src long, dst long, w double, deleted boolean"), spark.createDataFrame([(i,) for i in range(30)], "node long")
    train = {p for a, b, _, gone in edges if not gone for p in ((a, b), (b, a))}
    gone = {p for a, b, _, gone in edges if gone for p in ((a, b), (b, a))} - train
    got = {r.node: r.auc for r in node_centric.centric_auc(e, split, 30, nodes).collect()}
    assert set(got) == {a for a, _ in gone}
    for i, auc in got.items():
        others = [j for j in range(30) if j != i and (i, j) not in train | gone]
        assert abs(auc - np.mean([np.mean([(dist(i, j) > dist(i, x)) + 0.5 * (dist(i, j) == dist(i, x)) for j in others]) for a, x in gone if a == i])) < 1e-9
    for r in node_centric.vcmpr(e, split, nodes, 3).collect():
        best = sorted((j for j in range(30) if j != r.node and (r.node, j) not in train), key=lambda j: (dist(r.node, j), j))[:3]
        assert r.found == sum((r.node, j) in gone for j in best)


@pytest.mark.parametrize("method", ["ADA", "RPR", "KATZ"])
def test_hope_by_products_and_by_gsvd(spark, method):
    rng = np.random.default_rng(3)
    a = (rng.random((12, 12)) < 0.4) * rng.random((12, 12))
    np.fill_diagonal(a, 0)
    g = model.build(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12) if a[i, j]], "src long, dst long, w double"))
    p = HopeParams(method, rank=4, nbiter=6, alpha=0.3, beta=0.05)
    row = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    m = {"ADA": a @ np.diag(1 / np.maximum(a.sum(0) + a.sum(1), 1e-300)) @ a, "RPR": 0.7 * sum(0.3**k * np.linalg.matrix_power(row, k) for k in range(7)), "KATZ": sum(0.05**k * np.linalg.matrix_power(a, k) for k in range(1, 7))}[method]
    u, s, v = np.linalg.svd(m)
    e, sigma = spectral.hope(g, p)
    assert np.allclose(sigma, s[:4], rtol=1e-5)
    got = {r.node: (np.array(r.source), np.array(r.target)) for r in e.vectors.collect()}
    near = np.array([[got[i][0] @ got[j][1] for j in range(12)] for i in range(12)])
    assert np.allclose(near, (u[:, :4] * s[:4]) @ v[:4], atol=1e-4)
    if method != "ADA":
        full = 0.7 * np.linalg.inv(np.eye(12) - 0.3 * row) if method == "RPR" else np.linalg.inv(np.eye(12) - 0.05 * a) @ (0.05 * a)
        e, _ = spectral.hope_by_gsvd(g, HopeParams(method, rank=12, alpha=0.3, beta=0.05))
        got = {r.node: (np.array(r.source), np.array(r.target)) for r in e.vectors.collect()}
        assert np.allclose([[got[i][0] @ got[j][1] for j in range(12)] for i in range(12)], full, atol=1e-6)


def test_p_core(spark):
    g = toy(spark)
    assert {r.node for r in cores.p_core(g.edges, g.nodes, 2).collect()} == set(range(1, 8))
    assert {r.node for r in cores.p_core(g.edges, g.nodes, 3).collect()} == set()
    sub = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {r.node: r.p for r in cores.p_weight(g.edges, sub).collect()} == {1: 5.0, 2: 6.0, 3: 3.0}


def test_adamic_adar_and_hope(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, (12, 12)).astype(float)
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12) if a[i, j]], "src long, dst long, w double")
    d = a.sum(0) + a.sum(1)
    want = a @ np.diag(1 / d) @ a
    got = np.zeros((12, 12))
    for r in normalize.adamic_adar(e).collect():
        got[r.src, r.dst] = r.w
    assert np.allclose(got, want)
    g = Graph(e, spark.range(12).select(F.col("id").alias("node")), True)
    emb, sigma = spectral.hope(g, HopeParams("ADA", rank=12, nbiter=3))
    assert np.allclose(sigma, np.linalg.svd(want)[1][: len(sigma)], atol=1e-6)
    v = {r.node: r for r in emb.vectors.collect()}
    assert np.allclose([[np.dot(v[i].source, v[j].target) for j in range(12)] for i in range(12)], want, atol=1e-6)


def test_gsvd_values():
    a = np.array([[1, 6, 11], [2, 7, 12], [3, 8, 13], [4, 9, 14], [5, 10, 15]], float)
    b = np.array([[8, 1, 6], [3, 5, 7], [4, 9, 2]], float)
    g = spectral.gsvd(a, b)
    assert np.allclose(g.c[:2], [0.98067, 0.315531], atol=1e-5) and np.allclose(g.s[:2], [0.195655, 0.948915], atol=1e-5)
    assert np.allclose(g.c**2 + g.s**2, 1) and spectral.gsvd_residual(a, b, g) < 1e-10 and spectral.is_orthonormal(g.v[:, g.s > 1e-9])
    rng = np.random.default_rng(0)
    h = spectral.gsvd(rng.standard_normal((2, 6)), rng.standard_normal((3, 6)))
    assert (h.k, h.l) == (2, 3)
    assert np.allclose(spectral.approximate_gsvd(a, b, 3).c[:2], [0.9807, 0.3155], atol=1e-4)
    x = spectral.decreasing_nan_last(np.array([np.nan, 3, np.nan, 1, 5, np.nan]))
    assert x[:3].tolist() == [5, 3, 1] and np.isnan(x[3:]).all()


def test_rooted_pagerank(spark):
    g = toy(spark)
    r = {x.node: x.rank for x in normalize.rooted_pagerank(g, 0.85, 30).collect()}
    assert len(r) == 8 and r[4] > r[1] and 0 < sum(r.values()) <= 1 + 1e-9


def test_dense_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, []), (92, [0.0] * 5), (93, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for r in dense.nearest_to(df, df.filter("id % 10 = 0"), "id", "v", 3).collect():
        if r.id < 80:
            assert np.argsort(-s[r.id])[r["rank"] - 1] == r.neighbour
    assert dense.nearest_to(df, df.filter("id > 999"), "id", "v", 3).collect() == []


def test_nearest_of_and_classes(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 3, (120, 8))
    v[20:60] = v[20]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, vec array<long>")
    got = {}
    for r in sketch.nearest_of(df, df.filter("node % 7 = 0"), 8, 4, 0.5).orderBy("node", "rank").collect():
        got.setdefault(r.node, []).append((r.distance, r.neighbour))
    for i in range(0, 120, 7):
        assert got[i] == sorted((1 - (v[i] == v[j]).mean(), j) for j in range(120) if j != i)[:4]
    first = {tuple(x): min(j for j in range(120) if (v[j] == x).all()) for x in v}
    reps = sorted(set(first.values()))
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if (v[a] == v[b]).mean() >= 0.75}
    assert {(r.class_a, r.class_b) for r in sketch.similar_classes(df, 8, 0.75).collect()} == want


def test_precision_with_many_train_edges_inside_a_class(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [7] * 16) for i in range(200)] + [(i, [i] * 16) for i in range(200, 230)], "node long, vec array<long>")
    split = spark.createDataFrame([(0, j, 1.0, False) for j in range(1, 151)] + [(0, 151, 1.0, True), (0, 180, 1.0, True), (1, 2, 1.0, True), (1, 3, 1.0, True)], "src long, dst long, w double, deleted boolean")
    monkeypatch.setattr(graph_queries, "_trained", lambda spark, d: (None, split, model.Embedding(vectors, gf.positional_distance, True)))
    # The pairs of 0 with 151 to 199, then (1, 2).
    assert [(r.found, r.hits) for r in graph_queries.precision_at_50(spark, "").collect()] == [(50, 3)]


def test_nearest_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    v = np.repeat(rng.integers(0, 9, (4, 16)), 60, axis=0)
    v[60:120] = v[0]
    v[60:120, 3] = 99  # a class that agrees with the first in 15 slots
    v = v[(order := rng.permutation(240))]
    train = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 240, (6000, 2)) if a != b and min(a, b) < 12}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, vec array<long>")
    without = spark.createDataFrame([p if sum(p) % 2 else p[::-1] for p in train], "src long, dst long")
    all_pairs = {(i, j): (v[i] == v[j]).mean() for i in range(240) for j in range(i + 1, 240) if (v[i] == v[j]).sum() >= 15}
    pairs = sketch.nearest_pairs(df, 16, 15 / 16, 20, without)
    got = [(r.node_a, r.node_b, r.similarity) for r in pairs.collect()]
    assert len(got) == len({g[:2] for g in got}) and all(all_pairs[g[:2]] == g[2] for g in got)
    best = lambda ps: sorted((p for p in ps if p[:2] not in train), key=lambda p: (-p[2], *p[:2]))[:20]
    assert best(got) == best((*k, s) for k, s in all_pairs.items())


def _nearest_by_hand(v, k):
    out = {}
    for i in range(len(v)):
        common = (v == v[i]).sum(1)
        out[i] = sorted((1 - common[j] / v.shape[1], j) for j in range(len(v)) if j != i)[:k]
    return out


def test_neighbour_index_meets_only_rare_values():
    rng = np.random.default_rng(11)
    v = np.repeat(rng.integers(0, 1 << 40, (50, 16)), 10, axis=0)
    v[np.arange(500), 1 + np.arange(500) % 10] = -np.arange(1, 501)  # clusters of ten that agree in 14 slots
    v[:, 0] = 7  # and a value that all have
    names = np.arange(500)
    index = sketch._Index(*sketch._Index.parts(names, np.ones(500, np.int64), v))
    index.lists[:500] = -(10**6)  # the list of slot 0: to read it is an error
    a, b, common = index.nearest(names, np.zeros(500, np.int64), v, 8)
    want = _nearest_by_hand(v, 8)
    got = {}
    for x, y, c in zip(a, b, common):
        got.setdefault(int(x), []).append((1 - c / 16, int(y)))
    assert got == want


@pytest.mark.parametrize("shard", [1 << 19, 40])
@pytest.mark.parametrize("dim", [5, 16, 40, 70])
def test_nearest_of_all_nodes(spark, monkeypatch, shard, dim):
    monkeypatch.setattr(sketch, "SHARD", shard)
    rng = np.random.default_rng(dim)
    v = rng.integers(0, 40, (160, dim)) + 1000 * rng.integers(0, 4, (160, 1))
    v[30:50] = v[30]  # a class of more than k nodes, one of fewer
    v[50:53] = v[50]
    v[100:] += 10**6 * np.arange(1, 61)[:, None]  # nodes that have nothing in common with any
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, vec array<long>")
    got = {}
    for r in sketch.nearest_of(df, df, dim, 4).orderBy("node", "rank").collect():
        got.setdefault(r.node, []).append((r.distance, r.neighbour))
        assert r["rank"] == len(got[r.node])
    for i, want in _nearest_by_hand(v, 4).items():
        assert [b for _, b in got[i]] == [b for _, b in want] and np.allclose([d for d, _ in got[i]], [d for d, _ in want])


def test_hop_groups_without_moving_items(spark):
    edges = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.0), (4, 2, 5.0)], "src long, dst long, w double")
    vectors = spark.createDataFrame([(2, [7, 7, 3, 2]), (3, [3, 3, 3, 3])], "node long, vec array<long>")
    hop = sketch.accumulate(edges, sketch.counted(vectors), 4, 0.2)
    got = {(r.src, r.item): round(r.w, 9) for r in hop.collect()}
    assert got == {(1, 2): 2.1, (1, 3): 1.3, (1, 7): 0.2, (4, 2): 5.25, (4, 7): 0.5, (4, 3): 0.25}
    drawn = sketch.signatures(hop, ["src"], 16)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("item" in line.split(")")[0] or "_pass" in line.split(")")[0] for line in moved)
    assert sum("(src" in line for line in moved) == 1


def test_sketch_leaves_no_shuffle_files(spark):
    import glob
    import os

    files = lambda: [f for d in glob.glob(os.path.join(os.environ.get("SPARK_LOCAL_DIRS", "/tmp"), "blockmgr-*")) for f in glob.glob(f"{d}/*/shuffle_*.data")]
    runtime.collect_garbage(spark)
    before = set(files())
    sketch.embed(toy(spark, False), SketchParams(12, 0.2, 3))
    assert len(set(files()) - before) == 0
