import numpy as np
import pytest

from graphweft import model
from graphweft.operators import density
from graphweft.operators.density import Isotonic


def blocks(i):
    return [(round(b.x, 6), round(b.y, 6), b.w) for b in i.blocks]


def test_isotonic_values():
    assert Isotonic([0, 1, 2], [1, 2, 1.5])(1.5) == 1.75
    with pytest.raises(ValueError):
        Isotonic([], [])
    one = Isotonic([1], [2])
    assert len(one.blocks) == 1 and one.centre == (1, 2)
    i = Isotonic([0.5, 2, 1], [-0.5, 0, 2])
    assert blocks(i) == [(0.5, -0.5, 1), (1.5, 1, 2)] and [i.block_of(k) for k in range(3)] == [0, 1, 1]
    assert blocks(Isotonic([0, 1, 2], [1, 2, -1])) == [(1, 0.666667, 3)]
    assert Isotonic([1, 2], [5, 7])(1.5) == 6
    assert blocks(Isotonic([0, 1, 2], [-1, 2, 1], ascending=False)) == [(1, 0.666667, 3)]
    assert Isotonic([0, 1, 2], [3, 2, 1], ascending=False)(0.5) == 2.5
    assert Isotonic([1], [3])(0) == 3


def test_isotonic_is_least_squares():
    rng = np.random.default_rng(0)
    x, y, w = np.sort(rng.random(60)), rng.random(60), rng.integers(1, 5, 60)
    i = Isotonic(x, y, w)
    fit = np.concatenate([[b.y] * (b.last - b.first + 1) for b in i.blocks])
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * w).sum() - (y * w).sum()) < 1e-9
    for b in i.blocks:
        part = slice(b.first, b.last + 1)
        assert abs(np.average(y[part], weights=w[part]) - b.y) < 1e-9


@pytest.fixture(scope="module")
def planted(spark):
    """A clique of 12 with sparse surroundings."""
    rng = np.random.default_rng(5)
    rows = [(i, j, 1.0) for i in range(12) for j in range(i + 1, 12)] + [(int(a), int(b), 1.0) for a, b in zip(rng.integers(0, 80, 90), rng.integers(12, 80, 90)) if a != b]
    return model.build(spark.createDataFrame(rows, "src long, dst long, w double"))


def test_mass_is_kept_and_clique_is_densest(spark, planted):
    half = density.half_edges(planted)
    total = half.agg({"w": "sum"}).first()[0]
    alpha = density.balance(half, 15)
    assert abs(sum(r.load for r in density.loads(alpha).collect()) - total) < 1e-9
    assert all(abs(r.a + r.b - r.w) < 1e-9 for r in alpha.collect())
    assert abs(sum(r.y for r in density.tentative_density(alpha).collect()) - total) < 1e-9
    member, _ = density.decompose(planted, 15)
    rows = {r.node: r.block for r in member.collect()}
    assert set(rows) == {r.node for r in planted.nodes.collect()} and min(rows.values()) == 0
    assert set(range(12)) <= {n for n, b in rows.items() if b == 0}
    assert sum(r["size"] for r in density.block_sizes(member).collect()) == len(rows)


def test_stability_against_brute_force(spark, planted):
    alpha = density.balance(density.half_edges(planted), 3)
    nodes = sorted(r.node for r in planted.nodes.collect())
    member = {n: (0 if n < 12 else 1 if n < 30 else 2 if n < 50 else 3) for n in nodes}
    frame = spark.createDataFrame(list(member.items()), "node long, block int")
    got = {r.block: r.stable for r in density.stable_prefixes(alpha, frame).collect()}
    for k in range(4):
        load = dict.fromkeys(nodes, 0.0)
        for r in alpha.collect():
            a, b = r.a, r.b
            ia, ib = member[r.src] <= k, member[r.dst] <= k
            if ia and not ib:
                a, b = 0.0, r.a + r.b
            if ib and not ia:
                a, b = r.a + r.b, 0.0
            load[r.src] += a
            load[r.dst] += b
        inside, outside = [load[n] for n in nodes if member[n] <= k], [load[n] for n in nodes if member[n] > k]
        assert got[k] == (not outside or min(inside) > max(outside)), k


def test_transitions_sum_to_one(spark, planted):
    member = spark.createDataFrame([(r.node, r.node // 20) for r in planted.nodes.collect()], "node long, block int")
    t = density.transitions(planted.edges, member)
    sums = {}
    for r in t.collect():
        sums[r.i] = sums.get(r.i, 0) + r.p
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    assert all(abs(r.kl) < 1e-12 for r in density.transition_kl(t, t).collect())


def brute_force(points, close=1e-6):
    """(lo, hi, n, mean) of the decreasing regression of (load, y): ties first, then violators until there are none."""
    groups = []
    for x, y in sorted(points, reverse=True):
        if groups and groups[-1][-1][0] - x <= close:
            groups[-1].append((x, y))
        else:
            groups.append([(x, y)])
    mean = lambda g: sum(y for _, y in g) / len(g)
    k = 1
    while k < len(groups):
        if mean(groups[k]) >= mean(groups[k - 1]):
            groups[k - 1 : k + 1] = [groups[k - 1] + groups[k]]
            k = max(1, k - 1)
        else:
            k += 1
    return [(min(g)[0], max(g)[0], len(g), mean(g)) for g in groups]


@pytest.mark.parametrize("hub", [1e7, 3.0])
def test_regression_under_a_hub_against_brute_force(spark, hub):
    rng = np.random.default_rng(2)
    load = np.round(rng.exponential(1.0, 1500), 3) + rng.choice([0, 4e-7], 1500)
    points = [(float(x), float(y)) for x, y in zip(load, np.round(load * 4 + rng.normal(0, 1, 1500)))] + [(hub, 50.0)]
    frame = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "node long, load double, y double")
    want = brute_force(points)
    assert len(want) > 15
    blocks = density.blocks_of_density(frame)
    got = [(r.lo, r.hi, r.n, r.y) for r in blocks.orderBy("block").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    of = {r.node: r.block for r in density.node_blocks(frame, blocks).collect()}
    assert all(want[of[i]][0] <= x <= want[of[i]][1] for i, (x, _) in enumerate(points)) and len(of) == len(points)


def test_ties_across_ranges_are_one_point(spark):
    points = [(5 + 5e-7 * i, float(i % 7)) for i in range(300)] + [(4.0, 2.5), (3.0, 9.0), (2.0, 1.0)]
    frame = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "node long, load double, y double")
    got = [(r.lo, r.hi, r.n) for r in density.blocks_of_density(frame).orderBy("block").collect()]
    assert got == [w[:3] for w in brute_force(points)]
    assert density.blocks_of_density(frame.filter("node < 0")).collect() == []


def test_stability_of_many_blocks_against_brute_force(spark, planted):
    alpha = density.balance(density.half_edges(planted), 2)
    load = {r.node: r.load for r in density.loads(alpha).collect()}
    member = {n: k for k, n in enumerate(sorted(load, key=lambda n: (-load[n], n)))}
    frame = spark.createDataFrame(list(member.items()), "node long, block int")
    got = {r.block: r.stable for r in density.stable_prefixes(alpha, frame).collect()}
    rows = alpha.collect()
    assert len(got) == len(member)
    for k in range(len(member)):
        r = dict(load)
        for e in rows:
            if member[e.src] <= k < member[e.dst]:
                r[e.src], r[e.dst] = r[e.src] - e.a, r[e.dst] + e.a
            if member[e.dst] <= k < member[e.src]:
                r[e.dst], r[e.src] = r[e.dst] - e.b, r[e.src] + e.b
        inside, outside = [v for n, v in r.items() if member[n] <= k], [v for n, v in r.items() if member[n] > k]
        if outside and abs(min(inside) - max(outside)) > 1e-9:
            assert got[k] == (min(inside) > max(outside)), k


def test_blocks_do_not_depend_on_the_order_of_adding(spark):
    def fit(*groups):
        rows = [(100.0 - k - 1e-7 * i, y) for k, ys in enumerate(groups) for i, y in enumerate(ys)]
        got = density.blocks_of_density(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "node long, load double, y double").coalesce(1))
        return [(r.n, r.y) for r in got.orderBy("block").collect()]

    # 40.225 / 8 = 5.028125, halfway between two numbers of five digits
    ys = [5.0, 5.0, 5.008, 5.0, 5.0, 5.202, 5.0, 5.015]
    assert [fit(o) for o in (ys, ys[::-1], sorted(ys))] == [[(8, 5.028125)]] * 3
    # 0.6 / 3 = 0.2: equal means are one block, whatever their last bits
    assert [fit(o, [0.2], [0.1]) for o in ([0.1, 0.2, 0.3], [0.3, 0.2, 0.1])] == [[(4, 0.2), (1, 0.1)]] * 2
    # small ones stay apart
    assert [n for n, _ in fit([3e-12], [2e-12], [1e-12])] == [1, 1, 1]
