import math
import random

import pytest

from graphweft.llm import quantile_sketch as qs


def exact(values, q):
    values = sorted(values)
    return values[math.floor(q * (len(values) - 1))]


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_error_bound_and_merge(spark, error):
    rng = random.Random(2)
    data = [(rng.choice("abc"), d, rng.choice([0.0, rng.lognormvariate(0, 3), -rng.lognormvariate(2, 1), float(rng.randrange(5))])) for d in range(4) for _ in range(1500)]
    df = spark.createDataFrame([*data, ("a", 1, None), ("a", 1, float("nan")), ("z", 1, None)], "k string, day int, v double")
    parts = [qs.sketch(df.filter(f"day = {d}"), ["k", "day"], ["v"], error) for d in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    for keys in (["k"], ["k", "day"]):
        out = qs.percentiles(qs.merge(whole, keys), keys, [0.0, 0.1, 0.5, 0.9, 0.99, 1.0], error).collect()
        groups = {}
        for k, d, v in data:
            groups.setdefault((k, d)[: len(keys)], []).append(v)
        assert len(out) == 6 * len(groups)
        for r in out:
            want = exact(groups[tuple(r[c] for c in keys)], r.q)
            assert r.n == len(groups[tuple(r[c] for c in keys)]) and abs(r.value - want) <= error * abs(want) * (1 + 1e-9)


def test_edges(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", inf), ("a", -inf), ("a", 0.0), ("b", -0.0), ("c", float("nan")), ("d", 5e-324), ("e", 1.7e308)], "k string, v double")
    out = {(r.k, r.q): r.value for r in qs.percentiles(qs.sketch(df, ["k"], ["v"]), ["k"], [0.0, 0.5, 1.0]).collect()}
    assert (out["a", 0.0], out["a", 0.5], out["a", 1.0], out["b", 0.5]) == (-inf, 0.0, inf, 0.0)
    assert ("c", 0.5) not in out and abs(out["e", 0.5] / 1.7e308 - 1) <= 0.011
    assert qs.percentiles(qs.sketch(df.filter("k = 'x'"), ["k"], ["v"]), ["k"], [0.5]).collect() == []


def test_stored_days_are_combined(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "s")
    df = spark.createDataFrame([(rng.choice("ab"), d, rng.lognormvariate(0, 2)) for d in range(3) for _ in range(400)], "k string, day int, v double")
    for d in (0, 1, 1, 2):  # a day that is stored again replaces itself
        qs.store(qs.sketch(df.filter(f"day = {d}"), ["k", "day"], ["v"]), path, "day")
    rows = lambda s: sorted(map(tuple, qs.percentiles(qs.merge(s, ["k"]), ["k"], [0.1, 0.5, 0.99]).collect()))
    assert rows(qs.load(spark, path)) == rows(qs.sketch(df, ["k"], ["v"]))
    assert rows(qs.load(spark, path).filter("day < 2")) == rows(qs.sketch(df.filter("day < 2"), ["k"], ["v"]))


def test_one_per_key_with_strings_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None), (1, "b", None, 3), (2, None, float("nan"), 1), (2, "c", 2.0, 4), (3, None, None, None)], "id int, g string, v double, loaded_at int")
    assert {r.id: (r.g, r.v) for r in qs.one_per_key(df, ["id"]).collect()} in ({1: ("b", 1.0), 2: ("c", 2.0), 3: (None, None)}, {1: ("a", 1.0), 2: ("c", 2.0), 3: (None, None)})


def test_significant_digits(spark):
    df = spark.createDataFrame([(1.23456789123e-7,), (-9.9999999999e8,), (0.0,), (float("inf"),)], "v double")
    assert [r.x for r in df.select(qs.significant(df.v).alias("x")).collect()] == [1.23456789e-7, -1e9, 0.0, float("inf")]


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, None, 1), (2, None, 3), (1, 5, 9)], "id int, v int, loaded_at int")
    assert sorted((r.id, r.v, r.loaded_at) for r in qs.one_per_key(df, ["id"]).collect()) == [(1, 5, 1), (2, None, 3)]
