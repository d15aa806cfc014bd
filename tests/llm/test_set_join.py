import random

import pytest

from graphweft.llm import set_join


def brute(rows, t):
    best = {}
    for space, f, i, toks in rows:
        if i is not None and (clean := {x for x in toks or [] if x is not None}):
            best[space, f, i] = clean
    items = sorted(best.items(), key=lambda x: x[0][2])
    out = set()
    for k, ((s1, f1, i1), a) in enumerate(items):
        for (s2, f2, i2), b in items[k + 1 :]:
            if s1 == s2 and i1 != i2 and len(a & b) / len(a | b) >= t:
                out.add((f1, i1, f2, i2))
    return out


def make(rng, n):
    rows, bases = [], [[rng.randrange(10**6) for _ in range(rng.choice([1, 2, 5, 12, 20, 32, 64]))] for _ in range(n // 6)]
    for i in range(n):
        toks = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            if toks and rng.random() < 0.5:
                toks.pop(rng.randrange(len(toks)))
            else:
                toks.append(rng.choice([1, 2, 3, rng.randrange(10**6)]))
        rows.append((rng.randrange(2), rng.choice("xy"), i, toks + toks[: rng.randrange(3)]))
    return rows


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8, 0.95])
def test_against_brute_force(spark, t):
    rows = make(random.Random(int(t * 100)), 400)
    rows += [(0, "x", 1000, None), (0, "x", 1001, []), (0, "x", 1002, [None]), (0, "y", None, [1, 2]), rows[0], rows[0]] + [(1, "x", 2000 + i, [9, 8, 7]) for i in range(12)] + [(1, "y", 3000, list(range(3000))), (1, "y", 3001, list(range(40, 3000)))]
    got = [tuple(r) for r in set_join.similar_records(spark.createDataFrame(rows, "space int, field string, id long, toks array<long>"), t).select("field_a", "id_a", "field_b", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t) and len(got) > 50


def test_links_and_empty(spark):
    kind = "space int, field string, id long, toks array<long>"
    df = spark.createDataFrame([(0, "x", 1, [1, 2, 3, 4]), (0, "x", 2, [4, 3, 2, 1]), (0, "x", 3, [1, 2, 3]), (0, "x", 4, [9])], kind)
    out = {r.id: (r.class_id, r.copies, r.links) for r in set_join.links_per_record(df, 0.6).collect()}
    assert out == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1), 4: (4, 1, 0)}
    assert set_join.similar_records(df.filter("id > 9"), 0.6).collect() == []
