import numpy as np
import pytest

from graphweft.llm import vector_knn

DIM = 8
KIND = "id long, vec array<float>, field string, cosine int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "f", 0) for i, v in rows], KIND)


def brute(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            best[i] = x / np.linalg.norm(x)
    ids = sorted(best)
    x = np.array([best[i] for i in ids])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [(ids[j], s[a, j]) for j in np.lexsort((ids, -np.round(s[a], 6)))[:k] if s[a, j] > -2] for a, i in enumerate(ids)}


@pytest.fixture
def small(monkeypatch):
    for name, n in (("LEAF", 20), ("PER_LEAF", 5), ("ROWS", 60)):
        monkeypatch.setattr(vector_knn, name, n)


def test_recall_and_pairs(spark, small):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((700, DIM))
    rows = [(i, v * rng.uniform(0.1, 9)) for i, v in enumerate(base)] + [(1000 + i, base[i] + 0.05 * rng.standard_normal(DIM)) for i in range(80)]
    want = brute(rows, 5)
    got = {}
    for r in vector_knn.nearest(frame(spark, rows), "f", "id", "vec", DIM, recall=0.95).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.cosine))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    share = np.mean([len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / 5 for i in want])
    assert share > 0.9
    close = {(i, n) for i, v in want.items() for n, c in v if c >= 0.9}
    found = {(r.id, r.neighbour) for r in vector_knn.nearest(frame(spark, rows), "f", "id", "vec", DIM, recall=0.995, least=0.9).collect()}
    assert found <= close and len(found) >= 0.98 * len(close)


def test_copies_and_odd_rows(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((150, DIM)))] + [(i, [1.0] * DIM) for i in range(200, 300)] + [(i, [0.0, 2.0] + [0.0] * (DIM - 2)) for i in (401, 402, 403)]
    odd = [(500, None), (501, []), (502, [1.0] * (DIM - 1)), (503, [0.0] * DIM), (504, [float("nan")] + [1.0] * (DIM - 1)), (505, [None] + [1.0] * (DIM - 1)), (506, [float("inf")] * DIM), (None, [1.0] * DIM), rows[0], rows[0], rows[160]]
    got = {}
    for r in vector_knn.nearest(frame(spark, rows + odd), "f", "id", "vec", DIM, recall=1.0).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(rows + odd, 5)
    assert set(got) == set(want)
    for i in (200, 203, 250, 299, 401):
        assert sorted(got[i])[:2] == sorted(n for n, _ in want[i])[:2] and len(got[i]) == 5
    assert all(sorted(got[i]) == [j for j in range(200, 206) if j != i][:5] for i in range(200, 300))


def test_copies_of_a_direction_with_other_norms(spark, small):
    rng = np.random.default_rng(5)
    way = rng.standard_normal(DIM)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((150, DIM)))] + [(i, way * rng.uniform(0.01, 50)) for i in range(200, 400)]
    got = {}
    for r in vector_knn.nearest(frame(spark, rows), "f", "id", "vec", DIM, recall=1.0).collect():
        got.setdefault(r.id, []).append(r.neighbour)
        assert r.id < 200 or r.cosine > 0.999999
    assert all(len(set(got[i]) - {i}) == 5 and min(got[i]) >= 200 for i in range(200, 400))


def test_empty_and_single(spark):
    assert vector_knn.nearest(frame(spark, []), "f", "id", "vec", DIM).collect() == []
    assert vector_knn.nearest(frame(spark, [(1, [1.0] * DIM)]), "f", "id", "vec", DIM).collect() == []
    assert vector_knn.nearest(frame(spark, [(1, [0.0] * DIM)] * 20), "f", "id", "vec", DIM).collect() == []
