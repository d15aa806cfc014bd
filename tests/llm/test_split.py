import random
from collections import Counter

from graphweft.llm import split


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_forest_on_chains_stars_and_random(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [tuple(rng.sample(range(1000, 1200), 2)) for _ in range(150)] + [(7, 7)]
    links += links[:20] + [(b, a) for a, b in links[:20]]
    labels, tree = split.forest(spark.createDataFrame(links, "a long, b long"))
    out = {}
    for r in labels.collect():
        out.setdefault(r.root, set()).add(r.node)
    want = components([x for x in links if x[0] != x[1]])
    assert sorted(map(sorted, out.values())) == want
    taken = [(r.a, r.b) for r in tree.collect()]
    assert components(taken) == want and len(taken) == sum(len(c) - 1 for c in want)


def test_groups_by_two_keys(spark):
    rows = [(i, f"a{i // 4}" if i % 5 else None, i % 37) for i in range(200)] + [(300, "hot", None)] + [(i, "hot", 1000 + i) for i in range(301, 700)] + [(None, "hot", 1), (3, "a0", 3)]
    df = spark.createDataFrame(rows, "id long, k1 string, k2 long")
    labels, _ = split.groups(df, [["k1"], ["k2"]])
    links = []
    for c in (1, 2):
        first = {}
        for r in rows:
            if r[0] is not None and r[c] is not None and first.setdefault(r[c], r[0]) != r[0]:
                links.append((first[r[c]], r[0]))
    out = {}
    for r in labels.collect():
        out.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, out.values())) == components(links) and all(min(v) == k for k, v in out.items())


def test_deal_shares_by_band(spark):
    rng = random.Random(1)
    rows = [(i, g, rng.choice([1, 1, 1, 2, 3, 5, 9, 30]), f) for g, f in (("x", 0.3), ("y", 0.1)) for i in range(4000)]
    out = split.deal(spark.createDataFrame(rows, "root long, g string, size long, f double"), ["g"], "size", "f").collect()
    assert len(out) == len(rows)
    for g, f in (("x", 0.3), ("y", 0.1)):
        total, n = sum(r.size for r in out if r.g == g), Counter()
        for r in out:
            if r.g == g:
                n[r.split] += r.size
        assert abs((n["validation"] + n["test"]) / total - f) < 0.03 and abs(n["validation"] - n["test"]) / total < 0.03
        for lo, hi in ((1, 1), (2, 3), (30, 30)):
            band = [r.split != "train" for r in out if r.g == g and lo <= r.size <= hi]
            assert abs(sum(band) - f * len(band)) <= 2


def test_empty(spark):
    labels, tree = split.groups(spark.createDataFrame([], "id long, k string"), [["k"]])
    assert labels.collect() == [] and tree.collect() == []
