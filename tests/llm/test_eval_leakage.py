import random

from graphweft.llm import eval_leakage

VOCAB = [f"w{i}" for i in range(300)] + ["the", "of", "and", "a"] * 20


def brute(docs, items, run=12):
    def words(t):
        return [w.lower() for w in eval_leakage.words([t or ""])[0]]

    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randrange(5, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "¡¿!"), (93, " ".join(rng.choices(VOCAB, k=30)))]
    items.append((94, items[-1][1]))  # the same passage twice
    docs = []
    for d in range(300):
        w = rng.choices(VOCAB + [f"x{i}" for i in range(2000)], k=rng.randrange(0, 200))
        if d % 3 == 0:
            src = rng.choice(items)[1] or ""
            part = src.split(" ")
            n = rng.choice([8, 11, 12, 13, 20])
            s = rng.randrange(max(1, len(part) - n + 1))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.3 else x for x in part[s : s + n]]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(VOCAB) * 20 + " " + items[3][1]), (1002, "")]
    got = [(r.doc_id, r.item_id) for r in eval_leakage.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 30


def test_paraphrase(spark):
    rng = random.Random(6)
    item = [f"term{i}" for i in range(40)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    docs = [(1, " ".join(changed)), (2, " ".join(rng.sample(item, 40)))] + [(i, " ".join(rng.choices(VOCAB, k=80))) for i in range(3, 60)]
    out = eval_leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.longest_run, r.lcs_words) for r in out] == [(1, 7, 8, 35)]


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert eval_leakage.found(docs.filter("doc_id > 1"), items).collect() == []
    assert eval_leakage.found(docs, items.filter("item_id > 1")).collect() == []
    assert eval_leakage.found(docs, items).collect() == []
