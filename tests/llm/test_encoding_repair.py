import random

import pytest

from graphweft.llm import encoding_repair

CLEAN = {
    "de": "Die gewölbte Düse drückt gegen die Gehäusehälfte bei 20 °C ± 5 µm größer für Führung Öffnung länglich",
    "fr": "La pièce inférieure est fixée à l’électrode près de la fenêtre où le procédé a été préféré – voilà",
    "ru": "Предложена пористая крышка которая прижимает деталь при нагреваемой камере при температуре выше нормы",
    "en": "The naïve “design” failed at 20 °C – a cross-section of 3 µm × 5 µm ± 1 µm after σ = F/A and ∑ x │ 4 │",
}


def corpus(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.sample((w := CLEAN[k].split(" ")), len(w))) for k in rng.choices(sorted(CLEAN), k=n)]


DAMAGE = {
    "utf8 as cp1252": lambda t: t.encode().decode("cp1252"),
    "utf8 as latin1": lambda t: t.encode().decode("latin1"),
    "twice": lambda t: t.encode().decode("latin1").encode().decode("latin1"),
    "utf8 as cp437": lambda t: t.encode().decode("cp437"),
    "utf8 as mac": lambda t: t.encode().decode("mac_roman"),
}


@pytest.mark.parametrize("kind", sorted(DAMAGE))
def test_damaged_are_found_and_restored(spark, kind):
    texts = corpus(400)
    good = CLEAN["fr"].replace("à", "a")
    bad = DAMAGE[kind](good)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts + [bad, "Das " + DAMAGE[kind]("Düse") + " hier"])], "doc_id long, text string, run string, n int")
    assert {r.doc_id for r in encoding_repair.found(df).collect()} == {400, 401}
    out = {r.doc_id: r.restored_text for r in encoding_repair.restore(df).collect()}
    assert out == {400: good, 401: "Das Düse hier"}


def test_single_byte_and_lost(spark):
    texts = corpus(400)
    odd = [CLEAN["ru"].encode("cp1251").decode("koi8_r"), CLEAN["ru"].encode("cp1251").decode("cp1252"), CLEAN["de"].encode("cp1252").decode("mac_roman"), "na�ve", "1\x961 fait", "20 ░C"]
    df = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string")
    assert {r.doc_id for r in encoding_repair.found(df).collect()} == set(range(400, 406))
    out = {r.doc_id: r.restored_text for r in encoding_repair.restore(df).collect()}
    assert out[400] == out[401] == CLEAN["ru"] and out[403] == "naïve" and out[404] == "1–1 fait" and out[405] == "20 °C"


def test_long_runs_stay_whole(spark):
    words = [w for w in "предложена пористая крышка которая прижимает деталь при нагреваемой камере".split(" ")]
    long = "".join(words * 3)
    for text in (long, "x" * 40 + long[:100]):
        bad = text.encode().decode("latin1")
        df = spark.createDataFrame(list(enumerate(corpus(400) + [bad])), "doc_id long, text string")
        assert [(r.doc_id, r.restored_text) for r in encoding_repair.restore(df).collect()] == [(400, text)]
    for text in (long.encode().decode("latin1"), "漢字" * 100, "é" * 90 + "a" + "é" * 90, long):
        pieces, _ = encoding_repair.runs([text])
        assert "".join(pieces) == text
    assert max(map(len, encoding_repair.runs(["漢字" * 1000])[0])) == encoding_repair.PIECE
    assert len(encoding_repair.runs([long.encode().decode("latin1")])[0]) == 1


def test_lost_bytes_are_only_restored_to_words(spark):
    df = spark.createDataFrame(list(enumerate(corpus(400) + ["����se", "D�se"])), "doc_id long, text string")
    out = {r.doc_id: (r.restored_text, r.n_lost) for r in encoding_repair.restore(df).collect()}
    assert out[400] == ("����se", 1) and out[401] == ("Düse", 0)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "plain"), (5, "é" * 5000), (6, "�"), (6, "�")], "doc_id long, text string")
    assert {r.doc_id for r in encoding_repair.found(df).collect()} == {6}
    assert encoding_repair.found(df.filter("doc_id < 0")).collect() == []


MISREAD = {
    "cp1251 as cp1252": lambda t: t.encode("cp1251").decode("cp1252"),
    "utf8 as cp1252": lambda t: t.encode().decode("cp1252", "ignore"),
    "cp1252 as mac_roman": lambda t: t.encode("cp1252").decode("mac_roman"),
}


@pytest.mark.parametrize("kind, lang", [("cp1251 as cp1252", "ru"), ("utf8 as cp1252", "fr"), ("cp1252 as mac_roman", "de")])
def test_copies_of_a_damaged_text_are_found(spark, kind, lang):
    texts, bad = corpus(400), MISREAD[kind](CLEAN[lang].replace("à", "a").replace("’", "'"))
    df = spark.createDataFrame(list(enumerate(texts + [bad] * 200)), "doc_id long, text string")
    assert {r.doc_id for r in encoding_repair.found(df).collect()} == set(range(400, 600))


@pytest.mark.parametrize("kind, lang", [("cp1251 as cp1252", "ru"), ("utf8 as cp1252", "fr"), ("cp1252 as mac_roman", "de")])
def test_a_source_damaged_throughout_is_found(spark, kind, lang):
    words, rng = CLEAN[lang].replace("à", "a").replace("’", "'").split(" "), random.Random(1)
    texts, bad = corpus(400), [MISREAD[kind](" ".join(rng.sample(words, len(words)))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + bad)), "doc_id long, text string")
    assert {r.doc_id for r in encoding_repair.found(df).collect()} == set(range(400, 440))
    long = {w for w in words if len(w) > 3}
    assert all(long <= set(r.restored_text.split(" ")) for r in encoding_repair.restore(df).collect())
