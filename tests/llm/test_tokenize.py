import random

import pytest

from graphweft.llm import tokenize

TEXTS = [None, "", " ", "  \n ", "a", "don't 'sabc 'llx''s \n's I'VE we've it's's", "aaaa aaaaaaaa", "  x\t\ty  \r\n z ", "Ünïcode ½² ٣٤ 日本語 ՘   x ﻿�", "<|endoftext|> hi", "x" * 50000, "a\0b\0", "😀👍🏽 é", "'", " '", "\n'", "12345 67,8 !?. (a)b", " " * 300 + "end", "end" + " " * 300]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


def test_against_library(spark, reference):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenize.encode(df).collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)


def test_random(reference):
    rng = random.Random(1)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "the", "The", "abc", "é", "1", "42", "!", "...", "я", " ", "'re", "ve", "’s", "\0", "ſ", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    with open(tokenize.DEFAULT_TOKENIZER, "rb") as f:
        e = tokenize.Encoder(f.read())
    ids, n = e.encode(texts)
    out, at = [], 0
    for k in n.tolist():
        out.append(ids[at : at + k].tolist())
        at += k
    assert out == reference(texts)


def test_pool_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(tokenize, "WORDS", 10)
    with open(tokenize.DEFAULT_TOKENIZER, "rb") as f:
        e = tokenize.Encoder(f.read())
    for text in ("one two three four five six", "seven eight nine ten eleven twelve thirteen", "one seven"):
        assert e.encode([text])[0].tolist() == reference([text])[0]


def test_empty_table(spark):
    assert tokenize.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
