import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import tokens
from tests.conftest import DATA

ALPHABET = [*"ab1 2'stmdrevl\n\t .,!?éL", "　", "½", "日", "😀", "́", "\x1c", "\x85", "'s", "'ll", "'re", " '", "  ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def bpe():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Bpe.parse(f.read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoded(texts, bpe):
    ids, counts, _, _ = tokens.encode(texts, bpe)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_random_texts_as_the_library(bpe, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 14))) for _ in range(5000)]
    got = encoded(texts, bpe)
    assert got == library(texts)
    assert [bpe.decode(g) for g in got] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=1), min_size=1, max_size=4))
def test_any_text_comes_back(texts):
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.loaded(f.read())
    texts = [t for t in texts if not any("\ud800" <= c <= "\udfff" for c in t)] or ["x"]
    assert [bpe.decode(g) for g in encoded(texts, bpe)] == texts


def test_long_pieces_by_heap_as_by_scan(bpe):
    rng = random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choices("abcdeñ ", k=rng.randint(1, 60))).encode()
        assert bpe._long(raw) == bpe._short(raw)
    for text in ("a" * 20000, " " * 20000 + "x", "ñ" * 9999, "ab" * 9999):
        assert bpe.decode(encoded([text], bpe)[0]) == text


def test_operator_on_awkward_rows(spark, bpe):
    rows = [(1, "Hola, ¿qué tal?"), (2, ""), (3, None), (1, "Hola, ¿qué tal?"), (None, "x"), (4, " \n"), (5, "ñ " * 60000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS ids", "'b' AS starts")
    got = tokens.token_ids(df, offsets=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows).get(r["doc_id"])
        assert r["ids"] == (encoded([text], bpe)[0] if text else [])
        starts = [*r["starts"], len(text or "")]
        assert "".join((text or "")[a:b] for a, b in zip(starts, starts[1:])) == (text or "")
    marked = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df.filter("doc_id IN (2, 3)"), empty=(7,), null=(8, 9)).collect()}
    assert marked == {2: [7], 3: [8, 9]}
    assert tokens.token_ids(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, "doc_id").collect()}[5] == len(encoded(["ñ " * 60000], bpe)[0])


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(docs).collect()}
    assert got.keys() == want.keys() and [got[k] for k in want] == library([t or "" for t in want.values()])
