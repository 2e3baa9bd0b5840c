import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sedimenta.llm import likelihood, repetition
from tests.conftest import DATA


def brute(texts, n=8):
    """Scores with real n-grams in place of hashed ones."""
    grams = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in (t.split() for t in texts)]
    raw, once = Counter(g for d in grams for g in d), Counter(g for d in grams for g in set(d))
    s, b = likelihood.SMOOTH, likelihood.BUCKETS
    t, r = sum(once.values()) + s * b, sum(raw.values()) + s * b
    return [sum(math.log((once[g] + s) / t) - math.log((raw[g] + s) / r) - math.log(r / t) for g in d) / len(d) if d else 0.0 for d in grams]


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(300)]
    texts += [" ".join([*rng.choices(vocabulary, k=9)] * k) for k in (2, 3, 20)] + ["a " * 500, "", " ", "uno dos"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (900, None)], "doc_id bigint, text string").withColumns({"score": F.lit(1), "n": F.lit(2)}).repartition(5)
    got = {r["doc_id"]: r for r in likelihood.repetition_scores(df).collect()}
    want = brute(texts)
    assert len(got) == len(rows) + 1 and all(abs(got[i]["score"] - want[i]) < 1e-3 for i, _ in rows)
    assert got[900]["score"] == 0 and not got[900]["repetitive"] and got[302]["repetitive"] and got[303]["repetitive"] and got[300]["stretches"] == 11
    assert likelihood.repetition_scores(df.limit(0)).count() == 0


def test_trusted_and_raw_corpora_of_their_own(spark):
    good = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "doc_id bigint, text string")
    bad = spark.createDataFrame([(1, "buy cheap pills now buy cheap pills now here today")] * 3, "doc_id bigint, text string")
    found = likelihood.scores(good.union(bad.limit(1)), likelihood.counts(good, n=3), likelihood.counts(bad.union(good), n=3), n=3).collect()
    assert found[0]["score"] > found[1]["score"]


def test_agreement_with_exact_stretches(spark):
    """How well the score finds what exact stretches find: figures for the README, with floors."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r[0] for r in repetition.repetitive(docs).collect()}
    got = {r["doc_id"] for r in likelihood.repetition_scores(docs).filter("repetitive").collect()}
    print(f"likelihood ratio against exact stretches: recall {len(got & want) / max(len(want), 1):.3f}, precision {len(got & want) / max(len(got), 1):.3f}")
    assert len(got & want) >= 0.5 * len(want)
