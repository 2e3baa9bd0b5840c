"""Hashed n-gram likelihood ratios between a trusted and a raw corpus, for every document.

Both corpora are multinomials over hashed stretches of words. A document's score is the logarithm of how much likelier
the trusted one makes it than the raw one, per stretch, so long and short texts compare. For repetition, the trusted
corpus is the documents with each stretch counted once per document, the raw one the documents as they are: what
texts repeat within themselves weighs more in the raw corpus than in the trusted one, and a text full of it scores low.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.repetition import STRETCH, words
from sedimenta.llm.tokens import blocks
from sedimenta.session import cut

#: Buckets of hashed stretches: the model is two numbers for each, whatever the corpus.
BUCKETS = 1 << 20
#: Added to each bucket of both corpora.
SMOOTH = 0.5
#: A text of whose words 0.3 were said once before has 0.6 of its stretches twice, at ln 2 each.
THRESHOLD = -0.6 * math.log(2)


def _hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each stretch of n words, and the text it is of."""
    all_words, counts = words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(all_words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, distinct = pd.factorize(np.array(all_words, object))
    one = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[number]
    mixed = np.zeros(len(one) - n + 1, np.uint64)
    for i in range(n):
        mixed = (mixed ^ one[i : len(one) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = owner[: len(mixed)] == owner[n - 1 :]
    return (mixed[inside] % np.uint64(BUCKETS)).astype(np.int64), owner[: len(mixed)][inside]


def _each_block(column: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    for group in blocks(column):
        yield np.asarray(group), [column[i].as_py() for i in group]


def counts(df: DataFrame, text: str = "text", n: int = STRETCH, once: bool = False) -> DataFrame:
    """bucket, n: how often the stretches of each bucket stand in all texts; once: at most once per text. At most BUCKETS rows, counted within batches before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _each_block(batch.column(0)):
                bucket, owner = _hashes(texts, n)
                if once:
                    bucket = np.unique(owner * BUCKETS + bucket) % BUCKETS
                whole += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(whole[at], pa.int64())], ["bucket", "n"])

    return df.select(F.col(text).alias("_text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def ratios(target: DataFrame, raw: DataFrame) -> tuple[np.ndarray, float]:
    """log p(target) - log p(raw) of each bucket from two counts(), smoothed, and the ratio of a stretch that both have equally often."""
    both = cut(target.withColumnRenamed("n", "t").join(raw.withColumnRenamed("n", "r"), "bucket", "full").fillna(0)).toPandas()  # BUCKETS rows at most
    t, r = (np.full(BUCKETS, SMOOTH) for _ in range(2))
    t[both["bucket"]] += both["t"]
    r[both["bucket"]] += both["r"]
    return np.log(t / t.sum()) - np.log(r / r.sum()), float(np.log(r.sum() / t.sum()))


def scores(df: DataFrame, target: DataFrame, raw: DataFrame, key: str = "doc_id", text: str = "text", n: int = STRETCH) -> DataFrame:
    """key, stretches, score of each row: the mean ratio of its stretches less that of a stretch both corpora have equally often.

    target and raw: counts() of the two corpora. Texts of fewer than n words, empty and null ones have 0 stretches and a
    score of 0. Every row is scored whole, and alike whatever the others are.
    """
    ratio, level = ratios(target, raw)
    model = df.sparkSession.sparkContext.broadcast(ratio - level)  # BUCKETS numbers
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for group, texts in _each_block(batch.column(1)):
                bucket, owner = _hashes(texts, n)
                number[group] = np.bincount(owner, minlength=len(texts))
                score[group] = np.bincount(owner, model.value[bucket], minlength=len(texts)) / np.maximum(number[group], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(score)], [key, "stretches", "score"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, stretches bigint, score double")


def repetition_scores(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = STRETCH) -> DataFrame:
    """key, stretches, score, repetitive of each row, with the corpus itself as both corpora (see above)."""
    found = scores(df, counts(df, text, n, once=True), counts(df, text, n), key, text, n)
    return found.withColumn("repetitive", below(F.col("score")))


def below(score: Column) -> Column:
    """The decision about a document, the same for every corpus and run."""
    return score <= THRESHOLD
