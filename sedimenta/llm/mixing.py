"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tokens import VOCABULARY, token_counts
from sedimenta.session import cut


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_share, source_tokens, rate: how often each source's documents are used on average.

    sizes (source, tokens) is per document. The mix is as large as the targets allow: it grows until one source is used
    max_repeats times, so every source that has tokens and a share gets that share exactly, counted over such sources alone.
    With total_tokens it is of that size: a source whose cap doesn't allow its part gives what it can, and the others keep
    their size, so shares may differ from the targets; shares() tells the actual ones.
    A source listed twice has the sum of its shares and the least of its max_repeats; null max_repeats count as 1, null and
    negative shares as 0. Sources of targets without tokens have rate 0; sources without target don't come out.
    """
    wanted = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("most"))
    per_source = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    both = wanted.filter(F.col("source").isNotNull()).join(per_source, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("most") > 0)
    both = both.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    if total_tokens is not None:
        whole = both.agg(F.sum("share")).collect()[0][0] or 1.0
        size = total_tokens / whole
    else:
        size = both.agg(F.min(F.when(usable, F.col("most") * F.col("source_tokens") / F.col("share")))).collect()[0][0]
    rate = F.when(usable, F.least(F.lit(size) * F.col("share") / F.col("source_tokens"), F.col("most").cast("double"))).otherwise(0.0)
    return both.select("source", "target_share", "source_tokens", rate.alias("rate"))


def copies(rate, key, seed: int):
    """floor(rate) copies, and one more with the probability of the rest, decided by a hash of seed and key."""
    chance = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / float(1 << 53)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("bigint")).cast("int")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, vocabulary: str = VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """source, doc_id, tokens, copies: how often each document is used; documents that aren't used don't come out.

    Sizes are tokens of the whole text. Documents without tokens or source are never used; rows with one doc_id are
    decided alike. The same seed gives the same mix, whatever the partitions.
    """
    sized = cut(token_counts(documents, "doc_id", "source", vocabulary=vocabulary).filter("tokens > 0"))
    by_source = rates(sized, targets, total_tokens).filter("rate > 0").select("source", "rate")
    used = sized.join(by_source, "source").withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return used.filter("copies > 0").select("source", "doc_id", "tokens", "copies")


def expand(mixed: DataFrame) -> DataFrame:
    """One row per use of a document: source, doc_id, tokens, copy_no from 1."""
    return mixed.select("source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, mixed_tokens, documents, most_copies, actual_share of every source of targets; actual_share is null for an empty mix."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(got, "source", "left").fillna(0, ["mixed_tokens", "documents", "most_copies"])
    total = got.agg(F.sum("mixed_tokens")).collect()[0][0]
    return both.select("source", "target_share", "mixed_tokens", "documents", "most_copies", (F.col("mixed_tokens") / F.lit(total)).alias("actual_share"))
