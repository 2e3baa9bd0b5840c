"""Queries of the problems on texts, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import encoding, likelihood, mixing, repetition, tokens


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return encoding.page_values(table(spark, d, "raw_pages")).unionByName(encoding.item_values(table(spark, d, "items")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(_values(spark, d), restore=False).select("table_name", "row_id", "field")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(_values(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), offsets=True)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.expand(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return likelihood.repetition_scores(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p7_ids, p7_offsets, p8_mix, p8_shares, p9_found, p9_shares, p9_scores)}

_WHITE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STRETCHES = rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}{_WHITE}]', '', 'g'), '[{_WHITE}]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS stretch FROM w, unnest(generate_series(1, len(ws) - 7)) AS t(i)),
    d AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, stretch ORDER BY i) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS again FROM d, unnest(generate_series(0, 7)) AS t(k) GROUP BY doc_id),
    s AS (SELECT w.doc_id, len(ws) AS words, coalesce(again, 0) AS repeated_words FROM w LEFT JOIN c USING (doc_id))"""
ORACLES = {
    "p9_found": f"{_STRETCHES} SELECT doc_id FROM s WHERE repeated_words > 0 AND repeated_words * 10 >= words * 3",
    "p9_shares": f"{_STRETCHES} SELECT doc_id, words, repeated_words, repeated_words / greatest(words, 1) AS share FROM s",
}
