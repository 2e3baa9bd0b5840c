"""Repetition inside one document.

A likelihood ratio between a target and a raw corpus scores how unlike its corpus a text is; it can't tell that a
text repeats itself, which is a matter of one text alone. So the stretches themselves are looked up: stretches of
eight words get numbers by joining numbers of neighbours three times (1, 2, 4, 8 words), without hash
collisions, and a stretch with the number of an earlier one of its document is a repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.charclass import LETTER, NUMBER, SPACE, codepoints, table
from sedimenta.llm.tokens import blocks

#: Words of a stretch; a power of two.
STRETCH = 8
#: The share of repeated words from which a document counts as repetitive, in tenths.
TENTHS = 3

# Controls that split words beside the code points with the property White_Space.
SEPARATORS = [0x1C, 0x1D, 0x1E, 0x1F]


def _kept() -> np.ndarray:
    """1 for code points that belong to words, 2 for white space, 0 for those that are deleted."""
    global _KEPT
    if _KEPT is None:
        kept = np.zeros(0x110000, np.uint8)
        classes = table()
        kept[(classes == LETTER) | (classes == NUMBER)] = 1
        kept[classes == SPACE] = 2
        kept[SEPARATORS] = 2
        _KEPT = kept
    return _KEPT


_KEPT: np.ndarray | None = None


def words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts and how many each has: lower case, all but letters, digits and white space deleted, split at white space."""
    out: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    kept = _kept()
    for i, t in enumerate(texts):
        codes = codepoints(t.lower())
        kind = kept[codes]
        plain = np.where(kind == 2, np.uint32(32), codes)[kind > 0]
        own = plain.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(" ")
        own = [w for w in own if w]
        counts[i] = len(own)
        out += own
    return out, counts


def repeated(texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its words, and how many of them lie in a stretch that also starts earlier in the text."""
    all_words, counts = words(texts)
    n = len(all_words)
    if n < stretch:
        return counts, np.zeros(len(texts), np.int64)
    number = pd.factorize(np.array(all_words, object))[0].astype(np.int64)
    width = 1
    while width < stretch:
        pair = number[: len(number) - width] * (number.max() + 1) + number[width:]
        number = pd.factorize(pair)[0].astype(np.int64)
        width *= 2
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[: len(number)] == owner[stretch - 1 :]
    at = np.flatnonzero(inside)
    again = at[pd.Series(owner[at] * (number.max() + 1) + number[at]).duplicated().to_numpy()]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + stretch, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return counts, np.bincount(owner[covered], minlength=len(texts)).astype(np.int64)


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """key, words, repeated_words and share of each row; null, empty and blank texts have 0 words and a share of 0.

    The first appearance of a stretch isn't counted as repeated, and repetitions may overlap it. A text is always
    judged whole and by itself, so rows with one key or the same text don't touch each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n, again = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for group in blocks(texts):
                n[group], again[group] = repeated([texts[i].as_py() for i in group], stretch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(again), pa.array(again / np.maximum(n, 1))], [key, "words", "repeated_words", "share"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, words bigint, repeated_words bigint, share double")


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of rows of whose words at least TENTHS tenths are repeated."""
    found = repetition(df, key, text)
    return found.filter((F.col("repeated_words") > 0) & (F.col("repeated_words") * 10 >= F.col("words") * TENTHS)).select(key)
