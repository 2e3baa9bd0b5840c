"""Encoding with a byte-level BPE vocabulary, whole batches at a time.

Texts of a batch become one array of code points and one of their classes. Where a piece begins follows from
the classes around it and from where its run of one class begins and ends, which prefix scans over the array
give; no pattern is matched. The pieces are then merged pair by pair, each distinct piece once per worker.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.charclass import LETTER, OTHER, SPACE, codepoints, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points that are cut at once; a longer text is cut by itself.
BLOCK = 1_000_000
#: Merged pieces that a worker keeps; beyond that it starts afresh.
CACHE = 400_000
#: Longer pieces are merged with a heap and not kept.
LONG = 48


def piece_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point. firsts: whether a text does.

    Runs of letters, of numbers and of other signs are pieces, each with one U+0020 before it if there is one. Of white
    space before such a run the last sign is a piece by itself unless it is that space; white space at the end of a
    text is one piece. An apostrophe that begins a run of signs, with s, t, m, d, re, ve or ll after it, is a piece with them.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    cls = table()[codes]
    begins = np.ones(n, bool)
    begins[1:] = (cls[1:] != cls[:-1]) | firsts[1:]
    ends = np.ones(n, bool)
    ends[:-1] = begins[1:]
    text_ends = np.ones(n, bool)
    text_ends[:-1] = firsts[1:]
    starts = begins.copy()
    tail = np.flatnonzero(ends & (cls == SPACE) & ~text_ends)
    starts[tail] = True
    starts[tail[codes[tail] == 32] + 1] = False
    # the end of the text around each place, by a scan from the right
    at = np.arange(n)
    text_end = np.minimum.accumulate(np.where(text_ends, at, n)[::-1])[::-1]
    k = np.flatnonzero(begins & starts & (codes == 39) & (cls == OTHER) & (text_end > at))
    if len(k):
        c1 = codes[k + 1]
        two = k + 2 <= text_end[k]
        c2 = np.where(two, codes[np.minimum(k + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        pair = two & (((c2 == ord("e")) & ((c1 == ord("r")) | (c1 == ord("v")))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        for which, length in ((one, 2), (pair, 3)):
            p = k[which]
            starts[p + 1] = False
            if length == 3:
                starts[p + 2] = False
            after = p + length
            after = after[after <= text_end[p]]
            starts[after[cls[after] == LETTER]] = True
    return starts


class Bpe:
    """ids of pieces by ranks of byte strings: always the pair of least rank, the leftmost of equals, is merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[str, list[int]] = {}

    @classmethod
    def parse(cls, content: bytes) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)})

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            ids = self._short(raw) if len(raw) <= LONG else self._long(raw)
            if len(raw) <= LONG:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def _short(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, where = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The same in n log n: pairs wait in a heap, and those whose parts have changed since are skipped."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that begins at i
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = ranks.get(raw[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_bytes"):
            self._bytes = {i: b for b, i in self.ranks.items()}
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "surrogatepass")


_LOADED: dict[int, Bpe] = {}


def loaded(content: bytes) -> Bpe:
    """One Bpe per worker and vocabulary."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Bpe.parse(content)
    return _LOADED[key]


def encode(texts: list[str], bpe: Bpe) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and how many each text has, then where in its text each piece begins (in code points) and how many pieces each text has."""
    joined = "".join(texts)
    codes = codepoints(joined)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    text_from = np.concatenate([[0], np.cumsum(lengths)])
    firsts = np.zeros(len(codes) + 1, bool)
    firsts[text_from] = True
    at = np.flatnonzero(piece_starts(codes, firsts[:-1]))
    stops = np.append(at[1:], len(codes)).tolist()
    known, piece = bpe.known, bpe.piece
    slices = [joined[a:b] for a, b in zip(at.tolist(), stops)]
    merged = [known.get(s) or piece(s) for s in slices]
    sizes = np.fromiter(map(len, merged), np.int64, len(merged))
    ids = np.fromiter((i for m in merged for i in m), np.int32, int(sizes.sum()))
    piece_no = np.searchsorted(at, text_from)
    total = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), np.diff(piece_no))
    return ids, np.diff(total[piece_no]), (at - text_from[owner]).astype(np.int32), np.diff(piece_no)


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[list[int]]:
    """Places of texts that aren't null, in groups of at most so many bytes."""
    group: list[int] = []
    size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if n is None:
            continue
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, empty: tuple[int, ...] = (), null: tuple[int, ...] = (), offsets: bool = False) -> DataFrame:
    """key and ids (array<int>) of each row's text, without special tokens; with offsets also starts, where each piece begins, in code points.

    Every row comes out, repeated keys too. An empty text gives the ids empty, a null one null, both with no starts.
    Special tokens' strings in a text are ordinary text. vocabulary: a file of base64 byte strings and ranks, read by the driver.
    """
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content.value)
        for batch in batches:
            texts = batch.column(1)
            special = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0)
            if len(special):
                rows = [list(empty if texts[i].is_valid else null) for i in special.tolist()]
                columns = [batch.column(0).take(pa.array(special)), pa.array(rows, pa.list_(pa.int32()))]
                yield made(columns, pa.array([[]] * len(rows), pa.list_(pa.int32())))
            for group in blocks(texts):
                group = [i for i in group if texts[i].as_py() != ""]
                if not group:
                    continue
                ids, counts, starts, pieces = encode([texts[i].as_py() for i in group], bpe)
                yield made([batch.column(0).take(pa.array(group)), _lists(counts, ids)], _lists(pieces, starts))

    def made(columns: list[pa.Array], starts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, starts] if offsets else columns, [key, "ids", "starts"] if offsets else [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", starts array<int>" * offsets)


def token_counts(df: DataFrame, *keep: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep and tokens, the number of ids of each row's text; 0 for an empty or null one."""
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content.value)
        for batch in batches:
            texts = batch.column(len(keep))
            n = np.zeros(batch.num_rows, np.int64)
            for group in blocks(texts):
                n[group] = encode([texts[i].as_py() for i in group], bpe)[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n)], [*keep, "tokens"])

    shape = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{shape}, tokens bigint")
