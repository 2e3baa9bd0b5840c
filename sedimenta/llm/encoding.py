"""Text that was decoded with a wrong code page: which values, and what they said.

A swap of code pages is a substitution cipher: the bytes of a letter come out as other signs. The cipher signs
that swaps of known code pages can produce, and the letters each may stand for, follow from the code pages. Which
of them a sign stands for in a source, or whether it stands for itself, is learned by expectation-maximization:
the E step weighs the letters of each sign in its context by bigrams of letters (and by the pair of neighbours
where that was seen), the M step counts the letters anew. Contexts are counted per source first, so an iteration
works on counts, not on texts. A sign that no known swap produces, and that no Latin word has, may stand for any
letter: which one is learned per source from bigrams of letters alone (unknown()). The mapping is then applied with translate(), in the notation the sign was written in; all else of a text stays as it is.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut

# Code pages that a decoder may have used, and those that texts are written in beside UTF-8.
READ_AS = ["cp1252", "latin-1", "cp1251", "mac_roman", "cp850", "cp437"]
WRITTEN_IN = ["cp1252", "mac_roman", "cp850"]
# Code points that texts may have meant, first those of deep chains of errors.
COMMON = [*range(0xA0, 0x180), *range(0x2013, 0x2027), 0x20AC, 0x2122]
MEANT = [*COMMON, *range(0x218, 0x21C), *range(0x384, 0x3D0), *range(0x400, 0x460), *range(0x2200, 0x2270), *range(0x2500, 0x25A0), 0xFFFD]
LOST = "�"

#: Rounds of EM over the counts.
ROUNDS = 4
#: How much the mapping of all sources counts against that of one, in signs.
SHRINK = 5.0
#: The weight of pairs of neighbours against bigrams.
PAIRED = 0.7
#: Sources and mapped signs up to which the mappings are broadcast.
BROADCAST_ROWS = 100_000

#: Rows of the model that come to the driver at once; a larger one comes partition by partition, and is the same.
MODEL_ROWS = 2_000_000
#: Copies of each mapping where mappings are too many to be broadcast: the texts of a large source spread over as many tasks.
SALTS = 32

# Code pages under which texts of any script are looked for.
ANY_SCRIPT = ["cp1252", "latin-1", "cp1251"]
# Characters of references and escapes.
NOTED = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}")

#: Occurrences of a sign between letters from which it may be one of an unknown swap, and the share of one letter that decides.
UNKNOWN_LEAST, UNKNOWN_SHARE = 30, 0.75
#: By how much, in nats for each occurrence, the letter must fit better than the sign itself.
UNKNOWN_GAIN = 2.0

RUN = re.compile(r"[^\x00-\x7f]+")


def _page(name: str) -> list[str]:
    """The sign of each byte; where a code page has none, the control of that number."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


@functools.cache
def swaps() -> list[dict[str, str]]:
    """For each pair of single-byte code pages, the letter that each sign stands for."""
    pairs = [(_page(a), _page(b)) for a in WRITTEN_IN for b in READ_AS if a != b]
    return [{b[i]: a[i] for i in range(128, 256) if a[i] != b[i] and ord(a[i]) in COMMON and b[i] != "\x85"} for a, b in pairs]


@functools.cache
def kept_by() -> list[set[str]]:
    """For each pair of single-byte code pages, the signs that both have in one place."""
    pairs = [(_page(a), _page(b)) for a in WRITTEN_IN for b in READ_AS if a != b]
    return [{x for x, y in zip(a[128:], b[128:]) if x == y} for a, b in pairs]


@functools.cache
def ciphers() -> tuple[dict[str, tuple[str, ...]], int]:
    """The letters each cipher sign may stand for, by all chains of up to three errors; the length of the longest sign."""
    pages = [_page(p) for p in READ_AS]

    def misread(text: str) -> list[str]:
        raw = text.encode("utf-8")
        return list({"".join(p[b] for b in raw) for p in pages})

    signs: dict[str, set[str]] = defaultdict(set)
    deep = set(COMMON)
    for code in MEANT:
        letter = chr(code)
        level = [letter]
        for depth in range(3 if code in deep else 2):
            level = [s for t in level for s in misread(t)]
            for s in level:
                signs[s].add(letter)
    for swap in swaps():
        for sign, letter in swap.items():
            signs[sign].add(letter)
    return {s: tuple(sorted(x - {s})) for s, x in signs.items() if x - {s}}, max(map(len, signs))


@functools.cache
def _bytes_of(page: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_page(page)) if b > 127}


def any_script(run: str, i: int) -> tuple[int, str] | None:
    """The end and the character of UTF-8 that begins at place i of a run, read by one of ANY_SCRIPT: of any assigned code point of three or four bytes, or a letter of two."""
    for page in ANY_SCRIPT:
        codes = _bytes_of(page)
        lead = codes.get(run[i], 0)
        n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if n and i + n <= len(run):
            try:
                c = bytes(codes.get(x, 0) for x in run[i : i + n]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            kind = unicodedata.category(c) if len(c) == 1 else "Cn"
            if kind[0] == "L" or (n > 2 and kind not in ("Cn", "Co", "Cs", "Cc")):
                return i + n, c
    return None


@functools.lru_cache(200_000)
def signs_of(run: str) -> tuple[str, ...]:
    """A run of signs beyond ASCII, cut into cipher signs, the longest first, and single signs.

    Signs of other scripts count if two stand side by side, or for a character of four bytes.
    """
    known, longest = ciphers()
    out, i, n = [], 0, len(run)
    while i < n:
        for j in range(min(n, i + longest), i + 1, -1):
            if run[i:j] in known:
                break
        else:
            j = i + 1
            one = any_script(run, i)
            if one is not None and (one[0] - i == 4 or foreign(out[-1]) is not None if out else one[0] - i == 4):
                j = one[0]
            elif one is not None and one[0] < n and any_script(run, one[0]) is not None:
                j = one[0]
        out.append(run[i:j])
        i = j
    return tuple(out)


@functools.lru_cache(50_000)
def foreign(sign: str) -> str | None:
    """The character of another script that a sign of several characters stands for, if it isn't one of ciphers()."""
    if len(sign) < 2 or sign in ciphers()[0]:
        return None
    found = any_script(sign, 0)
    return found[1] if found is not None and found[0] == len(sign) else None


def resolved(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """text with character references of HTML and \\u escapes resolved, and for each of them: its place and length there, and how it was written."""
    if "&" not in text and "\\u" not in text:
        return text, []
    out: list[str] = []
    pieces: list[tuple[int, int, str]] = []
    last = size = 0
    for m in NOTED.finditer(text):
        raw = m[0]
        said = html.unescape(raw) if raw[0] == "&" else raw.encode("ascii").decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if said != raw:
            size += m.start() - last
            out += [text[last : m.start()], said]
            pieces.append((size, len(said), raw))
            size += len(said)
            last = m.end()
    return "".join([*out, text[last:]]), pieces


def plain(text: str) -> str:
    return resolved(text)[0]


def notated(letter: str, like: str) -> str:
    """A letter written as like is: as a reference by number or name, or as an escape."""
    if like.startswith("\\u"):
        units = letter.encode("utf-16-be")
        return "".join(f"\\u{units[i]:02x}{units[i + 1]:02x}" for i in range(0, len(units), 2))
    if like[1:3].lower() == "#x":
        return f"&#{like[2]}{ord(letter):X};"
    name = None if like[1] == "#" else html.entities.codepoint2name.get(ord(letter))
    return f"&{name};" if name else f"&#{ord(letter)};"


def rendered(text: str, pieces: list[tuple[int, int, str]]) -> str:
    """A resolved text with its pieces written as they were."""
    out, last = [], 0
    for at, n, raw in pieces:
        out += [text[last:at], raw]
        last = at + n
    return "".join([*out, text[last:]])


def amended(text: str, pieces: list[tuple[int, int, str]], changes: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """text and its pieces once each span (a, b) of changes says what it names; what was written as a reference or escape is so again."""
    out: list[str] = []
    kept: list[tuple[int, int, str]] = []
    last = size = k = 0
    for a, b, said in changes:
        while k < len(pieces) and pieces[k][0] + pieces[k][1] <= a:
            kept.append((pieces[k][0] + size - last, *pieces[k][1:]))
            k += 1
        size += a - last
        out += [text[last:a], said]
        if k < len(pieces) and pieces[k][0] < b:
            like = pieces[k][2]
            kept += [(size + i, 1, notated(c, like)) for i, c in enumerate(said) if ord(c) > 127]
            while k < len(pieces) and pieces[k][0] < b:
                k += 1
        size += len(said)
        last = b
    kept += [(at + size - last, n, raw) for at, n, raw in pieces[k:]]
    return "".join([*out, text[last:]]), kept


@functools.cache
def candidates() -> frozenset[str]:
    """Cipher signs, and the letters they may stand for: a fixed alphabet, whatever the texts."""
    known = ciphers()[0]
    return frozenset(known) | frozenset(x for letters in known.values() for x in letters)


@functools.lru_cache(20_000)
def fold(c: str) -> str:
    """A neighbour as one of some 150 sides: ASCII as it is, letters with marks by their base letter, the rest by category."""
    if len(c) != 1 or c < "\x80":
        return c if len(c) <= 1 else "\x02"
    base = unicodedata.normalize("NFKD", c)[0]
    return "\x04" + base if base < "\x80" and base.isalpha() else "\x03" + unicodedata.category(c)[0]


@functools.lru_cache(20_000)
def fold_more(c: str) -> str:
    """fold() with punctuation left out, and of letters with marks all but the case: FEW_SIDES sides at most. The sides of the model, whatever its size."""
    c = fold(c)
    if c[:1] == "\x04":
        return "\x04A" if c[1:].isupper() else "\x04a"
    return c if c.isalpha() or c in ("", " ", "0") or c[0] == "\x03" else "."


#: Sides of fold_more(): 52 letters of ASCII, 7 categories and their mark, letters with marks of either case, "", " ", "0" and ".".
FEW_SIDES = 66


def _side(c: str) -> str:
    """An ASCII neighbour: digits and white space are alike, the edge of a text is ''."""
    return "0" if c.isdigit() else " " if c.isspace() else c


def _near(c: str) -> str:
    """A neighbour beyond the candidates by its category alone, so contexts are of fixed alphabets but for single signs in their midst."""
    return c if c <= "\x7f" or c in candidates() else fold(c)


def contexts(text: str) -> Iterator[tuple[str, str, str]]:
    """The runs beyond ASCII of a resolved text, with the signs before and after."""
    n = len(text)
    for m in RUN.finditer(text):
        a, b = m.span()
        yield (text[a - 1] if a else "", m[0], text[b] if b < n else "")


def spread(left: str, run: str, right: str) -> list[tuple[str, str, str]]:
    """Each sign of a run with its neighbours."""
    signs = signs_of(run)
    sides = (_side(left), *signs, _side(right))
    return [(sides[i], s, sides[i + 2]) for i, s in enumerate(signs)]


class Model:
    """What signs stand for (mapping), and counts of letters between sides: left (side before, letter), right (letter, side after), pair (side, letter, side).

    side: the class of a neighbour.
    """

    def __init__(self, mapping: dict[str, dict[str, float]], left: dict, right: dict, pair: dict, side=fold_more):
        self.mapping, self.left, self.right, self.pair, self.side = mapping, left, right, pair, side
        self.total: dict[str, float] = defaultdict(float)
        for (letter, _), n in right.items():
            self.total[letter] += n

    def options(self, sign: str, own: dict[str, dict[str, float]] | None = None) -> list[tuple[str, float]]:
        """The letters of a sign, itself first, with their shares in the source (own) or in all."""
        known = ciphers()[0].get(sign)
        if not known:
            learned = (own or {}).get(sign)
            return list(learned.items()) if learned else [(sign, 1.0)]
        shares = (own or {}).get(sign) or self.mapping.get(sign)
        if shares is None:
            # a sign of several characters hardly ever stands for itself
            itself = 0.1 if len(sign) > 1 else 0.5
            return [(sign, itself), *((x, (1 - itself) / len(known)) for x in known)]
        return [(x, shares.get(x, 0.0)) for x in (sign, *known)]

    def sides(self, neighbour: str, own: dict[str, dict[str, float]] | None = None) -> dict[str, float]:
        """The sides that a neighbour may be, with their shares."""
        out: dict[str, float] = defaultdict(float)
        for x, p in self.options(neighbour, own):
            out[self.side(x)] += p
        return out

    def weigh(self, before: str, sign: str, after: str, own: dict[str, dict[str, float]] | None = None) -> list[tuple[str, float, str, str]]:
        """The E step for one context: letter, probability, and the likeliest sides before and after it."""
        lefts, rights = self.sides(before, own), self.sides(after, own)
        found = []
        for letter, share in self.options(sign, own):
            if share <= 1e-6:
                continue
            best, who = -1.0, (self.side(before), self.side(after))
            total = self.total.get(letter, 0.0)
            for x, p in lefts.items():
                for y, q in rights.items():
                    two = self.left.get((x, letter), 0.0) * self.right.get((letter, y), 0.0) / (total or 1.0)
                    s = p * q * ((1 - PAIRED) * two + PAIRED * self.pair.get((x, letter, y), 0.0) + 1e-7 * total + 1e-12)
                    if s > best:
                        best, who = s, (x, y)
            found.append((letter, share * best, *who))
        whole = sum(f[1] for f in found)
        return [(f[0], f[1] / whole, f[2], f[3]) for f in found]


def _first(before: str, sign: str, after: str) -> list[tuple[str, float, str, str]]:
    """The first E step: a single sign stands for itself, one of several characters mostly for a letter; neighbours for themselves."""
    none = Model({}, {}, {}, {})
    options = [(sign, 1.0)] if len(sign) == 1 else none.options(sign)
    return [(x, p, none.side(before), none.side(after)) for x, p in options]


def count_contexts(values: DataFrame) -> DataFrame:
    """source, before, sign, after, n: how often each sign beyond ASCII stands between its neighbours in the values (source, text) of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.update((source, *c) for c in contexts(plain(text.as_py())))
            out: Counter = Counter()
            for (source, *c), n in seen.items():
                for before, sign, after in spread(*c):
                    if sign in candidates() or len(sign) == 1:
                        out[source, _near(before), sign, _near(after)] += n
            keys = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(out.values()), pa.int64())], ["source", "before", "sign", "after", "n"])

    parts = values.select("source", "text").mapInArrow(run, "source string, before string, sign string, after string, n bigint")
    return parts.groupBy("source", "before", "sign", "after").agg(F.sum("n").alias("n"))


def _m_step(counts: DataFrame, model) -> Model:
    """One round of EM over counts (before, sign, after, n) of cipher signs and their letters; model: a broadcast Model, or None for the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, str, str, str], float] = defaultdict(float)
        for batch in batches:
            for before, sign, after, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sign not in candidates():
                    continue
                for letter, p, x, y in model.value.weigh(before, sign, after) if model is not None else _first(before, sign, after):
                    if p > 1e-4:
                        w = n * p
                        out["l", x, letter, ""] += w
                        out["r", letter, y, ""] += w
                        if len(letter) == 1:
                            out["p", x, letter, y] += w
                        if model is not None and sign in ciphers()[0]:
                            out["m", sign, letter, ""] += w
        keys = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(out.values()), pa.float64())], ["kind", "a", "b", "c", "w"])

    parts = counts.select("before", "sign", "after", "n").mapInArrow(run, "kind string, a string, b string, c string, w double")
    rows = cut(parts.groupBy("kind", "a", "b", "c").agg(F.sum("w").alias("w")))
    # letters are of candidates() and sides of FEW_SIDES classes, so what comes to the driver has a bound whatever the texts
    tables: dict[str, dict] = {k: {} for k in "lrpm"}
    for kind, a, b, c, w in rows.toPandas().itertuples(index=False) if rows.count() <= MODEL_ROWS else rows.toLocalIterator():
        tables[kind][(a, b, c) if kind == "p" else (a, b)] = w
    mapping: dict[str, dict[str, float]] = defaultdict(dict)
    for (sign, letter), w in tables["m"].items():
        mapping[sign][letter] = w
    mapping = {s: {x: w / sum(m.values()) for x, w in m.items()} for s, m in mapping.items()}
    return Model(mapping, tables["l"], tables["r"], tables["p"])


def learn(counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all sources from count_contexts(), by the same sides for tables of any size."""
    pooled = counts.filter(F.length("sign") > 0).groupBy("before", "sign", "after").agg(F.sum("n").alias("n"))
    pooled = cut(pooled)
    sc = counts.sparkSession.sparkContext
    model = _m_step(pooled, None)
    for _ in range(rounds):
        model = _m_step(pooled, sc.broadcast(model))
    return model


def _latin(sign: str) -> bool:
    return unicodedata.name(sign, "").startswith(("LATIN", "MODIFIER LETTER")) or unicodedata.category(sign) in ("Cf", "Co", "Pd", "Mn", "Mc", "Zs", "Zl", "Zp") or sign == LOST


def decipher(contexts: list[tuple[str, str, float]], model: Model) -> tuple[str, float] | None:
    """The letter that a sign with these contexts (before, after, n) stands for, and its share, by EM over all letters beyond ASCII that the model knows; None if none fits.

    A sign of a cipher has the neighbours of its letter: it must have them within UNKNOWN_GAIN nats of the letter's own, and
    fit by that much better than what stands anywhere.
    """
    letters = [x for x in model.total if len(x) == 1 and x > "\x7f" and unicodedata.name(x, "").startswith("LATIN") and model.total[x] >= UNKNOWN_LEAST]
    if not letters:
        return None
    sides = sorted({model.side(c) for b, a, _ in contexts for c in (b, a)})
    n = np.array([w for _, _, w in contexts])
    at = {s: i for i, s in enumerate(sides)}
    whole = np.array([model.total[x] for x in letters])
    left = np.array([[model.left.get((s, x), 0.0) + 0.02 for s in sides] for x in letters]) / (whole + 2)[:, None]
    right = np.array([[model.right.get((x, s), 0.0) + 0.02 for s in sides] for x in letters]) / (whole + 2)[:, None]
    like = left[:, [at[model.side(b)] for b, _, _ in contexts]] * right[:, [at[model.side(a)] for _, a, _ in contexts]]
    share = np.full(len(letters), 1 / len(letters))
    for _ in range(30):
        post = share[:, None] * like
        post /= post.sum(axis=0)
        share = (post * n).sum(axis=1) / n.sum()
    best = int(share.argmax())
    anywhere = (left * whole[:, None]).sum(axis=0)[[at[model.side(b)] for b, _, _ in contexts]] * (right * whole[:, None]).sum(axis=0)[[at[model.side(a)] for _, a, _ in contexts]] / whole.sum() ** 2
    fit = float((n * np.log(like[best])).sum() / n.sum())
    gain = fit - float((n * np.log(anywhere)).sum() / n.sum())
    p = n / n.sum()
    surprise = float((p * np.log(p)).sum()) - fit  # how unlike the letter's neighbours the sign's are
    return (letters[best], float(share[best])) if share[best] >= UNKNOWN_SHARE and gain > 0 and surprise <= UNKNOWN_GAIN else None


def unknown(counts: DataFrame, model) -> DataFrame:
    """source, sign, letter, w: what signs that no known swap produces stand for in a source, learned from bigrams of letters alone.

    Only signs that Latin words don't have, with UNKNOWN_LEAST occurrences next to letters of ASCII in the source, a fourth of
    them between two. The contexts of a sign are of a few sides, so each group has a bound.
    """
    letter = lambda c: F.col(c).rlike("^[A-Za-z]$")
    plain_side = lambda c: F.col(c).rlike("^[A-Za-z ]?$")
    near = counts.filter((F.length("sign") == 1) & plain_side("before") & plain_side("after") & (letter("before") | letter("after")))
    each = near.groupBy("source", "sign").agg(F.collect_list(F.struct("before", "after", F.col("n").cast("double").alias("n"))).alias("c"), F.sum("n").alias("n"), F.sum(F.when(letter("before") & letter("after"), F.col("n")).otherwise(0)).alias("m"))
    each = each.filter((F.col("n") >= UNKNOWN_LEAST) & (F.col("m") * 4 >= F.col("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, sign, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if sign not in ciphers()[0] and not _latin(sign):
                    said = decipher([(c["before"], c["after"], c["n"]) for c in found.as_py()], model.value)
                    if said is not None:
                        out.append((source, sign, said[0], 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.string(), pa.string(), pa.float64()))], ["source", "sign", "letter", "w"])

    return each.select("source", "sign", "c").mapInArrow(run, "source string, sign string, letter string, w double")


def source_mappings(counts: DataFrame, model) -> DataFrame:
    """source, mapping: for each source the share of each letter of each cipher sign it has, drawn towards the model of all.

    mapping is JSON text, {sign: {letter: share}}, of signs that may stand for another letter in this source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = model.value.weigh
        for batch in batches:
            out: dict[tuple[str, str, str], float] = defaultdict(float)
            for source, before, sign, after, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for letter, p, _, _ in weigh(before, sign, after):
                    if p > 1e-4:
                        out[source, sign, letter] += n * p
            keys = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(out.values()), pa.float64())], ["source", "sign", "letter", "w"])

    doubtful = [s for s, m in model.value.mapping.items() if sum(w for x, w in m.items() if x != s) > 1e-6]
    signs = counts.sparkSession.createDataFrame([(s,) for s in doubtful], "sign string")  # of a fixed alphabet
    parts = counts.join(F.broadcast(signs), "sign", "left_semi").select("source", "before", "sign", "after", "n")
    parts = parts.mapInArrow(run, "source string, sign string, letter string, w double")
    each = parts.groupBy("source", "sign", "letter").agg(F.sum("w").alias("w")).unionByName(unknown(counts, model))
    # signs of a fixed alphabet, so a source's list has a bound
    return each.groupBy("source").agg(F.to_json(F.collect_list(F.struct("sign", "letter", "w"))).alias("mapping"))


def _own(mapping: str | None, model: Model) -> dict[str, dict[str, float]]:
    """Shares of one source from its mapping, drawn towards all sources'."""
    seen: dict[str, dict[str, float]] = defaultdict(dict)
    for e in json.loads(mapping) if mapping else []:
        seen[e["sign"]][e["letter"]] = e["w"]
    out = {}
    for sign, had in seen.items():
        if sign not in ciphers()[0]:
            out[sign] = had
            continue
        n, common = sum(had.values()), model.mapping.get(sign, {})
        out[sign] = {x: (had.get(x, 0.0) + SHRINK * common.get(x, 0.0)) / (n + SHRINK) for x in {*had, *common}}
    return out


def _pairs(text: str, a: int, b: int, said: str) -> tuple[set[int], bool]:
    """The swaps that explain said for text[a:b] and don't contradict the rest of the word, and whether a letter of said stands beside a letter."""
    start, end = a, b
    while start > 0 and (text[start - 1].isalpha() or ord(text[start - 1]) > 127 and not text[start - 1].isspace()):
        start -= 1
    while end < len(text) and (text[end].isalpha() or ord(text[end]) > 127 and not text[end].isspace()):
        end += 1
    changed = [(x, y) for x, y in zip(text[a:b], said) if x != y]
    others = {c for c in text[start:a] + text[b:end] if ord(c) > 127}
    fit = {i for i, s in enumerate(swaps()) if all(s.get(x) == y for x, y in changed) and all(c in s or c in kept_by()[i] for c in others)}
    beside = [*said, text[a - 1] if a else " ", text[b] if b < len(text) else " "]
    return fit, any(y.isalpha() for _, y in changed) and sum(c.isalpha() for c in beside) > 1


class Reader:
    """Decides about the runs of one source."""

    def __init__(self, model: Model, own: dict[str, dict[str, float]]):
        self.model, self.own = model, own
        self.learned = {s for s in own if s not in ciphers()[0]}
        self.known: dict[tuple[str, str, str], str | None] = {}
        self.minded: dict[int, Reader] = {}

    def repaired(self, left: str, run: str, right: str) -> str | None:
        """What the run said, if any of its signs was a cipher; None if not. Signs that are lost stay."""
        key = (_side(left), run, _side(right))
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            signs = spread(left, run, right)
            said, wrong = [], LOST in run
            for before, sign, after in signs:
                if (char := foreign(sign)) is not None:
                    wrong = True
                    said.append(char)
                elif sign in ciphers()[0] or sign in self.learned:
                    letter, p, _, _ = max(self.model.weigh(before, sign, after, self.own), key=lambda f: f[1])
                    wrong |= letter != sign
                    said.append(letter)
                else:
                    said.append(sign)
            self.known[key] = self._translated([s[1] for s in signs], said) if wrong else None
        return self.known[key]

    @staticmethod
    def _translated(signs: list[str], said: list[str]) -> str:
        """Signs as private code points, translated into letters."""
        code = {s: 0xF0000 + i for i, s in enumerate(dict.fromkeys(zip(signs, said)))}
        table = {v: k[1] for k, v in code.items()}
        return "".join(chr(code[pair]) for pair in zip(signs, said)).translate(table)

    def readings(self, text: str) -> list[tuple[int, int, str]]:
        """Where the text was read wrongly, and what it said there.

        A sign of several characters, or U+FFFD, is proof by itself. A swap of single signs must put a letter beside a
        letter, and one pair of code pages must explain all signs of the word; where a text has such a swap, other
        swaps by that pair count too.
        """
        found, weak, proven = [], [], set()
        for m in RUN.finditer(text):
            a, b = m.span()
            said = self.repaired(text[a - 1] if a else "", m[0], text[b] if b < len(text) else "")
            if said is None:
                continue
            if LOST in m[0] or len(said) != len(m[0]):
                found.append((a, b, said))
                continue
            if self.learned and any(x in self.learned and x != y for x, y in zip(m[0], said)):
                if (a and text[a - 1].isalpha()) or text[b : b + 1].isalpha():
                    found.append((a, b, said))
                continue
            pairs, within = _pairs(text, a, b, said)
            if pairs and within:
                found.append((a, b, said))
                proven |= pairs
            else:
                weak.append((a, b, said, pairs))
        return sorted(found + [(a, b, said) for a, b, said, pairs in weak if pairs & proven])

    def wrong(self, text: str) -> bool:
        return bool(self.readings(text))

    def restored(self, text: str, pieces: list[tuple[int, int, str]] = (), rounds: int = 12) -> str:
        """The resolved text with all that was read wrongly put right, as far as it can be, and its pieces written as they were.

        Where single signs of a text were swapped, its other signs are weighed again with that swap in mind. Each round peels
        off up to three errors of a chain, and ends the search where it changes nothing.
        """
        reader, pieces = self, list(pieces)
        for _ in range(rounds):
            changes, swapped = [], Counter()
            for a, b, said in reader.readings(text):
                if said != text[a:b]:
                    changes.append((a, b, said))
                    if len(said) == b - a:
                        swapped.update(_pairs(text, a, b, said)[0])
            if not changes:
                break
            text, pieces = amended(text, pieces, changes)
            reader = self._minded(max(swapped, key=lambda i: (swapped[i], -i))) if swapped else self
        return rendered(text, pieces)

    def _minded(self, swap: int) -> Reader:
        if swap not in self.minded:
            self.minded[swap] = Reader(self.model, self.own | {s: {x: 0.9, s: 0.1} for s, x in swaps()[swap].items()})
        return self.minded[swap]


def repair(values: DataFrame, restore: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """The values (table_name, row_id, field, source, text) with at least one sign that a wrong decoding produced, and restored.

    restored is the text put right where the original can be had, letters that were written as references or escapes so again,
    all else as it stands; what a decoder replaced by U+FFFD is lost and stays. It is null unless restore. Null and empty
    texts never come out; a null source is one source.
    """
    spark = values.sparkSession
    values = values.filter(F.col("text").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    counts = cut(count_contexts(values))
    model = spark.sparkContext.broadcast(learn(counts, rounds))
    maps = cut(source_mappings(counts, model))
    few = maps.count() <= BROADCAST_ROWS
    if few:
        joined = values.join(F.broadcast(maps), "source", "left")
    else:  # a source may hold a third of all texts
        maps = maps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("table_name", "row_id", "field", "text"), F.lit(SALTS)).cast("int")
        joined = values.withColumn("_salt", salt).join(maps, ["source", "_salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        names = ["table_name", "row_id", "field"]
        for batch in batches:
            kept: list[int] = []
            texts: list[str | None] = []
            sources, maps_ = batch.column(3).to_pylist(), batch.column(5)
            for i, source in enumerate(sources):
                reader = readers.get(source)
                if reader is None:
                    if len(readers) > 2_000:
                        readers.clear()
                    reader = readers[source] = Reader(model.value, _own(maps_[i].as_py(), model.value))
                text, pieces = resolved(batch.column(4)[i].as_py())
                if reader.wrong(text):
                    kept.append(i)
                    texts.append(reader.restored(text, pieces) if restore else None)
            rows = batch.select([0, 1, 2]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*names, "restored"])

    columns = joined.select("table_name", "row_id", "field", "source", "text", "mapping")
    return columns.mapInArrow(run, "table_name string, row_id bigint, field string, restored string")


def page_values(raw_pages: DataFrame) -> DataFrame:
    """The html of pages as values; the source is the host of the url."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/:?#]+)", 1)
    dirty = F.col("html").rlike(r"[^\x00-\x7F]|&|\\u")
    return raw_pages.filter(dirty).select(F.lit("raw_pages").alias("table_name"), F.col("page_id").alias("row_id"), F.lit("html").alias("field"), host.alias("source"), F.col("html").alias("text"))


def item_values(items: DataFrame) -> DataFrame:
    """The top-level values of data that are or hold strings; data that is no JSON object has none."""
    parsed = items.filter(F.col("data").rlike(r"[^\x00-\x7F]|&|\\u")).select("id", "site", F.try_parse_json("data").alias("_v"))
    listed = parsed.lateralJoin(items.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "field", "value"))
    text = F.to_json("value")
    listed = listed.filter(F.col("field").isNotNull()).select("id", "site", "field", text.alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7F]|&|\\u"))
    return listed.select(F.lit("items").alias("table_name"), F.col("id").alias("row_id"), "field", F.col("site").alias("source"), "text")
