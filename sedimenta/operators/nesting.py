"""Flat, linked tables from deeply nested JSON, by structural indexing over whole batches.

A batch of bodies is one array of bytes. Bitmaps mark quotes that no backslash escapes, and from their parity
what lies inside strings; brackets, colons and commas outside strings give the structure. Depth is a prefix
sum over the brackets; sorting them by (depth, place) pairs each opening bracket with its end, so spans of
nodes come out without parsing values. The same arrays tell whether a body is JSON at all: each token must be one
that its neighbour and its enclosing bracket allow. Only names of nodes, and what else is asked for, are decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The levels of a listing and the member that names a node of each.
LEVELS = {"diario": "numero", "seccion": "codigo", "departamento": "codigo", "epigrafe": "nombre", "item": "identificador", "anexo": "ref"}

NODES = "node_id string, parent_id string, node_level string, name string, depth int, ordinal int, node_path string, node_json string, fields map<string,string>"
#: Bytes of text that are indexed at once; a longer body is indexed by itself.
BLOCK = 8_000_000

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[0x5B, 0x7B]] = _CLOSE[[0x5D, 0x7D]] = True
_STRUCT = np.zeros(256, bool)
_STRUCT[[0x5B, 0x5D, 0x7B, 0x7D, 0x3A, 0x2C]] = True


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_PLAIN = ~(_SPACE | _STRUCT)
_PLAIN[0x22] = False
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
SCALAR = re.compile(rb"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null")
LONE = re.compile("[\ud800-\udfff]")
#: Kinds of tokens beside structural bytes: a string, another scalar, the end of a body.
_STRING, _VALUE, _END = 0x22, 0x30, 0x0A


def _escapes(raw: np.ndarray) -> np.ndarray:
    """Places of backslashes that begin an escape: the first, third ... of each run."""
    back = np.flatnonzero(raw == 0x5C)
    first = np.diff(back, prepend=-2) != 1
    run = np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))
    return back[(np.arange(len(back)) - run) % 2 == 0]


def _quotes(raw: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Places of quotes that no escape covers."""
    quote = raw == 0x22
    quote[np.minimum(escapes + 1, len(raw) - 1)] = False
    return np.flatnonzero(quote)


def _per_body(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, at, side="right") - 1


@dataclass
class Scan:
    """Bodies joined, each ended by a line feed: the bytes, where each starts, which are JSON, and of those the places of the quotes that delimit strings and of structural bytes outside strings."""

    joined: bytes
    raw: np.ndarray
    starts: np.ndarray
    good: np.ndarray
    quotes: np.ndarray
    struct: np.ndarray


def scan(bodies: list[bytes]) -> Scan:
    """Bitmaps of all bodies at once. One with odd quotes or brackets would shift what follows, so it is blanked before the next step."""
    lengths = np.fromiter((len(b) + 1 for b in bodies), np.int64, len(bodies))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    joined = b"\n".join(bodies) + b"\n" if bodies else b""
    raw = np.frombuffer(joined, np.uint8).copy()
    ends = starts + lengths - 1
    good = np.ones(len(bodies), bool)

    def without(at: np.ndarray) -> np.ndarray:
        return at[good[_per_body(at, starts)]]

    def blank(bad: np.ndarray) -> None:
        good[bad] = False
        for i in bad.tolist():
            raw[starts[i] : ends[i]] = 0x20

    escapes = _escapes(raw)
    quotes = _quotes(raw, escapes)
    odd = np.bincount(_per_body(quotes, starts), minlength=len(starts)) % 2 == 1
    odd[_per_body(escapes[np.isin(escapes + 1, ends)], starts)] = True  # an escape of the line feed after the body
    odd[_per_body(np.flatnonzero(raw == 0), starts)] = True
    blank(np.flatnonzero(odd))
    quotes, escapes = without(quotes), without(escapes)
    edge = np.zeros(len(raw), np.int8)
    edge[quotes[0::2]], edge[quotes[1::2]] = 1, -1
    inside = np.cumsum(edge, dtype=np.int8).view(bool)  # from the opening quote up to before the closing one
    struct = np.flatnonzero(_STRUCT[raw] & ~inside)
    step = _OPEN[raw[struct]].astype(np.int64) - _CLOSE[raw[struct]]
    total = np.concatenate([[0], np.cumsum(step)])
    at = np.searchsorted(struct, np.append(starts, len(raw)))
    low = np.zeros(len(starts), np.int64)
    np.minimum.at(low, _per_body(struct, starts), total[1:] - total[at[:-1]][_per_body(struct, starts)])
    uneven = np.flatnonzero((total[at[1:]] != total[at[:-1]]) | (low < 0))
    if len(uneven):
        blank(uneven)
        for i in uneven.tolist():
            inside[starts[i] : ends[i]] = False
        quotes, escapes, struct = without(quotes), without(escapes), without(struct)
    good[_grammar(joined, raw, starts, ends, good, inside, escapes, quotes, struct)] = False
    return Scan(joined, raw, starts, good, without(quotes), without(struct))


def valid(bodies: list[bytes]) -> np.ndarray:
    """Which bodies are one JSON value each."""
    return scan(bodies).good


def _grammar(joined: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, good: np.ndarray, inside: np.ndarray, escapes: np.ndarray, quotes: np.ndarray, struct: np.ndarray) -> np.ndarray:
    """The bodies in which a token stands where it mustn't, or is none, among those whose quotes and brackets are even."""
    wrong = [np.flatnonzero(inside & (raw < 0x20))]
    escapes = escapes[inside[escapes]]
    wrong.append(escapes[~_ESCAPED[raw[escapes + 1]]])
    units = escapes[raw[escapes + 1] == 0x75]
    hexes = np.minimum(units[:, None] + np.arange(2, 6), len(raw) - 1)
    wrong.append(units[~_HEX[raw[hexes]].all(axis=1)])
    # scalars: runs of what is neither string, bracket, mark nor space
    plain = _PLAIN[raw] & ~inside
    change = np.flatnonzero(np.concatenate([plain[:1], plain[1:] != plain[:-1], plain[-1:]]))
    begin, end = change[0::2], change[1::2]
    spans = [joined[i:j] for i, j in zip(begin.tolist(), end.tolist())]
    fits = {t: SCALAR.fullmatch(t) is not None for t in set(spans)}
    wrong.append(begin[~np.fromiter((fits[t] for t in spans), bool, len(spans))])
    # all tokens in order, with the end of each body as one
    ends = ends[good]
    place = np.concatenate([struct, quotes[0::2], begin, ends])
    kind = np.concatenate([raw[struct], np.full(len(quotes) // 2, _STRING, np.uint8), np.full(len(begin), _VALUE, np.uint8), np.full(len(ends), _END, np.uint8)])
    order = np.argsort(place, kind="stable")
    place, kind = place[order], kind[order]
    opens, closes = _OPEN[kind], _CLOSE[kind]
    depth = np.cumsum(opens.astype(np.int64) - closes)  # after each token
    # what encloses each token: the last opening bracket one level up
    level = np.where(opens, depth - 1, depth) + np.where(closes, 1, 0)
    around = np.full(len(kind), _END, np.uint8)
    openings = np.flatnonzero(opens)
    span = len(kind) + 1
    keyed = np.sort(depth[openings] * span + openings)
    k = np.searchsorted(keyed, level * span + np.arange(len(kind))) - 1
    hit = (level > 0) & (k >= 0)
    hit[hit] = keyed[k[hit]] // span == level[hit]
    around[hit] = kind[keyed[k[hit]] % span]
    before = np.concatenate([[_END], kind[:-1]])
    start = np.isin(kind, [_STRING, _VALUE, 0x7B, 0x5B])
    done = np.isin(before, [_STRING, _VALUE, 0x7D, 0x5D])
    in_object = around == 0x7B
    key = (kind == _STRING) & in_object & np.isin(before, [0x7B, 0x2C])
    after_key = np.concatenate([[False], key[:-1]])
    allowed = np.select(
        [kind == 0x3A, kind == 0x2C, kind == 0x7D, kind == 0x5D, kind == _END],
        [after_key, done & ~after_key & (around != _END), in_object & ((before == 0x7B) | done & ~after_key), (around == 0x5B) & ((before == 0x5B) | done), done],
        key | (start & np.where(in_object, before == 0x3A, np.where(around == 0x5B, np.isin(before, [0x5B, 0x2C]), before == _END))),
    )
    wrong.append(place[~allowed])
    return np.unique(_per_body(np.concatenate(wrong), starts))


def index(found: Scan, levels: dict[str, str | None], with_fields: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], list[str], list[dict[str, str | None]]]:
    """Nodes of valid bodies, in order of place: body, start, end (in bytes of the body), parent's place in this list or -1, level, name, and with_fields their own members."""
    joined, raw, starts, quotes, struct = found.joined, found.raw, found.starts, found.quotes, found.struct
    kind = raw[struct]
    step = _OPEN[kind].astype(np.int64) - _CLOSE[kind]
    depth = np.cumsum(step) + _CLOSE[kind]  # of a bracket: the depth of its inside; of others: that of where they stand
    brackets = np.flatnonzero(_OPEN[kind] | _CLOSE[kind])
    by_depth = brackets[np.lexsort((brackets, depth[brackets]))]
    close_of = np.full(len(struct), -1)
    close_of[by_depth[0::2]] = by_depth[1::2]  # at one depth brackets open and close in turn
    # the string that stands before each colon is a key
    colons = np.flatnonzero(kind == 0x3A)
    q = np.searchsorted(quotes, struct[colons]) - 1
    key_from, key_to = quotes[q - 1] + 1, quotes[q]
    numbers: dict[bytes, int] = {}
    key_no = np.fromiter((numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(key_from.tolist(), key_to.tolist())), np.int64, len(colons))
    spelled = [LONE.sub("\ufffd", json.loads(b'"' + k + b'"')) if b"\\" in k else k.decode("utf-8", "replace") for k in numbers]
    by_text: dict[str, int] = {}
    same = np.array([by_text.setdefault(k, i) for i, k in enumerate(spelled)], np.int64) if spelled else np.zeros(0, np.int64)
    key_no = same[key_no]  # keys that are written in different ways are one
    wanted = np.array([k in levels for k in spelled], bool)[key_no] if spelled else np.zeros(0, bool)
    # the bracket that a key's value opens, if it opens one: the structural byte right after its colon, nothing but space between
    after = np.minimum(colons + 1, len(struct) - 1)
    opens = _OPEN[kind[after]] & (after > colons)
    # containers: for each wanted key, its object, or the objects right under its array
    level_at = np.full(len(struct), -1)  # of an opening brace: the colon whose key makes it a node
    object_keys = colons[wanted & opens & (kind[after] == 0x7B)]
    level_at[object_keys + 1] = object_keys
    arrays = colons[wanted & opens & (kind[after] == 0x5B)]
    if len(arrays):
        braces = np.flatnonzero(kind == 0x7B)
        # an element of an array stands right after its bracket or after a comma at that depth
        owner = _enclosing(kind, depth, close_of, braces)
        of_array = np.full(len(struct), -1)
        of_array[arrays + 1] = arrays
        under = (owner >= 0) & (of_array[owner] >= 0) & (kind[braces - 1] != 0x3A)
        level_at[braces[under]] = of_array[owner[under]]
    place = np.flatnonzero(level_at >= 0)
    owners = _enclosing(kind, depth, close_of, colons)
    place = _last_of_repeated(place, level_at, key_no, colons, kind, owners, close_of)
    colon_no = np.full(len(struct), -1)
    colon_no[colons] = np.arange(len(colons))
    level_of = [spelled[i] for i in key_no[colon_no[level_at[place]]].tolist()]
    start, end = struct[place], struct[close_of[place]] + 1
    # the colons of a node's own members, and among them its name
    names = [""] * len(place)
    by_place = {p: n for n, p in enumerate(place.tolist())}
    naming = {*levels.values()}

    def value(c: int) -> bytes:
        nxt = colons[c] + 1
        return joined[struct[colons[c]] + 1 : struct[close_of[nxt]] + 1 if opens[c] else struct[nxt]]

    is_node = np.zeros(len(struct) + 1, bool)
    is_node[place] = True
    candidates = np.flatnonzero(np.array([k in naming for k in spelled], bool)[key_no] & is_node[owners]) if spelled else np.zeros(0, np.int64)
    for c, o in zip(candidates.tolist(), owners[candidates].tolist()):
        n = by_place[o]
        if levels[level_of[n]] == spelled[key_no[c]]:
            names[n] = _text(value(c)) or ""  # of repeated members the last counts, as they come in order
    fields: list[dict[str, str | None]] = [{} for _ in level_of] if with_fields else []
    if with_fields and len(place):
        # of each object: the node it is or belongs to without an array between, and the path from there
        home: dict[int, tuple[int, str]] = {p: (n, "") for p, n in by_place.items()}
        before = np.maximum(np.arange(len(struct)) - 1, 0)
        is_object, is_array = opens & (kind[after] == 0x7B), opens & (kind[after] == 0x5B)
        for c, o in enumerate(owners.tolist()):
            at = home.get(o)
            if at is None or (wanted[c] and opens[c]):
                continue
            path = at[1] + spelled[key_no[c]]
            if is_object[c]:
                home.setdefault(int(colons[c]) + 1, (at[0], f"{path}."))
            else:
                fields[at[0]][path] = value(c).strip().decode("utf-8", "replace") if is_array[c] else _text(value(c))
    parent = _parents(start, end)
    body = _per_body(start, starts)
    return body, start - starts[body], end - starts[body], parent, level_of, names, fields


def _enclosing(kind: np.ndarray, depth: np.ndarray, close_of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The opening bracket right around each structural byte of at, or -1: the last one before it that is one level up."""
    outside = depth[at] - _OPEN[kind[at]]
    span = len(kind) + 1
    openings = np.flatnonzero(_OPEN[kind])
    order = np.sort(depth[openings] * span + openings)
    k = np.searchsorted(order, outside * span + at) - 1
    found = order[np.maximum(k, 0)] if len(order) else np.zeros(len(at), np.int64)
    good = (k >= 0) & (found // span == outside) & (outside > 0)
    return np.where(good, found % span, -1)


def _last_of_repeated(place, level_at, key_no, colons, kind, owner, close_of):
    """place without nodes that lie under a member whose key the same object repeats later: a JSON object keeps the last."""
    used = np.unique(level_at[place])
    pair = owner * (key_no.max(initial=0) + 1) + key_no
    last = np.full(len(pair), True)
    order = np.lexsort((np.arange(len(pair)), pair))
    last[order[:-1]] = pair[order[1:]] != pair[order[:-1]]
    if last.all() or not len(used):
        return place
    lost = colons[~last & _OPEN[kind[np.minimum(colons + 1, len(kind) - 1)]]]
    cover = np.zeros(len(kind) + 1, np.int64)
    np.add.at(cover, lost + 1, 1)
    np.add.at(cover, close_of[lost + 1] + 1, -1)
    return place[np.cumsum(cover)[place] == 0]


def _text(raw: bytes) -> str | None:
    """A member's value as text: strings decoded, halves of surrogate pairs as U+FFFD; null as None; anything else as it stands."""
    raw = raw.strip(b" \t\r\n")
    if raw == b"null":
        return None
    if raw[:1] == b'"':
        return LONE.sub("\ufffd", json.loads(raw)) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
    return raw.decode("utf-8", "replace")


def _parents(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For spans that nest, sorted by start: the place of the innermost span around each, or -1."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.concatenate([start, end])
    sign = np.concatenate([np.ones(n, np.int64), -np.ones(n, np.int64)])
    order = np.argsort(edge, kind="stable")
    level = np.empty(2 * n, np.int64)
    level[order] = np.cumsum(sign[order])
    level = level[:n]
    coded = np.sort(level * n + np.arange(n))
    k = np.searchsorted(coded, (level - 1) * n + np.arange(n)) - 1
    found = coded[np.maximum(k, 0)]
    return np.where((level > 1) & (k >= 0), found % n, -1)


def nodes(bodies: list[str], levels: dict[str, str | None] = LEVELS, with_json: bool = False, with_fields: bool = False) -> dict[str, list | np.ndarray]:
    """Columns of the nodes of bodies that are valid JSON: body, ordinal, parent (an ordinal or -1), node_level, name, depth, node_path, node_json, fields."""
    coded = [b.removeprefix("\ufeff").encode("utf-8", "surrogatepass") for b in bodies]
    found = scan(coded)
    body, start, end, parent, level_of, names, fields = index(found, levels, with_fields) if found.good.any() else (*[np.zeros(0, np.int64)] * 4, [], [], [])
    ordinal = np.arange(len(body)) - np.searchsorted(body, body)
    paths: list[str] = []
    depths = np.zeros(len(body), np.int32)
    for n, p in enumerate(parent.tolist()):
        paths.append(names[n] if p < 0 else f"{paths[p]} > {names[n]}")
        depths[n] = 0 if p < 0 else depths[p] + 1
    text = [coded[b][s:e].decode("utf-8", "replace") for b, s, e in zip(body.tolist(), start.tolist(), end.tolist())] if with_json else None
    return {"body": body, "ordinal": ordinal, "parent": np.where(parent < 0, -1, ordinal[np.maximum(parent, 0)]) if len(body) else parent, "node_level": level_of, "name": names, "depth": depths, "node_path": paths, "node_json": text, "fields": fields if with_fields else None}


def flatten(df: DataFrame, key: str = "json_id", body: str = "body", levels: dict[str, str | None] | None = None, with_json: bool = False, with_fields: bool = False) -> DataFrame:
    """Nodes of df.body, each linked to its parent: key, node_id, parent_id (null at the top), node_level, name, depth, ordinal, node_path, node_json, fields.

    levels: the keys whose objects are nodes, each with the member that names it, or None for a name of ''; by default LEVELS.
    node_id is '<key>/<ordinal>', ordinals count nodes in the order of the text. Null, empty and invalid bodies
    have no nodes; a leading byte order mark is skipped. An object that repeats a member keeps the last.
    node_json is null unless with_json. fields is null unless with_fields: a map of the node's own members to text, those of
    objects in it under 'member.member', arrays as JSON; members that are nodes themselves are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    wanted = LEVELS if levels is None else levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            block: list[int] = []
            size = 0
            lengths = pc.binary_length(texts).to_pylist()
            for i, n in enumerate(lengths):
                if n is None:
                    continue
                if block and size + n > BLOCK:
                    yield rows(block, ids, texts)
                    block, size = [], 0
                block.append(i)
                size += n
            if block:
                yield rows(block, ids, texts)

    def rows(block: list[int], ids: list, texts: pa.Array) -> pa.RecordBatch:
        found = nodes([texts[i].as_py() for i in block], wanted, with_json, with_fields)
        at = [ids[block[b]] for b in found["body"]]
        none = [None] * len(at)
        columns = {
            key: pa.array(at, batch_type),
            "node_id": [f"{a}/{o}" for a, o in zip(at, found["ordinal"].tolist())],
            "parent_id": [None if p < 0 else f"{a}/{p}" for a, p in zip(at, found["parent"].tolist())],
            "node_level": found["node_level"],
            "name": found["name"],
            "depth": pa.array(found["depth"], pa.int32()),
            "ordinal": pa.array(found["ordinal"], pa.int32()),
            "node_path": found["node_path"],
            "node_json": found["node_json"] or none,
            "fields": pa.array([list(f.items()) for f in found["fields"]] if with_fields else none, pa.map_(pa.string(), pa.string())),
        }
        return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for k, v in columns.items()})

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(df.schema[key].dataType)
    return df.select(F.col(key), F.col(body)).mapInArrow(run, f"`{key}` {kind}, {NODES}")


def level_table(found: DataFrame, level: str, members: list[str], key: str = "json_id") -> DataFrame:
    """The flat table of one level from flatten(with_fields=True): key, node_id, parent_id, ordinal, name and a column for each of members.

    A member a node lacks is null; a dot in its name is written as an underscore.
    """
    own = found.filter(F.col("node_level") == level)
    return own.select(key, "node_id", "parent_id", "ordinal", "name", *(F.try_element_at("fields", F.lit(m)).alias(m.replace(".", "_")) for m in members))


def members(found: DataFrame) -> DataFrame:
    """node_level, member, nodes: which members the nodes of each level have, from flatten(with_fields=True)."""
    return found.select("node_level", F.explode(F.map_keys("fields")).alias("member")).groupBy("node_level", "member").agg(F.count(F.lit(1)).alias("nodes"))
