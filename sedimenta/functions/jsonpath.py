"""Paths through JSON documents that remember what they came through.

Steps: ``$`` the document and ``@name`` the nearest ancestor reached by that key (both only at the start), ``key`` or
``"any key"``, ``..key`` at any depth in the order of the text, not below a match, ``[n]`` and ``[*]``. A key step
goes through the elements of a list; ``[0]`` and ``[*]`` of what is no list are the thing itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True, eq=False)
class Spot:
    """A value, its document, and the keyed containers on the way: (key, container), outermost first."""

    value: object
    root: object
    trail: tuple = ()

    def under(self, key: str) -> Spot:
        v = self.value[key]
        return Spot(v, self.root, (*self.trail, (key, v)) if isinstance(v, (dict, list)) else self.trail)

    def each(self) -> list[Spot]:
        """The elements of a list; in their trails the element takes the place of the list."""
        above, key = self.trail, None
        if above and above[-1][1] is self.value:
            above, key = above[:-1], above[-1][0]
        return [Spot(v, self.root, (*above, (key, v)) if key is not None and isinstance(v, (dict, list)) else above) for v in self.value]


def document(text: str) -> Spot:
    value = json.loads(text)
    return Spot(value, value)


@lru_cache(4096)
def compile_path(path: str) -> tuple[tuple[str, object], ...]:
    """Steps of a path; ValueError names the place where it makes no sense."""
    steps: list[tuple[str, object]] = []
    rest = path.strip()

    def name(s: str) -> tuple[str, str]:
        if s[:1] == '"':
            end = s.find('"', 1)
            if end > 0:
                return s[1:end], s[end + 1 :]
        end = next((i for i, c in enumerate(s) if c in ".[]@$"), len(s))
        if not end:
            raise ValueError(f"invalid JSON path {path!r} at {s!r}")
        return s[:end], s[end:]

    while rest:
        if rest[0] == "$" and not steps:
            steps.append(("root", None))
            rest = rest[1:]
        elif rest[0] == "@" and not steps:
            key, rest = name(rest[1:])
            steps.append(("up", key))
        elif rest.startswith(".."):
            key, rest = name(rest[2:])
            steps.append(("deep", key))
        elif rest[0] == "[":
            inside, closed, rest_ = rest[1:].partition("]")
            if not closed or not (inside == "*" or inside.isdigit()):
                raise ValueError(f"invalid JSON path {path!r} at {rest!r}")
            steps.append(("all", None) if inside == "*" else ("at", int(inside)))
            rest = rest_
        else:
            key, rest = name(rest[1:] if rest[0] == "." else rest)
            steps.append(("key", key))
    return tuple(steps)


def _deep(spot: Spot, key: str) -> list[Spot]:
    found: list[Spot] = []
    stack = [(spot, False)]
    while stack:
        s, hit = stack.pop()
        if hit:
            found.append(s)
        elif isinstance(s.value, dict):
            stack += reversed([(s.under(k), k == key) for k in s.value])
        elif isinstance(s.value, list):
            stack += [(e, False) for e in reversed(s.each())]
    return found


def _step(spots: list[Spot], kind: str, arg) -> list[Spot]:
    if kind == "root":
        return [Spot(s.root, s.root) for s in spots[:1]]
    if kind == "up":
        out = []
        for s in spots:
            i = next((i for i in range(len(s.trail) - 1, -1, -1) if s.trail[i][0] == arg), None)
            if i is not None:
                out.append(Spot(s.trail[i][1], s.root, s.trail[: i + 1]))
        return out
    if kind == "deep":
        return [d for s in spots for d in _deep(s, arg)]
    if kind == "key":
        flat = [e for s in spots for e in (s.each() if isinstance(s.value, list) else [s])]
        return [s.under(arg) for s in flat if isinstance(s.value, dict) and arg in s.value]
    out = []
    for s in spots:
        if not isinstance(s.value, list):
            out += [s] if kind == "all" or arg == 0 else []
        elif kind == "all":
            out += s.each()
        elif arg < len(s.value):
            out.append(s.each()[arg])
    return out


def select(spot: Spot, path: str) -> list[Spot]:
    spots = [spot]
    for kind, arg in compile_path(path):
        spots = _step(spots, kind, arg)
    return spots


def items(spot: Spot, path: str) -> list[Spot]:
    """What path selects, lists as their elements."""
    return [e for s in select(spot, path) for e in (s.each() if isinstance(s.value, list) else [s])]


def as_text(value) -> str | None:
    """null as None, containers as JSON, true and false in lower case."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (dict, list, bool)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def texts(spot: Spot, path: str) -> list[str]:
    """The values of path as texts, lists as their elements, nulls and empty texts left out."""
    return [t for t in (as_text(s.value) for s in items(spot, path)) if t]
