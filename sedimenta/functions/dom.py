"""A light tree of HTML elements from the standard tokenizer, and CSS selectors over it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

# Elements without content, and what an opening tag ends without being told.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("table ul ol dl select html body".split())


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)  # of Node and str

    def walk(self):
        """All elements below, in the order of the text."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self):
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack += reversed(n.children)

    def text(self) -> str:
        """Texts below, each stripped, joined by a space."""
        return " ".join(t for t in (x.strip() for x in self.texts()) if t)

    def html(self) -> str:
        """The element with its own tags."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, tuple):
                out.append(n[0])
            elif isinstance(n, str):
                out.append(escape(n, quote=False))
            elif n.tag == "#document":
                stack += reversed(n.children)
            else:
                out.append(f"<{n.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ">")
                if n.tag not in VOID:
                    stack.append((f"</{n.tag}>",))
                    raw = n.tag in ("script", "style")
                    stack += [(c,) if raw and isinstance(c, str) else c for c in reversed(n.children)]
        return "".join(out)

    def siblings(self) -> list[Node]:
        return [c for c in self.parent.children if isinstance(c, Node)] if self.parent else [self]

    def following(self) -> Node | None:
        """The element right after this one."""
        own = self.siblings()
        i = next(i for i, n in enumerate(own) if n is self)
        return own[i + 1] if i + 1 < len(own) else None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"button"})
        if tag in ENDS:
            self._close(ENDS[tag], SCOPE)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        node.attrs = dict(reversed(node.attrs.items()))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)

    def _close(self, tags: set, scope) -> None:
        """Ends the outermost open element of tags, as far as no element of scope stands between."""
        n, found = self.at, None
        while n.parent is not None and n.tag not in scope - tags:
            if n.tag in tags:
                found = n
            n = n.parent
        if found is not None:
            self.at = found.parent


def parse(text: str) -> Node:
    """The tree of an HTML text. Unclosed and stray tags are mended, nothing raises."""
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?:[iI]\s*)?)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^)]*)\))?""",
    re.X,
)


@dataclass(frozen=True)
class Simple:
    """One compound, with how it hangs on the one before: ' ', '>', '+' or '~'."""

    hang: str
    tests: tuple


def _bare(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


@lru_cache(4096)
def compile_css(selector: str) -> tuple[tuple[Simple, ...], ...]:
    """Groups of compounds. ValueError for what isn't a selector."""
    groups = []
    for group in re.split(r",(?![^\[]*\])(?![^(]*\))", selector):
        chain: list[Simple] = []
        rest, hang = group.strip(), " "
        if not rest:
            raise ValueError(f"empty selector in {selector!r}")
        while rest:
            tests = []
            while m := _PART.match(rest):
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower()))
                elif m["id"]:
                    tests.append(("attr", "id", "=", _bare(m["id"])))
                elif m["cls"]:
                    tests.append(("attr", "class", "~=", _bare(m["cls"])))
                elif m["attr"]:
                    tests.append(("attr", m["attr"].lower(), m["op"], m["val"].strip("\"'") if m["val"] else None))
                elif m["pseudo"] == "not":
                    tests.append(("not", compile_css(m["arg"])))
                else:
                    tests.append(("pseudo", m["pseudo"], _nth(m["pseudo"], m["arg"])))
                rest = rest[m.end() :]
            if not tests:
                raise ValueError(f"not a selector: {selector!r}")
            chain.append(Simple(hang, tuple(tests)))
            m = re.match(r"\s*([>+~])\s*|\s+", rest)
            if rest and not m:
                raise ValueError(f"not a selector: {selector!r}")
            if m:
                hang, rest = m[1] or " ", rest[m.end() :]
        groups.append(tuple(chain))
    return tuple(groups)


def _nth(name: str, arg: str | None) -> tuple[int, int] | None:
    known = {"first-child": (0, 1), "last-child": (0, 1), "only-child": (0, 1), "empty": (0, 0)}
    if name in known:
        return known[name]
    if name not in ("nth-child", "nth-last-child", "nth-of-type"):
        raise ValueError(f"unknown pseudo-class :{name}")
    arg = {"odd": "2n+1", "even": "2n"}.get((arg or "").strip(), (arg or "").replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise ValueError(f"not a position: {arg!r}")
    step = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return step, int(m[2] or 0)


def _passes(n: Node, test: tuple) -> bool:
    if test[0] == "tag":
        return test[1] in ("*", n.tag)
    if test[0] == "not":
        return not any(_matches(n, chain) for chain in test[1])
    if test[0] == "attr":
        _, name, op, want = test
        have = n.attrs.get(name)
        if have is None or op is None:
            return have is not None
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op == "|=":
            return have == want or have.startswith(f"{want}-")
        return bool(want) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](want)
    _, name, position = test
    if name == "empty":
        return not n.children
    own = n.siblings()
    if name == "nth-of-type":
        own = [x for x in own if x.tag == n.tag]
    i = next(i for i, x in enumerate(own) if x is n) + 1
    if name in ("last-child", "nth-last-child"):
        i = len(own) + 1 - i
    if name == "only-child":
        return len(own) == 1
    step, first = position
    return i == first if step == 0 else (i - first) % step == 0 and (i - first) // step >= 0


def _matches(n: Node, chain: tuple[Simple, ...], end: int | None = None) -> bool:
    end = len(chain) - 1 if end is None else end
    if n.tag == "#document" or not all(_passes(n, t) for t in chain[end].tests):
        return False
    if end == 0:
        return True
    hang = chain[end].hang
    if hang == ">":
        return n.parent is not None and _matches(n.parent, chain, end - 1)
    if hang == " ":
        up = n.parent
        while up is not None:
            if _matches(up, chain, end - 1):
                return True
            up = up.parent
        return False
    own = n.siblings()
    i = next(i for i, x in enumerate(own) if x is n)
    before = own[i - 1 : i] if hang == "+" else own[:i]
    return any(_matches(x, chain, end - 1) for x in before)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root that match, in the order of the text."""
    groups = compile_css(selector)
    return [n for n in root.walk() if any(_matches(n, chain) for chain in groups)]
