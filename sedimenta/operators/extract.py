"""Records from pages: one pass over each page takes the raw texts of all selectors, built-in expressions do the rest.

The Python side parses a page once and returns, for each block, field and alternative, the texts a selector found.
Which alternative counts is decided after cleaning, by Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions import dom, jsonpath, structured
from sedimenta.functions.cleaners import TYPES, clean, is_empty
from sedimenta.spec import FieldSpec, Site, java, split_selector

#: Attributes whose values are resolved against the page.
LINKS = ("href", "src", "action")


def _css_value(node: dom.Node, take: str, attr: str, base: str | None) -> str | None:
    if take == "text":
        return node.text()
    if take == "html":
        return node.html()
    v = node.attrs.get(attr)
    return _joined(base, v) if v is not None and base and attr in LINKS else v


def _joined(base: str, rel: str) -> str:
    try:
        return urljoin(base, rel)
    except ValueError:
        return rel


def found(root, selector: str | None, many: bool, base: str | None) -> list[str | None]:
    """The texts of a selector in a block: all of them, or for one value only that of the first node, which may be None."""
    if isinstance(root, jsonpath.Spot):
        if selector is None:
            v = jsonpath.as_text(root.value)
            return [v] if v is not None else []
        values = jsonpath.texts(root, selector.removeprefix("json:"))
        return values if many else values[:1]
    if selector is None:
        return [root.text()]
    kind, _, rest = selector.partition(":")
    if kind in ("jsonld", "meta", "label"):
        values = {"jsonld": structured.jsonld, "meta": structured.meta, "label": structured.labelled}[kind](root, rest.strip())
        return values if many else values[:1]
    css, take, attr = split_selector(selector)
    nodes = dom.select(root, css) if css else [root]
    if many:
        return [v for n in nodes if (v := _css_value(n, take, attr, base)) is not None]
    return [_css_value(nodes[0], take, attr, base)] if nodes else []


def document_base(root: dom.Node, url: str) -> str:
    """Where links of a page start from: the first base with an href, resolved against its URL."""
    first = next((n for n in dom.select(root, "base[href]")), None)
    return _joined(url, first.attrs["href"]) if first is not None else url


def _plan(fields: dict[str, FieldSpec]) -> list[tuple[list[str | None], bool]]:
    return [(f.selectors, f.many) for f in fields.values()]


def _raw(root, plan: list, base: str | None) -> list[list[list[str | None]]]:
    return [[found(root, s, many, base) for s in selectors] for selectors, many in plan]


RAW = pa.list_(pa.list_(pa.list_(pa.string())))
LISTED = "item_pos int, page_base string, next_url string, detail_url string, problem string, raw array<array<array<string>>>"


def listing(pages: DataFrame, site: Site) -> DataFrame:
    """One row per block of each list page (columns of pages but html, with url and html among them) and one with null item_pos per page.

    The page's own row has next_url, what the pagination selector found, and problem: why the page has no blocks, if its body can't be read.
    page_base is where links start from; detail_url is absolute. A null html counts as empty.
    """
    keep = [c for c in pages.columns if c != "html"]
    is_json, spec, plan, next_selector = site.fetch.format == "json", site.list, _plan(site.list.fields), site.pagination.next_selector

    def one(url: str, text: str) -> list[tuple]:
        try:
            if is_json:
                doc = jsonpath.document(text)
                blocks, base, root = jsonpath.items(doc, spec.item_selector.removeprefix("json:")), url, None
            else:
                root = dom.parse(text)
                blocks, base = dom.select(root, spec.item_selector), document_base(root, url)
        except (ValueError, RecursionError) as e:
            return [(None, url, None, None, f"{type(e).__name__}: {e}"[:4000], [])]
        following = (found(root, next_selector, False, base) or [None])[0] if next_selector and root is not None else None
        rows = [(None, base, following if following and following not in (base, url) else None, None, None, [])]
        for i, b in enumerate(blocks):
            detail = (found(b, spec.detail_url, False, base) or [None])[0] if spec.detail_url else None
            rows.append((i, base, None, _joined(base, detail) if detail else None, None, _raw(b, plan, base)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            urls, texts = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1)
            for i, url in enumerate(urls):
                own = one(url or "", texts[i].as_py() or "")
                at += [i] * len(own)
                rows += own
            columns = list(zip(*rows)) or [()] * 6
            made = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:5]), pa.array(columns[5], RAW)]
            kept = batch.select(range(len(keep))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*keep, "item_pos", "page_base", "next_url", "detail_url", "problem", "raw"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.select(*keep, F.coalesce("final_url", "url").alias("_url"), F.col("html").alias("_html")).mapInArrow(run, f"{shape}, {LISTED}")


def details(pages: DataFrame, fields: dict[str, FieldSpec]) -> DataFrame:
    """detail_url (the url asked for), final_url, raw of each detail page."""
    plan = _plan(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for url, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                root = dom.parse(text.as_py() or "")
                raws.append(_raw(root, plan, document_base(root, url or "")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, RAW)], ["detail_url", "final_url", "raw"])

    columns = pages.select(F.col("url").alias("detail_url"), F.coalesce("final_url", "url").alias("final_url"), "html")
    return columns.mapInArrow(run, "detail_url string, final_url string, raw array<array<array<string>>>")


def post_filter(value: Column, pattern: str) -> Column:
    """The first group of the first match, if the pattern has groups and that one took part, else the whole match; null without a match.

    A group that took no part gives null where a later one did.
    """
    compiled, rx = re.compile(pattern), java(pattern)
    if not compiled.groups:
        return F.regexp_substr(value, F.lit(rx))
    if compiled.groups == 1 and not re.search(r"\)[?*{]|\|", pattern):
        return F.when(value.rlike(rx), F.regexp_extract(value, rx, 1))
    return _python_filter(pattern)(value)


def _python_filter(pattern: str):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        rx = re.compile(pattern)

        def one(v):
            m = None if v is None else rx.search(v)
            return None if m is None else m[1] if m.lastindex else m[0]

        return pd.Series([one(v) for v in values], dtype=object)

    return run


def field_value(alternatives: Column, f: FieldSpec, now: Column) -> Column:
    """A field's value from the raw texts of its alternatives: the first that isn't empty once cleaned, else the default."""
    kind = "list" if f.type == "list" else f"array<{TYPES[f.type]}>" if f.multiple else f.type
    out = []
    for i in range(len(f.selectors)):
        values = F.get(alternatives, F.lit(i))
        if f.regex and not f.many:
            values = F.array(post_filter(F.get(values, F.lit(0)), f.regex))
        v = clean(values, f.type, now, f.multiple and f.type != "list")
        out.append(F.when(~is_empty(v, kind), v))
    value = F.coalesce(*out) if len(out) > 1 else out[0]
    return value if f.default is None else F.coalesce(value, _literal(f))


def _literal(f: FieldSpec) -> Column:
    kind = TYPES[f.type]
    if f.multiple and f.type != "list":
        kind = f"array<{kind}>"
    return (F.array(*(F.lit(x) for x in f.default)) if isinstance(f.default, list) else F.lit(f.default)).cast(kind)


def kind_of(f: FieldSpec) -> str:
    return "list" if f.type == "list" else f"array<{TYPES[f.type]}>" if f.multiple else f.type


def with_fields(df: DataFrame, fields: dict[str, FieldSpec], now: Column, raw: str = "raw", prefix: str = "f_") -> DataFrame:
    """df with a column prefix+name for each field, from its raw column, which goes."""
    return df.withColumns({f"{prefix}{n}": field_value(F.get(F.col(raw), F.lit(i)), f, now) for i, (n, f) in enumerate(fields.items())}).drop(raw)


def missing(fields: dict[str, FieldSpec], prefix: str = "f_") -> Column:
    """array<string>: the required fields that are empty."""
    tests = [F.when(is_empty(F.col(f"{prefix}{n}"), kind_of(f)), F.lit(n)) for n, f in fields.items() if f.required]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def passes(site: Site, prefix: str = "f_") -> Column:
    """Whether a listed record matches all patterns to include and none to exclude; null counts as ''."""
    text = lambda k: F.coalesce(F.col(f"{prefix}{k}").cast("string"), F.lit(""))
    ok = F.lit(True)
    for k, p in site.list.include.items():
        ok = ok & text(k).rlike(java(p))
    for k, p in site.list.exclude.items():
        ok = ok & ~text(k).rlike(java(p))
    return ok
