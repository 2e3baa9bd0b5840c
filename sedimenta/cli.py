"""Commands: run, dry-run, export, status, validate, schema, init-site."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from pathlib import Path

from sedimenta.spec import Dates, SpecError, json_schema, load_site

SKELETON = """\
name: {name}
description: what is taken from here, and for whom
base_url: https://www.example.org
start_urls: [/list]
pagination: {{next_selector: "a.next::attr(href)", max_pages: 5}}
list:
  item_selector: "div.card"
  detail_url: "a.title::attr(href)"
  fields:
    title: {{selector: "a.title", required: true}}
detail:
  fields:
    price: {{selector: ".price", type: money}}
    date: {{selector: "time::attr(datetime)", type: date}}
key: [title]
"""


def day(text: str) -> int | dt.date:
    try:
        return int(text)
    except ValueError:
        return dt.date.fromisoformat(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sedimenta")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "dry-run"):
        c = sub.add_parser(name)
        c.add_argument("site")
        c.add_argument("--pages", help="parquet of captured pages; without it pages are fetched")
        c.add_argument("--cache", action=argparse.BooleanOptionalAction, help="use the cache of pages; by default what the declaration says, and in a dry run")
        c.add_argument("--offline", action="store_true", help="read pages from the cache alone")
        c.add_argument("--limit", type=int, default=10 if name == "dry-run" else None)
        c.add_argument("--from", dest="first", type=day)
        c.add_argument("--to", dest="last", type=day)
        c.add_argument("--export", action="store_true")
    c = sub.add_parser("export")
    c.add_argument("site")
    c.add_argument("--format", choices=["csv", "json", "xlsx"])
    c.add_argument("--out")
    c.add_argument("--active", action="store_true")
    sub.add_parser("status").add_argument("site", nargs="?")
    sub.add_parser("validate").add_argument("site")
    sub.add_parser("schema").add_argument("--out", default="site.schema.json")
    c = sub.add_parser("init-site")
    c.add_argument("name")
    c.add_argument("--folder", default="sites")
    p.add_argument("--cache-root", default=os.environ.get("SEDIMENTA_CACHE", "data/cache"))
    p.add_argument("--store", default=os.environ.get("SEDIMENTA_STORE", "data/store"))
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        return _do(a, spark)
    except SpecError as e:
        print(e, file=sys.stderr)
        return 2


def _do(a: argparse.Namespace, spark) -> int:
    if a.command == "schema":
        Path(a.out).write_text(json.dumps(json_schema(), indent=2), encoding="utf-8")
        return 0
    if a.command == "init-site":
        out = Path(a.folder) / f"{a.name}.yaml"
        if out.exists():
            print(f"{out} exists", file=sys.stderr)
            return 1
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(SKELETON.format(name=a.name), encoding="utf-8")
        return 0
    site = load_site(a.site) if a.site else None
    if a.command == "validate":
        print(f"{a.site}: {len(site.all_fields)} fields, key {site.key or 'URL'}")
        return 0
    from sedimenta.plans.site_run import SiteRun
    from sedimenta.session import local_session
    from sedimenta.sources import export
    from sedimenta.sources.store import Store
    from sedimenta.sources.web import Web

    spark = spark or local_session()
    store = Store(spark, a.store)

    def write(active: bool, fmt: str | None, out: str | None) -> int:
        items = store.items(site.name, include_gone=not active).orderBy("id")
        if not items.limit(1).count():
            print("nothing stored", file=sys.stderr)
            return 1
        print(export.write(export.flatten(items, list(site.all_fields)), fmt or site.export.default, site.name, out or site.export.path))
        return 0

    if a.command == "export":
        return write(a.active, a.format, a.out)
    if a.command == "status":
        from sedimenta.operators.report import last_runs

        name = site.name if site else None
        for r in last_runs(store.log("runs"), name).collect():
            print(r["id"], r["site"], r["started_at"], r["status"], f"new {r['items_new']} updated {r['items_updated']} unchanged {r['items_unchanged']} skipped {r['items_skipped']} gone {r['items_gone']} errors {r['errors']}")
        if name:
            print(f"stored {store.count_items(name)}, active {store.count_items(name, include_gone=False)}")
        return 0
    dates = None
    if a.first is not None or a.last is not None:
        known = site.dates or Dates()
        dates = Dates(start=known.start if a.first is None else a.first, end=known.end if a.last is None else a.last, skip_weekdays=known.skip_weekdays)
    dry = a.command == "dry-run"
    mode = "offline" if a.offline else {True: "on", False: "off"}.get(a.cache, "on" if dry else None)
    source = spark.read.parquet(a.pages) if a.pages else Web(spark, site, a.cache_root, mode)
    r = SiteRun(spark, site, source, None if dry else store, dry, a.limit, dates).run()
    print(f"{r.site}: {r.status}", *(f"{n.removeprefix('items_')} {getattr(r, n)}" for n in vars(r) if n.startswith("items_") or n in ("pages", "errors")), *r.warnings, sep="\n  ")
    for name, n in sorted(r.empty_fields.items(), key=lambda x: -x[1]):
        print(f"  empty {name}: {n / r.items_extracted:.0%}" if r.items_extracted else f"  empty {name}: {n}")
    if dry:
        for s in r.sample:
            print(json.dumps({k: (str(v)[:120] if v is not None else None) for k, v in s.items()}, ensure_ascii=False))
    if a.export and not dry:
        return write(False, None, None)
    return 1 if r.status == "error" else 0


if __name__ == "__main__":
    sys.exit(main())
