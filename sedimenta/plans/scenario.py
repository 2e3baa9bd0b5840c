"""Three runs of a made-up site over captured pages made from the suppliers, through the engine's own runs and store.

Each supplier is a record of a list page with a page of its own. Balances decide what happens to it: see the conditions
below, which SQL states again. Pages are 25 suppliers long and come in blocks of two, linked by their next link; the
second links back to the first.

run 1: all. Balances below -900 are forbidden by robots.txt, up to -500 have no page; those from -500 to 0 are listed twice,
       the second time with half a unit more; above 9000 the name is blank, which is invalid. Names that end in 7 are excluded.
run 2: without balances from 0 to 500, which are gone, and above 9000; from 1000 to 3000 with one unit more.
run 3: detail pages are skipped where the item is known and listed as before; all of up to 9000, from 4000 to 5000 with two units more.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.plans.site_run import COUNTERS, SiteRun
from sedimenta.session import cut, scratch
from sedimenta.sources.store import Store
from sedimenta.sources.web import Captured
from sedimenta.spec import Site, parse_site

BASE = "https://s.example"
TIMES = [dt.datetime(2026, 5, d, 12) for d in (1, 6, 11)]
PAGE = 25
ROBOTS = "User-agent: *\nDisallow: /x/\n"


def site(blocks: int, refresh_days: float | None = None) -> Site:
    return parse_site({
        "name": "suppliers", "base_url": BASE, "start_urls": [f"/l/{b}" for b in range(blocks)], "track_removed": True, "politeness": {"max_consecutive_errors": 0},
        "pagination": {"next_selector": "a.next::attr(href)", "max_pages": 4},
        "list": {"item_selector": "li", "detail_url": "a::attr(href)", "exclude": {"name": "7$"}, "fields": {"key": {"selector": "::attr(data-key)", "type": "int"}, "name": {"selector": ["b.none", "a"], "required": True}, "balance": {"selector": "i", "type": "money"}}},
        "detail": {"fields": {"nation": {"selector": "label:nation", "type": "int"}}, "refresh_days": refresh_days}, "key": ["key"],
    })


def listed(run: int, b: Column) -> Column:
    return {1: F.lit(True), 2: (b <= 9000) & ~((b >= 0) & (b < 500)), 3: b <= 9000}[run]


def more(run: int, b: Column) -> Column:
    one = F.when((b >= 1000) & (b < 3000), 1.0)
    return {1: F.lit(0.0), 2: F.coalesce(one, F.lit(0.0)), 3: F.coalesce(one, F.when((b >= 4000) & (b < 5000), 2.0), F.lit(0.0))}[run]


def captured(suppliers: DataFrame, run: int) -> DataFrame:
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    at = F.lit(TIMES[run - 1].isoformat(" ")).cast("timestamp_ntz")
    detail = F.concat(F.when((b < -900) & F.lit(run == 1), "/x/").otherwise("/s/"), k.cast("string"))
    shown = lambda v: F.concat(F.translate(F.format_number(v, 2), ",.", ".,"), F.lit(" €"))
    item = lambda v: F.concat(F.lit("<li data-key="), k.cast("string"), F.lit("><a href='"), detail, F.lit("'>"), F.when(b > 9000, " ").otherwise(F.col("s_name")), F.lit("</a><i>"), shown(v), F.lit("</i>"))
    items = F.when((b >= -500) & (b < 0) & F.lit(run == 1), F.concat(item(b), item(b + 0.5))).otherwise(item(b + more(run, b)))
    rows = suppliers.filter(listed(run, b)).withColumns({"block": F.floor(k / (2 * PAGE)), "second": F.floor(k / PAGE) % 2})
    lists = rows.groupBy("block", "second").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", items.alias("html")))).alias("rows"))  # PAGE of them
    url = lambda second: F.concat(F.lit(f"{BASE}/l/"), F.col("block").cast("string"), F.when(second == 1, "/2").otherwise(""))
    onward = F.concat(F.lit("<a class=next href='"), url(1 - F.col("second")), F.lit("'>next</a>"))
    lists = lists.select(url(F.col("second")).alias("url"), F.lit(200).alias("status"), F.concat(F.array_join(F.transform("rows", lambda r: r["html"]), ""), onward).alias("html"), at.alias("fetched_at"))
    ends = rows.select("block").distinct().select(F.concat(F.lit(f"{BASE}/l/"), F.col("block").cast("string"), F.lit("/2")).alias("url"), F.lit(404).alias("status"), F.lit("").alias("html"), at.alias("fetched_at"))
    page = F.concat(F.lit("<dl><dt>Nation:</dt><dd>"), F.col("s_nationkey").cast("string"), F.lit("</dd></dl>"))
    there = rows.filter(F.lit(run > 1) | (b < -900) | (b >= -500))
    pages = [there.select(F.concat(F.lit(BASE), detail).alias("url"), F.lit(s).alias("status"), h.alias("html"), (at + F.expr(f"INTERVAL '{m}' MINUTE")).alias("fetched_at")) for s, h, m in ((200, F.lit("<dl><dt>nation</dt><dd>-1</dd></dl>"), -9), (200, page, 0), (503, F.lit("busy"), 9))]
    return lists.unionByName(ends).unionByName(pages[0]).unionByName(pages[1]).unionByName(pages[2]).withColumn("final_url", F.lit(None).cast("string"))


def run_all(spark: SparkSession, suppliers: DataFrame, limit: int | None = None) -> tuple[Store, DataFrame]:
    """The store after three runs (one, if there is a limit), and what they reported."""
    store = Store(spark, scratch(spark, "suppliers"))
    blocks = int(suppliers.agg(F.floor(F.max("s_suppkey") / (2 * PAGE)) + 1).collect()[0][0] or 1)
    robots = spark.createDataFrame([(BASE, 200, ROBOTS)], "origin string, status int, text string")
    told = []
    for run in (1,) if limit is not None else (1, 2, 3):
        source = Captured(cut(captured(suppliers, run)), robots)
        r = SiteRun(spark, site(blocks, 30 if run == 3 else None), source, store, limit=limit, now=TIMES[run - 1]).run()
        told.append((run, r.status, r.items_seen, r.items_filtered, r.items_invalid, r.empty_fields.get("name", 0), *(getattr(r, c) for c in COUNTERS)))
    reports = spark.createDataFrame(told, "run int, status string, items_seen int, items_filtered int, items_invalid int, empty_names int, " + ", ".join(f"{c} int" for c in COUNTERS))
    return store, reports
