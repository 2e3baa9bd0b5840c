"""Upserts against a plain model, over random runs, and on awkward rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sedimenta.functions.cleaners import moment
from sedimenta.operators import extract, lifecycle
from sedimenta.sources.store import ITEMS
from sedimenta.spec import FieldSpec, parse_site

ORDER = ["start_pos", "page_no", "item_pos"]
SEEN = "site string, natural_key string, content_hash string, data string, source_url string, start_pos int, page_no int, item_pos int"


def at(day):
    return dt.datetime(2026, 5, day)


def plain(stored, seen, touched, run, now, gone):
    """The same, row by row."""
    items, results = {k: dict(v) for k, v in stored.items()}, []
    top = max([v["id"] for v in items.values()], default=0)
    hit = set()
    for site, key, h, data, url, *_ in sorted(seen, key=lambda r: r[5:]):
        k, hit = (site, key), hit | {(site, key)}
        old = items.get(k)
        if old is None:
            top += 1
            items[k] = dict(id=top, content_hash=h, data=data, source_url=url, first_seen=now, last_changed=now, run_id=run)
            results.append("new")
        elif old["content_hash"] != h:
            old.update(content_hash=h, data=data, source_url=url, last_changed=now, run_id=run)
            results.append("updated")
        else:
            results.append("unchanged")
        items[k].update(last_seen=now, seen_run_id=run, fetched_at=now, gone_at=None)
    for k in touched:
        items[k].update(last_seen=now, seen_run_id=run, gone_at=None)
    for k, v in items.items():
        if gone and k not in hit and k not in touched and v["gone_at"] is None:
            v["gone_at"] = now
    return items, sorted(results)


def test_random_runs(spark):
    rng = random.Random(5)
    model, stored = {}, spark.createDataFrame([], ITEMS)
    for run in range(1, 5):
        keys = [f"k{i}" for i in range(12)]
        seen = [("s", rng.choice(keys), f"h{rng.randint(0, 2)}", f"d{run}.{i}", f"u{i}", 0, i // 5, i % 5) for i in range(10)]
        hit = {r[1] for r in seen}
        touched = [k for k in model if k[1] not in hit and rng.random() < 0.4]
        now, gone = at(run), run != 2
        df = spark.createDataFrame(seen, SEEN)
        classified = lifecycle.classify(df, stored, ORDER)
        after = lifecycle.upsert(stored, classified, spark.createDataFrame(touched, "site string, natural_key string"), run, moment(now), ORDER, gone)
        stored = spark.createDataFrame(after.collect(), ITEMS)
        model, results = plain(model, seen, touched, run, now, gone)
        assert sorted(r["result"] for r in classified.collect()) == results
        got = {(r["site"], r["natural_key"]): {k: r[k] for k in next(iter(model.values()))} for r in stored.collect()}
        assert got == model, run


def test_awkward(spark):
    empty, none = spark.createDataFrame([], ITEMS), spark.createDataFrame([], SEEN)
    keys = spark.createDataFrame([], "site string, natural_key string")
    assert lifecycle.upsert(empty, lifecycle.classify(none, empty, ORDER), keys, 1, moment(at(1)), ORDER, True).count() == 0
    twice = spark.createDataFrame([("s", "k", "h", "d", None, 0, 1, 0)] * 2, SEEN)
    after = lifecycle.upsert(empty, lifecycle.classify(twice, empty, ORDER), keys, 1, moment(at(1)), ORDER, True).collect()
    assert len(after) == 1 and after[0]["id"] == 1 and after[0]["source_url"] is None
    urls = spark.createDataFrame([(i, "s", f"k{i}", None, "{}", u, None, None, None, None, None, None, None) for i, u in enumerate(["a", "a", "b", None, None])], ITEMS)
    assert [r["id"] for r in lifecycle.unique_by_url(urls).collect()] == [2]


def test_listing_on_awkward_pages(spark):
    site = parse_site({"name": "s", "base_url": "https://s", "start_urls": ["/"], "list": {"item_selector": "li", "detail_url": "a::attr(href)", "fields": {"t": {"selector": ["b", "i"]}, "n": {"type": "int", "default": 7, "selector": "u"}, "l": {"type": "list", "selector": "em"}, "m": {"multiple": True, "type": "money", "selector": "em"}}}})
    pages = [(1, "https://s/a/b", None, "<base href='/z/'><li><b></b><i>x</i><a href='q'></a><em>1,5</em><em>dos</em>"), (2, None, None, None), (3, "https://s/", "https://s/f/", "<li>"), (3, "https://s/", "https://s/f/", "<li>"), (4, "https://s/", None, "<li>" * 3000)]
    df = spark.createDataFrame(pages, "id int, url string, final_url string, html string").withColumn("item", F.lit(1))
    rows = extract.with_fields(extract.listing(df, site), site.list.fields, moment(at(1))).collect()
    first = next(r for r in rows if r["id"] == 1 and r["item_pos"] == 0)
    assert (first["f_t"], first["f_n"], first["f_l"], first["f_m"], first["detail_url"], first["page_base"]) == ("x", 7, ["1,5", "dos"], [1.5, None], "https://s/z/q", "https://s/z/")
    assert sum(r["item_pos"] is not None for r in rows) == 1 + 2 + 3000 and sum(r["item_pos"] is None for r in rows) == 5
    assert extract.listing(df.limit(0), site).count() == 0
    checked = spark.createDataFrame([("", []), (None, None), ("a", ["x"])], "f_t string, f_l array<string>")
    fields = {"t": FieldSpec(required=True), "l": FieldSpec(required=True, type="list")}
    assert [r[0] for r in checked.select(extract.missing(fields)).collect()] == [["t", "l"], ["t", "l"], []]
