import datetime as dt
import json
import zipfile

import pytest

from sedimenta.plans.site_run import SiteRun
from sedimenta.sources import export
from sedimenta.sources.store import Store
from sedimenta.sources.web import Captured
from sedimenta.spec import SpecError, load_site, parse_site

HTML = {
    "name": "citas", "base_url": "https://c.example/", "start_urls": ["/"], "track_removed": True,
    "pagination": {"next_selector": "li.sig a::attr(href)", "max_pages": 5},
    "list": {"item_selector": "div.cita", "detail_url": "span a::attr(href)", "fields": {
        "texto": {"selector": "span.t", "required": True}, "autor": {"selector": ["b.none", "small"]}, "tags": {"selector": "a.tag", "type": "list"}, "precio": {"selector": ".p", "type": "money"}}},
    "detail": {"fields": {"nacido": {"selector": ".n", "type": "date"}, "lugar": {"selector": ".l", "regex": r"^in\s+(.*)$"}, "tel": {"selector": "p.tel", "type": "phone"}}},
    "key": ["texto", "autor"],
}


def cita(t, a, link=None, extra=""):
    return f"<div class=cita><span class=t>{t}</span><small>{a}</small>{extra}" + (f"<span><a href='{link}'>más</a></span>" if link else "") + "</div>"


def site_pages(first="Uno", invalid=True):
    p1 = cita(first, "Ana", "/a/ana", "<a class=tag>x</a><a class=tag>y z</a><i class=p>7.081,35 €</i>") + cita("Dos", "Luis", "/a/luis") + "<li class=sig><a href='/p/2'>&gt;</a></li>"
    p2 = cita("Tres", "Ana", "/a/ana") + (cita("", "Nadie") if invalid else "") + "<li class=sig><a href='/p/3'>&gt;</a></li>"
    u = "https://c.example"
    return [(f"{u}/", f"{u}/", 200, p1), (f"{u}/p/2", f"{u}/p/2", 200, p2), (f"{u}/p/3", f"{u}/p/3", 200, "<p>fin</p>"),
            (f"{u}/a/ana", f"{u}/a/ana", 200, "<span class=n>7 de noviembre de 1964</span><span class=l>in Soria</span><p class=tel>976 40 50 60</p>"), (f"{u}/a/luis", f"{u}/a/luis2", 200, "<p>nada</p>")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "url string, final_url string, status int, html string")


def at(day):
    return dt.datetime(2026, 9, day, 8)


def test_runs_over_time(spark, tmp_path):
    site, store = parse_site(HTML), Store(spark, str(tmp_path / "s"))
    run = lambda rows, day, s=site, **k: SiteRun(spark, s, frame(spark, rows), store, now=at(day), **k).run()
    r = run(site_pages(), 1)
    assert (r.status, r.pages, r.items_seen, r.items_new, r.items_invalid, r.errors) == ("ok", 5, 4, 3, 1, 1)
    assert r.empty_fields == {"texto": 1, "tags": 3, "precio": 3, "nacido": 2, "lugar": 2, "tel": 2} and r.fill_rate("precio") == 0.25
    one = {i["natural_key"]: i for i in store.items().collect()}
    d = json.loads(one["Uno|Ana"]["data"])
    assert d == {"texto": "Uno", "autor": "Ana", "tags": ["x", "y z"], "precio": 7081.35, "nacido": "1964-11-07", "lugar": "Soria", "tel": "+34976405060"}
    assert one["Dos|Luis"]["source_url"] == "https://c.example/a/luis2" and [one[k]["id"] for k in ("Uno|Ana", "Dos|Luis", "Tres|Ana")] == [1, 2, 3]
    r = run(site_pages(), 2)
    assert (r.items_new, r.items_unchanged, r.items_updated, r.items_gone) == (0, 3, 0, 0)
    # a fourth of the items is invalid, too many to mark any as gone
    assert run(site_pages("Otro"), 3).items_gone == 0 and store.count_items("citas", include_gone=False) == 4
    r = run(site_pages("Otro", False), 3)
    assert (r.items_new, r.items_unchanged, r.items_gone) == (0, 3, 1)
    gone = store.items().filter("gone_at IS NOT NULL").collect()
    assert [(g["natural_key"], g["gone_at"], g["last_seen"], g["id"]) for g in gone] == [("Uno|Ana", at(3), at(2), 1)]
    assert store.count_items("citas") == 4 and store.count_items("citas", include_gone=False) == 3
    r = run(site_pages(invalid=False), 4)
    back = {i["natural_key"]: i for i in store.items().collect()}
    assert back["Uno|Ana"]["gone_at"] is None and back["Uno|Ana"]["first_seen"] == at(1) and back["Otro|Ana"]["gone_at"] == at(4)
    # a detail that fails: its item is left as it is, and nothing is marked as gone
    broken = [(u, f, 500 if "luis" in u else s, h) for u, f, s, h in site_pages("Otro", False)]
    r = run(broken, 5)
    assert r.status == "ok" and r.items_gone == 0 and r.errors == 1 and r.items_unchanged == 2
    assert store.log("runs").count() == 6 and store.log("errors").filter("kind = 'validate'").count() == 3 and store.log("pages").count() == 30
    # incremental: all details known and fetched lately
    fresh = parse_site(HTML | {"detail": HTML["detail"] | {"refresh_days": 3}})
    r = run(site_pages(invalid=False), 6, fresh)
    assert (r.items_skipped, r.pages) == (3, 3)
    flat = export.flatten(store.items("citas"), ["texto", "tags"]).orderBy("texto")
    assert [tuple(x)[:3] for x in flat.collect()][-1] == ("Uno", "x; y z", "https://c.example/a/ana")
    for fmt in ("csv", "json", "xlsx"):
        out = export.write(flat, fmt, "citas", tmp_path / f"o.{fmt}")
        assert out.stat().st_size > 100
    assert (tmp_path / "o.csv").read_bytes().startswith("﻿texto;tags;_url".encode())
    assert "x; y z" in zipfile.ZipFile(tmp_path / "o.xlsx").read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        export.write(flat, "xml", "citas")


def test_dry_limit_expect_and_breaker(spark, tmp_path):
    r = SiteRun(spark, parse_site(HTML), frame(spark, site_pages()), dry_run=True, limit=2, now=at(1)).run()
    assert (r.items_seen, r.items_new, r.status, r.pages) == (2, 2, "ok", 3) and len(r.sample) == 2
    strict = parse_site(HTML | {"expect": {"min_items": 9, "fill_rate": {"precio": 0.9}}})
    r = SiteRun(spark, strict, frame(spark, site_pages()), now=at(1)).run()
    assert r.status == "degraded" and len(r.warnings) == 2
    many = parse_site(HTML | {"start_urls": [f"/x/{i}" for i in range(6)] + ["/"], "politeness": {"max_consecutive_errors": 3}})
    r = SiteRun(spark, many, frame(spark, site_pages()), now=at(1)).run()
    assert r.status == "aborted" and r.items_seen == 0 and r.errors == 3
    empty = SiteRun(spark, parse_site(HTML), frame(spark, []), now=at(1)).run()
    assert (empty.status, empty.errors, empty.pages) == ("ok", 1, 0)


JSON = {
    "name": "boletin", "base_url": "https://b.example", "start_urls": ["/api/{date:%Y%m%d}.json"], "dates": {"start": "2026-09-24", "end": "2026-09-26"}, "fetch": {"format": "json"},
    "list": {"item_selector": "..item", "detail_url": "json:url", "include": {"seccion": "^5A$"}, "exclude": {"titulo": "(?i)formaliz"}, "fields": {
        "id": {"selector": "json:id", "required": True}, "titulo": {"selector": "json:titulo"}, "seccion": {"selector": "json:@seccion.codigo"}, "fecha": {"selector": "json:$.d.f", "type": "date"}, "n": {"selector": "json:@diario.numero", "type": "int"}}},
    "detail": {"fields": {"ref": {"selector": "label:Referencia", "required": True}}}, "key": ["id"],
}


def test_json_site(spark, tmp_path):
    u = "https://b.example"
    item = lambda i, t: {"id": i, "titulo": t, "url": f"/d/{i}"}
    day25 = {"d": {"f": "20260925", "diario": {"numero": "7", "seccion": [{"codigo": "5A", "item": [item("a", "Obra"), item("b", "Formalización")]}, {"codigo": "1", "item": item("c", "Otro")}]}}}
    detail = lambda i: (f"{u}/d/{i}", None, 200, f"<dl><dt>Referencia:</dt><dd>R-{i}</dd></dl>")
    rows = [(f"{u}/api/20260924.json", None, 404, ""), (f"{u}/api/20260925.json", None, 200, json.dumps(day25)), (f"{u}/api/20260926.json", None, 200, "no json"), detail("a")]
    store = Store(spark, str(tmp_path / "s"))
    r = SiteRun(spark, parse_site(JSON), frame(spark, rows), store, now=at(27)).run()
    assert (r.items_seen, r.items_new, r.items_filtered, r.errors, r.status) == (1, 1, 2, 1, "ok")
    assert json.loads(store.items().collect()[0]["data"]) == {"id": "a", "titulo": "Obra", "seccion": "5A", "fecha": "2026-09-25", "n": 7, "ref": "R-a"}
    assert [e["kind"] for e in store.log("errors").collect()] == ["parse"]


def test_spec_faults(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("name: x\nbase_url: https://x/\nstart_urls: [/]\nlist: {item_selektor: a}\n")
    with pytest.raises(SpecError, match=r"list.item_selektor: unknown key; did you mean 'item_selector'"):
        load_site(f)
    for change in ({"key": ["nope"]}, {"start_urls": ["/{date:%Y}"]}, {"fetch": {"format": "json"}}, {"expect": {"fill_rate": {"nope": 1}}}, {"list": HTML["list"] | {"include": {"texto": "("}}}, {"list": HTML["list"] | {"item_selector": "a["}}):
        with pytest.raises(SpecError):
            parse_site(HTML | change)
    assert parse_site(HTML).base_url == "https://c.example"


def test_latest_usable_capture_counts(spark):
    u = "https://c.example/a/ana"
    page = lambda born: f"<span class=n>{born}</span>"
    captures = {
        "error after good": [(200, page("1 de mayo de 1964"), 1), (200, page("2 de mayo de 1964"), 2), (503, "z", 3), (404, "z", None)],
        "later is smaller": [(200, page("9 de mayo de 1964"), 1), (200, page("2 de mayo de 1964"), 2)],
        "no body, not modified": [(200, page("2 de mayo de 1964"), 1), (200, None, 2), (200, "", 3), (304, None, 4), (None, None, 5)],
    }
    rest = [(*r, at(1)) for r in site_pages(invalid=False) if r[0] != u]
    for rows in captures.values():
        given = rest + [(u, u, status, html, day and at(day)) for status, html, day in rows]
        pages = spark.createDataFrame(given, "url string, final_url string, status int, html string, fetched_at timestamp_ntz")
        r = SiteRun(spark, parse_site(HTML), pages, now=at(9)).run()
        assert (r.items_seen, r.items_new, r.errors) == (3, 3, 0) and {str(i["nacido"]) for i in r.sample if i["autor"] == "Ana"} == {"1964-05-02"}
    failed = rest + [(u, u, 503, "z", at(1)), (u, u, 404, "a", at(2))]
    r = SiteRun(spark, parse_site(HTML), spark.createDataFrame(failed, "url string, final_url string, status int, html string, fetched_at timestamp_ntz"), now=at(9)).run()
    assert (r.items_new, r.errors) == (1, 1)


def test_two_sites_share_no_ids_and_no_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for name in ("citas", "otras"):
        assert SiteRun(spark, parse_site(HTML | {"name": name}), frame(spark, site_pages()), store, now=at(1)).run().items_new == 3
    ids = sorted(i["id"] for i in store.items().collect())
    assert ids == [1, 2, 3, 4, 5, 6] and sorted(r["id"] for r in store.log("runs").collect()) == [1, 2]
    assert sorted(map(tuple, store.counts().collect())) == [("citas", 3, 3), ("otras", 3, 3)]


def test_two_runs_of_a_site_at_once(spark, tmp_path):
    store, site = Store(spark, str(tmp_path / "s")), parse_site(HTML)
    slow = SiteRun(spark, site, frame(spark, site_pages()), store, now=at(2))
    fetch = slow.source.fetch

    def fetch_late(*a, **k):
        slow.source.fetch = fetch
        assert [(r["id"], r["status"]) for r in store.log("runs").collect()] == [(1, "running")]
        assert SiteRun(spark, site, frame(spark, site_pages()), store, now=at(3)).run().items_new == 3
        return fetch(*a, **k)

    slow.source.fetch = fetch_late
    r = slow.run()
    assert r.status == "error" and store.count_items("citas") == 3
    assert sorted((r["id"], r["status"]) for r in store.log("runs").collect()) == [(1, "error"), (2, "ok")]
    assert "Conflict" in store.log("errors").filter("run_id = 1").collect()[0]["message"]


def test_runs_that_fail_or_are_stopped(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for fault in (OSError("disk"), KeyboardInterrupt()):
        run = SiteRun(spark, parse_site(HTML), frame(spark, site_pages()), store, now=at(1))

        def fail(*a, fault=fault, **k):
            raise fault

        run.source.fetch = fail
        if isinstance(fault, OSError):
            assert run.run().status == "error"
        else:
            with pytest.raises(KeyboardInterrupt):
                run.run()
    SiteRun(spark, parse_site(HTML), frame(spark, site_pages()), store, dry_run=True, now=at(2)).run()
    assert [(r["id"], r["status"], r["errors"]) for r in store.log("runs").orderBy("id").collect()] == [(1, "error", 1), (2, "interrupted", 0), (3, "dry-run", 1)]
    assert store.log("errors").collect()[0]["message"] == "OSError: disk" and store.items().count() == 0


def test_breaker_counts_details(spark, tmp_path):
    """Lists answer, details fail: three in a row end the run at the second item of the second page; robots denials count for nothing."""
    u = "https://c.example"
    p1 = cita("Uno", "A", "/a/1") + cita("Dos", "B", "/a/2") + cita("Tres", "C") + "<li class=sig><a href='/p/2'>&gt;</a></li>"
    p2 = "".join(cita(f"N{i}", "D", f"/a/{i}") for i in range(3, 9)) + "<li class=sig><a href='/p/3'>&gt;</a></li>"
    p3 = cita("Nunca", "E", "/a/1")
    rows = [(f"{u}/", None, 200, p1), (f"{u}/p/2", None, 200, p2), (f"{u}/p/3", None, 200, p3), (f"{u}/a/1", None, 200, "<p>x"), (f"{u}/a/2", None, 500, "")]
    site = parse_site(HTML | {"politeness": {"max_consecutive_errors": 3}})
    store = Store(spark, str(tmp_path / "s"))
    r = SiteRun(spark, site, frame(spark, rows), store, now=at(1)).run()
    # seen: all records of the pages fetched; those whose detail wasn't fetched any more vanish without an error
    assert (r.status, r.items_seen, r.items_new, r.errors, r.pages) == ("aborted", 9, 2, 4, 4) and r.items_gone == 0
    robots = spark.createDataFrame([(u, 200, "User-agent: *\nDisallow: /a/\nAllow: /a/1")], "origin string, status int, text string")
    r = SiteRun(spark, site, Captured(frame(spark, rows), robots), now=at(1)).run()
    assert (r.status, r.items_seen, r.items_new, r.errors) == ("ok", 10, 3, 7)
    ignoring = parse_site(HTML | {"politeness": {"max_consecutive_errors": 0, "respect_robots": False}})
    assert SiteRun(spark, ignoring, Captured(frame(spark, rows), robots), now=at(1)).run().status == "ok"
