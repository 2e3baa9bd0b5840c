import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sedimenta import cli
from sedimenta.functions.cleaners import moment
from sedimenta.functions.urls import any_join, join_rooted, path_and_query
from sedimenta.operators import extract, lifecycle, report
from sedimenta.plans import reference_queries
from sedimenta.plans.site_run import SiteRun
from sedimenta.sources import pages, web
from sedimenta.sources.pointer import Conflict, Pointer
from sedimenta.sources.store import Store
from sedimenta.spec import SpecError, java, parse_site

ROBOTS = "# rules\nUser-agent: a\nUser-agent: B/2\nDisallow: /x # no\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\nAllow: /ok\nAllow: /o%20k*$\nDisallow:\nCrawl-delay: x\nnonsense\nUser-agent: a\nAllow: /x/y\nCrawl-delay: 5\n"


def test_robots_rules():
    assert pages.rules_for(ROBOTS, 200, "b/9")[0] == [(False, "/x")] and pages.rules_for(ROBOTS, 200, "a")[0] == [(False, "/x"), (True, "/x/y")]
    assert pages.rules_for(ROBOTS, 200, "a")[1] == 5 and pages.rules_for(ROBOTS, 200, "zzz")[0] == [(False, "/"), (True, "/ok"), (True, "/o%20k*$")]
    assert pages.rules_for("", 404, "a") == ([], None) and pages.rules_for(None, 503, "a")[0] == [(False, "/")] and pages.rules_for(None, None, "a")[0] == [(False, "/")]


def test_allowed(spark):
    urls = ["https://h/ok/1", "https://h/nope", "https://h/o%20kay", "https://H/ok", "https://other/x", "https://down/x", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("origin", F.lit("x"))
    rules = pages.robots_rules(spark.createDataFrame([("https://h", 200, ROBOTS), ("https://down", 500, None)], "origin string, status int, text string"), "bot")
    got = {r["url"]: r["allowed"] for r in pages.allowed(df.select("url"), rules).collect()}
    assert [got[u] for u in urls] == [True, False, True, True, True, False, True]


def test_urls(spark):
    cases = [("https://a/b/c?d", "/x"), ("https://a/b/c?d", "x"), ("https://a/b/", "?q"), ("https://a/b", "//z/y"), ("https://a/b", "mailto:x"), (None, "x"), ("https://a", None), ("https://[", "x")]
    df = spark.createDataFrame(cases, "b string, r string")
    got = [tuple(r) for r in df.select(any_join(F.col("b"), F.col("r")), join_rooted(F.col("b"), F.col("r"))).collect()]
    assert got[0] == ("https://a/x", "https://a/x") and got[1] == ("https://a/b/x", None) and got[3] == ("https://z/y", None) and got[4] == ("mailto:x", "mailto:x") and got[5] == (None, None)
    paths = spark.createDataFrame([("https://a",), ("https://a/x%20y+z?q=%C3%B1#f",), ("https://a/%zz",)], "u string").select(path_and_query(F.col("u"))).collect()
    assert [r[0] for r in paths] == ["/", "/x y+z?q=ñ", "/%zz"]


def test_cache(spark):
    now, old = dt.datetime(2026, 1, 10), dt.datetime(2026, 1, 1)
    schema = "url string, status int, html string, fetched_at timestamp_ntz"
    cache = spark.createDataFrame([("a", 200, "A0", old), ("b", 200, "B", old)], schema)
    after = pages.cache_after(cache, spark.createDataFrame([("a", 200, "A1", now), ("b", 304, None, now), ("c", 500, "x", now)], schema), moment(now))
    assert sorted((r["url"], r["html"], r["fetched_at"]) for r in after.collect()) == [("a", "A1", now), ("b", "B", now)]
    asked = spark.createDataFrame([("a",), ("z",)], "url string")
    modes = {m: {r["url"]: r["source"] for r in pages.cached(asked, cache, m, moment(now)).collect()} for m in ("on", "off", "offline")}
    assert modes == {"on": {"a": "network", "z": "network"}, "off": {"a": "network", "z": "network"}, "offline": {"a": "cache", "z": "offline_miss"}}
    with pytest.raises(ValueError):
        pages.cached(asked, cache, "maybe", moment(now))


def test_seeds_and_charsets(spark):
    days = pages.date_seeds(spark.range(1), "/d/{date:%Y/%m/%d}.json?x={y}", dt.date(2026, 1, 2), dt.date(2026, 1, 5), [5, 6])
    assert [r["url"] for r in days.orderBy("day").collect()] == ["/d/2026/01/02.json?x={y}", "/d/2026/01/05.json?x={y}"]
    assert pages.date_seeds(spark.range(1), "{date}", dt.date(2026, 1, 2), dt.date(2026, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        pages.java_date_format("%q")
    body = '<meta charset="ISO-8859-1">ñ'.encode("latin-1")
    df = spark.createDataFrame([(bytearray(body),), (bytearray(b"x"),), (None,)], "c binary")
    rows = df.select(pages.meta_charset(F.col("c")).alias("n"), pages.decoded(F.col("c"), pages.meta_charset(F.col("c"))).alias("t")).collect()
    assert [r["n"] for r in rows] == ["iso-8859-1", "utf-8", "utf-8"] and rows[0]["t"].endswith("ñ") and rows[2]["t"] is None


def test_breaker_and_waits(spark):
    rows = list(enumerate(["fail", "end", "fail", "ok", "fail", "fail", "skip", "fail", "ok"]))
    df = spark.createDataFrame(rows, "i int, o string").withColumn("g", F.lit(1))
    got = report.circuit_breaker(df, ["g"], ["i"], "o", 3).orderBy("i").collect()
    assert [r["failures"] for r in got] == [1, 1, 2, 0, 1, 2, 2, 3, 0] and [r["aborted"] for r in got] == [False] * 7 + [True] * 2
    assert not any(r["aborted"] for r in report.circuit_breaker(df, ["g"], ["i"], "o", 0).collect())
    waits = spark.createDataFrame([(1, None), (9, "x"), (2, "500"), (3, "0")], "a int, r string").select(report.retry_wait(F.col("a"), F.col("r"))).collect()
    assert [r[0] for r in waits] == [2, 30, 120, 8]
    assert report.may_mark_gone(True, True, False, False, "ok", 1, 5) and not report.may_mark_gone(True, True, False, False, "ok", 2, 5)


def test_keys_and_regexes(spark):
    df = spark.createDataFrame([("a", 1.5, "f"), (None, None, "f"), ("x" * 600, None, "f"), ("", None, None)], "a string, b double, f string")
    got = [r[0] for r in df.select(lifecycle.natural_key([F.col("a"), F.col("b")], F.col("f"))).collect()]
    assert got[:2] == ["a|1.5", "f"] and len(got[2]) == 499 and got[2][458] == "#" and got[3] is None
    texts = spark.createDataFrame([("ab1",), ("x",), (None,)], "v string")
    run = lambda p: [r[0] for r in texts.select(extract.post_filter(F.col("v"), p)).collect()]
    assert run(r"\d") == ["1", None, None] and run(r"([a-z])\d") == ["b", None, None] and run(r"(a)|(x)") == ["a", None, None] and run(r"(?P<n>b)?1") == ["b", None, None]
    for bad in ("(", "(?P<a>x)(?P=a)"):
        with pytest.raises(SpecError):
            java(bad)


def test_pointer(spark, tmp_path):
    p = Pointer(spark, str(tmp_path / "P"))
    assert p.read() is None and p.current() == (0, None)
    for i, value in enumerate(({"a": 1}, {"ñ": [1, 2]})):
        p.swap(value, i)
        assert p.current() == (i + 1, value)
    with pytest.raises(Conflict):
        p.swap({"late": 1}, 1)
    assert p.read() == {"ñ": [1, 2]}
    calls = []

    def add(value):
        calls.append(value)
        if len(calls) == 1:
            p.swap({"other": 1}, 2)
        return value | {"mine": 1}

    assert p.change(add) == {"other": 1, "mine": 1} == p.read() and len(calls) == 2
    for i in range(4, 40):
        p.swap({"n": i}, i)
    assert not [f for f in tmp_path.iterdir() if f.name.endswith("tmp")] and len([f for f in tmp_path.iterdir() if not f.name.startswith(".")]) < 30


class Site(BaseHTTPRequestHandler):
    hits: dict = {}

    def do_GET(self):
        n = self.hits[self.path] = self.hits.get(self.path, 0) + 1
        status, body, headers = 200, f"<p>{self.path}ñ</p>".encode(), {}
        if self.path == "/robots.txt":
            body = b"User-agent: *\nDisallow: /private"
        elif self.path == "/flaky" and n == 1:
            status, headers = 503, {"Retry-After": "0.01"}
        elif self.path == "/busy" and n == 1:
            status, headers = 429, {"Retry-After": "0.01"}
        elif self.path.startswith("/gone"):
            status = 404
        elif self.path == "/list":
            status, body = (304, b"") if self.headers.get("If-None-Match") == "v1" else (200, b"<li><a href=/same>A</a><li><a href=/latin>B</a><li><a href=/private/z>C</a>")
        elif self.path == "/moved":
            status, headers = 302, {"Location": "/private/x"}
        elif self.path == "/same" and self.headers.get("If-None-Match") == "v1":
            status, body = 304, b""
        elif self.path == "/latin":
            body = "<p>ñ</p>".encode("latin-1")
            headers = {"Content-Type": "text/html; charset=latin-1"}
        self.send_response(status)
        for k, v in ({"ETag": "v1"} | headers).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def base():
    Site.hits = {}
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def web_site(base, **politeness):
    return parse_site({"name": "w", "base_url": base, "start_urls": ["/list"], "politeness": {"delay_seconds": 0, "max_retries": 2, "timeout_seconds": 5} | politeness,
        "list": {"item_selector": "li", "detail_url": "a::attr(href)", "fields": {"t": {"selector": "a", "required": True}}}, "detail": {"fields": {"d": {"selector": "p"}}}, "key": ["t"]})


def test_requests(spark, base, tmp_path):
    paths = ["/a", "/private/p", "/flaky", "/gone", "/moved", "/latin", "/busy"]
    urls = [base + p for p in paths] + ["http://127.0.0.1:1/x", "nonsense", base + "/a"]
    asked = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, place int")
    got = {r["url"].removeprefix(base): r for r in web.Web(spark, web_site(base), str(tmp_path)).fetch(asked, web_site(base)).collect()}
    assert {p: got[p]["status"] for p in paths} == {"/a": 200, "/private/p": None, "/flaky": 200, "/gone": 404, "/moved": None, "/latin": 200, "/busy": 200}
    assert got["/a"]["html"] == "<p>/añ</p>" and got["/latin"]["html"] == "<p>ñ</p>" and all(got[p]["error"].startswith("robots") for p in ("/private/p", "/moved"))
    assert got["http://127.0.0.1:1/x"]["status"] is None and got["nonsense"]["error"] and len(got) == 9
    assert Site.hits["/robots.txt"] == 1 and Site.hits["/flaky"] == 2 and Site.hits["/busy"] == 2 and "/private/p" not in Site.hits
    # a host that fails isn't asked for ever: after two failures in a row the rest of it stays unasked
    Site.hits = {}
    many = spark.createDataFrame([(f"{base}/gone{i}", i) for i in range(20)], "url string, place int")
    one = web_site(base, max_consecutive_errors=2, max_concurrency=1)
    errors = [r["error"] for r in web.Web(spark, one, str(tmp_path)).fetch(many, one).collect()]
    assert sum(e is None for e in errors) == 2 and sum(bool(e) and e.startswith("stopped") for e in errors) == 18 and len(Site.hits) == 3
    assert web.Web(spark, one, str(tmp_path)).fetch(many.limit(0), one).count() == 0


def test_run_over_the_web(spark, base, tmp_path):
    site, store, root = web_site(base), Store(spark, str(tmp_path / "s")), str(tmp_path / "c")
    dry = lambda mode=None, s=site: SiteRun(spark, s, web.Web(spark, s, root, mode), dry_run=True).run()
    # offline with nothing in the cache: no request at all
    r = dry("offline")
    assert (r.status, r.pages, r.errors) == ("ok", 0, 1) and not Site.hits
    first, again = dry("on"), dry("on")
    assert (first.pages, first.pages_cached, first.items_new, first.errors) == (3, 0, 2, 1) and (again.pages, again.pages_cached, again.items_new) == (3, 3, 2)
    hits = dict(Site.hits)
    r = dry("offline")
    assert (r.pages, r.pages_cached, r.items_new, r.errors) == (3, 3, 2, 1) and Site.hits == hits
    # all stale: asked for with validators, and not changed
    stale = site.model_copy(update={"cache": site.cache.model_copy(update={"ttl_hours": 0.0})})
    r = dry("on", stale)
    assert (r.pages, r.pages_cached, r.items_new) == (3, 2, 2) and Site.hits["/same"] == hits["/same"] + 1  # /latin knows no validators
    # a real run: lists are revalidated, details taken as they are; the forbidden detail is an error that counts for nothing
    run = lambda s=site, **k: SiteRun(spark, s, web.Web(spark, s, root, "on"), store, **k).run()
    hits = dict(Site.hits)
    r = run()
    assert (r.status, r.pages, r.pages_cached, r.items_seen, r.items_new, r.errors) == ("ok", 3, 3, 3, 2, 1) and Site.hits["/same"] == hits["/same"] and Site.hits["/list"] == hits["/list"] + 1
    assert [e["kind"] for e in store.log("errors").collect()] == ["robots"]
    closed = site.model_copy(update={"start_urls": ["/private/list"]})
    r = run(closed)
    assert (r.status, r.pages, r.errors, r.items_gone) == ("ok", 0, 1, 0)


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["init-site", "x", "--folder", str(tmp_path)]) == 0 and cli.main(["init-site", "x", "--folder", str(tmp_path)]) == 1
    site = str(tmp_path / "x.yaml")
    assert cli.main(["validate", site]) == 0 and cli.main(["schema", "--out", str(tmp_path / "s.json")]) == 0 and json.loads((tmp_path / "s.json").read_text())["title"] == "Site"
    (tmp_path / "bad.yaml").write_text("name: x\nnam: y\n")
    assert cli.main(["validate", str(tmp_path / "bad.yaml")]) == 2 and "did you mean 'name'" in capsys.readouterr().err
    page = '<div class=card><a class=title href="/d">T</a></div>'
    rows = [("https://www.example.org/list", None, 200, page), ("https://www.example.org/d", None, 200, "<b class=price>3,5 €</b>")]
    spark.createDataFrame(rows, "url string, final_url string, status int, html string").write.parquet(str(tmp_path / "p"))
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "export", site], spark) == 1
    assert cli.main([*store, "run", site, "--pages", str(tmp_path / "p")], spark) == 0 and cli.main([*store, "status", site], spark) == 0
    assert cli.main([*store, "export", site, "--format", "csv", "--out", str(tmp_path / "o.csv"), "--active"], spark) == 0
    assert (tmp_path / "o.csv").read_text("utf-8-sig").splitlines()[1].startswith("T;3.5;;https://www.example.org/d;")
    assert cli.main([*store, "dry-run", site, "--pages", str(tmp_path / "p")], spark) == 0
    assert "stored 1, active 1" in capsys.readouterr().out


def test_error_messages_are_cut_at_the_stores_limit(spark, tmp_path):
    texts = {"short": "a" * 31, "full": "ñ" * 4000, "over": "ñ" * 4000 + "z", "none": None}
    errors = spark.createDataFrame([(1, k, "fetch", m) for k, m in texts.items()], "run_id bigint, url string, kind string, message string")
    store = Store(spark, str(tmp_path / "s"))
    store.commit("s", 1, None, {"errors": errors})
    assert {r["url"]: r["message"] for r in store.log("errors").collect()} == texts | {"over": "ñ" * 4000}
    errors.withColumn("id", F.lit(1)).write.parquet(str(tmp_path / "errors.parquet"))
    for name, most in (("error_log", 30), ("error_log_whole", 4000)):
        assert {r["url"]: r["message"] for r in reference_queries.QUERIES[name](spark, str(tmp_path)).collect()} == {k: m and m[:most] for k, m in texts.items()}
