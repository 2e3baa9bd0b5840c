"""Where a run's pages come from: captured pages, or the web with robots rules, a cache, pacing and retries.

Both answer fetch(asked): asked (url, place and whatever else) with the columns of RESPONSE. What is fetched is written
to the shared folder once, as asking again would be another request. Python does nothing but the requests; which are
made, when, and which again, is decided by DataFrame operators between rounds.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
import uuid
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.urls import origin
from sedimenta.operators.report import pacing, retry_wait
from sedimenta.session import cut
from sedimenta.sources import pages as P
from sedimenta.sources.pointer import Pointer
from sedimenta.spec import Site

RESPONSE = {"final_url": "string", "status": "int", "html": "string", "from_cache": "boolean", "elapsed_ms": "int", "error": "string"}
CACHE = "url string, final_url string, status int, html string, etag string, last_modified string, fetched_at timestamp_ntz"
AGENT = "sedimenta/0.2"
# Headers of every request, which a site may override.
HEADERS = {"User-Agent": AGENT, "Accept-Language": "es-ES,es;q=0.9,en;q=0.5"}
#: What error begins with where robots rules forbid a page, and where a host wasn't asked any more.
ROBOTS, STOPPED = "robots: ", "stopped: "
#: Hosts that one task asks at a time.
HOSTS = 16
#: Files of the cache that are joined into one by the run that would add another.
FRAGMENTS = 64


def _with_response(asked: DataFrame, found: DataFrame) -> DataFrame:
    return asked.join(found.select("url", *RESPONSE), "url", "left")


class Captured:
    """pages: url, final_url, status, html and, if known, from_cache, elapsed_ms and fetched_at; robots, if given: origin, status, text.

    Of several captures of a URL the latest usable one counts (pages.best_capture), an error only where there is none. A URL
    that isn't there has null columns.
    """

    def __init__(self, pages: DataFrame, robots: DataFrame | None = None):
        kinds = RESPONSE | {"fetched_at": "timestamp_ntz"}
        lacking = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in pages.columns}
        self.pages = pages.withColumns(lacking) if lacking else pages
        self.robots = robots

    def fetch(self, asked: DataFrame, site: Site, revalidate: bool = False) -> DataFrame:
        """Only captures of asked URLs are looked at, whose html is shuffled once."""
        wanted = self.pages.join(asked.select("url").distinct(), "url", "left_semi")
        found = P.best_capture(wanted, list(RESPONSE))
        if self.robots is not None and site.politeness.respect_robots:
            rules = P.robots_rules(self.robots, site.fetch.headers.get("User-Agent", AGENT))
            found = asked.select("url").distinct().join(found, "url", "left")
            found = found.drop("error").join(forbidden(found.select("url", "final_url"), rules), "url", "left")
            found = found.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in RESPONSE if c != "error"})
        return _with_response(asked, found)


def forbidden(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """url, error of the responses (url, final_url) that rules forbid, where they were asked for or where they were redirected to."""
    said = P.allowed(responses.select("url", F.explode(F.array_distinct(F.array("url", F.coalesce("final_url", "url")))).alias("_at")).withColumnRenamed("url", "_url").withColumnRenamed("_at", "url"), rules)
    wrong = said.filter("NOT allowed").groupBy(F.col("_url").alias("url")).agg(F.bool_or(F.col("url") == F.col("_url")).alias("itself"), F.min("url").alias("to"))
    return wrong.select("url", F.when(F.col("itself"), f"{ROBOTS}forbidden by robots.txt").otherwise(F.concat(F.lit(f"{ROBOTS}redirected to "), "to", F.lit(", forbidden by robots.txt"))).alias("error"))


class Web:
    """Pages over HTTP for one site and run.

    mode off: no cache; on: fresh entries are used, except for lists that are to be revalidated, stale ones are asked for
    with their validators; offline: the cache alone. robots.txt is read once per origin and run. Each host is asked in the
    order of place, one request per gap (the larger of delay_seconds and its crawl delay), with max_concurrency in flight.
    Responses with a status of retry_status, and failures, are asked for again, up to max_retries attempts in all; after
    a 429 the whole host waits. A host that fails max_consecutive_errors times in a row isn't asked on in that round.
    """

    def __init__(self, spark: SparkSession, site: Site, root: str, mode: str | None = None, now: Column | None = None):
        self.spark, self.mode = spark, mode or ("on" if site.cache.enabled else "off")
        self.root = f"{root}/{site.name}"
        self.pointer = Pointer(spark, f"{self.root}/CACHE") if self.mode != "off" else None
        self.now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
        self.texts: DataFrame | None = None

    # --- cache ---

    def _entries(self, urls: DataFrame) -> DataFrame:
        folders = (self.pointer.read() or {"files": []})["files"] if self.pointer else []
        log = self.spark.read.schema(CACHE).parquet(*folders) if folders else self.spark.createDataFrame([], CACHE)
        log = log.join(urls.select("url").distinct(), "url", "left_semi")
        return P.cache_after(log.filter("status <> 304"), log.filter("status = 304"), F.lit(None).cast("timestamp_ntz"))

    def _keep(self, responses: DataFrame) -> None:
        """Responses under 400 join the cache; of a 304 just its moment."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        responses.filter("status < 400").withColumn("fetched_at", self.now).select(*(c.split()[0] for c in CACHE.split(", "))).write.parquet(path)
        value = self.pointer.change(lambda v: {"files": [*(v or {"files": []})["files"], path]})
        if len(value["files"]) > FRAGMENTS:
            log = self.spark.read.schema(CACHE).parquet(*value["files"])
            whole = f"{self.root}/{uuid.uuid4().hex}"
            P.cache_after(log.filter("status <> 304"), log.filter("status = 304"), F.lit(None).cast("timestamp_ntz")).write.parquet(whole)
            self.pointer.change(lambda v: {"files": [whole, *(f for f in v["files"] if f not in value["files"])]})

    # --- the web ---

    def _robots(self, urls: DataFrame, site: Site, headers: dict) -> DataFrame:
        """origin, status, text of the robots.txt of all origins so far, each asked once."""
        origins = urls.select(origin(F.col("url")).alias("origin")).filter("origin IS NOT NULL").distinct()
        if self.texts is not None:
            origins = origins.join(self.texts, "origin", "left_anti")
        asked = origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit(0.0).alias("ready_s"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
        got = cut(request(asked, site, headers, stop_after=0).select(F.regexp_replace("url", "/robots.txt$", "").alias("origin"), "status", F.col("html").alias("text")))
        self.texts = got if self.texts is None else cut(self.texts.unionByName(got))
        return self.texts

    def fetch(self, asked: DataFrame, site: Site, revalidate: bool = False) -> DataFrame:
        urls = asked.groupBy("url").agg(F.min("place").alias("place")).filter(F.col("url").isNotNull())
        if self.mode == "off":
            got = self._ask(urls.withColumns({"etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string")}), site)
            return _with_response(asked, got)
        entries = cut(self._entries(urls))
        looked = cut(P.cached(urls, entries, self.mode, self.now, site.cache.ttl_hours, revalidate))
        hit = looked.filter("source = 'cache'").select("url", F.col("cached_final_url").alias("final_url"), F.col("cached_status").alias("status"), F.col("cached_html").alias("html"), F.lit(True).alias("from_cache"), F.lit(0).alias("elapsed_ms"), F.lit(None).cast("string").alias("error"))
        if self.mode == "offline":
            missed = looked.filter("source <> 'cache'").select("url", *(F.lit(None).cast(k).alias(n) for n, k in RESPONSE.items() if n != "error"), F.lit("offline, and not in the cache").alias("error"))
            return _with_response(asked, hit.unionByName(missed))
        got = self._ask(looked.filter("source = 'network'").select("url", "place").join(entries.select("url", "etag", "last_modified"), "url", "left"), site)
        self._keep(got)
        old = entries.select("url", *(F.col(c).alias(f"_{c}") for c in ("final_url", "status", "html")))
        renewed = (F.col("status") == 304) & F.col("_status").isNotNull()
        pick = {c: F.when(renewed, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("final_url", "html")} | {"from_cache": renewed, "status": F.when(renewed, F.col("_status")).otherwise(F.col("status"))}
        got = got.join(old, "url", "left").select("url", *(pick.get(n, F.col(n)).alias(n) for n in RESPONSE))
        return _with_response(asked, hit.unionByName(got))

    def _ask(self, urls: DataFrame, site: Site) -> DataFrame:
        """urls (url, place, etag, last_modified) asked for, again where that may help: url, RESPONSE, etag, last_modified."""
        rule, headers = site.politeness, HEADERS | site.fetch.headers
        open_ = cut(urls.withColumns({"attempt": F.lit(1), "wait_s": F.lit(0.0)}))
        done, gap = [], None
        if rule.respect_robots:
            texts = self._robots(urls, site, headers)
            rules = cut(P.robots_rules(texts, headers["User-Agent"]))
            gap = P.crawl_delays(texts, headers["User-Agent"])
            no = cut(forbidden(open_.select("url", F.lit(None).cast("string").alias("final_url")), rules))
            done.append(no.select("url", *(F.lit(None).cast(k).alias(n) for n, k in RESPONSE.items() if n != "error"), "error", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified")))
            open_ = open_.join(no, "url", "left_anti")
        host = origin(F.col("url"))
        while True:
            timed = open_.withColumn("_host", F.coalesce(host, F.lit("")))
            timed = timed.join(gap, timed["_host"] == gap["origin"], "left").drop("origin") if gap is not None else timed.withColumn("crawl_delay", F.lit(None).cast("double"))
            timed = pacing(timed, "_host", ["wait_s", "place", "url"], F.lit(rule.delay_seconds), F.col("crawl_delay"))
            got = cut(request(timed.withColumn("ready_s", F.col("ready_s") + F.col("wait_s")), site, headers, rule.max_consecutive_errors))
            both = open_.join(got.withColumnsRenamed({"etag": "_etag", "last_modified": "_modified"}), "url")
            stopped = F.coalesce(F.col("error").startswith(STOPPED), F.lit(False))
            again = (F.col("status").isNull() | F.col("status").isin(rule.retry_status)) & (F.col("attempt") < rule.max_retries) & ~stopped
            wait = F.when(again, retry_wait(F.col("attempt"), F.col("retry_after")))
            held = F.max(F.when(F.col("status") == 429, wait)).over(Window.partitionBy(origin(F.col("url"))))
            both = cut(both.withColumns({"_again": again, "_stopped": stopped, "_wait": F.greatest(F.coalesce(wait, F.lit(0.0)), F.coalesce(held, F.lit(0.0)))}))
            more = both.filter("_again OR _stopped")
            left = more.agg(F.count_if("_again").alias("again"), F.count_if("_stopped").alias("stopped")).collect()[0]
            final = both.filter("NOT _again AND NOT _stopped") if left["again"] else both
            done.append(final.select("url", *RESPONSE, F.col("_etag").alias("etag"), F.col("_modified").alias("last_modified")))
            if not left["again"]:  # where all that failed has failed for good, what wasn't asked stays so: the breaker tells
                break
            step = F.when(F.col("_again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
            open_ = cut(more.select("url", "place", "etag", "last_modified", step.alias("attempt"), F.col("_wait").alias("wait_s")))
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        if rule.respect_robots:  # redirects may lead to other origins, or to what is forbidden here
            moved = cut(out.filter("final_url <> url").select("url", "final_url"))
            texts = self._robots(moved.select(F.col("final_url").alias("url")), site, headers)
            late = forbidden(moved, P.robots_rules(texts, headers["User-Agent"])).withColumnRenamed("error", "_late")
            out = out.join(late, "url", "left")
            out = out.withColumns({c: F.when(F.col("_late").isNull(), F.col(c)) for c in out.columns if c not in ("url", "error", "_late")} | {"error": F.coalesce("_late", "error")}).drop("_late")
        return cut(out)


def text_of(body: bytes, header: str | None) -> str:
    """A body as text: by the charset of the Content-Type header, else of a meta tag in the first 4096 bytes, else UTF-8."""
    named = re.search(r"charset=[\"']?([\w-]+)", header or "", re.I) or re.search(P.META_CHARSET.encode(), body[:4096])
    name = named[1] if named else "utf-8"
    name = name.decode("ascii", "replace") if isinstance(name, bytes) else name
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def request(asked: DataFrame, site: Site, headers: dict, stop_after: int) -> DataFrame:
    """One request for each of asked (url, ready_s, etag, last_modified), ready_s seconds from the start of its task at the earliest.

    url, final_url, status, html, from_cache, elapsed_ms, error, etag, last_modified, retry_after. All of a host is in one task,
    as it has one pace; hosts of a task are asked side by side, up to HOSTS. After stop_after failures in a row (0: never), and
    after a 429, the rest of the host comes out with an error that begins with STOPPED.
    """
    timeout, flight = site.politeness.timeout_seconds, max(1, site.politeness.max_concurrency)
    schema = "url string, " + ", ".join(f"{n} {k}" for n, k in RESPONSE.items()) + ", etag string, last_modified string, retry_after string"

    def one(url: str, etag: str | None, modified: str | None) -> dict:
        own = headers | {n: v for n, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
        began = time.monotonic()
        took = lambda: int((time.monotonic() - began) * 1000)
        said = lambda h: {"etag": h.get("ETag"), "last_modified": h.get("Last-Modified"), "retry_after": h.get("Retry-After")}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=own), timeout=timeout) as r:
                return {"url": url, "final_url": r.url, "status": r.status, "html": text_of(r.read(), r.headers.get("Content-Type")), "elapsed_ms": took()} | said(r.headers)
        except urllib.error.HTTPError as e:
            return {"url": url, "final_url": e.url or url, "status": e.code, "html": text_of(e.read(), e.headers.get("Content-Type")), "elapsed_ms": took()} | said(e.headers)
        except (OSError, ValueError) as e:
            return {"url": url, "error": f"{type(e).__name__}: {e}"}

    def ask_host(rows: list[tuple], start: float) -> list[dict]:
        rows, out, lock, streak = iter(sorted(rows, key=lambda r: (r[1], r[0]))), [], Lock(), [0]

        def work() -> None:
            while True:
                with lock:
                    row = next(rows, None)
                    if row is None:
                        return
                    if streak[0] is None or (stop_after and streak[0] >= stop_after):
                        out.append({"url": row[0], "error": f"{STOPPED}the host failed too often"})
                        continue
                    time.sleep(max(0.0, start + row[1] - time.monotonic()))
                got = one(row[0], row[2], row[3])
                with lock:
                    out.append(got)
                    if got.get("status") == 429:
                        streak[0] = None
                    elif streak[0] is not None:
                        streak[0] = streak[0] + 1 if (got.get("status") or 599) >= 400 else 0

        with ThreadPoolExecutor(flight) as pool:
            for f in [pool.submit(work) for _ in range(flight)]:
                f.result()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, list[tuple]] = defaultdict(list)
        for batch in batches:
            for host, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                hosts[host].append(tuple(row))
        start = time.monotonic()
        names = ["url", *RESPONSE, "etag", "last_modified", "retry_after"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        with ThreadPoolExecutor(HOSTS) as pool:
            for rows in pool.map(lambda r: ask_host(r, start), hosts.values()):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n, False if n == "from_cache" else None) for r in rows], k) for n, k in zip(names, kinds)], names)

    rows = asked.select(F.coalesce(origin(F.col("url")), F.lit("")).alias("_host"), "url", F.col("ready_s").cast("double").alias("ready_s"), "etag", "last_modified")
    return rows.repartition("_host").mapInArrow(run, schema)
