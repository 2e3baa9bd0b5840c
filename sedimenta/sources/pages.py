"""Captured pages as a source: start URLs, pages of listings, the cache and robots rules."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions.urls import origin, path_and_query
from sedimenta.spec import Dates, Site

# The codes of strftime that date patterns of URLs use, as Java writes them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%-d": "d", "%-m": "M"}
# How a page declares its charset.
META_CHARSET = r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)"


def java_date_format(pattern: str) -> str:
    """A strftime pattern for date_format; ValueError for codes it lacks."""
    out, literal = "", ""
    for piece in re.split(r"(%-?.)", pattern):
        if piece == "%%":
            literal += "%"
        elif piece.startswith("%"):
            if piece not in STRFTIME:
                raise ValueError(f"date code {piece} isn't supported")
            out += (f"'{literal}'" if literal else "") + STRFTIME[piece]
            literal = ""
        else:
            literal += piece.replace("'", "''")
    return out + (f"'{literal}'" if literal else "")


def date_seeds(sites: DataFrame, template: str, first: dt.date, last: dt.date, skip_weekdays: list[int] = ()) -> DataFrame:
    """sites with day and url for each day from first to last, both included, but for weekdays to skip (0 is Monday)."""
    span = F.sequence(F.lit(first), F.lit(last)) if first <= last else F.array().cast("array<date>")
    days = sites.withColumn("day", F.explode(span))
    if skip_weekdays:
        days = days.filter(~F.weekday("day").isin(list(skip_weekdays)))
    url = F.lit("")
    for piece in re.split(r"(\{date[^}]*\})", template):
        m = re.fullmatch(r"\{date(?::(.*))?\}", piece)
        url = F.concat(url, F.date_format("day", java_date_format(m[1] or "%Y-%m-%d")) if m else F.lit(piece))
    return days.withColumn("url", url)


def seeds(spark: SparkSession, site: Site, today: dt.date, dates: Dates | None = None) -> DataFrame:
    """start_pos, url, by_date: the URLs a run of site starts from, absolute, in the order declared; those with {date...} once per day. dates overrides the declared ones."""
    declared = list(enumerate(site.start_urls))
    span = dates or site.dates
    if span is None:
        return spark.createDataFrame([(i, site.absolute(u), False) for i, u in declared], "start_pos int, url string, by_date boolean")
    first, last = span.ends(today)
    out = spark.createDataFrame([(i, site.absolute(u)) for i, u in declared if "{date" not in u], "_no int, url string").select("_no", F.lit(first).alias("day"), "url", F.lit(False).alias("by_date"))
    for i, u in declared:
        if "{date" in u:
            days = date_seeds(spark.createDataFrame([(i,)], "_no int"), site.absolute(u), first, last, span.skip_weekdays)
            out = out.unionByName(days.select("_no", "day", "url", F.lit(True).alias("by_date")))
    numbered = F.row_number().over(Window.orderBy("_no", "day")) - 1  # days of one declaration: few
    return out.select(numbered.cast("int").alias("start_pos"), "url", "by_date")


def page_url(template: Column, start_page: int, page_no: Column) -> Column:
    """The URL of a listing's page_no-th page by its template, in which {page} is a number that is start_page on the first page."""
    return F.replace(template, F.lit("{page}"), (page_no + (start_page - 1)).cast("string"))


def fetch_outcome(status: Column, tolerated: Column, error: Column | None = None) -> Column:
    """ok, fail, or end: a 404 or 410 where the end of a listing may show so. A null status is a failure, unless error says that robots rules forbade the page (robots) or that it wasn't asked for (stopped)."""
    told = F.lit(None) if error is None else F.when(error.startswith("robots: "), "robots").when(error.startswith("stopped: "), "stopped")
    return F.coalesce(told, F.when(status < 400, "ok").when(status.isin(404, 410) & tolerated, "end").otherwise("fail"))


def fresh(fetched_at: Column, now: Column, ttl_hours: float) -> Column:
    """Whether a response may still be used: younger than ttl_hours."""
    return fetched_at > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_hours * 3600).cast("decimal(18,6)"))


#: What a cache keeps of a response, if it has it.
KEPT = ["final_url", "status", "html", "etag", "last_modified", "fetched_at"]


def cached(requests: DataFrame, cache: DataFrame, mode: str, now: Column, ttl_hours: float = 24, revalidate: bool = False) -> DataFrame:
    """requests (url, ...) with source: cache, network or offline_miss, and the cached response's columns as cached_*.

    mode off never looks, offline takes whatever is there, on takes what is fresh, unless it is to be revalidated, and leaves
    the rest to the network. Of several responses to one URL the latest counts.
    """
    if mode not in ("off", "on", "offline"):
        raise ValueError(f"cache mode {mode!r}")
    kept = [c for c in KEPT if c in cache.columns]
    latest = cache.groupBy("url").agg(F.max_by(F.struct(*kept), "fetched_at").alias("hit"))
    both = requests.join(latest, "url", "left")
    on = F.lit(False) if revalidate else fresh(F.col("hit.fetched_at"), now, ttl_hours)
    usable = F.col("hit").isNotNull() & {"off": F.lit(False), "offline": F.lit(True), "on": on}[mode]
    missed = F.lit("offline_miss" if mode == "offline" else "network")
    both = both.withColumn("source", F.when(F.coalesce(usable, F.lit(False)), "cache").otherwise(missed))
    keep = F.col("source") == "cache"
    return both.select(*requests.columns, "source", *(F.when(keep, F.col(f"hit.{c}")).alias(f"cached_{c}") for c in kept))


def cache_after(cache: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """The cache after responses (url, status, html, fetched_at and others of KEPT): errors aren't stored, the latest counts.

    A 304 renews the date of what is there: to now, or its own where now is null.
    """
    kept = [c for c in KEPT if c in cache.columns and c in responses.columns]
    stored = cache.select("url", *kept).unionByName(responses.filter(F.col("status") < 400).filter(F.col("status") != 304).select("url", *kept))
    latest = stored.groupBy("url").agg(F.max_by(F.struct(*kept), "fetched_at").alias("r"))
    renewed = responses.filter(F.col("status") == 304).groupBy("url").agg(F.max("fetched_at").alias("renewed"), F.lit(True).alias("is_renewed"))
    both = latest.join(renewed, "url", "left")
    date = F.when(F.col("is_renewed"), F.coalesce(now, F.greatest("renewed", F.col("r.fetched_at")))).otherwise(F.col("r.fetched_at"))
    return both.select("url", *((date if c == "fetched_at" else F.col(f"r.{c}")).alias(c) for c in kept))


def best_capture(captures: DataFrame, columns: list[str]) -> DataFrame:
    """url and columns of one capture of each URL (url, status, html, fetched_at and columns): the latest usable one, else the latest.

    Usable as in cache_after: a status under 400 that is not 304. One with a body counts before one without. A capture
    without a date is older than all others; ties go by the columns' order.
    """
    usable = F.coalesce((F.col("status") < 400) & (F.col("status") != 304), F.lit(False))
    columns = [c for c in columns if c != "url"]
    body = usable & (F.coalesce(F.length("html"), F.lit(0)) > 0)
    best = F.max(F.struct(body.alias("_body"), usable.alias("_usable"), "fetched_at", *columns))
    return captures.groupBy("url").agg(best.alias("p")).select("url", *(F.col(f"p.{c}").alias(c) for c in columns))


def meta_charset(content: Column) -> Column:
    """The charset a page's first 4096 bytes declare in a meta tag, in lower case, else utf-8. content: binary."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(head, META_CHARSET, 1)), F.lit("")), F.lit("utf-8"))


def decoded(content: Column, charset: Column) -> Column:
    """Bytes as text by a charset's name; what it can't read becomes U+FFFD, an unknown charset is read as UTF-8. Runs in Python, as the JVM knows few charsets."""
    return _decode(content, charset)


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, name):
        if raw is None:
            return None
        try:
            return bytes(raw).decode(name or "utf-8", "replace")
        except LookupError:
            return bytes(raw).decode("utf-8", "replace")

    return pd.Series([one(r, n) for r, n in zip(content, charset)], dtype=object)


# --- robots rules ---


# The lines of a robots.txt that count.
AGENT, RULES, DELAY = "user-agent", ("allow", "disallow"), "crawl-delay"
DIRECTIVE = re.compile(r"([^:#]*):([^#]*)")


def _agent_token(name: str) -> str:
    return name.split("/")[0].strip().lower()


def robots_lines(text: str) -> pd.DataFrame:
    """A robots.txt as a relation: agent, key, value, one row per directive and agent it is for, in order.

    Each agent also has a row of its own, with the key user-agent. Agents of lines in a row are meant together; what comes
    before the first of them is for nobody. Comments and lines without a colon are no directives.
    """
    found = [m.groups() for m in map(DIRECTIVE.match, text.splitlines()) if m]
    lines = pd.DataFrame([(k.strip().lower(), v.strip()) for k, v in found], columns=["key", "value"], dtype=object)
    names = lines["key"] == AGENT
    # a block begins where a line names an agent and the one before doesn't
    lines["block"] = (names & ~names.shift(fill_value=False)).cumsum()
    agents = lines.loc[names, ["block", "value"]].rename(columns={"value": "agent"})
    agents["agent"] = agents["agent"].map(_agent_token)
    return agents.drop_duplicates().merge(lines, on="block")[["agent", "key", "value"]]


def rules_for(text: str | None, status: int | None, agent: str) -> tuple[list[tuple[bool, str]], float | None]:
    """Rules (allow, pattern) and delay for an agent: those of its own blocks, else of '*'. No answer or an error of the server denies all, 4xx allows all."""
    if status is None or status >= 500:
        return [(False, "/")], None
    lines = robots_lines("" if status >= 400 else text or "")
    own = _agent_token(agent)
    lines = lines[lines["agent"] == (own if own and own in set(lines["agent"]) else "*")]
    rules = lines[lines["key"].isin(RULES) & (lines["value"] != "")]
    delays = pd.to_numeric(lines.loc[lines["key"] == DELAY, "value"], errors="coerce").dropna()
    return [(k == RULES[0], v) for k, v in zip(rules["key"], rules["value"])], float(delays.max()) if len(delays) else None


def rule_regex(pattern: str) -> str:
    """A robots pattern for rlike, from the start of the path: '*' is anything, a final '$' the end; percent escapes are resolved as in paths."""
    from urllib.parse import unquote

    body = unquote(pattern.rstrip("$"))
    return "(?s)^" + ".*".join(re.escape(p) for p in body.split("*")) + ("$" if pattern.endswith("$") else "")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, allow, pattern, size, rx: the rules of each robots.txt (origin, status, text) for an agent."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(o, a, p, len(p), rule_regex(p)) for o, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))) for a, p in rules_for(t, s, agent)[0]]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string()))], ["origin", "allow", "pattern", "size", "rx"])

    return robots.select("origin", F.col("status").cast("int").alias("status"), "text").mapInArrow(run, "origin string, allow boolean, pattern string, size int, rx string")


def crawl_delays(robots: DataFrame, agent: str) -> DataFrame:
    """origin, crawl_delay: the delay each robots.txt (origin, status, text) asks an agent for, the largest if there are several; null without one."""

    @F.pandas_udf(T.DoubleType())
    def delay(status: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([rules_for(None if pd.isna(t) else t, None if pd.isna(s) else int(s), agent)[1] for s, t in zip(status, text)], dtype="float64")

    return robots.select("origin", delay(F.col("status").cast("int"), F.col("text")).alias("crawl_delay"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, ...) with allowed: the longest pattern of its origin that matches decides, allow before deny; true without one.

    An equi-join on the origin; the rules of an origin come as one short list, so no URL is paired with other origins' rules.
    """
    listed = rules.groupBy("origin").agg(F.collect_list(F.struct("size", "allow", "rx")).alias("rules"))  # a robots.txt is a bounded file
    both = urls.withColumn("origin", origin(F.col("url"))).join(listed, "origin", "left").withColumn("_path", path_and_query(F.col("url")))
    hits = F.filter(F.coalesce("rules", F.array().cast("array<struct<size:int,allow:boolean,rx:string>>")), lambda r: F.rlike(F.col("_path"), r["rx"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["size"], r["allow"])))
    return both.select(*urls.columns, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
