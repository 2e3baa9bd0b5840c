"""A run of one site, as a DataFrame plan: listing, filter, limit, skip, detail join, check, upsert, report."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.cleaners import moment
from sedimenta.functions.urls import any_join
from sedimenta.operators import extract, lifecycle, report
from sedimenta.session import cut, cuts, ship
from sedimenta.sources import pages as P
from sedimenta.sources.store import Store
from sedimenta.sources.web import Captured, Web
from sedimenta.spec import Dates, Site

ORDER = ["start_pos", "page_no", "item_pos"]
#: The place of a fetch in a run: that of the item that asked for it; a list page stands before its items.
PLACE = "struct<start_pos:int,page_no:int,item_pos:int>"
COUNTERS = ["pages", "pages_cached", "items_new", "items_updated", "items_unchanged", "items_skipped", "items_gone", "errors"]


@dataclass
class RunReport:
    site: str
    status: str = "running"
    pages: int = 0
    pages_cached: int = 0
    items_seen: int = 0
    items_new: int = 0
    items_updated: int = 0
    items_unchanged: int = 0
    items_skipped: int = 0
    items_gone: int = 0
    items_invalid: int = 0
    items_filtered: int = 0
    errors: int = 0
    warnings: list[str] = field(default_factory=list)
    empty_fields: dict[str, int] = field(default_factory=dict)
    sample: list[dict] = field(default_factory=list)

    @property
    def items_extracted(self) -> int:
        return self.items_seen - self.items_skipped

    def fill_rate(self, name: str) -> float:
        return 1 - self.empty_fields.get(name, 0) / self.items_extracted if self.items_extracted else 1.0


class SiteRun:
    """pages: a source of pages (web.Captured or web.Web), or captured pages as a DataFrame.

    A URL that the source lacks is a failed fetch. Without a store, or dry, no items, pages or errors are written and every
    valid item is new; a dry run with a store leaves a row with status dry-run. A run that fails is stored with status error,
    one that is stopped with interrupted.
    """

    def __init__(self, spark: SparkSession, site: Site, pages: DataFrame | Captured | Web, store: Store | None = None, dry_run: bool = False, limit: int | None = None, dates: Dates | None = None, now: dt.datetime | None = None, batch: tuple[str, int] | None = None):
        ship(spark)
        self.spark, self.site, self.store, self.dry = spark, site, store, dry_run
        self.limit, self.dates, self.now, self.batch = limit, dates, now or dt.datetime.now().replace(microsecond=0), batch
        self.at = moment(self.now)
        self.source = Captured(pages.filter(F.col("url").isNotNull())) if isinstance(pages, DataFrame) else pages

    @property
    def writes(self) -> bool:
        return self.store is not None and not self.dry

    # --- the run ---

    def run(self) -> RunReport:
        rep, self._began = RunReport(self.site.name), dt.datetime.now()
        run_id = self.store.begin(self.site.name, self.now, self.dry) if self.store else None
        try:
            with cuts(self.spark):
                self._run(rep, run_id)
        except Exception as e:
            logging.getLogger(__name__).exception("run of %s failed", self.site.name)
            rep.status, rep.errors = "error", rep.errors + 1
            self._finish(rep, run_id, [(None, "fetch", f"{type(e).__name__}: {e}")])
        except BaseException:
            rep.status = "interrupted"
            self._finish(rep, run_id, [])
            raise
        return rep

    def _row(self, rep: RunReport, run_id: int) -> DataFrame:
        values = {"id": run_id, "site": self.site.name, "started_at": self.now, "finished_at": self.now + (dt.datetime.now() - self._began), "status": "dry-run" if self.dry else rep.status} | {c: getattr(rep, c) for c in COUNTERS} | {"notes": "\n".join(rep.warnings) or None}
        kinds = ["bigint", "string", "timestamp_ntz", "timestamp_ntz", "string", *["int"] * len(COUNTERS), "string"]
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} {k}" for c, k in zip(values, kinds)))

    def _finish(self, rep: RunReport, run_id: int | None, errors: list[tuple]) -> None:
        """Stores the run's own row, without items."""
        if run_id is None:
            return
        logs = {"runs": self._row(rep, run_id)}
        if errors and self.writes:
            logs["errors"] = self._stamped(self.spark.createDataFrame(errors, "url string, kind string, message string"), run_id, "created_at")
        self.store.commit(self.site.name, run_id, None, logs, batch=None)

    def _stamped(self, df: DataFrame, run_id: int, column: str) -> DataFrame:
        return df.withColumn("run_id", F.lit(run_id)).withColumn(column, self.at)

    # --- fetching ---

    def _fetch(self, asked: DataFrame, tolerated: Column, kind: str) -> DataFrame:
        """asked (url, place, ...) with the response's columns, outcome and kind. Lists are revalidated unless the run is dry."""
        got = self.source.fetch(asked, self.site, revalidate=kind == "list" and not self.dry)
        return got.withColumn("outcome", P.fetch_outcome(F.col("status"), tolerated, F.col("error"))).withColumn("kind", F.lit(kind))

    def _aborted_at(self, fetches: list[DataFrame]):
        """The place of the fetch that made max_consecutive_errors failures in a row, or None."""
        rows = _all([f.select("place", "kind", "url", "outcome") for f in fetches]).withColumn("_one", F.lit(1))
        told = report.circuit_breaker(rows, ["_one"], ["place", "kind", "url"], "outcome", self.site.politeness.max_consecutive_errors)
        return told.filter("aborted").agg(F.min("place").alias("m")).collect()[0]["m"]

    def _listing(self) -> tuple[DataFrame, DataFrame]:
        """Fetched list pages, and the rows of extract.listing() of those that have a body. A level of pages at a time, max_pages at most."""
        place = F.struct("start_pos", "page_no", F.lit(-1).alias("item_pos")).cast(PLACE).alias("place")
        asked = cut(P.seeds(self.spark, self.site, self.now.date(), self.dates).withColumn("page_no", F.lit(1)).select("*", place))
        fetched, rows, visited = [], [], asked.select("start_pos", "url")
        rule = self.site.pagination
        for n in range(1, rule.max_pages + 1):
            level = cut(self._fetch(asked, F.col("by_date") | F.lit(n > 1), "list"))
            fetched.append(level)
            parsed = cut(extract.listing(level.filter("outcome = 'ok'"), self.site))
            rows.append(parsed)
            if n == rule.max_pages or not (rule.url_template or rule.next_selector) or self._aborted_at(fetched) is not None:
                break
            more = parsed.filter("item_pos IS NOT NULL").select("start_pos", "url").distinct()
            following = parsed.filter("item_pos IS NULL AND problem IS NULL").join(more, ["start_pos", "url"], "left_semi")
            following = following.withColumn("page_no", F.col("page_no") + 1)
            if rule.url_template:
                onward = P.page_url(F.lit(self.site.absolute(rule.url_template)), rule.start_page, F.col("page_no"))
            else:
                onward = F.col("next_url")
            asked = following.select("start_pos", onward.alias("url"), "by_date", "page_no").filter("url IS NOT NULL")
            asked = cut(asked.join(visited, ["start_pos", "url"], "left_anti").select("start_pos", "url", "by_date", "page_no", place))
            if not asked.limit(1).count():
                break
            visited = visited.unionByName(asked.select("start_pos", "url"))
        return cut(_all(fetched)), cut(_all(rows))

    def _skip(self, wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The places of wanted records whose stored item is fresh, and the items (site, natural_key) they touch."""
        site, names = self.site, list(self.site.list.fields)
        in_list = not site.key or set(site.key) <= set(names)
        has = wanted.filter("detail_url IS NOT NULL").withColumn("site", F.lit(site.name))
        has = has.withColumn("list_json", lifecycle.canonical_json({n: F.col(f"f_{n}") for n in names}) if names else F.lit("{}"))
        has = has.withColumn("source_url", F.col("detail_url")).withColumn("natural_key", lifecycle.natural_key([F.col(f"f_{k}") for k in site.key] if in_list else [], F.col("detail_url")))
        skipped = lifecycle.skippable(has, stored, names, "natural_key" if in_list else "source_url", self.at, site.detail.refresh_days)
        skipped = cut(skipped.select(*ORDER, "site", "natural_key", "source_url"))
        if in_list:
            return skipped, skipped.select("site", "natural_key")
        alone = lifecycle.unique_by_url(stored).select("site", "source_url", "natural_key")
        return skipped, skipped.select("site", "source_url").join(alone, ["site", "source_url"]).select("site", "natural_key")

    def _run(self, rep: RunReport, run_id: int | None) -> None:
        site = self.site
        snapshot = self.store.snapshot(site.name) if self.store else None
        stored = self.store.items(site.name) if self.store else None
        fetched, rows = self._listing()
        listed = extract.with_fields(rows.filter("item_pos IS NOT NULL"), site.list.fields, self.at)
        listed = listed.withColumn("missing", extract.missing(site.list.fields)).withColumn("passes", extract.passes(site))
        listed = cut(listed.withColumn("detail_url", any_join(F.col("page_base"), F.col("detail_url"))))
        # what comes after the place of end didn't happen: the page of the limit's last record, or of the breaker's
        end = self._aborted_at([fetched])
        aborted = end is not None
        wanted = listed.filter("passes")
        if aborted:
            wanted = wanted.filter(_page_until(end))
        if self.limit is not None:
            wanted = cut(wanted.orderBy(*ORDER).limit(self.limit))
            last = wanted.agg(F.max(F.struct(*ORDER)).alias("m")).collect()[0]["m"]
            if last is not None and wanted.count() == self.limit:
                aborted, end = False, last
        seen = wanted = wanted.drop("passes")
        skipped = touched = None
        if site.detail and site.detail.refresh_days is not None and self.writes:
            skipped, touched = self._skip(wanted, stored)
            wanted = cut(wanted.join(skipped.select(*ORDER), ORDER, "left_anti"))
        details = None
        if site.detail:
            urls = wanted.filter("detail_url IS NOT NULL").groupBy(F.col("detail_url").alias("url")).agg(F.min(F.struct(*ORDER)).cast(PLACE).alias("place"))
            details = cut(self._fetch(urls, F.lit(False), "detail"))
            stop = self._aborted_at([fetched if end is None else fetched.filter(_page_until(end)), details])
            if stop is not None:
                aborted, end, last = True, stop, None
                details = cut(details.filter(F.col("place") <= _place(stop)))
                seen, wanted = seen.filter(_page_until(stop)), cut(wanted.filter(_page_until(stop)))
                skipped = skipped.filter(_page_until(stop)) if skipped is not None else None
            details = cut(details.filter("outcome <> 'stopped'"))
        if end is not None:
            fetched, rows = fetched.filter(_page_until(end)), rows.filter(_page_until(end))
        until = F.lit(True) if end is None else F.struct(*ORDER) < _place(end) if self.limit is not None and not aborted else _page_until(end)
        rep.items_filtered = listed.filter(~F.col("passes") & until).count()
        rep.items_seen = seen.count()
        rep.items_skipped = skipped.count() if skipped is not None else 0

        records = cut(self._with_details(wanted, details))
        lost = F.col("detail_url").isNotNull() & ~F.col("has_detail") if site.detail else F.lit(False)
        n_lost = records.filter(lost).count()
        records = records.filter(~lost)
        kinds = {n: extract.kind_of(f) for n, f in site.all_fields.items()}
        rep.empty_fields = {r["field"]: r["empty"] for r in report.empty_counts(records, kinds).collect() if r["empty"]}
        columns = {c[2:]: F.col(c) for c in records.columns if c.startswith("f_")}
        if not site.detail and site.list.detail_url and "detail_url" not in columns:
            columns["detail_url"] = F.col("detail_url")
        rep.sample = [r.asDict() for r in records.orderBy(*ORDER).limit(5).select(*(c.alias(n) for n, c in columns.items())).collect()]
        invalid = records.filter(F.size("missing") > 0)
        rep.items_invalid = invalid.count()

        fetches = [fetched] if details is None else [fetched, details]
        problems = self._problems(fetched, rows)
        invalid = invalid.select(F.col("source_url").alias("url"), F.lit("validate").alias("kind"), F.concat(F.lit("required but empty: "), F.array_join("missing", ", ")).alias("message"))
        errors = cut(_all([*map(self._failures, fetches), problems, invalid]))
        rep.errors = errors.count()
        log = _all([f.select("url", "final_url", "kind", "status", "elapsed_ms", "from_cache").filter("status IS NOT NULL") for f in fetches])
        counts = log.agg(F.count(F.lit(1)).alias("n"), F.count_if("from_cache").alias("c")).collect()[0]
        rep.pages, rep.pages_cached = counts["n"], counts["c"]
        incomplete = n_lost > 0 or fetched.filter("outcome IN ('fail', 'robots', 'stopped')").limit(1).count() > 0 or problems.limit(1).count() > 0
        if aborted:
            rep.warnings.append(f"aborted after {site.politeness.max_consecutive_errors} failed fetches in a row")
        elif not incomplete and self.limit is None:
            rep.warnings += report.expectations({"items_seen": rep.items_seen, "items_skipped": rep.items_skipped}, {n: rep.fill_rate(n) for n in site.expect.fill_rate}, site.expect.min_items, site.expect.fill_rate)
        rep.status = report.final_status(aborted, rep.warnings)

        valid = records.filter(F.size("missing") == 0)
        if not self.writes:
            rep.items_new = valid.count()
            self._finish(rep, run_id, [])
            return
        key = lifecycle.natural_key([columns[k] for k in site.key], F.coalesce("detail_url", "source_url"))
        valid = valid.select(F.lit(site.name).alias("site"), *ORDER, "source_url", key.alias("natural_key"), lifecycle.canonical_json(columns).alias("data"))
        classified = cut(lifecycle.classify(valid.withColumn("content_hash", lifecycle.content_hash(F.col("data"))), stored, ORDER))
        for r in classified.groupBy("result").count().collect():
            setattr(rep, f"items_{r['result']}", r["count"])
        gone = report.may_mark_gone(site.track_removed, self.writes, self.limit is not None, incomplete, rep.status, rep.items_invalid, rep.items_seen)
        if touched is None:
            touched = classified.select("site", "natural_key").limit(0)
        after = cut(lifecycle.upsert(stored, classified, touched, run_id, self.at, ORDER, gone, self.store.reserve(rep.items_new)))
        if gone:
            rep.items_gone = after.filter(F.col("gone_at") == self.at).count()
        page_log = log.select(F.coalesce("final_url", "url").alias("url"), "kind", "status", "elapsed_ms")
        logs = {"runs": self._row(rep, run_id), "pages": self._stamped(page_log, run_id, "fetched_at"), "errors": self._stamped(errors, run_id, "created_at")}
        self.store.commit(site.name, run_id, after, logs, snapshot, self.batch)

    def _failures(self, fetches: DataFrame) -> DataFrame:
        """url, kind, message of the fetches that failed or were forbidden."""
        message = F.coalesce(F.concat(F.lit("HTTP "), F.col("status").cast("string")), "error", F.lit("no response"))
        return fetches.filter("outcome IN ('fail', 'robots')").select("url", F.when(F.col("outcome") == "robots", "robots").otherwise("fetch").alias("kind"), message.alias("message"))

    def _problems(self, fetched: DataFrame, rows: DataFrame) -> DataFrame:
        """url, kind, message of list pages that can't be read, and of first pages, not of a day, without items."""
        unread = rows.filter("item_pos IS NULL AND problem IS NOT NULL").select("url", F.lit("parse").alias("kind"), F.col("problem").alias("message"))
        with_items = rows.filter("item_pos IS NOT NULL").select("start_pos", "url").distinct()
        bare = rows.filter("item_pos IS NULL AND problem IS NULL AND page_no = 1 AND NOT by_date").join(with_items, ["start_pos", "url"], "left_anti")
        return unread.unionByName(bare.select("url", F.lit("parse").alias("kind"), F.lit(f"{self.site.list.item_selector!r} found no items").alias("message")))

    def _with_details(self, wanted: DataFrame, got: DataFrame | None) -> DataFrame:
        """Listed records joined with their detail pages, each parsed once. Detail fields replace listed ones, null or not."""
        site = self.site
        if got is None:
            return wanted.withColumn("source_url", F.col("page_base")).withColumn("has_detail", F.lit(False))
        parsed = extract.details(got.filter("outcome = 'ok'"), site.detail.fields)
        parsed = extract.with_fields(parsed.withColumnRenamed("final_url", "detail_final"), site.detail.fields, self.at, prefix="d_").withColumn("has_detail", F.lit(True))
        parsed = parsed.withColumn("d_missing", extract.missing(site.detail.fields, "d_"))
        both = wanted.join(parsed, "detail_url", "left").withColumn("has_detail", F.coalesce("has_detail", F.lit(False)))
        fields = {}
        for n in site.all_fields:
            if n in site.detail.fields:
                listed = F.col(f"f_{n}") if n in site.list.fields else F.lit(None)
                fields[f"f_{n}"] = F.when(F.col("has_detail"), F.col(f"d_{n}")).otherwise(listed)
        missing = F.when(F.col("has_detail"), F.concat("missing", "d_missing")).otherwise(F.col("missing"))
        both = both.withColumns(fields | {"missing": missing, "source_url": F.coalesce("detail_final", "page_base")})
        return both.drop("detail_final", "d_missing", *(f"d_{n}" for n in site.detail.fields))


def _place(row) -> Column:
    return F.struct(*(F.lit(row[c]).cast("int").alias(c) for c in ORDER))


def _page_until(row) -> Column:
    """Whether a row's page is that of a place or comes before it."""
    return F.struct("start_pos", "page_no") <= F.struct(*(F.lit(row[c]).cast("int").alias(c) for c in ORDER[:2]))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
