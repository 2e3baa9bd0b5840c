"""What a run did, and whether that is as expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.cleaners import is_empty

#: A run with a larger share of invalid items marks nothing as gone.
INVALID_SHARE = 0.2


def empty_counts(df: DataFrame, kinds: dict[str, str], prefix: str = "f_") -> DataFrame:
    """field, empty: how many rows of df have each field empty; a field df doesn't have is empty everywhere."""
    tests = {n: is_empty(F.col(f"{prefix}{n}"), k) if f"{prefix}{n}" in df.columns else F.lit(True) for n, k in kinds.items()}
    if not tests:
        return df.sparkSession.createDataFrame([], "field string, empty bigint")
    one = df.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
    return one.unpivot([], list(tests), "field", "empty")


def fill_rate(empty: Column, extracted: Column) -> Column:
    """1 - empty/extracted; 1.0 if nothing was extracted."""
    return F.coalesce(1 - empty / F.nullif(extracted, F.lit(0)), F.lit(1.0))


def circuit_breaker(fetches: DataFrame, group: list[str], order: list[str], outcome: str, limit: int) -> DataFrame:
    """fetches with failures, how many in a row failed up to each, and aborted: whether limit was reached at or before it.

    outcome: 'ok' resets, 'fail' counts, anything else does neither. limit 0 never aborts. A group is one run of one site,
    whose fetches are sequential by nature; its rows are narrow and Spark's window spills.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    island = F.count_if(F.col(outcome) == "ok").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = fetches.withColumn("_island", island)
    inner = Window.partitionBy(*group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("failures", F.count_if(F.col(outcome) == "fail").over(inner))
    reached = (F.col("failures") >= limit) if limit else F.lit(False)
    return marked.withColumn("aborted", F.bool_or(reached).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def retry_wait(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: a Retry-After of digits up to 120, else, and for 0, 2 to the power of the attempt up to 30."""
    told = F.when(retry_after.rlike(r"^\d+(\.\d+)?$"), F.least(retry_after.try_cast("double"), F.lit(120.0)))
    return F.coalesce(F.when(told > 0, told), F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0)))


def pacing(fetches: DataFrame, host: str, order: list[str], delay: Column, crawl_delay: Column) -> DataFrame:
    """fetches with ready_s: seconds from the start until each may go out, one per gap and host."""
    w = Window.partitionBy(host).orderBy(*order)
    return fetches.withColumn("ready_s", (F.row_number().over(w) - 1) * F.greatest(delay, F.coalesce(crawl_delay, F.lit(0.0))))


def expectations(report: dict, rates: dict[str, float], min_items: int | None, fill: dict[str, float]) -> list[str]:
    """Warnings of a complete run."""
    out = []
    if min_items is not None and report["items_seen"] < min_items:
        out.append(f"{report['items_seen']} items, expected at least {min_items}")
    if report["items_seen"] - report["items_skipped"]:
        out += [f"field {n!r} filled in {rates[n]:.0%} of the items, expected at least {low:.0%}" for n, low in fill.items() if rates[n] < low]
    return out


def final_status(aborted: bool, warnings: list[str]) -> str:
    return "aborted" if aborted else "degraded" if warnings else "ok"


def may_mark_gone(tracks: bool, writes: bool, limited: bool, incomplete: bool, status: str, invalid: int, seen: int) -> bool:
    return tracks and writes and not limited and not incomplete and status == "ok" and invalid <= INVALID_SHARE * max(seen, 1)


def last_runs(runs: DataFrame, site: str | None = None, n: int = 10) -> DataFrame:
    return (runs.filter(F.col("site") == site) if site else runs).orderBy(F.col("id").desc()).limit(n)
