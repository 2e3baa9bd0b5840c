"""Taking each new or changed record once, landing by landing.

Rows land in batches, and each batch gets the next number of a commit sequence. That number is the watermark: a
run of process() fixes the highest number as its upper limit before it reads anything, reads the batches past the
watermark up to there, and commits its output together with the new watermark. So a row is read once however late
it lands and whatever moments it speaks of, and batches of the past are never read again. What a run must know of
the past is kept by day: the states already seen, looked up on the days the new rows speak of, and the output,
looked up only for runs that late rows belong to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.chains import HOT_ROWS, linked
from sedimenta.session import cut, cuts
from sedimenta.sources.pointer import Pointer

OK = ["ok", "degraded"]
STATE = ["site", "natural_key", "changed"]
#: Folders of one day that are joined into one, by the run that would add another.
FRAGMENTS = 32


def successful() -> Column:
    return F.trim(F.lower("status")).isin(OK) & F.col("finished_at").isNotNull()


def commits(runs: DataFrame, upper: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """site, run_id, low, high: the window (low, high] of each successful run; low is null for a site's first.

    A run is successful if any of its rows has status ok or degraded, trimmed and in lower case, and a
    finished_at; the earliest such finished_at counts. Of runs that finish together the lowest id takes the
    states: the window of the others is empty. Rows without site or id are no commits. upper: only runs that finished until then.
    """
    won = runs.filter(successful() & F.col("site").isNotNull() & F.col("id").isNotNull()).groupBy("site", F.col("id").alias("run_id")).agg(F.min("finished_at").alias("high"))
    if upper is not None:
        won = won.filter(F.col("high") <= F.lit(upper).cast("timestamp_ntz"))
    windows = linked(won, ["site"], "high", ["run_id"], ["high"], None, hot_rows).select("site", "run_id", F.col("_prev.high").alias("low"), "high")
    return windows.filter(F.col("low").isNull() | (F.col("low") < F.col("high")))


def states(loads: DataFrame) -> DataFrame:
    """Each state of a record, (site, natural_key, changed), with the moment it became known.

    changed is last_changed, or fetched_at where that is null; rows with neither form one state. Rows without
    loaded_at, site or natural_key never become known.
    """
    known = loads.filter(F.col("loaded_at").isNotNull() & F.col("site").isNotNull() & F.col("natural_key").isNotNull())
    return known.groupBy("site", "natural_key", F.coalesce("last_changed", "fetched_at").alias("changed")).agg(F.min("loaded_at").alias("known_at"))


def owners(found: DataFrame, windows: DataFrame) -> DataFrame:
    """States (site, natural_key, changed, known_at) with run_id and high of the commit whose window they became known in; both null if there is none yet.

    The as-of lookup is an equi-join: a commit is listed under each day its window touches and a state under the day it
    became known, so a large site spreads over its days and no task holds a site. A site's first window opens with the
    first day of found.
    """
    first = found.agg(F.to_date(F.min("known_at")).alias("d")).collect()[0]["d"]
    first = F.lit(first).cast("date")
    opens = F.greatest(F.coalesce(F.to_date("low"), first), first)
    listed = windows.filter(F.to_date("high") >= opens).select(F.col("site").alias("_site"), "run_id", "low", "high", F.explode(F.sequence(opens, F.to_date("high"))).alias("_day"))
    inside = (F.col("low").isNull() | (F.col("known_at") > F.col("low"))) & (F.col("known_at") <= F.col("high"))
    on = [F.col("site") == F.col("_site"), F.to_date("known_at") == F.col("_day"), inside]
    return found.join(listed, on, "left").drop("_site", "_day", "low")


class Days:
    """A table that only grows, in folders by day; what a manifest knows of it is {day: [folder]}."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, folders: dict[str, list[str]]):
        self.spark, self.root, self.name, self.schema, self.folders = spark, root, name, schema, folders

    def read(self, days: list[str] | None = None) -> DataFrame:
        """All rows, or those of some days alone: other folders aren't opened."""
        paths = [f for d, fs in self.folders.items() if days is None or d in days for f in fs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame) -> dict[str, list[str]]:
        """The manifest's entry once rows (the schema's columns and day) are added; the folders so far stay as they are."""
        folders = {d: list(fs) for d, fs in self.folders.items()}
        for day, path in self._write(rows).items():
            folders[day] = [*folders.get(day, []), path]
        if scattered := [d for d, fs in folders.items() if len(fs) > FRAGMENTS]:
            again = self.read_paths({d: folders[d] for d in scattered})
            folders |= {d: [path] for d, path in self._write(again).items()}
        return folders

    def read_paths(self, folders: dict[str, list[str]]) -> DataFrame:
        out = None
        for d, fs in folders.items():
            part = self.spark.read.schema(self.schema).parquet(*fs).withColumn("day", F.lit(d))
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, rows: DataFrame) -> dict[str, str]:
        folder = f"{self.root}/{self.name}-{uuid.uuid4().hex}"
        rows.hint("rebalance", "day").write.partitionBy("day").parquet(folder)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(folder))]
        return {n.removeprefix("day="): f"{folder}/{n}" for n in names if n.startswith("day=")}


def _day(moment: str) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.lit("none"))


class IncrementalReader:
    """Takes what is new since the last commit and writes it together with the new watermark.

    land() numbers a batch; process() takes the batches past the watermark. Each state goes to the successful run whose
    window it became known in, also where it lands after that run was processed: then it comes out with the next
    process(), under that run, unless that run has the record already. States that no run has taken yet wait. A run
    that dies before its commit leaves folders that no reader sees, and the next one starts at the old watermark; after
    the commit nothing is taken again. Of two processes at once the second fails with Conflict and takes nothing.
    Runs whose rows turn up late take only states that no other run has taken.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.landed = Pointer(spark, f"{root}/LANDED")
        self.pointer = Pointer(spark, f"{root}/WATERMARK")

    def land(self, *paths: str) -> int:
        """Numbers parquet files or folders, which must not change any more, as the next batch; a path that has a number keeps it. The highest number."""

        def add(landed: dict | None) -> dict:
            batches = (landed or {"batches": []})["batches"]
            had = {p for b in batches for p in b}
            new = [p for p in paths if p not in had]
            return {"batches": [*batches, new] if new else batches}

        return len(self.landed.change(add)["batches"])

    def process(self, runs: DataFrame) -> int:
        """Takes all batches past the watermark, and states that waited for a run; the number of rows written."""
        version, seen = self.pointer.current()
        seen = seen or {"mark": 0, "states": {}, "records": {}, "waiting": None}
        batches = (self.landed.read() or {"batches": []})["batches"]
        upper = len(batches)  # fixed before anything is read
        last_end = runs.filter(successful()).agg(F.max("finished_at").cast("string")).collect()[0][0]
        index = Days(self.spark, self.root, "states", "site string, natural_key string, changed timestamp_ntz", seen["states"])
        output = Days(self.spark, self.root, "records", "run_id bigint, site string, natural_key string", seen["records"])
        with cuts(self.spark):
            paths = [p for b in batches[seen["mark"] : upper] for p in b]
            waiting = self.spark.read.parquet(seen["waiting"]) if seen["waiting"] else None
            if not paths and waiting is None:
                return 0
            pool = waiting
            if paths:
                new = states(self.spark.read.option("mergeSchema", True).parquet(*paths)).withColumn("day", _day("changed"))
                if seen["states"]:
                    new = cut(new)
                    days = [r["day"] for r in new.select("day").distinct().collect()]  # days of the calendar
                    had = index.read(days).select(*(F.col(c).alias(f"_{c}") for c in STATE))
                    new = new.join(had, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in STATE], "left_anti")
                fresh = cut(new)
                pool = fresh.drop("day") if waiting is None else fresh.drop("day").unionByName(waiting)
                seen["states"] = index.add(fresh.select(*STATE, "day"))
            pool = cut(owners(pool, commits(runs, last_end)) if last_end is not None else pool.withColumns({"run_id": F.lit(None).cast("bigint"), "high": F.lit(None).cast("timestamp_ntz")}))
            taken = pool.filter("run_id IS NOT NULL").select("run_id", "site", "natural_key", _day("high").alias("day")).distinct()
            if seen["records"]:
                taken = cut(taken)
                days = [r["day"] for r in taken.select("day").distinct().collect()]  # days of the calendar
                taken = taken.join(output.read(days), ["run_id", "site", "natural_key"], "left_anti")
            taken = cut(taken.select("run_id", "site", "natural_key", "day"))
            count = taken.count()
            if count:
                seen["records"] = output.add(taken)
            seen["waiting"] = f"{self.root}/waiting-{uuid.uuid4().hex}"
            pool.filter("run_id IS NULL").select(*STATE, "known_at").write.parquet(seen["waiting"])
        self.pointer.swap(seen | {"mark": upper}, version)
        return count

    def read(self) -> DataFrame:
        """run_id, site, natural_key: the records of all committed batches, once per run."""
        seen = self.pointer.read() or {"records": {}}
        return Days(self.spark, self.root, "records", "run_id bigint, site string, natural_key string", seen["records"]).read()


def replay(loads: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, site, natural_key: what each successful run takes of loads that are all there, without a store."""
    return owners(states(loads), commits(runs)).filter("run_id IS NOT NULL").select("run_id", "site", "natural_key").distinct()
