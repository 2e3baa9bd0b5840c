"""Items, runs, pages and errors on disk: snapshots of items behind a pointer, logs that only grow."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.pointer import Conflict, Pointer

ITEMS = "id bigint, site string, natural_key string, content_hash string, data string, source_url string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_changed timestamp_ntz, run_id bigint, seen_run_id bigint, fetched_at timestamp_ntz, gone_at timestamp_ntz"
RUNS = "id bigint, site string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, pages int, pages_cached int, items_new int, items_updated int, items_unchanged int, items_skipped int, items_gone int, errors int, notes string"
PAGES = "run_id bigint, url string, kind string, status int, elapsed_ms int, fetched_at timestamp_ntz"
ERRORS = "run_id bigint, url string, kind string, message string, created_at timestamp_ntz"
LOGS = {"runs": RUNS, "pages": PAGES, "errors": ERRORS}
#: Messages are cut to so many signs.
MESSAGE = 4000


class Store:
    """A run's items, its log rows and its own row become visible together, in one change of the pointer.

    A run is registered first, which gives it its number and, until it is committed, a row with status running or dry-run.
    Runs of several sites at once don't disturb each other; of two runs of one site that both write items, the second
    fails with Conflict. Tables written by older versions may lack columns; they are read as null.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.pointer = Pointer(spark, f"{root}/CURRENT")

    @staticmethod
    def _whole(state: dict | None) -> dict:
        return {"items": {}, "runs": [], "pages": [], "errors": [], "run_id": 0, "open": {}, "item_id": None, "batches": {}} | (state or {})

    def _state(self) -> dict:
        return self._whole(self.pointer.read())

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return conform(self.spark.read.option("mergeSchema", True).parquet(*folders), schema)

    def snapshot(self, site: str) -> str | None:
        """The folder that holds the site's items now; commit() takes it to see whether another run was faster."""
        return self._state()["items"].get(site)

    def items(self, site: str | None = None, include_gone: bool = True) -> DataFrame:
        """Items of one site or all. Each site has a folder of its own, so other sites aren't read."""
        had = self._state()["items"]
        df = self._read([had[site]] if site in had else [] if site else list(had.values()), ITEMS)
        return df if include_gone else df.filter(F.col("gone_at").isNull())

    def counts(self) -> DataFrame:
        """site, stored, active: how many items each site has."""
        return count_items(self.items())

    def count_items(self, site: str, include_gone: bool = True) -> int:
        return self.items(site, include_gone).count()

    def log(self, name: str) -> DataFrame:
        state = self._state()
        df = self._read(state[name], LOGS[name])
        if name == "runs" and state["open"]:
            rows = [(int(i), o["site"], dt.datetime.fromisoformat(o["started_at"]), o["status"]) for i, o in state["open"].items()]
            df = df.unionByName(conform(self.spark.createDataFrame(rows, "id bigint, site string, started_at timestamp_ntz, status string"), RUNS))
        return df

    def begin(self, site: str, started_at: dt.datetime, dry: bool = False) -> int:
        """Registers a run; its number, which no other run has."""

        def add(state: dict | None) -> dict:
            state = self._whole(state)
            number = state["run_id"] + 1
            row = {"site": site, "status": "dry-run" if dry else "running", "started_at": started_at.isoformat()}
            return state | {"run_id": number, "open": state["open"] | {str(number): row}}

        return self.pointer.change(add)["run_id"]

    def reserve(self, n: int) -> int:
        """n ids of items that no other run gets; the largest id before them. Ids of a run that fails are never used."""
        largest = self.items().agg(F.max("id")).collect()[0][0] if self._state()["item_id"] is None else None

        def take(state: dict | None) -> dict:
            state = self._whole(state)
            before = state["item_id"] if state["item_id"] is not None else largest or 0
            return state | {"item_id": before + n}

        return self.pointer.change(take)["item_id"] - n

    def batch(self, stream: str) -> int:
        """The number of the last batch of a stream that was committed; -1 for none."""
        return self._state()["batches"].get(stream, -1)

    def commit(self, site: str, run_id: int, items: DataFrame | None, logs: dict[str, DataFrame], snapshot: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """items: the site's next snapshot, made from the one in snapshot, or None to keep it. batch: a stream and
        the number of its batch that this is the run of. Nothing shows before the change."""
        mark = uuid.uuid4().hex
        if items is not None:
            items.write.parquet(f"{self.root}/items/{mark}")
        for name, df in logs.items():
            if name == "errors":
                df = cut_messages(df)
            conform(df, LOGS[name]).write.parquet(f"{self.root}/{name}/{mark}")

        def add(state: dict | None) -> dict:
            state = self._whole(state)
            if items is not None:
                if state["items"].get(site) != snapshot:
                    raise Conflict(f"another run of {site!r} has written its items")
                state["items"][site] = f"{self.root}/items/{mark}"
            for name in logs:
                state[name] = [*state[name], f"{self.root}/{name}/{mark}"]
            state["run_id"] = max(state["run_id"], run_id)
            state["open"].pop(str(run_id), None)
            if batch is not None:
                state["batches"][batch[0]] = batch[1]
            return state

        self.pointer.change(add)


def count_items(items: DataFrame) -> DataFrame:
    """site, stored, active of items."""
    return items.groupBy("site").agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("gone_at").isNull()).alias("active"))


def cut_messages(errors: DataFrame, most: int = MESSAGE) -> DataFrame:
    """errors with messages of at most so many signs."""
    return errors.withColumn("message", F.substring("message", 1, most))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of schema, those it lacks as null, those beyond left out."""
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
