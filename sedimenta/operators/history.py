"""History of changing records, rebuilt chain by chain.

A chain is all rows of one record. Late or corrected rows can land anywhere in it, so the unit of work is
the affected chain: an update fetches all sightings of the records it touches, rebuilds all their intervals
and replaces just those chains, in one pointer swap. Sightings are kept beside the intervals, in the same
buckets and with a digest in place of the record, so no raw row is read twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.chains import HOT_ROWS, linked
from sedimenta.functions.jsontext import digest
from sedimenta.session import cut, cuts
from sedimenta.sources.pointer import Pointer

ENTITY = ["site", "natural_key"]


def observations(loads: DataFrame) -> DataFrame:
    """Rows of loads as sightings: moment, whether the record was gone, and a digest of its state.

    The moment is gone_at where that is set, else last_seen; rows with neither sort first and start versions
    with a null valid_from. data that isn't JSON is compared as text; null data equals only null data.
    """
    return loads.select(
        *ENTITY,
        F.coalesce("gone_at", "last_seen").alias("moment"),
        F.col("gone_at").isNotNull().alias("gone"),
        digest(F.col("data")).alias("state"),
        "load_id",
    )


def boundaries(sightings: DataFrame, source: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The sightings that begin a version (begins) or end one without beginning another (gone).

    Rows of one moment are taken in the order seen before gone, then load_id, then state; a repeated row changes nothing.
    source: a cheaper table with the records of the same rows.
    """
    prev = F.col("_prev")
    begins = ~F.col("gone") & (prev.isNull() | prev["gone"] | (prev["state"] != F.col("state")))
    ends = F.col("gone") & prev.isNotNull() & ~prev["gone"]
    found = linked(sightings, ENTITY, "moment", ["gone", "load_id", "state"], ["state", "gone"], source, hot_rows, kept=begins | ends)
    return found.withColumn("begins", begins).drop("_prev")


def intervals(bounds: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions from boundaries: valid_from, valid_to (exclusive; null while valid), is_current, and the load_id that began each."""
    bounds = cut(bounds)  # it is read three times: to find long chains, their threshold, and the intervals
    after = linked(bounds, ENTITY, "moment", ["gone", "load_id", "state"], ["moment"], None, hot_rows, backwards=True)
    return after.filter("begins").select(
        *ENTITY, "load_id", F.col("moment").alias("valid_from"), F.col("_prev.moment").alias("valid_to"), F.col("_prev").isNull().alias("is_current"), F.hex("state").alias("state")
    )


def rebuild(loads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Boundaries of the chains of all records in loads."""
    return boundaries(observations(loads), loads.select(*ENTITY), hot_rows)


VERSIONS = [*ENTITY, "load_id", "valid_from", "valid_to", "is_current", "state"]
SIGHTINGS = [*ENTITY, "moment", "gone", "state", "load_id"]


class HistoryStore:
    """Versions and sightings on disk, in buckets of records; a manifest names the folders of each bucket.

    update() writes new folders for the buckets that hold touched records, then puts a new manifest in force. A run that
    dies before that leaves the old history in force; running it again gives the same result. Of two updates at once the
    second fails with Conflict and is to be run again. Of a bucket only rows of touched records are sorted; the others'
    versions are copied. buckets is fixed when the store begins, in the manifest: a bucket should be some executors' work.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root
        self.pointer = Pointer(spark, f"{root}/MANIFEST")
        self.buckets = (self.pointer.read() or {"of": buckets})["of"]

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*ENTITY), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, what: str) -> dict[str, str]:
        """The folder of each bucket of df; a large bucket is split over tasks by adaptive execution."""
        folder = f"{self.root}/{what}-{uuid.uuid4().hex}"
        self._bucket(df).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        names = [s.getPath().getName() for s in self.pointer.fs.listStatus(hadoop.Path(folder))]
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def read(self) -> DataFrame:
        folders = (self.pointer.read() or {}).get("versions", {})
        if not folders:
            return self.spark.createDataFrame([], "site string, natural_key string, load_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, state string")
        return self.spark.read.parquet(*sorted(folders.values())).select(*VERSIONS)

    def update(self, arrived: DataFrame, hot_rows: int = HOT_ROWS) -> None:
        """arrived: raw rows, new, late or corrected. Repeating an update changes nothing, as sightings already kept are left out."""
        version, manifest = self.pointer.current()
        manifest = manifest or {"of": self.buckets, "versions": {}, "sightings": {}}
        with cuts(self.spark):
            fresh = cut(self._bucket(observations(arrived).select(*SIGHTINGS)))
            hit = [str(r["bucket"]) for r in fresh.select("bucket").distinct().collect()]  # at most self.buckets
            if not hit:
                return
            touched = fresh.select(*(F.col(c).alias(f"_t_{c}") for c in ENTITY)).distinct()
            same = lambda df: [df[c].eqNullSafe(F.col(f"_t_{c}")) for c in ENTITY]
            seen = [f for b in hit for f in manifest["sightings"].get(b, [])]
            whole = fresh = fresh.drop("bucket")
            if seen:
                had = self.spark.read.parquet(*seen).select(*SIGHTINGS)
                had = cut(had.join(touched, same(had), "left_semi"))
                known = had.select(*(F.col(c).alias(f"_s_{c}") for c in SIGHTINGS))
                fresh = cut(fresh.join(known, [fresh[c].eqNullSafe(F.col(f"_s_{c}")) for c in SIGHTINGS], "left_anti"))
                whole = had.unionByName(fresh)
            versions = intervals(boundaries(whole, whole.select(*ENTITY), hot_rows), hot_rows)
            old = [manifest["versions"][b] for b in hit if b in manifest["versions"]]
            if old:
                kept = self.spark.read.parquet(*old).select(*VERSIONS)
                versions = versions.unionByName(kept.join(touched, same(kept), "left_anti"))
            written = self._write(versions, "versions")
            added = self._write(fresh, "sightings")
        for b in hit:
            manifest["versions"].pop(b, None)
            manifest["sightings"][b] = [*manifest["sightings"].get(b, []), *([added[b]] if b in added else [])]
        manifest["versions"] |= written
        self.pointer.swap(manifest, version)
