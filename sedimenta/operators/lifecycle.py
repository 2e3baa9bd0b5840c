"""Stored records over runs: keys and hashes, new, updated, unchanged, skipped and gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The length a key may have, and how a longer one is shortened.
KEY_LENGTH, KEPT, DIGITS = 500, 458, 40
HASH_LENGTH = 32


def natural_key(parts: list[Column], fallback: Column) -> Column:
    """Parts as text, joined by '|', empty ones as ''; the fallback if all are empty or there is none. Long keys end in '#' and a hash."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    joined = F.concat_ws("|", *texts) if texts else F.lit("")
    key = F.when(F.concat(*texts) != "", joined).otherwise(fallback) if texts else fallback
    return F.when(F.length(key) > KEY_LENGTH, F.concat(F.substring(key, 1, KEPT), F.lit("#"), F.substring(F.sha2(key, 256), 1, DIGITS))).otherwise(key)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A record as JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_LENGTH)


def unique_by_url(items: DataFrame) -> DataFrame:
    """Items whose source_url no other item of their site has."""
    once = items.filter(F.col("source_url").isNotNull()).groupBy("site", "source_url").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return items.join(once.drop("n"), ["site", "source_url"], "left_semi")


def in_run(records: DataFrame, order: list[str], run: list[str] = ()) -> DataFrame:
    """records (site, natural_key, content_hash, ...) with before, the hash of the record's earlier appearance in the run, and last.

    run: columns that tell runs apart, where records are of several. Appearances are few: a run sees a record a handful of
    times, so one key's window stays small; rows of other keys don't meet.
    """
    w = Window.partitionBy("site", "natural_key", *run).orderBy(*order)
    return records.withColumn("before", F.lag("content_hash").over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())


def classify(records: DataFrame, stored: DataFrame, order: list[str], run: list[str] = ()) -> DataFrame:
    """records with result: new, updated or unchanged, against the appearance before in the run, or the stored one."""
    had = stored.select("site", "natural_key", F.col("content_hash").alias("stored_hash"))
    both = in_run(records, order, run).join(had, ["site", "natural_key"], "left")
    earlier = F.coalesce("before", "stored_hash")
    return both.withColumn("result", F.when(earlier.isNull(), "new").when(earlier != F.col("content_hash"), "updated").otherwise("unchanged")).drop("stored_hash")


def upsert(stored: DataFrame, classified: DataFrame, touched: DataFrame, run_id: int, now: Column, order: list[str], gone: bool, after_id: int | None = None) -> DataFrame:
    """The next snapshot of items, by one full join of stored items with what the run saw.

    stored: id, site, natural_key, content_hash, data, source_url, first_seen, last_seen, last_changed, run_id, seen_run_id, fetched_at, gone_at.
    classified: as from classify(), with data and source_url. touched (site, natural_key): seen, but not fetched again. gone:
    whether active items that weren't seen are marked. New ids follow after_id, in the order of the run; without it, the
    largest one of stored, which must be all items then.
    """
    keys = ["site", "natural_key"]
    changes = classified.groupBy(*keys).agg(F.bool_or(F.col("result") != "unchanged").alias("changed"), F.max_by(F.struct("content_hash", "data", "source_url"), F.struct(*order)).alias("seen"), F.max_by(F.struct("content_hash", "data", "source_url"), F.when(F.col("result") != "unchanged", F.struct(*order))).alias("kept"), F.min(F.struct(*order)).alias("place"))
    touch = touched.select(*keys).distinct().withColumn("touched", F.lit(True))
    all_ = stored.join(changes, keys, "full").join(touch, keys, "left")
    is_new, hit, skip = F.col("id").isNull(), F.col("seen").isNotNull(), F.coalesce("touched", F.lit(False))
    moved = hit & F.col("changed")
    first_id = stored.agg(F.coalesce(F.max("id"), F.lit(0))).collect()[0][0] if after_id is None else after_id
    # new items are numbered by their place: ranks within ranges, then the ranges' offsets
    numbered = _numbered(all_.filter(is_new & hit).select(*keys, "place"), "place", first_id)
    all_ = all_.join(numbered, keys, "left")
    pick = lambda new, old: F.when(new, old)
    vanished = F.lit(gone) & F.col("gone_at").isNull() & ~hit & ~skip
    return all_.select(
        F.coalesce("id", "new_id").alias("id"),
        *keys,
        pick(moved, F.col("kept.content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        pick(moved, F.col("kept.data")).otherwise(F.col("data")).alias("data"),
        pick(moved, F.col("kept.source_url")).otherwise(F.col("source_url")).alias("source_url"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(hit | skip, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(moved, now).otherwise(F.col("last_changed")).alias("last_changed"),
        F.when(moved, F.lit(run_id)).otherwise(F.col("run_id")).cast("bigint").alias("run_id"),
        F.when(hit | skip, F.lit(run_id)).otherwise(F.col("seen_run_id")).cast("bigint").alias("seen_run_id"),
        F.when(hit, now).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(hit | skip, F.lit(None).cast("timestamp_ntz")).when(vanished, now).otherwise(F.col("gone_at")).alias("gone_at"),
    )


def _numbered(rows: DataFrame, by: str, after: int) -> DataFrame:
    """rows with new_id = after + their place in the order of by, without bringing them into one task: range partitions are counted, then offset."""
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_n", F.monotonically_increasing_id())
    from sedimenta.session import cut

    ranged = cut(ranged.withColumn("_part", F.shiftright("_n", 33).cast("int")).withColumn("_in", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    offsets, total = [], after
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    start = F.lit(after).cast("bigint")
    if offsets:
        start = F.try_element_at(F.create_map(*(F.lit(x) for kv in offsets for x in kv)), F.col("_part")).cast("bigint")
    return ranged.select("site", "natural_key", (start + F.col("_in") + 1).alias("new_id"))


def skippable(listed: DataFrame, stored: DataFrame, list_fields: list[str], by: str, now: Column, days: float) -> DataFrame:
    """The rows of listed whose stored item was fetched within days and has the same values of list_fields.

    by: natural_key, or source_url for sites whose key needs the detail; then only items alone with their URL count.
    listed has site, by, and list_json, the canonical JSON of the list fields.
    """
    known = stored if by == "natural_key" else unique_by_url(stored)
    wanted = lambda text: F.to_json(F.transform(F.array(*(F.lit(n) for n in sorted(list_fields))), lambda k: F.struct(k.alias("k"), F.try_element_at(F.from_json(text, "map<string,string>"), k).alias("v"))))
    known = known.filter(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400).cast("decimal(18,6)")))
    known = known.select("site", by, wanted("data").alias("_had"))
    return listed.withColumn("_have", wanted("list_json")).join(known, ["site", by]).filter(F.col("_have") == F.col("_had")).drop("_have", "_had")
