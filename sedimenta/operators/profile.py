"""Data quality of every column, from masks of its values.

Each value is generalised to a mask of character classes; rows are counted by (load, field, mask) before
anything else, so what is shuffled follows the number of masks, not of rows. Null rates, ranges, violations,
medians, dominant and rare masks and the distance between the masks of two loads all come from these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.chains import HOT_ROWS, hot_keys, linked
from sedimenta.functions.fields import fields, loads_of
from sedimenta.session import cut

# The states a run can have.
STATUSES = ["running", "ok", "degraded", "aborted", "error", "interrupted", "dry-run"]

#: A mask with a smaller share of a field's values in a load is rare ...
RARE = 0.01
#: ... if the field's most frequent mask has at least this share.
DOMINANT = 0.9
#: From so many values a load's most frequent mask is a format of the load's own, however few they are among the site's: fewer can't show DOMINANT beside another mask.
OWN_VALUES = 10
#: Texts up to this length keep their length in the mask.
EXACT_LENGTH = 24
#: Texts with white space beyond this length are prose, with a coarse mask.
PROSE = 120
#: Patterns that are compiled once for all rows.
COMPILED = 64
#: Numbers are counted by their first digits; where that leaves a median's comparison open, by value.
DIGITS = 5

_LATIN = "abcdefghijklmnopqrstuvwxyz"


def mask(text: Column, spaced: bool = False) -> Column:
    """The character classes of a string: A upper, a lower, 9 digit, others as they are.

    A single word of up to EXACT_LENGTH characters keeps its length, longer ones are told by their runs. Text with white
    space is told, with spaced, in the same way with each blank kept, up to PROSE characters; without spaced, and beyond
    PROSE, by whether it has digits and other signs and by the power of two of its length, so masks of long texts stay
    few. Each value takes one branch, whose expressions appear once: nothing is computed twice.
    """
    words = F.concat(
        F.lit("text:"),
        F.when(text.rlike("[0-9]"), "9").otherwise(""),
        F.when(text.rlike(r"[^\p{L}0-9\s]"), ".").otherwise(""),
        F.length(F.bin(F.length(text))).cast("string"),
    )
    ascii_only = F.octet_length(text) == F.length(text)
    exact = F.translate(text, _LATIN.upper() + _LATIN + "0123456789", "A" * 26 + "a" * 26 + "9" * 10)
    wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Nd}", "9"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", "9"), r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a")
    blank = text.contains(" ") | text.rlike(r"\s")
    return (
        F.when(text == "", "")
        .when((F.length(text) > PROSE) & blank if spaced else blank, words)
        .when(F.length(text) > EXACT_LENGTH, F.concat(F.lit("+"), runs))
        .when(ascii_only, exact)
        .otherwise(wide)
    )


def number_mask(number: Column) -> Column:
    """Sign, power of ten and whether there is a fraction."""
    size = F.floor(F.log10(F.abs(number)))
    return F.concat(F.lit("#"), F.when(number < 0, "-").otherwise(""), F.coalesce(size.cast("string"), F.lit("0")), F.when(number != F.floor(number), ".").otherwise(""))


def nested_mask(value: Column, kind: Column) -> Column:
    """Of variants that are neither strings nor numbers: true or false, arrays by their schema and how many values they hold, objects by their schema, null as null.

    Numbers of any size and precision have one schema, NUMBER; lists of more than 9 values are told by the power of two of their length.
    """
    schema = F.regexp_replace(F.schema_of_variant(value), r"\b(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))(?=[,>])", "NUMBER")
    size = F.size(F.try_variant_get(value, "$", "array<variant>"))
    many = F.when(size > 9, F.concat(F.lit("2^"), (F.length(F.bin(size)) - 1).cast("string"))).otherwise(size.cast("string"))
    return F.when(kind == "boolean", F.to_json(value)).when(kind == "array", F.concat(schema, F.lit(":"), many)).when(kind == "object", schema).otherwise(kind)


def usable(pattern: Column) -> Column:
    """A pattern for rlike, with named groups and ends as Python writes them; null if the engine that runs it can't compile it."""
    java = F.concat(F.lit("(?d)"), F.replace(F.replace(pattern, F.lit("(?P<"), F.lit("(?<")), F.lit("\\Z"), F.lit("\\z")))
    return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java).isNotNull(), java)


def declared(site_fields: DataFrame) -> DataFrame:
    """site, field, pattern, min_value, max_value; of fields declared more than once the least non-null values count. Patterns that can't be run are null."""
    return site_fields.filter(F.col("site").isNotNull() & F.col("field").isNotNull()).groupBy("site", "field").agg(
        F.min("pattern").alias("pattern"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
    ).withColumn("pattern", usable(F.col("pattern")))


def matcher(rules: DataFrame):
    """A function of text and pattern that tells whether they match. The most used patterns, COMPILED at most, are compiled once for all rows; others with each row."""
    often = rules.filter("pattern IS NOT NULL").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(COMPILED).collect()

    def matches(text: Column, pattern: Column) -> Column:
        out = F.rlike(text, pattern)
        for r in reversed(often):
            out = F.when(pattern == r["pattern"], text.rlike(r["pattern"])).otherwise(out)
        return out

    return matches


def by_load(item_loads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """site, load_run_id, data of the rows with both, the rows of a load together, so that their counts meet before they are shuffled.

    Of the loads with so many rows that one task would be long, rows are dealt out by load_id; the threshold rises with the
    table, so at most chains.MAX_HOT_KEYS loads are told apart. Record texts are smaller than the rows their fields make.
    """
    rows = item_loads.filter(F.col("site").isNotNull() & F.col("load_run_id").isNotNull())
    hot, limit = hot_keys(rows, ["site", "load_run_id"], hot_rows)
    if not hot:
        return rows.select("site", "load_run_id", "data").repartition("site", "load_run_id")
    few = rows.sparkSession.createDataFrame([(r["site"], r["load_run_id"], -(-r["_n"] // limit)) for r in hot], "site string, load_run_id bigint, _lanes int")
    lanes = rows.select("site", "load_run_id", "data", "load_id").join(F.broadcast(few), ["site", "load_run_id"], "left")
    lanes = lanes.withColumn("_lane", F.when(F.col("_lanes").isNotNull(), F.pmod(F.xxhash64("load_id"), F.col("_lanes"))).otherwise(0))
    return lanes.repartition("site", "load_run_id", "_lane").select("site", "load_run_id", "data")


def mask_counts(item_loads: DataFrame, site_fields: DataFrame, distinct: bool = False, hot_rows: int = HOT_ROWS, spaced: bool = False, nested: bool = False, exact: bool = True) -> DataFrame:
    """site, run_id, field, mask, bucket, n, empty, strings, bad, numbers, outside, low, high: counts of the values of each load's field, by mask.

    empty: null, '' and []. strings: non-empty strings, bad: those that don't match the declared pattern. outside:
    numbers beyond the declared bounds. bucket: the first digits of a number; low and high: the range in the bucket.
    With distinct also how many values differ (unless exact: about how many), null left out; arrays, objects and booleans by
    their canonical JSON. Values of different masks differ, so these add up over masks. With spaced, texts with white space, and with
    nested, arrays, objects and booleans have masks of their own: for reports of masks, as no other figure needs them.
    """
    rules = cut(declared(site_fields))
    matches = matcher(rules)
    each = fields(by_load(item_loads, hot_rows), "data", "site", "load_run_id").join(rules, ["site", "field"], "left")
    text = F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string"))
    number = F.when(F.col("kind") == "number", F.try_variant_get("value", "$", "double"))
    none = (F.col("kind") == "array") & (F.to_json("value") == "[]")
    other = nested_mask(F.col("value"), F.col("kind")) if nested else F.col("kind")
    each = each.select("site", F.col("load_run_id").alias("run_id"), "field", "kind", "value", text.alias("text"), number.alias("number"), none.alias("none"), "pattern", "min_value", "max_value")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.col("number")))) - (DIGITS - 1))
    bucket = F.when(F.col("number") == 0, F.lit(0.0)).otherwise(F.floor(F.col("number") / scale) * scale)
    full = F.col("text").isNotNull() & (F.col("text") != "")
    shape = F.when(F.col("text").isNotNull(), mask(F.col("text"), spaced)).when(F.col("number").isNotNull(), number_mask(F.col("number"))).otherwise(other)
    each = each.withColumn("seen", F.coalesce("text", F.col("number").cast("string"), F.when(F.col("kind") != "null", F.to_json("value")))) if distinct else each
    return each.groupBy("site", "run_id", "field", shape.alias("mask"), bucket.alias("bucket")).agg(
        *([(F.count_distinct if exact else F.approx_count_distinct)("seen").alias("distinct")] if distinct else []),
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("kind") == "null") | (F.col("text") == "") | F.col("none")).alias("empty"),
        F.count_if(full).alias("strings"),
        F.count_if(full & F.col("pattern").isNotNull() & ~matches(F.col("text"), F.col("pattern"))).alias("bad"),
        F.count("number").alias("numbers"),
        F.count_if((F.col("number") < F.col("min_value")) | (F.col("number") > F.col("max_value"))).alias("outside"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )


def field_profile(counts: DataFrame, item_loads: DataFrame, runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per load and held field, with the same figures of the load before as prev (null if that doesn't hold the field).

    rows, empty (null, '', [] or no such key), strings, bad, numbers, outside, low, high, masks, and the median of the
    numbers as bounds low_median and high_median, which are equal unless many numbers share their first digits.
    """
    middle = lambda c: F.expr(f"percentile({c}, 0.5, n_numbers)")
    counts = counts.withColumn("n_numbers", F.col("numbers"))
    by_field = counts.groupBy("site", "run_id", "field").agg(
        F.sum("n").alias("present"),
        F.sum("empty").alias("blank"),
        *(F.sum(c).alias(c) for c in ("strings", "bad", "numbers", "outside", "distinct") if c in counts.columns),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        middle("low").alias("low_median"),
        middle("high").alias("high_median"),
    )
    loads = loads_of(item_loads, runs)
    order = linked(cut(loads), ["site"], "started_at", ["run_id"], ["run_id"], None, hot_rows)
    held = by_field.join(order, ["site", "run_id"]).filter(F.col("present") * 2 >= F.col("rows"))
    held = held.withColumn("empty", F.col("rows") - F.col("present") + F.col("blank")).withColumn("prev_run", F.col("_prev.run_id")).drop("_prev", "blank")
    held = cut(held)
    figures = ["rows", "empty", "numbers", "low_median", "high_median"]
    before = held.select("site", F.col("run_id").alias("prev_run"), "field", F.struct(*figures).alias("prev"))
    return held.join(before, ["site", "prev_run", "field"], "left")


def column_profile(df: DataFrame, table_name: str, exact: bool = True) -> DataFrame:
    """One row per column of any table: table_name, column, type, rows, nulls, null_rate, distinct, low and high as text.

    One pass of aggregates that combine before they are shuffled. distinct counts 64-bit hashes of the values, which are the
    only thing that a second pass shuffles, once per column and value; unless exact it is a sketch's estimate, in the first
    pass. Maps have neither distinct values nor a range; arrays and structs have those of their JSON text. An empty table
    has a null null_rate.
    """
    parts, hashes = [], []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        plain = F.lit(None).cast("string") if kind.startswith("map") else F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")))) if kind.startswith(("array", "struct")) else c
        figures = [F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.min(plain).cast("string").alias("low"), F.max(plain).cast("string").alias("high")]
        figures.append(F.lit(0).cast("bigint").alias("distinct") if exact else F.approx_count_distinct(plain).alias("distinct"))
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("type"), *figures))
        hashes.append(F.struct(F.lit(f.name).alias("column"), F.when(plain.isNotNull(), F.xxhash64(plain)).alias("h")))
    each = df.agg(F.array(*parts).alias("each")).select(F.explode("each").alias("e")).select("e.*")
    if exact:
        seen = df.select(F.explode(F.array(*hashes)).alias("v")).select("v.*").filter("h IS NOT NULL").groupBy("column", "h").agg(F.lit(1).alias("one"))
        each = each.drop("distinct").join(seen.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")), "column", "left").fillna(0, ["distinct"])
    return each.select(F.lit(table_name).alias("table_name"), "column", "type", "rows", "nulls", (F.col("nulls") / F.nullif("rows", F.lit(0))).alias("null_rate"), "distinct", "low", "high")


def findings(profile: DataFrame, item_loads: DataFrame) -> DataFrame:
    """site, run_id, field, finding (null_rate, pattern, range, shift) of a field_profile."""
    p = F.col("prev")
    more_empty = 4 * (F.col("empty") * p["rows"] - p["empty"] * F.col("rows")) >= F.col("rows") * p["rows"]
    comparable = (F.col("numbers") >= 10) & (p["numbers"] >= 10) & (F.col("high_median") > 0) & (p["high_median"] > 0)
    apart = lambda a, b: (a > 3 * b) | (a * 3 < b)
    corners = [apart(F.col(x), p[y]) & (F.col(x) > 0) & (p[y] > 0) for x in ("low_median", "high_median") for y in ("low_median", "high_median")]
    all_apart, any_apart = corners[0], corners[0]
    for c in corners[1:]:
        all_apart, any_apart = all_apart & c, any_apart | c
    tests = {
        "null_rate": more_empty,
        "pattern": (F.col("bad") > 0) & (F.col("bad") * 10 >= F.col("strings")),
        "range": (F.col("outside") > 0) & (F.col("outside") * 10 >= F.col("numbers")),
        "shift": comparable & all_apart,
    }
    found = profile.select("site", "run_id", "field", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))).alias("finding"))
    open_ = profile.filter(comparable & any_apart & ~all_apart)
    open_ = cut(open_.select("site", "run_id", "prev_run", "field"))
    if open_.limit(1).count():
        found = found.unionByName(_shifts_by_value(open_, item_loads))
    return found


def _shifts_by_value(open_: DataFrame, item_loads: DataFrame) -> DataFrame:
    """The shifts among loads whose medians' bounds leave it open, by exact medians of their values, counted by value first."""
    both = open_.select("site", F.col("run_id").alias("load_run_id"), "field").unionByName(open_.select("site", F.col("prev_run").alias("load_run_id"), "field")).distinct()
    rows = item_loads.join(both.select("site", "load_run_id").distinct(), ["site", "load_run_id"], "left_semi")
    values = fields(rows, "data", "site", "load_run_id").filter("kind = 'number'").join(both, ["site", "load_run_id", "field"], "left_semi")
    values = values.groupBy("site", "load_run_id", "field", F.try_variant_get("value", "$", "double").alias("number")).agg(F.count(F.lit(1)).alias("n"))
    medians = cut(values.groupBy("site", "load_run_id", "field").agg(F.expr("percentile(number, 0.5, n)").alias("median")))
    now = medians.withColumnRenamed("load_run_id", "run_id")
    was = medians.withColumnsRenamed({"load_run_id": "prev_run", "median": "was"})
    joined = open_.join(now, ["site", "run_id", "field"]).join(was, ["site", "prev_run", "field"])
    apart = (F.col("median") > 3 * F.col("was")) | (F.col("median") * 3 < F.col("was"))
    return joined.filter((F.col("median") > 0) & (F.col("was") > 0) & apart).select("site", "run_id", "field", F.lit("shift").alias("finding"))


def run_findings(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """site, run_id, field, finding of each run: domain (status null or not exactly an allowed one, in any of its rows) and report.

    report: an entry of empty_fields is negative or above items_seen - items_skipped; where either is null only negative entries count.
    """
    wrong = F.col("status").isNull() | ~F.col("status").isin(STATUSES)
    domain = runs.filter(wrong).select("site", F.col("id").alias("run_id"), F.lit("status").alias("field"), F.lit("domain").alias("finding"))
    entries = reports.select("site", "run_id", (F.col("items_seen") - F.col("items_skipped")).alias("most"), F.explode("empty_fields").alias("field", "n"))
    report = entries.filter((F.col("n") < 0) | (F.col("n") > F.col("most"))).select("site", "run_id", "field", F.lit("report").alias("finding"))
    return domain.unionByName(report).distinct()


def mask_report(counts: DataFrame, item_loads: DataFrame, runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per load, field and mask: n, share, dominant (the field's most frequent mask in the load), rare, and divergence.

    rare works at any size of a load: beside another mask with at least DOMINANT in the load, a share under RARE in the load;
    beside one with at least DOMINANT in the load or in all loads of the site, a share under RARE in all loads, or just one
    value in them. The load's own dominant mask is not rare if it has at least OWN_VALUES values.
    divergence is the total variation distance, 0 to 1, between the field's masks in the load and in the load before;
    null where that doesn't have the field. Ties for dominant go to the mask that sorts first.
    """
    by_mask = cut(counts.groupBy("site", "run_id", "field", "mask").agg(F.sum("n").alias("n")))
    at_site = by_mask.groupBy("site", "field", "mask").agg(F.sum("n").alias("site_n"))
    site_totals = at_site.groupBy("site", "field").agg(F.sum("site_n").alias("site_total"), F.min(F.struct((-F.col("site_n")).alias("m"), "mask")).alias("site_top"))
    at_site = at_site.join(site_totals, ["site", "field"])
    order = linked(cut(loads_of(item_loads, runs).drop("rows")), ["site"], "started_at", ["run_id"], ["run_id"], None, hot_rows)
    by_mask = by_mask.join(order.select("site", "run_id", F.col("_prev.run_id").alias("prev_run")), ["site", "run_id"])
    totals = by_mask.groupBy("site", "run_id", "field").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "mask")).alias("top"))
    both = by_mask.join(totals, ["site", "run_id", "field"]).join(at_site, ["site", "field", "mask"])
    share, dominant = F.col("n") / F.col("total"), F.col("top.mask")
    other = lambda top, total: (F.col(f"{top}.mask") != F.col("mask")) & (-F.col(f"{top}.m") >= DOMINANT * F.col(total))
    in_load, in_site = other("top", "total"), other("site_top", "site_total")
    few_in_site = (F.col("site_n") < RARE * F.col("site_total")) | (F.col("site_n") == 1)
    own = (F.col("mask") == dominant) & (F.col("n") >= OWN_VALUES)
    rare = ((in_load & (share < RARE)) | ((in_load | in_site) & few_in_site)) & ~own
    shares = cut(both.select("site", "run_id", "prev_run", "field", "mask", "n", share.alias("share"), dominant.alias("dominant"), rare.alias("rare")))
    before = shares.select("site", F.col("run_id").alias("prev_run"), "field", "mask", F.col("share").alias("was"))
    common = shares.join(before, ["site", "prev_run", "field", "mask"]).groupBy("site", "run_id", "field").agg(F.sum(F.least("share", "was")).alias("common"))
    had = before.select("site", "prev_run", "field").distinct().withColumn("had", F.lit(True))
    joined = shares.join(common, ["site", "run_id", "field"], "left").join(had, ["site", "prev_run", "field"], "left")
    return joined.select("site", "run_id", "field", "mask", "n", "share", "dominant", "rare", F.when(F.col("had"), F.abs(F.round(1 - F.coalesce("common", F.lit(0.0)), 6))).alias("divergence"))
