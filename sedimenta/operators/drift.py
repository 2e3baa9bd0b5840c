"""Schemas that drift: versioned fingerprints, the steps between them, and one table for all rows.

Each load has a fingerprint of the fields it holds and their types. Loads with the fingerprint of the load
before need nothing; between others a migration step lists fields added, removed, renamed and retyped. The
renames of a site, chained, give each field of each load its latest name, under which its rows come out; the
type it had last and a default are rules by which values of other loads are cast and fields they lack are filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.chains import HOT_ROWS, join_hot, linked
from sedimenta.functions.fields import fields, kind_of, loads_of
from sedimenta.session import cut

KINDS = ["string", "number", "boolean", "array", "object"]


def fingerprints(item_loads: DataFrame, runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per load: site, run_id, started_at, held (array of field and type, sorted), fingerprint, and the same of the load before as prev.

    A load holds a field if the key is in at least half of its rows; the type is that of more than half of the
    field's non-null values, or null if no type is.
    """
    rows = item_loads.filter(F.col("site").isNotNull() & F.col("load_run_id").isNotNull())
    counted = fields(rows, "data", "site", "load_run_id").groupBy("site", F.col("load_run_id").alias("run_id"), "field").agg(
        F.count(F.lit(1)).alias("present"), F.count_if(F.col("kind") != "null").alias("filled"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS)
    )
    major = F.coalesce(*(F.when(F.col(f"n_{k}") * 2 > F.col("filled"), k) for k in KINDS))
    loads = loads_of(item_loads, runs)
    joined = loads.join(counted.select("site", "run_id", "field", "present", major.alias("type")), ["site", "run_id"], "left")
    held = F.when(F.col("present") * 2 >= F.col("rows"), F.struct("field", "type"))
    each = joined.groupBy("site", "run_id", "started_at").agg(F.sort_array(F.collect_list(held)).alias("held"))  # fields in half of a load's rows: few
    each = cut(each.withColumn("fingerprint", F.md5(F.to_json("held"))))
    return linked(each, ["site"], "started_at", ["run_id"], ["run_id", "held", "fingerprint"], None, hot_rows).withColumnRenamed("_prev", "prev")


def steps(prints: DataFrame, item_loads: DataFrame) -> DataFrame:
    """The migration step of each load whose fingerprint differs from the load before: site, run_id, change_kind, field, new_field.

    Of the records in both loads (their latest rows by moment seen, then arrival) with a value in a field that is no
    longer held and with the key of one newly held, more than half must agree for a rename; a field can pair with several.
    """
    moved = prints.filter(F.col("prev").isNotNull() & (F.col("fingerprint") != F.col("prev.fingerprint")))
    now, before = F.col("held"), F.col("prev.held")
    names_now, names_before = F.transform(now, lambda x: x["field"]), F.transform(before, lambda x: x["field"])
    types_before = F.map_from_arrays(names_before, F.transform(before, lambda x: x["type"]))
    moved = moved.select(
        "site",
        "run_id",
        "started_at",
        F.col("prev.run_id").alias("prev_run"),
        F.array_except(names_before, names_now).alias("gone"),
        F.array_except(names_now, names_before).alias("new"),
        F.transform(F.filter(now, lambda x: F.try_element_at(types_before, x["field"]) != x["type"]), lambda x: x["field"]).alias("retyped"),
    )
    moved = cut(moved)
    pairs = moved.filter((F.size("gone") > 0) & (F.size("new") > 0)).select("site", "run_id", "prev_run", F.explode("gone").alias("field"), "new")
    pairs = pairs.select("site", "run_id", "prev_run", "field", F.explode("new").alias("new_field"))
    renamed = cut(_agreeing(pairs, item_loads))
    gone = moved.select("site", "run_id", F.explode("gone").alias("field")).join(renamed, ["site", "run_id", "field"], "left_anti")
    new = moved.select("site", "run_id", F.explode("new").alias("field")).join(renamed.select("site", "run_id", F.col("new_field").alias("field")), ["site", "run_id", "field"], "left_anti")
    retyped = moved.select("site", "run_id", F.explode("retyped").alias("field"))
    found = renamed.select("site", "run_id", F.lit("renamed").alias("change_kind"), "field", "new_field")
    for name, part in (("removed", gone), ("added", new), ("retyped", retyped)):
        found = found.unionByName(part.select("site", "run_id", F.lit(name).alias("change_kind"), "field", F.lit("").alias("new_field")))
    return found


def _agreeing(pairs: DataFrame, item_loads: DataFrame) -> DataFrame:
    """site, run_id, field, new_field of the pairs whose values agree in more than half of the records."""
    sides = pairs.select("site", F.col("prev_run").alias("load_run_id"), F.col("field").alias("key")).unionByName(pairs.select("site", F.col("run_id").alias("load_run_id"), F.col("new_field").alias("key")))
    sides = sides.distinct().groupBy("site", "load_run_id").agg(F.collect_list("key").alias("wanted"))
    rows = item_loads.filter(F.col("natural_key").isNotNull()).select("site", "load_run_id", "natural_key", "data", "load_id", "loaded_at", F.coalesce("gone_at", "last_seen").alias("moment"))
    rows = join_hot(rows, sides, ["site", "load_run_id"], "load_id", how="inner")
    parsed = rows.select("site", "load_run_id", "natural_key", F.struct("moment", "loaded_at", "load_id").alias("place"), "wanted", "data")
    latest = parsed.groupBy("site", "load_run_id", "natural_key").agg(F.max_by(F.struct("data", "wanted"), "place").alias("last"))
    latest = latest.select("site", "load_run_id", "natural_key", "last.data", "last.wanted")
    values = fields(latest, "data", "site", "load_run_id", "natural_key", "wanted").filter(F.array_contains("wanted", F.col("field")))
    values = values.select("site", "load_run_id", "natural_key", F.col("field").alias("key"), F.to_json("value").alias("value"), (F.col("kind") != "null").alias("filled"))
    before = values.filter("filled").join(pairs.withColumnsRenamed({"prev_run": "load_run_id", "field": "key"}), ["site", "load_run_id", "key"])
    before = before.select("site", "run_id", F.col("key").alias("field"), "new_field", "natural_key", F.col("value").alias("was"))
    after = values.withColumnsRenamed({"load_run_id": "run_id", "key": "new_field"}).select("site", "run_id", "new_field", "natural_key", F.col("value").alias("now"))
    both = before.join(after, ["site", "run_id", "new_field", "natural_key"])
    agreed = both.groupBy("site", "run_id", "field", "new_field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") == F.col("now")).alias("same"))
    return agreed.filter(F.col("same") * 2 > F.col("n")).select("site", "run_id", "field", "new_field")


def latest_names(prints: DataFrame, found: DataFrame) -> DataFrame:
    """site, since, field, name: from rows of runs that started before since, field comes out as name, the end of its chain of renames.

    Of several renames of one field in one step the alphabetically first new name counts.
    """
    began = prints.select("site", "run_id", "started_at")
    hop = found.filter("change_kind = 'renamed'").groupBy("site", "run_id", "field").agg(F.min("new_field").alias("name"))
    hop = cut(hop.join(began, ["site", "run_id"]).select("site", "field", "name", F.col("started_at").alias("since"), F.col("started_at").alias("until")))
    while True:  # pointers double their reach each time, so as many rounds as the logarithm of the longest chain
        ahead = hop.select("site", F.col("field").alias("name"), F.col("name").alias("name2"), F.col("since").alias("since2"), F.col("until").alias("until2"))
        onward = hop.join(ahead, ["site", "name"]).filter(F.col("since2") > F.col("until"))
        onward = onward.groupBy("site", "field", "since").agg(F.min(F.struct("since2", "name2", "until2")).alias("to"))
        jumped = hop.join(onward, ["site", "field", "since"], "left")
        more = jumped.filter("to is not null").limit(1).count()
        if not more:
            return hop.select("site", "since", "field", "name")
        hop = cut(jumped.select("site", "field", F.coalesce("to.name2", "name").alias("name"), "since", F.coalesce("to.until2", "until").alias("until")))


def targets(prints: DataFrame, found: DataFrame) -> DataFrame:
    """site, field, type, default: cast and default rules of each field that a load of the site holds, under its latest name.

    type is that of the latest load that gives the field one (string, number, boolean, array, object; null if none does).
    default is null, as no step tells a value for the rows before it: other defaults as text can be put in its place.
    """
    names = latest_names(prints, found)
    held = prints.select("site", "run_id", "started_at", F.explode("held").alias("h")).select("site", "run_id", "started_at", "h.field", "h.type")
    later = held.join(names, ["site", "field"]).filter(F.col("started_at") < F.col("since"))
    later = later.groupBy("site", "run_id", "field").agg(F.min_by("name", "since").alias("name"))
    held = held.join(later, ["site", "run_id", "field"], "left").withColumn("field", F.coalesce("name", "field"))
    last = F.max_by("type", F.when(F.col("type").isNotNull(), F.struct("started_at", "run_id", "type")))
    return cut(held.groupBy("site", "field").agg(last.alias("type")).withColumn("default", F.lit(None).cast("string")))


def cast_text(value: Column, text: Column, kind: Column, target: Column) -> Column:
    """A value (variant, its text and kind) as text of the target type, null where it can't be: casts lose nothing.

    Strings and JSON texts of numbers and booleans stand for each other if they read as such. A list of one value, or an
    object of one entry, stands for that value, and a value for a list of it; null stays null. Where target is null, or the kind already
    is the target, the text stays.
    """
    elements = F.try_variant_get(value, "$", "array<variant>")
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    only = F.when((kind == "array") & (F.size(elements) == 1), F.get(elements, F.lit(0))).when((kind == "object") & (F.size(entries) == 1), F.get(F.map_values(entries), F.lit(0)))
    inner = F.when(kind.isin("array", "object"), only).otherwise(value)
    inner_kind = F.when(inner.isNotNull(), kind_of(inner))
    plain = F.when(inner_kind == "string", F.try_variant_get(inner, "$", "string")).otherwise(F.to_json(inner))
    scalar = inner_kind.isin("string", "number", "boolean")
    number = plain.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return (
        F.when(target.isNull() | (kind == target) | (kind == "null"), text)
        .when((target == "string") & scalar, plain)
        .when((target == "number") & scalar & number, plain)
        .when((target == "boolean") & scalar & plain.isin("true", "false"), plain)
        .when((target == "array") & (kind != "array"), F.concat(F.lit("["), F.to_json(value), F.lit("]")))
        .when((target == "object") & (kind == "array") & (inner_kind == "object"), plain)
    )


def conform(item_loads: DataFrame, runs: DataFrame, prints: DataFrame, found: DataFrame, rules_of: DataFrame | None = None) -> DataFrame:
    """All rows in one shape: load_id, site, natural_key, run_id, file_name, fields, and with rules_of (targets()) failed.

    fields maps each field's latest name to its value as text (strings as they are, others as canonical JSON), so a field that
    changes its type reads the same everywhere; null values are kept. If two keys of a row end under one name, the one
    that has that name already counts, unless it is null. data that is no JSON object gives an empty map.

    With rules_of each value is cast to its field's type, and fields that a row lacks have their default. What can't be
    cast is null in fields, and failed maps the field to its text. Data that is no JSON object gives defaults only.
    """
    names = latest_names(prints, found)
    began = runs.groupBy(F.col("site"), F.col("id").alias("load_run_id")).agg(F.min("started_at").alias("started_at"))
    ruled = began.join(names, "site").filter(F.col("started_at") < F.col("since"))
    ruled = ruled.groupBy("site", "load_run_id", "field").agg(F.min_by("name", "since").alias("name"))
    rules = ruled.groupBy("site", "load_run_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("rules"))
    if rules_of is not None:  # all a load needs comes with one join; fields in half of a load's rows: few
        per_site = rules_of.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("types"), F.map_from_entries(F.collect_list(F.struct("field", "default"))).alias("defaults"))
        rules = item_loads.select("site", "load_run_id").distinct().join(rules, ["site", "load_run_id"], "left").join(per_site, "site", "left")
    rows = item_loads.select("load_id", "site", "natural_key", "load_run_id", "file_name", "data")
    rows = join_hot(rows, cut(rules), ["site", "load_run_id"], "load_id")
    rows = rows.withColumn("values", F.try_variant_get(F.try_parse_json("data"), "$", "map<string,variant>"))
    entry = F.map_entries(F.coalesce("values", F.create_map().cast("map<string,variant>")))
    entry = F.transform(entry, lambda e: F.struct(e["key"], e["value"], F.coalesce(kind_of(e["value"]), F.lit("null")).alias("kind")))
    text = lambda e: F.when(e["kind"] == "string", F.try_variant_get(e["value"], "$", "string")).when(e["kind"] != "null", F.to_json(e["value"]))
    entry = F.transform(entry, lambda e: F.struct(e["key"], e["value"], e["kind"], F.when(e["value"].isNotNull(), text(e)).alias("text")))
    to = lambda k: F.coalesce(F.try_element_at("rules", k), k)
    rank = lambda e: e["text"].isNull().cast("int") * 2 + (to(e["key"]) != e["key"]).cast("int")
    place = lambda e: (to(e["key"]).alias("key"), rank(e).alias("rank"), e["key"].alias("was"))
    if rules_of is None:
        named = F.transform(entry, lambda e: F.struct(*place(e), e["text"].alias("value")))
    else:
        typed = lambda e: cast_text(e["value"], e["text"], e["kind"], F.try_element_at("types", to(e["key"])))
        named = F.transform(entry, lambda e: F.struct(*place(e), typed(e).alias("value"), e["text"].alias("text")))
    rows = rows.withColumn("best", F.sort_array(named))
    keys = F.array_distinct(F.transform("best", lambda e: e["key"]))
    rows = rows.withColumn("first", F.transform(keys, lambda k: F.element_at(F.filter("best", lambda e: e["key"] == k), 1)))
    had = F.map_from_entries(F.transform("first", lambda e: F.struct(e["key"], e["value"])))
    out = ["load_id", "site", "natural_key", F.col("load_run_id").alias("run_id"), "file_name"]
    if rules_of is None:
        return rows.select(*out, had.alias("fields"))
    lacking = F.map_filter(F.coalesce("defaults", F.create_map().cast("map<string,string>")), lambda k, v: ~F.exists("first", lambda e: e["key"] == k))
    failed = F.filter("first", lambda e: e["value"].isNull() & e["text"].isNotNull())
    return rows.select(*out, F.map_concat(had, lacking).alias("fields"), F.map_from_entries(F.transform(failed, lambda e: F.struct(e["key"], e["text"]))).alias("failed"))
