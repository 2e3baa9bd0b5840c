"""Fields of JSON records as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS = 20


def kind_of(value: Column) -> Column:
    """string, number, boolean, array, object or null: the JSON type of a variant."""
    shape = F.substring_index(F.schema_of_variant(value), "<", 1)
    return F.coalesce(F.try_element_at(KIND_NAMES(), shape), F.lit("number"))


def KIND_NAMES() -> Column:
    return F.create_map(*(F.lit(x) for x in ("STRING", "string", "BOOLEAN", "boolean", "ARRAY", "array", "OBJECT", "object", "VOID", "null")))


def fields(rows: DataFrame, data: str, *keep: str) -> DataFrame:
    """keep and field, value (a variant), kind: one row per top-level key of data. Rows whose data is no JSON object have none."""
    parsed = rows.select(*keep, F.try_parse_json(F.col(data)).alias("_v"))
    listed = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "field", "value"))
    return listed.filter(F.col("field").isNotNull()).select(*keep, "field", "value").withColumn("kind", kind_of(F.col("value")))


def loads_of(item_loads: DataFrame, runs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """site, run_id, rows, started_at: the rows with one load_run_id, if there are at least min_rows, with the start of that run.

    A run that runs lists more than once starts at its earliest started_at; one it doesn't list, at null.
    """
    counted = item_loads.groupBy("site", F.col("load_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("rows"))
    began = runs.groupBy(F.col("id").alias("run_id")).agg(F.min("started_at").alias("started_at"))
    return counted.filter((F.col("rows") >= min_rows) & F.col("site").isNotNull() & F.col("run_id").isNotNull()).join(began, "run_id", "left")
