"""Captured pages as they arrive: each micro-batch lands in a table, and the site is run over what has landed.

A list page may come in one batch and its detail pages in another: a record is taken by the first run that finds both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.plans.site_run import SiteRun
from sedimenta.sources.store import Store
from sedimenta.spec import Site

PAGES = "url string, final_url string, status int, html string, fetched_at timestamp_ntz"


def read_pages(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of the parquet files that land in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(folder)


def follow(pages: DataFrame, site: Site, store: Store, checkpoint: str):
    """Starts a query that extracts and upserts each batch once what is there has been taken (trigger availableNow).

    The number of a batch is committed together with its run, so a batch that comes again after a failure lands in its
    place again and is not run twice. A run reads of all landed pages only those its site asks for; of several captures
    of a URL the latest usable one counts. Items are never marked as gone here, as it isn't known what is still to come.
    """
    part = site.model_copy(update={"track_removed": False})
    landed = f"{store.root}/captured/{site.name}"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        batch.write.mode("overwrite").parquet(f"{landed}/{stream}-{number}")
        if number <= store.batch(stream):
            return
        whole = spark.read.schema(PAGES).option("recursiveFileLookup", True).parquet(landed)
        report = SiteRun(spark, part, whole, store, batch=(stream, number)).run()
        if report.status == "error":
            raise RuntimeError(f"the run over batch {number} failed; see the log")

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
