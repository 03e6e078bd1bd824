"""Pulls as Structured Streaming: I14 -> I15 -> I11. Each micro-batch holds the pulls that have
landed since; a pull is published as a version of the book table only when no page of it is
missing or was rejected, and logged either way (K6)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.plans.tables import load_log_row, log_once
from shelfcheck.sources.ingest import ContractError, publish_edit, published_rows
from shelfcheck.sources.page_source import stream_landing
from shelfcheck.sources.pages import book_table

TABLE = "bojun_offline_inventory"


def load_pulls(root: str):
    """foreachBatch function. A pull that is published already (a batch that runs again) is left."""

    def apply(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession
        pages.persist()
        try:
            pulls = sorted(r["pull"] for r in pages.select("pull").distinct().collect())  # pulls, not pages
            for pull in pulls:
                version = f"pull-{os.path.basename(pull)}"
                if published_rows(spark, root, TABLE, version) is not None:
                    continue
                try:
                    made = publish_edit(spark, root, TABLE, book_table(pages.where(F.col("pull") == pull)), version)
                    state, message = "success", f"{made.rows[TABLE]} rows"
                except ContractError as e:
                    state, message = "failed", str(e)
                log_once(load_log_row(spark, TABLE, os.path.basename(pull), 0, state, message, None), root, f"{TABLE}-{version}")
        finally:
            pages.unpersist()

    return apply


def run_pull_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, available_now: bool = True):
    """Start the stream; with ``available_now`` it takes what has landed and stops."""
    w = stream_landing(spark, landing).writeStream.foreachBatch(load_pulls(root)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
