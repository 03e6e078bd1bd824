"""File arrival as Structured Streaming: the optional stream form of I7 + I11.

Exports of one dataset land as files in a folder. A file stream over that folder tracks
which files have arrived (its checkpoint makes every file count exactly once); each
micro-batch loads the files that arrived in it with the batch pipeline: read as text
(I1), normalise headers (I2, I5), check the contract (I7), load (I3, I6, I8-I10) and
publish as version ``s<batch_id>`` (I11). A batch that breaks the contract publishes
nothing, so the former version stays current; either way one row goes to the load
history (K6).

Only the names and sizes of a micro-batch's files reach the driver (at most
``maxFilesPerTrigger`` of them), never their rows: the executors read the files.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfcheck.plans.tables import load_log_row, log_once
from shelfcheck.session import checkpoint_root
from shelfcheck.sources.ingest import (
    ContractError,
    load_tables,
    header_findings,
    normalize_frame,
    open_export,
    publish,
    published_rows,
    skip_description_row,
    validate_all,
)


# The fixed schema of Spark's binaryFile source (stream sources need it stated).
_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def load_arrivals(root: str, table: str, fmt: str = "csv", context_headers: bool = False,
                  operator: str | None = None):
    """foreachBatch function: load and publish the files of one micro-batch.

    The batch frame has one row per arrived file (``path``, ``length``). A replayed
    batch whose version is already published does nothing, so the sink is idempotent.
    """

    def apply(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        version = f"s{batch_id}"
        arrived = sorted((r["path"], r["length"]) for r in files.select("path", "length").collect())
        if not arrived:
            return
        paths = [p for p, _ in arrived]
        names = ",".join(os.path.basename(p) for p in paths)
        size = sum(n for _, n in arrived)
        run, published = f"{table}-{version}", published_rows(spark, root, table, version)
        if published is not None:
            # A replay. The first run may have ended between publishing and its history row.
            log_once(load_log_row(spark, table, names, size, "success", f"{published} rows", operator), root, run)
            return
        try:
            described = table == "meituan_store_inventory"
            export = open_export(spark, paths, fmt, context_headers=context_headers, ordered=described)
            df = normalize_frame(export.frame, context_headers)
            if described:
                df = skip_description_row(df)
            validate_all(spark, {table: df}, header_findings(export.groups, table, context_headers))
            pub = publish(spark, root, load_tables(spark, {table: df}), version)
            state, message = "success", f"{pub.rows[table]} rows"
        except ContractError as e:
            state, message = "failed", str(e)
        log_once(load_log_row(spark, table, names, size, state, message, operator), root, run)

    return apply


def run_arrival_stream(spark: SparkSession, landing: str, root: str, table: str,
                       checkpoint: str | None = None, file_glob: str = "*.csv",
                       files_per_batch: int = 1, fmt: str = "csv", available_now: bool = True,
                       context_headers: bool = False, operator: str | None = None):
    """Start the stream over ``landing``; returns the streaming query.

    ``checkpoint`` defaults to a fresh folder below the shared checkpoint folder; pass
    the same one again to resume after the files already loaded. With ``available_now``
    the query loads what has landed and stops; otherwise it polls every minute.
    """
    ckpt = checkpoint or os.path.join(checkpoint_root(spark), f"arrivals-{uuid.uuid4().hex}")
    arrivals = (spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
                .option("pathGlobFilter", file_glob)
                .option("maxFilesPerTrigger", files_per_batch).load(landing)
                .select("path", "length"))
    w = (arrivals.writeStream.foreachBatch(load_arrivals(root, table, fmt, context_headers, operator))
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
