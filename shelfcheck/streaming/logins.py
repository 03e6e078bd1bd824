"""M5 as Structured Streaming: fold arriving login events into the profile table.

Every value of a profile is order-free (operators/logins.py), so no event-time window or
watermark is needed and an event counts however late it arrives. Re-delivered events are
recognised by their id alone, whatever else of them changed: the ids seen are streaming
state, spread by id over the state store's partitions, and a micro-batch looks up its own ids
only. Events without an id cannot be recognised and all count, as in the batch form.

A micro-batch is reduced to one row per user, which is appended to a merge-on-read table
(sources/keyed.py) under the batch's number; buckets are compacted after some batches and
versions no longer needed are deleted, so the number of files stays bounded. State and table
are both versioned by batch: a batch that runs again, after a lost executor or driver, reads
the state before it and publishes nothing twice, so the sink is exactly-once.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shelfcheck.operators.logins import accepted, fold_profiles, profile_from_logins
from shelfcheck.session import scratch_path
from shelfcheck.sources.keyed import KeyedTable

_AT = "struct<ts: timestamp, event_id: bigint>"
PROFILE_SCHEMA = (
    "open_id string, union_id string, feishu_user_id string, name string, avatar_url string, email string, "
    "mobile string, source string, is_admin boolean, is_active boolean, first_login_at timestamp, "
    f"last_login_at timestamp, login_count bigint, updated_at timestamp, _last {_AT}, _email_at {_AT}, _mobile_at {_AT}"
)
COMPACT_AFTER, KEEP_VERSIONS = 8, 2
# Ids seen are kept for good: in RocksDB they need not fit the executors' memory.
_STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def profile_table(spark: SparkSession, root: str, buckets: int | None = None) -> KeyedTable:
    """The stored profiles; ``buckets`` counts when the table is created (the session's shuffle
    partitions if not given)."""
    return KeyedTable(spark, root, fold_profiles, PROFILE_SCHEMA, PROFILE_SCHEMA, "open_id", buckets)


def latest_profiles(spark: SparkSession, root: str) -> DataFrame:
    return profile_table(spark, root).read()


def fold_batch(root: str, buckets: int | None = None, compact_after: int = COMPACT_AFTER):
    """foreachBatch function: one batch of accepted logins into the profile table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table = profile_table(batch.sparkSession, root, buckets)
        last = table.version()
        if last is not None and last >= batch_id:
            batch.write.format("noop").mode("overwrite").save()  # a replay only renews its state
            return
        # Exports often carry zone-less times; the stored profiles have zoned ones.
        logins = batch.withColumn("ts", batch["ts"].cast("timestamp"))
        table.append(profile_from_logins(logins), batch_id, compact_after)
        table.vacuum(KEEP_VERSIONS)

    return apply


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings that a query copies when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_profile_stream(logins: DataFrame, root: str, checkpoint: str, available_now: bool = True,
                       buckets: int | None = None, compact_after: int = COMPACT_AFTER):
    """Start the stream over a streaming ``logins`` frame (A12 input columns + event_id)."""
    w = (accepted(logins).writeStream.outputMode("append").foreachBatch(fold_batch(root, buckets, compact_after))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    with _settings(logins.sparkSession, _STATE_STORE):
        return w.start()


def profiles_via_stream(spark: SparkSession, events_dir: str, to_logins, files_per_batch: int = 1,
                        file_glob: str = "*.parquet") -> DataFrame:
    """Drive the stream over landed event files to completion and return the profiles.

    ``events_dir`` is the landing folder (a glob may name several), ``file_glob`` selects
    the event files in it. ``to_logins`` maps the raw event frame to the login columns.
    Output and stream checkpoint live in a fresh folder below the shared checkpoint folder.
    """
    base = scratch_path(spark, f"profiles-{uuid.uuid4().hex}")
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(events_dir).schema
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .option("pathGlobFilter", file_glob).parquet(events_dir))
    q = run_profile_stream(to_logins(raw), f"{base}/table", f"{base}/ckpt")
    q.awaitTermination()
    return latest_profiles(spark, f"{base}/table")
