"""M1-M4, F8: keyed changes to stored tables.

Each operator is a rule: rows and changes in, the new rows out. Over whole frames that is a
rewrite; ``geo_table`` and ``edit_table`` bind the rules to a merge-on-read table
(sources/keyed.py), where a change costs what it touches. All "last change wins" logic is an
aggregate (``max_by`` on a sequence number), never a window over a key, so a key with very
many changes is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcheck.functions.scalars import blank_to_null
from shelfcheck.sources.keyed import KeyedTable

GEO_OK, GEO_FAIL = "ok", "fail"
OPS = ("insert", "update", "delete")
# Changes of one key are scanned in slices of this many sequence numbers.
SEQ_SPAN = 100_000
GEO_VALUE_COLS = ["lng", "lat", "adcode", "formatted_address", "level"]


# ---------------------------------------------------------------- M1 geocode cache

def upsert_geo(cache: DataFrame, results: DataFrame) -> DataFrame:
    """M1: merge geocode results into the cache by address.

    ok -> every field is taken from the result; fail -> only status and time change,
    earlier coordinates stay. Of several results for one address the latest gives status
    and time, and the latest *ok* one the fields, as applying them in turn would.
    Re-applying the same batch gives the same table. Results of several batches in one frame
    carry ``_version``, the batch's place in the order of application.
    """
    turn = ["_version"] if "_version" in results.columns else []
    at = F.struct(*turn, "updated_at", "status")
    was_ok = F.col("status") == GEO_OK
    latest = results.groupBy("address").agg(
        F.max_by(F.struct("status", "updated_at"), at).alias("last"),
        F.max_by(F.struct(*GEO_VALUE_COLS), F.when(was_ok, at)).alias("good"),
        F.coalesce(F.max(was_ok), F.lit(False)).alias("has_good"))
    latest = latest.select("address", "last.*", "good.*", "has_good")
    c, r = cache.alias("c"), latest.alias("r")
    joined = c.join(r, F.col("c.address") == F.col("r.address"), "full_outer")
    ok = F.col("r.has_good")
    cols = [F.coalesce(F.col("r.address"), F.col("c.address")).alias("address")]
    for v in GEO_VALUE_COLS:
        cols.append(F.when(ok, F.col(f"r.{v}")).otherwise(F.col(f"c.{v}")).alias(v))
    cols.append(F.coalesce(F.col("r.status"), F.col("c.status")).alias("status"))
    cols.append(F.coalesce(F.col("r.updated_at"), F.col("c.updated_at")).alias("updated_at"))
    return joined.select(*cols)


# ---------------------------------------------------------------- F8 / M2 edited tables

def clean_changes(changes: DataFrame, editable: list[str], required: str) -> tuple[DataFrame, DataFrame]:
    """F8: keep editable fields only; strip; '' -> null. Reject an insert without the
    required field, and an update that supplies it empty.

    ``changes``: (seq, op, id, fields map<string,string>); a key present in ``fields``
    means "supplied" (its value may be null = set to null). Returns (clean, rejects).
    """
    keep = F.map_filter("fields", lambda k, v: k.isin(*editable))
    cleaned = changes.withColumn("fields", F.transform_values(keep, lambda k, v: blank_to_null(v)))
    has_req = F.array_contains(F.map_keys("fields"), required)
    req_val = F.try_element_at("fields", F.lit(required))
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    bad = ((F.col("op") == "insert") & (~has_req | req_val.isNull())) | (
        (F.col("op") == "update") & has_req & req_val.isNull())
    # A null map counts as nothing supplied; every row lands on exactly one side.
    bad = ~known | F.coalesce(bad, F.col("op") == "insert")
    reason = F.when(known, F.lit(f"{required} empty")).otherwise(F.lit("unknown op"))
    return cleaned.where(~bad), cleaned.where(bad).withColumn("reason", reason)


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """M2: (new table, misses) after inserts, updates and deletes in ``seq`` order: a miss is an
    update or delete that finds no row at its place in the sequence."""
    return changed_table(table, changes, key), change_misses(table, changes, key)


def changed_table(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """M2: the table after all changes (updates change supplied fields only).

    Per key, changes before the latest insert/delete are superseded by it; each field
    takes its last supplied value after that point. ``seq`` may be of any ordered type.
    """
    cols = [c for c in table.columns if c != key]
    resets = changes.where(F.col("op").isin("insert", "delete")).groupBy(key).agg(
        F.max_by("op", "seq").alias("last_reset_op"), F.max("seq").alias("last_reset_seq"))
    fields = (changes.where(F.col("op").isin("insert", "update"))
              .select(key, "seq", "op", F.explode("fields").alias("field", "value"))
              .join(resets, key, "left")
              .where(F.col("last_reset_seq").isNull() | (F.col("seq") >= F.col("last_reset_seq")))
              .groupBy(key, "field").agg(F.max_by("value", "seq").alias("value")))
    per_key = fields.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    touched = per_key.join(resets, key, "full_outer")

    base = table.withColumn("_in_base", F.lit(True))
    merged = base.join(touched, key, "full_outer")
    inserted = F.col("last_reset_op") == "insert"
    deleted = F.col("last_reset_op") == "delete"
    exists = (F.col("_in_base").isNotNull() | inserted) & ~F.coalesce(deleted, F.lit(False))
    out_cols = [F.col(key)]
    for c in cols:
        supplied = F.coalesce(F.array_contains(F.map_keys("m"), c), F.lit(False))
        base_val = F.when(~F.coalesce(inserted, F.lit(False)), F.col(c))
        out_cols.append(F.when(supplied, F.try_element_at("m", F.lit(c)).cast(table.schema[c].dataType))
                        .otherwise(base_val).alias(c))
    return merged.where(exists).select(*out_cols)


def change_misses(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Updates and deletes (key, op, seq) whose row does not exist when they apply: after a
    delete, before the insert, or never.

    The last insert / delete before a change decides. It comes from the change's own slice
    of the sequence or, failing that, from the last earlier slice that has one; slices are
    reduced to one row first, so a key with very many changes is never one task's window.
    """
    reset = F.when(F.col("op").isin("insert", "delete"), F.col("op"))
    sliced = changes.select(key, "op", "seq", F.floor(F.col("seq") / SEQ_SPAN).alias("_slice"))
    inside = Window.partitionBy(key, "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (sliced.groupBy(key, "_slice").agg(F.max_by(reset, F.when(reset.isNotNull(), F.col("seq"))).alias("_r"))
               .select(key, "_slice", F.last("_r", ignorenulls=True).over(across).alias("_before")))
    placed = (sliced.withColumn("_own", F.last(reset, ignorenulls=True).over(inside))
              .where(F.col("op").isin("update", "delete")).join(carried, [key, "_slice"])
              .withColumn("_state", F.coalesce("_own", "_before")))
    gone = placed.where(F.col("_state") == "delete")
    never = placed.where(F.col("_state").isNull()).join(table.select(key), key, "left_anti")
    return gone.unionByName(never).select(key, "op", "seq")


def ensure_ids(df: DataFrame, key: str = "id", order_by: list[str] | None = None) -> DataFrame:
    """M3: give rows without an id the next ids after the current maximum; existing
    ids never change. New rows are numbered in a stable order (``order_by``).

    The numbering is distributed and stays on the JVM: new rows are range-sorted, each
    row is tagged with its partition and its position inside it, the per-partition
    counts (one row per partition) give each partition its offset, and the offsets are
    broadcast back. The tagged rows are checkpointed to the shared checkpoint folder
    first, so the count and the numbering read the same rows even if a task is retried.
    """
    from shelfcheck.session import checkpoint_root

    order_by = order_by or [c for c in df.columns if c != key]
    has = df.where(F.col(key).isNotNull())
    start = has.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    new = df.where(F.col(key).isNull()).drop(key).orderBy(*order_by)
    checkpoint_root(df.sparkSession)
    part = F.spark_partition_id()
    tagged = new.select(
        "*", part.alias("_part"),
        (F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)).alias("_pos"),
    ).checkpoint(eager=True)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    with_id = tagged.join(F.broadcast(offsets), "_part").withColumn(
        key, F.lit(int(start)).cast("bigint") + F.coalesce("_off", F.lit(0)) + F.col("_pos") + 1)
    return has.withColumn(key, F.col(key).cast("bigint")).unionByName(with_id.select(*has.columns))


def set_active(users: DataFrame, flags: DataFrame, now_col=None) -> tuple[DataFrame, DataFrame]:
    """M4: toggle ``is_active`` per open_id and stamp ``updated_at``; report misses."""
    stamp = now_col if now_col is not None else F.current_timestamp()
    last = flags.groupBy("open_id").agg(F.max_by("active", "seq").alias("_active"))
    out = users.join(last, "open_id", "left").withColumn(
        "updated_at", F.when(F.col("_active").isNotNull(), stamp).otherwise(F.col("updated_at"))
    ).withColumn("is_active", F.coalesce(F.col("_active"), F.col("is_active"))).drop("_active")
    misses = last.join(users.select("open_id"), "open_id", "left_anti").select("open_id")
    return out.select(*users.columns), misses


# ---------------------------------------------------------------- M1 / M2 over merge-on-read tables

GEO_COLUMNS = ("address string, lng double, lat double, adcode string, formatted_address string, level string, "
               "status string, updated_at timestamp")
CHANGE_COLUMNS = "seq bigint, op string, {key} bigint, fields map<string, string>"


def geo_table(spark: SparkSession, root: str, buckets: int | None = None) -> KeyedTable:
    """M1: the geocode cache; its changes are batches of geocode results."""
    return KeyedTable(spark, root, upsert_geo, GEO_COLUMNS, GEO_COLUMNS, "address", buckets)


def edit_table(spark: SparkSession, root: str, columns: str, key: str = "id", buckets: int | None = None) -> KeyedTable:
    """M2: an edited table (``columns`` DDL with a bigint ``key``); its changes are clean ones
    (``clean_changes``), applied batch after batch and by ``seq`` within a batch."""
    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return changed_table(rows, changes.withColumn("seq", F.struct("_version", "seq")).drop("_version"), key)

    return KeyedTable(spark, root, merge, columns, CHANGE_COLUMNS.format(key=key), key, buckets)


def sort_for_listing(df: DataFrame, required: str, key: str = "id") -> DataFrame:
    """Required field nulls last, then id."""
    return df.orderBy(F.col(required).asc_nulls_last(), F.col(key).asc_nulls_last())

