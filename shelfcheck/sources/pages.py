"""Landed inventory API pages -> book inventory rows.

Each landed file holds one page: ``{code, msg, data: {current, pageSize, total,
totalPage, records: [...]}}``. Records are parsed as ``map<string,string>`` because
field names arrive in two casings (``cstoreCode`` / ``cStoreCode``): a struct schema
would either miss one casing or, declaring both, be ambiguous in case-insensitive
resolution. The first non-empty casing wins; quantities go through X1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcheck.contracts import BOOK_API_SCHEMA, PAGE_OK_CODE, PAGE_QTY_FIELDS, PAGE_TEXT_FIELDS
from shelfcheck.functions.scalars import to_int
from shelfcheck.sources.bucketed import Bucketed
from shelfcheck.sources.ingest import ContractError, publish_edit

PAGE_SCHEMA = (
    "code bigint, msg string, data struct<current: bigint, pageSize: bigint, total: bigint, "
    "totalPage: bigint, records: array<map<string, string>>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page file: (source_file, pull, page struct)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), "value")
    return raw.select(
        "source_file",
        # a pull is the folder its pages landed in
        F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1).alias("pull"),
        F.from_json("value", PAGE_SCHEMA).alias("page"),
    )


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages whose envelope code is not OK (or that did not parse)."""
    return pages.where(F.coalesce(F.col("page.code"), F.lit(-1)) != PAGE_OK_CODE).select(
        "source_file", "pull", F.col("page.code").alias("code"), F.col("page.msg").alias("msg"))


def _first_non_empty(rec, names: list[str]):
    return F.coalesce(*[F.when(rec[n] != "", rec[n]) for n in names])


def inventory_rows(pages: DataFrame) -> DataFrame:
    """One row per record of an OK page, in the book API schema."""
    ok = pages.where(F.col("page.code") == PAGE_OK_CODE)
    recs = ok.select("pull", F.col("page.data.current").alias("page_no"),
                     F.explode_outer("page.data.records").alias("rec")).where(F.col("rec").isNotNull())
    rec = F.col("rec")
    cols = [_first_non_empty(rec, names).alias(c) for c, names in PAGE_TEXT_FIELDS.items()]
    cols.append(F.lit(None).cast("string").alias("product_name"))
    for c, field in PAGE_QTY_FIELDS.items():
        cols.append(to_int(f"rec['{field}']").alias(c))
    return recs.select("pull", "page_no", *cols)


def page_completeness(pages: DataFrame) -> DataFrame:
    """Per pull, page numbers 1..totalPage that did not land (or were rejected).

    A pull ends at a page without records or at totalPage; in batch form every
    expected page must be present. ``sequence`` + ``explode`` builds the expected
    numbers per pull, an anti join removes the landed ones.
    """
    accepted = F.col("page.code") == PAGE_OK_CODE
    ok = pages.where(accepted).select("pull", F.col("page.data.current").alias("page_no"))
    # A pull without any accepted page still expects its first one.
    total = F.max(F.when(accepted, F.col("page.data.totalPage")))
    seen = F.coalesce(F.max(accepted), F.lit(False))
    expected = (pages.groupBy("pull").agg(F.when(seen, total).otherwise(F.lit(1)).cast("bigint").alias("total_page"))
                .where(F.col("total_page") >= 1)
                .select("pull", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total_page"))).alias("page_no")))
    return expected.join(ok, ["pull", "page_no"], "left_anti").orderBy("pull", "page_no")


def book_table(pages: DataFrame) -> DataFrame:
    """I14 rows of a complete pull as the book inventory table of the API form."""
    missing = page_completeness(pages).limit(5).collect()
    if missing:
        raise ContractError(f"pull is incomplete, missing pages: {[tuple(r) for r in missing]}")
    schema = StructType.fromDDL(BOOK_API_SCHEMA)
    return inventory_rows(pages).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def load_pull(spark: SparkSession, root: str, path: str, version: str, **window):
    """API pull -> published book table: pages, completeness (I15), rows (I14), optional
    store / product / barcode restriction (I17), publish with the load time (I11, I13)."""
    rows = filter_pull(book_table(read_pages(spark, path)), **window)
    return publish_edit(spark, root, "bojun_offline_inventory", rows, version)


def inventory_pull_stats(rows: DataFrame) -> DataFrame:
    """I16: rows, distinct warehouses, distinct products of a pull."""
    # Counts per (warehouse, product) first: one exchange of reduced rows, then a distinct
    # count over the pairs that are left.
    pairs = rows.groupBy("store_warehouse", "product_code").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                     F.count_distinct("store_warehouse").alias("stores"),
                     F.count_distinct("product_code").alias("products"))


def filter_pull(rows: DataFrame, store: str | None = None, product: str | None = None,
                barcode: str | None = None, start=None, end=None, time_col: str = "modified_at") -> DataFrame:
    """Restrict a pull to one store / product / barcode and to rows changed in
    [start, end) (each optional; the times need a ``time_col``).

    On a parquet-backed frame these equality filters reach the reader.
    """
    cond = F.lit(True)
    if store:
        cond = cond & (F.col("store_warehouse") == store)
    if product:
        cond = cond & (F.col("product_code") == product)
    if barcode:
        cond = cond & (F.col("barcode") == barcode)
    if start is not None:
        cond = cond & (F.col(time_col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(time_col) < F.lit(end))
    return rows.where(cond)


class PullStore:
    """Rows of pulls stored clustered by warehouse: ``read`` of one reads one bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        names = [f for f in StructType.fromDDL(BOOK_API_SCHEMA).fields if f.name != "store_warehouse"]
        columns = "store_warehouse string, pull string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
        self.table = Bucketed.open(spark, f"{root}/pulled", columns, "store_warehouse", buckets)

    def add(self, rows: DataFrame) -> None:
        """``inventory_rows`` of one or more pulls."""
        self.table.append(rows)

    def read(self, store: str, **window) -> DataFrame:
        return filter_pull(self.table.frame(), store=store, **window)
