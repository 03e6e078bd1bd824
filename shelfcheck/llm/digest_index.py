"""Exact dedup against a persistent digest index.

The index holds one row per distinct normalised text (A-Z lower-cased; null counts as
empty): its SHA-256 and the document that stays. It is a table bucketed and sorted by the
digest (sources/bucketed.py). A delivery is reduced to one row per digest, the largest doc_id, before
anything is compared; the reduced rows meet the index in a sort-merge anti-join for which the
index is not shuffled, and the digests it lacks are appended, one file per bucket. ``compact``
merges the files of many deliveries and can raise the bucket count.

What the index has, stays: a text it knows is dropped from every later delivery, whatever its
id, so deliveries that should keep the largest id overall arrive in falling order of ids.
Adding a delivery again changes nothing. No Python runs on the executors, and no key is
ever gathered: digests are summed before each shuffle, and only digests that repeat are
joined back to the documents, from written tables, so that adaptive execution can split the
share of a hot digest.

Texts count as equal when their SHA-256 is. Defined cases: a null text equals the empty one; a
null doc_id is smaller than any other; of rows that repeat the same text and doc_id one stays
(the first of the scan); an empty table gives no rows and leaves the index as it is; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.sources.bucketed import Bucketed
from shelfcheck.llm.util import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: Column | str) -> Column:
    """SHA-256 of the normalised text, lower-case hex."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), 256)


def digests(docs: DataFrame, delivery: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(delivery, row, doc_id, digest) of every document, written once: row numbers them."""
    return materialize(docs.select(delivery.cast("string").alias("delivery"), F.monotonically_increasing_id().alias("row"),
                                   docs[doc_id].alias("doc_id"), F.unhex(digest(docs[text])).alias("digest")), "digests")


class DigestIndex:
    """Digest -> the document that stays, over all deliveries so far."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.table = Bucketed.open(spark, path, f"digest binary, doc_id {id_type}, delivery string, row bigint",
                                   "digest", buckets)

    @staticmethod
    def reduced(rows: DataFrame) -> DataFrame:
        """One row per digest of ``rows`` (see ``digests``): its size and its largest document."""
        best = F.max(F.struct("doc_id", (-F.col("row")).alias("first"), "delivery"))
        return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("b")).select(
            "digest", "n", "b.doc_id", "b.delivery", (-F.col("b.first")).alias("row"))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The reduced rows whose digest the index lacks."""
        placed = self.reduced(rows).repartition(self.table.buckets, "digest")
        return placed.hint("merge").join(self.table.frame().select("digest"), "digest", "left_anti")

    def add(self, rows: DataFrame) -> None:
        self.table.append(self.unseen(rows), placed=True)

    def compact(self, buckets: int | None = None) -> None:
        self.table = self.table.compact(buckets)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Every row with the document that stays for its text (``keep_id``), the number of
        ``rows`` that share the text, and whether it is the one that stays. The rows have been
        added before."""
        own = F.struct("doc_id", "delivery", "row")
        found = self.table.frame().select("digest", own.alias("keep"))
        groups = (self.reduced(rows).repartition(self.table.buckets, "digest").hint("merge").join(found, "digest")
                  .where((F.col("n") > 1) | (own != F.col("keep")) | F.isnull(F.col("keep.doc_id")))
                  .select("digest", "n", "keep"))
        groups = materialize(groups, "digest-groups")  # texts that stand once and stay need no partner
        joined = rows.join(groups, "digest", "left").withColumn("keep", F.coalesce("keep", own))
        return joined.select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            ((F.col("keep.row") == F.col("row")) & (F.col("keep.delivery") == F.col("delivery"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def dedupe(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` through ``index`` in two deliveries, the upper half of the id range first, so
    that of equal texts the largest doc_id stays; one row per document (see ``resolve``)."""
    bounds = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = None if bounds["low"] is None else (bounds["low"] + bounds["high"]) // 2
    upper = F.coalesce(docs["doc_id"] > F.lit(middle).cast("bigint"), F.lit(False))
    rows = digests(docs, F.when(upper, "upper").otherwise("lower"))
    for delivery in ("upper", "lower"):
        index.add(rows.where(F.col("delivery") == delivery))
    return index.resolve(rows)
