"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.llm.util import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has a link; label is the smallest node reachable.

    ``edges`` holds long columns ``a`` and ``b``; loops, repeats and either direction are
    allowed, nulls are ignored. Each round hangs every node's larger neighbours, then its
    smaller ones, under the smallest node it sees, until each component is one star. A
    round is joins against a written table of minima, so adaptive execution can split the
    rows of a hub; nothing is gathered per node.
    """
    cur = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = _mark(cur)
    while seen[0]:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
                          .withColumnRenamed("u", "lo"), "low")
        big = materialize(cur.join(low, "lo").select("hi", F.col("m").alias("lo")).distinct(), "large")
        low = materialize(big.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        cur = materialize(
            big.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")),
                                      F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct(), "small")
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    stars = cur.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return stars.unionByName(cur.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.bit_xor(F.xxhash64("hi", "lo")).alias("x"),
                  F.sum((F.xxhash64("lo", "hi") % 1_000_003)).alias("s")).first()
    return r["n"], r["x"], r["s"]
