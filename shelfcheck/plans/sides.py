"""J1 with M6: the three stock sides stored as sums, so that a new export re-reads its own side.

Each load of a side is reduced to one row per (store, product) and written into one table that
is bucketed by these keys and has a folder per side and load; a log names the current load of
each side. The detail is summed from the current loads bucket by bucket: the scan is already
placed by the keys, so J1 needs no shuffle and no export. Likewise for the outlet guard: dealer
totals lie bucketed by customer, outlet stock by outlet, so that F4 for a given outlet reads
one bucket of each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.operators import guard as gd
from shelfcheck.operators.reconcile import QTY, SIDES, reconcile
from shelfcheck.sources.bucketed import Bucketed
from shelfcheck.sources.files import Files


class SideSums:
    """Sums per (store_key, product_key) of every side's current load."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.root, self.files = root, Files(spark)
        self.table = Bucketed.open(spark, f"{root}/sums", "store_key bigint, product_key bigint, qty bigint, side string, load string",
                                   ("store_key", "product_key"), buckets, partitions=("side", "load"))

    def loads(self) -> dict[str, str]:
        """The current load of each side."""
        known = self.files.numbered(f"{self.root}/_loads")
        return self.files.get(f"{self.root}/_loads/{known[-1]}") if known else {}

    def refresh(self, side: str, lines: DataFrame) -> None:
        """Replace one side by ``lines`` (store_key, product_key, qty). Until the load is logged the
        former one stays current; a run that fails leaves a folder that no log names."""
        if side not in SIDES:
            raise ValueError(f"unknown side {side!r}, expected one of {SIDES}")
        load, known = uuid.uuid4().hex[:12], self.files.numbered(f"{self.root}/_loads")
        number = known[-1] + 1 if known else 0
        sums = (lines.groupBy("store_key", "product_key").agg(F.sum(F.col("qty").cast("bigint")).alias("qty"))
                .select("*", F.lit(side).alias("side"), F.lit(load).alias("load")))
        self.table.append(sums)
        self.files.put(f"{self.root}/_loads/{number}", {**self.loads(), side: load})

    def _current(self, loads: dict[str, str]) -> DataFrame:
        mine = F.lit(False)
        for side, load in loads.items():
            mine = mine | ((F.col("side") == side) & (F.col("load") == load))
        return self.table.frame().where(mine)

    def lines(self) -> DataFrame:
        """The current sums in the wide line form of ``reconcile``."""
        return self._current(self.loads()).select(
            "store_key", "product_key", *[F.when(F.col("side") == s, F.col("qty")).alias(QTY[s]) for s in SIDES])

    def detail(self, virtual_threshold: int) -> DataFrame:
        """J1 over the current loads, without a shuffle."""
        return reconcile(self.lines(), virtual_threshold)


class GuardStore:
    """J8 inputs stored for lookups: dealer totals by customer, outlet stock by outlet."""

    SEPARATOR = "\u0000"

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.products = Bucketed.open(spark, f"{root}/dealer_products", "customer_name string, product_code string, offline_qty bigint",
                                      "customer_name", buckets)
        self.stock = Bucketed.open(spark, f"{root}/outlet_stock",
                                   "outlet string, platform string, outlet_code string, product_code string, outlet_qty bigint",
                                   "outlet", buckets)

    @classmethod
    def outlet(cls, platform, outlet_code):
        return F.concat(platform, F.lit(cls.SEPARATOR), outlet_code)

    def fill(self, products: DataFrame, stock: DataFrame) -> None:
        """``guard.dealer_products`` and ``guard.outlet_stock`` results. A version of its own: fill
        a store once, in a folder of its own."""
        self.products.append(products)
        keyed = stock.withColumn("outlet", self.outlet(F.col("platform"), F.col("outlet_code")))
        self.stock.append(keyed)

    def outlet_detail(self, customer: str, platform: str, outlet_code: str, names: DataFrame | None = None) -> DataFrame:
        """F4 of one outlet: one bucket of either table is read."""
        products = self.products.frame().where(F.col("customer_name") == customer)
        own = self.stock.frame().where(F.col("outlet") == f"{platform}{self.SEPARATOR}{outlet_code}")
        return gd.detail_rows(products, own.select("product_code", "outlet_qty"), names)
