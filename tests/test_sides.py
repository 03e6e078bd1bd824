"""Stored sides and guard inputs: one side refreshed alone, lookups that read one bucket."""

import re

import pytest
from pyspark.sql import functions as F

from shelfcheck.operators import guard as gd
from shelfcheck.operators.reconcile import reconcile, stack_sides
from shelfcheck.plans.sides import GuardStore, SideSums


def lines(spark, n, seed):
    return spark.range(n).selectExpr(
        f"if(id % 11 = 0, null, id * {seed} % 7) AS store_key", f"if(id % 13 = 0, null, id * {seed} % 17) AS product_key",
        f"id % 5 - 1 AS qty")


def rows(df):
    return sorted(map(tuple, df.select("store_key", "product_key", "bojun_qty", "jd_qty", "mt_qty", "flag").collect()), key=repr)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def spoil(table, key):
    """Make every bucket but the key's unreadable."""
    (own,) = {r[0] for r in table.frame().where(F.col(table.keys[0]) == key).selectExpr("input_file_name()").collect()}
    files = [r[0] for r in table.frame().selectExpr("input_file_name()").distinct().collect()]
    assert len(files) > 3
    for f in files:
        if f != own:
            with open(f.removeprefix("file://"), "wb") as out:
                out.write(b"spoilt")


def test_refreshing_one_side_equals_a_full_build(spark, tmp_dir):
    sums = SideSums(spark, tmp_dir, buckets=6)
    assert sums.detail(90).count() == 0
    sides = {"book": lines(spark, 300, 3), "jd": lines(spark, 200, 5), "mt": lines(spark, 100, 2)}
    for side, frame in sides.items():
        sums.refresh(side, frame)
    assert rows(sums.detail(90)) == rows(reconcile(stack_sides(sides), 90))
    sides["jd"] = lines(spark, 150, 4)
    sums.refresh("jd", sides["jd"])
    again = SideSums(spark, tmp_dir)  # another session
    assert again.table.buckets == 6
    detail = again.detail(90)
    assert rows(detail) == rows(reconcile(stack_sides(sides), 90))
    plan = executed(detail)
    assert "Exchange" not in plan and "Bucketed: true" in plan  # summed bucket by bucket
    (folders,) = re.findall(r"InMemoryFileIndex\((\d+) paths\)", plan)
    assert folders == "3"  # one load of each side: the first jd load is not read
    with pytest.raises(ValueError):
        sums.refresh("tmall", sides["jd"])


def test_a_failed_refresh_leaves_the_former_load(spark, tmp_dir):
    sums = SideSums(spark, tmp_dir, buckets=3)
    for side in ("book", "jd", "mt"):
        sums.refresh(side, lines(spark, 60, 3))
    before = rows(sums.detail(90))
    broken = lines(spark, 60, 5).selectExpr("store_key", "product_key", "if(qty = 2, raise_error('gone'), qty) AS qty")
    with pytest.raises(Exception, match="gone"):
        sums.refresh("jd", broken)
    assert rows(SideSums(spark, tmp_dir).detail(90)) == before


def test_lookup_of_an_outlet_reads_one_bucket(spark, tmp_dir):
    products = spark.range(600).selectExpr("concat('c', id % 12) AS customer_name", "cast(id AS string) AS product_code",
                                           "id % 9 - 2 AS offline_qty")
    stock = spark.range(900).selectExpr("if(id % 2 = 0, 'jd', 'mt') AS platform", "concat('o', id % 30) AS outlet_code",
                                        "cast(id * 7 % 900 AS string) AS product_code", "id % 4 AS outlet_qty")
    store = GuardStore(spark, tmp_dir, buckets=8)
    store.fill(products, stock)
    assert store.outlet_detail("nobody", "jd", "o10").count() == 0
    got = store.outlet_detail("c4", "jd", "o10")
    chosen = spark.createDataFrame([("c4", "jd", "o10")], "customer_name string, platform string, outlet_code string")
    want = gd.outlet_detail(chosen, stock, products)
    pick = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert pick(got) == pick(want) and got.count() == 50
    spoil(store.products, "c4")
    spoil(store.stock, f"jd{store.SEPARATOR}o10")
    assert pick(store.outlet_detail("c4", "jd", "o10")) == pick(want)


def test_one_warehouse_of_stored_pulls_reads_one_bucket(spark, tmp_dir):
    from shelfcheck.sources.pages import PullStore

    store = PullStore(spark, tmp_dir, buckets=8)
    names = [f for f in store.table.frame().columns if f not in ("store_warehouse", "pull", "product_code")]
    types = dict(store.table.frame().dtypes)
    pulled = spark.range(200).selectExpr("concat('w', id % 20) AS store_warehouse", "'p' AS pull", "cast(id AS string) AS product_code",
                                         *[f"cast(id AS {types[n]}) AS {n}" for n in names])
    store.add(pulled)
    got = store.read("w3", product="23")
    assert [r["product_code"] for r in got.collect()] == ["23"] and store.read("w3").count() == 10
    spoil(store.table, "w3")
    assert store.read("w3").count() == 10
