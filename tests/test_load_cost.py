"""What loading costs per row: one reconciliation for all exports, no shuffle for description rows,
one reading of a cell, statistics of wide exports."""

import contextlib
import io

from pyspark.sql import functions as F

from shelfcheck.functions import scalars
from shelfcheck.operators import match as mt
from shelfcheck.operators.common import distinct_values
from shelfcheck.plans import queries as Q
from shelfcheck.sources import ingest
from shelfcheck.sources import testbind as tb
from shelfcheck.sources.headers import first_records
from tests.conftest import SF_SMALL

ODD = ["12345.0", " -3. ", "007", "　12\t", "", " ", None, "x", "12 x", "1e3", "0x1p3", "inf", "-Infinity", "NaN", "nan1", ".", "-",
       "\x0012", "1d", "+.5", "店 A　", "a\n", "2024-01-02", "1_0", "99999999999999999999"]


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def odd_texts(spark):
    return spark.createDataFrame([(v,) for v in ODD], "v string").coalesce(1)


def test_exports_and_book_are_reconciled_once(spark, monkeypatch):
    made = []
    real = Q.keyed_detail
    monkeypatch.setattr(Q, "keyed_detail", lambda *a: made.append(1) or real(*a))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    Q._published(spark, SF_SMALL)
    assert len(made) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_description_rows_are_dropped_without_a_shuffle_of_the_rows(spark):
    df = spark.createDataFrame([("f", 1, "门店对应的唯一ID"), ("f", 2, "a"), ("g", 1, "b")], "source_file string, source_pos int, x string")
    kept = ingest.skip_description_row(df.select("x", "source_file", "source_pos"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan_of(kept) and "SortMergeJoin" not in plan_of(kept)
        assert sorted(r["x"] for r in kept.collect()) == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_text_cell_is_read_once(spark):
    df = odd_texts(spark)
    got = df.select(scalars.format_value("v", "string").alias("t"))
    assert plan_of(got).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("regexp_replace(") == 1
    plain = df.select(scalars.whole_number_text(scalars.blank_to_null("v")).alias("t"))
    assert [r["t"] for r in got.collect()] == [r["t"] for r in plain.collect()]


def test_statistics_of_many_columns_are_those_of_each(spark):
    df = odd_texts(spark)
    num = F.regexp_replace("v", r"(?U)^\s+|\s+$", "").try_cast("double")
    numeric, whole = df.agg(F.count(num), F.count_if(num == F.rint(num))).first()
    wide = df.select(*[F.col("v").alias(f"c{i}") for i in range(30)], F.lit(None).cast("string").alias("none"))
    stats = ingest.column_stats(wide)
    assert list(stats) == wide.columns
    assert stats["none"] == ingest.ColumnStats(0, 0, 0, 0, None, 0, 0, 0)
    assert all(repr(stats[f"c{i}"]) == repr(stats["c0"]) for i in range(30))
    one = stats["c0"]
    assert (one.present, one.values, one.numeric, one.whole) == (len(ODD) - 1, len(ODD) - 3, numeric, whole)
    assert (one.coded, one.dated) == (1, 1)


def test_first_rows_are_found_without_sorting_the_rows(spark):
    df = spark.createDataFrame([("f", 0, 5, "门店对应的唯一ID"), ("f", 0, 7, "门店对应的唯一ID"), ("f", 64, 1, "b"), ("g", 64, 3, "c"), ("g", 0, 9, "d")],
                               "source_file string, block long, row long, x string")
    df = df.select("x", "source_file", F.struct("block", "row").alias("source_pos")).repartition(3)
    kept = ingest.skip_description_row(df)
    assert any("HashAggregate" in line and "partial_min(" in line for line in plan_of(kept).splitlines())
    assert sorted(r["x"] for r in kept.collect()) == ["b", "c", "d", "门店对应的唯一ID"]


def test_an_export_makes_rows_of_its_own_side_only(spark):
    det = spark.createDataFrame([(1, 2, 5, None, 7), (1, None, None, 3, 0), (None, 4, -1, 1, None), (1, 2, 5, None, 7)],
                                "store_key long, product_key long, bojun_qty long, jd_qty long, mt_qty long")
    for side in (tb.BOOK, tb.JD, tb.MT):
        own, all_sides = tb.side_rows(det, side), tb.side_rows(det)
        assert "Generate" not in plan_of(own)
        assert sorted(map(str, own.collect())) == sorted(map(str, all_sides.where(F.col("side") == side).collect()))


def test_distinct_codes_are_reduced_by_hash_before_a_largest_text(spark):
    pairs = spark.createDataFrame([("1", "b"), ("2", "b"), ("1", "b"), (None, "c"), ("3", None)], "product_code string, barcode string")
    rows = distinct_values(pairs, "product_code", "barcode")
    assert rows.count() == 4
    largest = mt.barcode_map(rows)
    assert plan_of(largest).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Aggregate [") == 2
    assert sorted((r[0], r[1]) for r in largest.collect()) == [("b", "2"), ("c", None)]


def test_header_records_after_a_byte_order_mark(spark, tmp_dir):
    for name, text in (("a", "﻿x,y\n1,2\n"), ("b", "﻿ \n\n  \nx,y\n3,4\n"), ("c", " ﻿,y\n5,6\n")):
        with open(f"{tmp_dir}/{name}.csv", "w", encoding="utf-8") as f:
            f.write(text)
    got = {r["file"][-5:]: r["record"] for r in first_records(spark, tmp_dir).collect()}
    assert got == {"a.csv": "x,y", "b.csv": "x,y", "c.csv": " ﻿,y"}
