"""X1-X10, A4/A5 rates: scalar expressions on literal frames."""

from pyspark.sql import functions as F

from shelfcheck.contracts import UNKNOWN_USER
from shelfcheck.functions import rates, scalars


def test_to_int_truncates_and_nulls_junk(spark):
    df = spark.createDataFrame([("3.9",), ("-3.9",), ("",), ("NaN",), ("x",), (None,), ("12",)], "v string")
    got = [r[0] for r in df.select(scalars.to_int("v")).collect()]
    assert got == [3, -3, None, None, None, None, 12]


def test_strip_all_removes_unicode_space(spark):
    df = spark.createDataFrame([("　 店A\t　",), ("  b ",)], "v string")
    got = [r[0] for r in df.select(scalars.strip_all("v")).collect()]
    assert got == ["店A", "b"]
    kept = [r[0] for r in df.select(scalars.trim_spaces("v")).collect()]
    assert kept[0].startswith("　")  # btrim keeps U+3000


def test_coerce_cell_by_declared_type(spark):
    df = spark.createDataFrame([("13684045.0", "3.9", "2.5"), ("  ", "x", None), (" a ", "-7", "1e3")],
                               "t string, i string, f string")
    got = df.select(scalars.coerce_cell("t", "text").alias("t"), scalars.coerce_cell("i", "int").alias("i"),
                    scalars.coerce_cell("f", "float").alias("f")).collect()
    assert [tuple(r) for r in got] == [("13684045", 3, 2.5), (None, None, None), ("a", -7, 1000.0)]


def test_parse_location(spark):
    df = spark.createDataFrame([("116.4,39.9",), ("116.4",), ("a,b",), (None,)], "v string")
    got = [tuple(r[0]) for r in df.select(scalars.parse_location("v")).collect()]
    assert got[0] == (116.4, 39.9, True)
    assert got[1] == (None, None, False)
    assert got[2] == (None, None, False)
    assert got[3] == (None, None, False)


def test_display_name_and_minute_text(spark):
    df = spark.createDataFrame([("Ann", "ou_123456789"), ("", "ou_123456789"), (None, ""), (None, None)],
                               "name string, id string")
    got = [r[0] for r in df.select(scalars.display_name("name", "id")).collect()]
    assert got == ["Ann", "ou_12345", UNKNOWN_USER, UNKNOWN_USER]
    ts = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS t").select(scalars.minute_text("t")).first()[0]
    assert ts == "2024-05-06 07:08"


def test_adcode_prefix(spark):
    df = spark.createDataFrame([("440305",)], "a string")
    r = df.select(scalars.adcode_prefix("a", "province"), scalars.adcode_prefix("a", "city")).first()
    assert tuple(r) == ("44", "4403")


def test_row_rate_edges(spark):
    # A5: book 0 with platform 0 -> 100; book -3 with platform -5 -> null; book null -> null;
    # rounding half away from zero; negative platform below positive book.
    df = spark.createDataFrame([(0, 0), (-5, -3), (5, None), (None, 5), (1, 8), (3, 7), (-1, 8), (9, 4)],
                               "p bigint, b bigint")
    got = [r[0] for r in df.select(rates.row_rate("p", "b")).collect()]
    assert got == [100.0, None, None, None, 12.5, 42.9, -12.5, 100.0]


def test_group_rate_without_comparable_rows_is_100(spark):
    df = spark.createDataFrame([(None, None), (1, 3)], "n bigint, d bigint")
    got = [r[0] for r in df.select(rates.group_rate("n", "d")).collect()]
    assert got == [100.0, 33.3]


def test_pct_tenths_half_up(spark):
    # 12.25 -> 12.3 and 12.35 -> 12.4 (not banker's / binary-float rounding)
    df = spark.createDataFrame([(49, 400), (247, 2000), (-49, 400)], "n bigint, d bigint")
    got = [r[0] for r in df.select(rates.pct_tenths("n", "d")).collect()]
    assert got == [12.3, 12.4, -12.3]


def test_platform_diff(spark):
    df = spark.createDataFrame([(5, None), (None, 3), (2, 3)], "p bigint, b bigint")
    got = [r[0] for r in df.select(rates.platform_diff(F.col("p"), F.col("b"))).collect()]
    assert got == [5, None, -1]
