"""Headers, contract checks, type inference, publishing, edited-table import, pages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfcheck.contracts import HEADER_MAPS
from shelfcheck.sources import ingest, pages


def write_text(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_normalize_headers_unique():
    got = ingest.normalize_headers([" a ", "Unnamed: 1", "", "nan", "a", "a_2", "a"])
    assert got == ["a", "_blank", "_blank_2", "_blank_3", "a_2", "a_2_2", "a_3"]
    assert len(set(got)) == len(got)
    assert ingest.normalize_headers(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]


def test_prefix_context_headers():
    cols = ["营业状态", "京东ID", "营业状态", "美团ID", "营业状态_2", "饿了么ID", "营业状态"]
    assert ingest.prefix_context_headers(cols) == [
        "营业状态", "京东ID", "京东营业状态", "美团ID", "美团营业状态", "饿了么ID", "饿了么营业状态"]


def test_prefer_source_first_existing(spark, tmp_dir):
    b = os.path.join(tmp_dir, "b.csv")
    c = os.path.join(tmp_dir, "c.csv")
    write_text(b, "x\n1\n")
    write_text(c, "x\n2\n3\n")
    path, df = ingest.prefer_source(spark, [os.path.join(tmp_dir, "a.csv"), b, c])
    assert path == b and df.count() == 1
    with pytest.raises(FileNotFoundError):
        ingest.prefer_source(spark, [os.path.join(tmp_dir, "none.csv")])


def test_skip_description_row(spark, tmp_dir):
    p = os.path.join(tmp_dir, "mt.csv")
    write_text(p, "门店ID,库存\n门店对应的唯一ID,库存数量\n101,5\n102,7\n")
    df = ingest.with_source_order(ingest.read_export(spark, p))
    got = ingest.skip_description_row(df).select("门店ID").collect()
    assert [r[0] for r in got] == ["101", "102"]
    q = os.path.join(tmp_dir, "mt2.csv")
    write_text(q, "门店ID,库存\n101,5\n102,7\n")
    df2 = ingest.with_source_order(ingest.read_export(spark, q))
    assert ingest.skip_description_row(df2).count() == 2


def test_drop_empty_blank_columns(spark):
    df = spark.createDataFrame([("1", None, "x"), ("2", None, None)], "a string, _blank string, _blank_2 string")
    assert ingest.drop_empty_blank_columns(df).columns == ["a", "_blank_2"]


def test_validate_all_missing_empty_unknown(spark):
    cols = list(HEADER_MAPS["meituan_store_inventory"])
    good = spark.createDataFrame([tuple("v" for _ in cols)], ", ".join(f"`{c}` string" for c in cols))
    extra = good.withColumn("new col", F.lit("z"))
    report = ingest.validate_all(spark, {"meituan_store_inventory": extra})
    assert [r["check"] for r in report.collect()] == ["unknown_column"]
    with pytest.raises(ingest.ContractError, match="missing_column"):
        ingest.validate_all(spark, {"meituan_store_inventory": good.drop(cols[0])})
    with pytest.raises(ingest.ContractError, match="no_rows"):
        ingest.validate_all(spark, {"meituan_store_inventory": good.limit(0)})


def test_infer_types_rules(spark):
    df = spark.createDataFrame(
        [("12345.0", "1.0", "1.5", None, "2024-01-02 03:04:05", "x", "1e19", "007"),
         ("2", "2", "2", None, "2024-01-03 00:00:00", "12", "1", "008")],
        "store_id string, whole string, frac string, empty string, ts string, mixed string, "
        "huge string, barcode string")
    t = ingest.infer_types(df)
    assert t == {"store_id": "string", "whole": "bigint", "frac": "double", "empty": "double",
                 "ts": "timestamp", "mixed": "string", "huge": "double", "barcode": "string"}
    out = ingest.format_values(df, t).first()
    assert out["store_id"] == "12345" and out["whole"] == 1 and out["barcode"] == "007"


def test_promote_if_all_integer(spark):
    df = spark.createDataFrame([("12",), (None,)], "stock_qty string")
    out, done = ingest.promote_if_all_integer(df, "stock_qty")
    assert done and dict(out.dtypes)["stock_qty"] == "bigint"
    df2 = spark.createDataFrame([("12",), ("x",)], "stock_qty string")
    out2, done2 = ingest.promote_if_all_integer(df2, "stock_qty")
    assert not done2 and dict(out2.dtypes)["stock_qty"] == "string"


def test_select_datasets():
    assert ingest.select_datasets(["meituan_outlet", "feishu"]).count("feishu_meituan_outlet") == 1
    with pytest.raises(ValueError):
        ingest.select_datasets(["nope"])
    assert len(ingest.select_datasets(None)) == 9


def test_load_publishes_all_or_nothing(spark, tmp_dir):
    cols = list(HEADER_MAPS["meituan_store_inventory"])
    vals = {"门店ID": "101", "库存": "12"}
    good = spark.createDataFrame([tuple(vals.get(c, "v") for c in cols)], ", ".join(f"`{c}` string" for c in cols))
    pub = ingest.load(spark, tmp_dir, {"meituan_store_inventory": good}, "1", ["meituan_inventory"])
    first = ingest.current_path(spark, tmp_dir, "meituan_store_inventory")
    assert first == pub.tables["meituan_store_inventory"]
    t = spark.read.parquet(first)
    assert dict(t.dtypes)["stock_qty"] == "bigint" and dict(t.dtypes)["store_id"] == "string"
    with pytest.raises(ingest.ContractError):
        ingest.load(spark, tmp_dir, {"meituan_store_inventory": good.drop("库存")}, "2", ["meituan_inventory"])
    assert ingest.current_path(spark, tmp_dir, "meituan_store_inventory") == first
    assert ingest.current_path(spark, tmp_dir, "data_meta") is not None


def test_import_table(spark):
    df = spark.createDataFrame(
        [("店A", "客户1", "13684045.0", "x"), (None, None, None, "y"), ("  ", None, None, None)],
        "`门店名称` string, `客户名称` string, `京东ID` string, `未知列` string")
    rows, counts = ingest.import_table(df, "mapping")
    c = counts.first()
    assert (c["inserted"], c["skipped_empty"]) == (1, 2)
    r = rows.first()
    assert r["store_name"] == "店A" and r["jd_id"] == "13684045" and r["seq_no"] is None
    with pytest.raises(ingest.ContractError):
        ingest.import_table(df.drop("门店名称"), "mapping")


def page(code, current, total_page, records):
    return json.dumps({"code": code, "msg": "m", "data": {"current": current, "pageSize": 2, "total": 3,
                                                          "totalPage": total_page, "records": records}})


def test_pages_casings_codes_and_completeness(spark, tmp_dir):
    d = os.path.join(tmp_dir, "pull1")
    write_text(os.path.join(d, "p1.json"), page(200, 1, 3, [
        {"cstoreCode": "S1", "cstoreName": "店1", "mproductName": "P1", "qty": "3.9"},
        {"cStoreCode": "S2", "cStoreName": "店2", "mProductName": "P2", "qty": 5, "qtycan": ""},
        {"cstoreCode": "", "cStoreCode": "S3", "cstoreName": "店3", "mproductName": "P1", "qty": "x"}]))
    write_text(os.path.join(d, "p3.json"), page(500, 3, 3, []))
    pg = pages.read_pages(spark, d)
    rows = {r["store_code"]: r for r in pages.inventory_rows(pg).collect()}
    assert set(rows) == {"S1", "S2", "S3"}
    assert rows["S1"]["stock_qty"] == 3 and rows["S2"]["stock_qty"] == 5 and rows["S3"]["stock_qty"] is None
    assert rows["S2"]["allocatable"] is None and rows["S3"]["store_warehouse"] == "店3"
    assert [r["code"] for r in pages.rejected_pages(pg).collect()] == [500]
    assert [r["page_no"] for r in pages.page_completeness(pg).collect()] == [2, 3]
    st = pages.inventory_pull_stats(pages.inventory_rows(pg)).first()
    assert (st["rows"], st["stores"], st["products"]) == (3, 3, 2)
    assert pages.filter_pull(pages.inventory_rows(pg), product="P1").count() == 2
