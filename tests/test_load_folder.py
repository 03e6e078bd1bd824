"""Exports of every dataset as CSV files in one folder, loaded by their own rules (I1-I13), and
landed API pages loaded into the book table (I14-I17)."""

import csv
import json
import os

import pytest

from shelfcheck.contracts import ADDRESS_HEADERS, ADDRESS_STEM, HEADER_MAPS, SOURCE_STEMS, STATUS_HEADER_ANCHORS
from shelfcheck.sources import ingest, pages


def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def export(table):
    """Header and two data rows, with the layout quirks of the real exports."""
    head = list(HEADER_MAPS[table])
    if table == "feishu_store_mapping":  # repeated status headers after their anchors, no address column
        head = [h for h in head if HEADER_MAPS[table][h] != "store_address"]
        status = [f"{p}营业状态" for p in STATUS_HEADER_ANCHORS.values()]
        head = [h for h in head if h not in status]
        for anchor in STATUS_HEADER_ANCHORS:
            head.insert(head.index(anchor) + 1, "营业状态")
    if table == "feishu_jd_outlet":  # a nameless status column
        head = ["" if h == "_blank" else h for h in head]
    rows = [[f"v{i}" for _ in head] for i in (1, 2)]
    if table == "meituan_store_inventory":
        stock = head.index(next(h for h, c in HEADER_MAPS[table].items() if c == "stock_qty"))
        rows[0][stock], rows[1][stock] = "12", ""
        rows.insert(0, ["门店对应的唯一ID"] + ["说明"] * (len(head) - 1))
    if table != "feishu_jd_outlet":  # an empty nameless column, as spreadsheets leave them
        head, rows = head + [""], [r + [""] for r in rows]
    return [head, *rows]


@pytest.fixture()
def folder(tmp_dir):
    for table, stems in SOURCE_STEMS.items():
        write_csv(f"{tmp_dir}/in/{stems[0]}.csv", export(table))
        if len(stems) > 1:
            write_csv(f"{tmp_dir}/in/{stems[1]}.csv", [["old"], ["x"]])
    write_csv(f"{tmp_dir}/in/{ADDRESS_STEM}.csv", [["x", *ADDRESS_HEADERS], ["1", " v1 ", " "], ["2", "v1", "Road 1"], ["3", "v1", "Road 9"]])
    return f"{tmp_dir}/in"


def test_every_dataset_loads_and_publishes(spark, folder, tmp_dir):
    pub = ingest.load_folder(spark, f"{tmp_dir}/out", folder, "1")
    assert pub.rows == {**dict.fromkeys(SOURCE_STEMS, 2), "data_meta": 1}
    for table, canonical in HEADER_MAPS.items():
        got = spark.read.parquet(ingest.current_path(spark, f"{tmp_dir}/out", table))
        assert set(got.columns) == set(canonical.values()), table
    stock = spark.read.parquet(pub.tables["meituan_store_inventory"])
    assert dict(stock.dtypes)["stock_qty"] == "bigint"
    assert sorted((r["stock_qty"] or 0) for r in stock.collect()) == [0, 12]
    stores = {r["store_name"]: r for r in spark.read.parquet(pub.tables["feishu_store_mapping"]).collect()}
    assert stores["v1"]["store_address"] == "Road 1" and stores["v2"]["store_address"] is None


def test_one_broken_export_publishes_nothing(spark, folder, tmp_dir):
    write_csv(f"{folder}/{SOURCE_STEMS['jd_store'][0]}.csv", [["unexpected"], ["1"]])
    with pytest.raises(ingest.ContractError, match="jd_store: missing_column"):
        ingest.load_folder(spark, f"{tmp_dir}/out", folder, "1")
    assert ingest.current_path(spark, f"{tmp_dir}/out", "jd_store_inventory") is None


def test_values_keep_their_digits_and_dates_need_a_date(spark):
    df = spark.createDataFrame(
        [("9007199254740993", "09:00", "0123", "3000000000", "3.9"), ("1", "18:30", "7", "5", "-3.9")],
        "big string, business_hours string, shelf string, many string, part string")
    types = ingest.infer_types(df)
    assert types == {"big": "bigint", "business_hours": "string", "shelf": "string", "many": "bigint", "part": "double"}
    first = ingest.format_values(df, types).first()
    assert (first["big"], first["business_hours"], first["shelf"]) == (9007199254740993, "09:00", "0123")
    from shelfcheck.functions.scalars import coerce_cell, to_int

    row = df.select(coerce_cell("many", "int").alias("m"), to_int("big").alias("b"), to_int("part").alias("p")).first()
    assert tuple(row) == (None, 9007199254740993, 3)


def page(no, total, records, code=None):
    from shelfcheck.contracts import PAGE_OK_CODE

    return {"code": PAGE_OK_CODE if code is None else code, "msg": "", "data": {
        "current": no, "pageSize": 2, "total": 3, "totalPage": total, "records": records}}


def test_pull_to_book_table(spark, tmp_dir):
    from shelfcheck.contracts import PAGE_QTY_FIELDS, PAGE_TEXT_FIELDS

    def record(i):
        r = {names[-1]: f"{c}{i}" for c, names in PAGE_TEXT_FIELDS.items()}
        return r | {f: f"{i}.0" for f in PAGE_QTY_FIELDS.values()}

    def land(pull, docs):
        os.makedirs(f"{tmp_dir}/{pull}", exist_ok=True)
        for k, d in enumerate(docs):
            with open(f"{tmp_dir}/{pull}/{k}.json", "w") as f:
                json.dump(d, f)
        return f"{tmp_dir}/{pull}/*.json"

    good = land("good", [page(1, 2, [record(1), record(2)]), page(2, 2, [record(3)])])
    pub = pages.load_pull(spark, f"{tmp_dir}/out", good, "1")
    rows = spark.read.parquet(pub.tables["bojun_offline_inventory"]).collect()
    assert sorted(r["stock_qty"] for r in rows) == [1, 2, 3] and pub.rows["data_meta"] == 1
    one = pages.load_pull(spark, f"{tmp_dir}/out", good, "2", store="store_warehouse2")
    assert one.rows["bojun_offline_inventory"] == 1
    for name, docs in {"gap": [page(1, 2, [record(1)])], "rejected": [page(1, 1, [record(1)], code=500)]}.items():
        with pytest.raises(ingest.ContractError, match="incomplete"):
            pages.load_pull(spark, f"{tmp_dir}/out", land(name, docs), "3")


def test_import_of_no_rows_is_rejected(spark, tmp_dir):
    from shelfcheck.contracts import EDITED_TABLES

    cfg = EDITED_TABLES["jd_outlet"]
    heads = [zh for _, zh, _ in cfg["columns"]]
    schema = ", ".join(f"`{h}` string" for h in heads)
    blank = spark.createDataFrame([tuple(None for _ in heads)], schema)
    with pytest.raises(ingest.ContractError, match="no rows"):
        ingest.replace_table(spark, f"{tmp_dir}/out", blank, "jd_outlet", "1")
    pub = ingest.replace_table(spark, f"{tmp_dir}/out", spark.createDataFrame([tuple("1" for _ in heads)], schema), "jd_outlet", "1")
    assert sorted(pub.rows.values()) == [1, 1] and "data_meta" in pub.rows
