"""Reports from published tables: every sheet, no rebuild of an unchanged load, missing tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfcheck.plans import published as pb
from shelfcheck.plans import queries as Q
from shelfcheck.plans import reports as R
from shelfcheck.sources import ingest
from tests.conftest import SF_SMALL


def test_reports_from_published_tables(spark, tmp_dir):
    root, out = Q._published(spark, SF_SMALL), f"{tmp_dir}/reports"
    made = pb.build_reports(spark, root, out, 90)
    sheets = {k: {n: spark.read.parquet(p) for n, p in s.items()} for k, s in made.items()}
    detail, cust = sheets["recon"]["detail"], sheets["recon"]["customer_summary"]
    for col, qty in (("bojun_sum", "bojun_qty"), ("jd_sum", "jd_qty"), ("mt_sum", "mt_qty")):
        assert cust.agg(F.sum(col)).first()[0] == detail.agg(F.sum(qty)).first()[0]
    assert detail.where("product_name is null").count() == 0
    book = spark.read.parquet(ingest.current_path(spark, root, pb.BOOK))
    unmatched = sheets["recon"]["unmatched_products"]
    assert unmatched.count() > 0 and unmatched.join(book, unmatched["platform_code"] == book["product_code"]).count() == 0
    jd = spark.read.parquet(ingest.current_path(spark, root, pb.JD))
    lost = unmatched.where("platform = '京东'").agg(F.sum("total_qty")).first()[0]
    assert jd.agg(F.sum("available_stock")).first()[0] == cust.agg(F.sum("jd_sum")).first()[0] + lost
    guard = sheets["guard"]["outlet_summary"]
    assert guard.where("product_cnt <> ok_cnt + bad_cnt").count() == 0 and guard.count() > 0

    marks = {d: os.stat(f"{d}/_SUCCESS").st_mtime_ns for s in made.values() for d in s.values()}
    assert pb.build_reports(spark, root, out, 90) == made  # an unchanged load is not rebuilt
    assert marks == {d: os.stat(f"{d}/_SUCCESS").st_mtime_ns for d in marks}
    jd.where("available_stock > 3").write.parquet(f"{tmp_dir}/less")
    ingest.publish(spark, root, {pb.JD: spark.read.parquet(f"{tmp_dir}/less")}, "9")
    newer = pb.build_reports(spark, root, out, 90, ("recon",))
    assert newer["recon"]["detail"] != made["recon"]["detail"]
    assert spark.read.parquet(newer["recon"]["customer_summary"]).agg(F.sum("jd_sum")).first()[0] < cust.agg(F.sum("jd_sum")).first()[0]
    with pytest.raises(FileNotFoundError, match="not published"):
        pb.build_reports(spark, f"{tmp_dir}/nothing", out, 90)


def test_stores_of_several_mapping_rows(spark):
    rows = [("S", "C", "闭店", "1", "9"), ("S", "C", None, "2", None), ("T", "C", "闭店", "7", "8"), (None, "C", None, "5", "5")]
    got = {r["store_name"]: (r["jd_id"], r["meituan_id"], r["remark"]) for r in pb.store_dimension(spark.createDataFrame(
        rows, "store_name string, customer_name string, remark string, jd_id string, meituan_id string")).collect()}
    assert got == {"S": ("2", "9", None), "T": ("7", "8", "闭店")}


def test_payload_is_one_document(spark, tmp_dir):
    paths = R.write_payload(Q.recon_inputs(spark, SF_SMALL), ingest.stamp_snapshot(spark), tmp_dir)
    with open(f"{tmp_dir}/payload/index.json") as f:
        assert json.load(f) == paths and set(paths) == {"meta", "detail", "unStores", "unProducts", "outletGuard"}
