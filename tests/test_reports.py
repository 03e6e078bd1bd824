"""K1-K4 sinks on the smallest test tables: folders, column order, totals agree."""

import os

from pyspark.sql import functions as F

from shelfcheck.contracts import FLAGS, POINT_TYPES
from shelfcheck.plans import queries as Q
from shelfcheck.plans import reports as R
from shelfcheck.sources import ingest
from tests.conftest import SF_SMALL


def test_recon_and_guard_reports(spark, tmp_dir):
    timings = {}
    paths = R.write_reports(("recon", "guard"), Q.recon_inputs(spark, SF_SMALL), tmp_dir, timings=timings)
    assert set(paths["recon"]) == {"customer_summary", "store_summary", "detail", "unmatched_stores",
                                   "unmatched_products"}
    assert set(paths["guard"]) == {"outlet_summary", "listed_detail"}
    assert set(timings) == {"recon", "guard", "total"}
    cust = spark.read.parquet(paths["recon"]["customer_summary"])
    assert cust.columns == ["customer_name", "store_cnt", "bojun_sum", "jd_sum", "jd_diff", "jd_rate",
                            "mt_sum", "mt_diff", "mt_rate"]
    store = spark.read.parquet(paths["recon"]["store_summary"])
    detail = spark.read.parquet(paths["recon"]["detail"])
    for col in ("bojun_sum", "jd_sum", "mt_sum"):
        assert cust.agg(F.sum(col)).first()[0] == store.agg(F.sum(col)).first()[0]
    assert cust.agg(F.sum("bojun_sum")).first()[0] == detail.agg(F.sum("bojun_qty")).first()[0]
    assert detail.where(~F.col("flag").isin(*FLAGS)).count() == 0
    csv = R.write_report("recon", Q.recon_inputs(spark, SF_SMALL), os.path.join(tmp_dir, "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(csv["customer_summary"]).count() == cust.count()


def test_payload_and_map(spark, tmp_dir):
    snap = ingest.stamp_snapshot(spark)
    paths = R.write_payload(Q.recon_inputs(spark, SF_SMALL), snap, tmp_dir)
    meta = spark.read.json(paths["meta"]).first()
    assert meta["flags"] == FLAGS and meta["inactive"] == 0 and len(meta["generated_at"]) == 16
    det = spark.read.json(paths["detail"])
    assert "flag_idx" in det.columns and det.agg(F.max("flag_idx")).first()[0] <= 5
    mp = R.write_map_payload(Q._map_points(spark, SF_SMALL), snap, tmp_dir)
    m = spark.read.json(mp["meta"]).first()
    pts = spark.read.json(mp["points"])
    assert m["types"] == POINT_TYPES and m["total"] == pts.count()
    assert m["located"] == pts.where(F.col("lng").isNotNull()).count()
