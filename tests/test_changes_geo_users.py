"""M1-M5, F8, J9, X8/X9, A8-A10, J10/J11, A12, K5-K7, S8, S9."""

import datetime as dt
import json

from pyspark.sql import functions as F

from shelfcheck.contracts import POINT_TYPES
from shelfcheck.operators import changes as ch
from shelfcheck.operators import geo
from shelfcheck.operators import logins as lg
from shelfcheck.plans import tables as tbl

GEO = "address string, lng double, lat double, adcode string, formatted_address string, level string, status string, updated_at timestamp"
T1, T2, T3 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)


def test_upsert_geo_fail_keeps_coordinates_and_is_idempotent(spark):
    cache = spark.createDataFrame([("a", 1.0, 2.0, "11", "A", "门牌号", "ok", T1),
                                   ("b", None, None, None, None, None, "fail", T1)], GEO)
    res = spark.createDataFrame([("a", None, None, None, None, None, "fail", T2),
                                 ("b", 5.0, 6.0, "22", "B", "兴趣点", "ok", T2),
                                 ("c", None, None, None, None, None, "fail", T2)], GEO)
    out = ch.upsert_geo(cache, res)
    got = {r["address"]: r for r in out.collect()}
    assert (got["a"]["lng"], got["a"]["status"], got["a"]["updated_at"]) == (1.0, "fail", T2)
    assert (got["b"]["lng"], got["b"]["status"]) == (5.0, "ok")
    assert got["c"]["status"] == "fail" and got["c"]["lng"] is None
    again = ch.upsert_geo(out, res)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


CHG = "seq int, op string, id bigint, fields map<string,string>"


def test_apply_changes_sequence(spark):
    table = spark.createDataFrame([(1, "S1", "C1"), (2, "S2", "C2"), (3, "S3", None)],
                                  "id bigint, store_name string, customer_name string")
    changes = spark.createDataFrame([
        (1, "update", 1, {"customer_name": "X"}),
        (2, "update", 1, {"store_name": "S1b"}),          # two changes to one id both apply
        (3, "update", 2, {"customer_name": None}),         # update setting null
        (4, "delete", 3, {}),
        (5, "insert", 9, {"store_name": "N", "customer_name": "Cn"}),
        (6, "update", 77, {"store_name": "?"}),            # unknown id
    ], CHG)
    new, misses = ch.apply_changes(table, changes)
    got = {r["id"]: (r["store_name"], r["customer_name"]) for r in new.collect()}
    assert got == {1: ("S1b", "X"), 2: ("S2", None), 9: ("N", "Cn")}
    assert [r["id"] for r in misses.collect()] == [77]


def test_clean_changes(spark):
    changes = spark.createDataFrame([
        (1, "insert", None, {"store_name": "  ", "remark": "x"}),
        (2, "update", 1, {"store_name": " A ", "secret": "y"}),
        (3, "update", 1, {"store_name": ""}),
    ], CHG)
    clean, rejects = ch.clean_changes(changes, ["store_name", "remark"], "store_name")
    assert [r["seq"] for r in rejects.collect()] == [1, 3]
    row = clean.first()
    assert dict(row["fields"]) == {"store_name": "A"}


def test_ensure_ids_keeps_existing(spark):
    df = spark.createDataFrame([(5, "b"), (None, "z"), (None, "a"), (2, "c")], "id bigint, name string")
    got = {r["name"]: r["id"] for r in ch.ensure_ids(df, order_by=["name"]).collect()}
    assert got == {"b": 5, "c": 2, "a": 6, "z": 7}


def test_ensure_ids_numbers_many_partitions_in_order(spark):
    rows = [(None, f"n{i:04d}") for i in range(997)] + [(10, "x"), (40, "y")]
    df = spark.createDataFrame(rows, "id bigint, name string").repartition(7)
    got = ch.ensure_ids(df, order_by=["name"]).collect()
    ids = {r["name"]: r["id"] for r in got}
    assert len(got) == 999 and ids["x"] == 10 and ids["y"] == 40
    assert [ids[f"n{i:04d}"] for i in range(997)] == list(range(41, 41 + 997))


def test_set_active(spark):
    users = spark.createDataFrame([("u1", True, T1), ("u2", True, T1)], "open_id string, is_active boolean, updated_at timestamp")
    flags = spark.createDataFrame([(1, "u1", False), (2, "u9", False)], "seq int, open_id string, active boolean")
    out, misses = ch.set_active(users, flags, F.lit(T3))
    got = {r["open_id"]: (r["is_active"], r["updated_at"]) for r in out.collect()}
    assert got == {"u1": (False, T3), "u2": (True, T1)}
    assert [r[0] for r in misses.collect()] == ["u9"]


def test_queue_and_quality(spark):
    src = spark.createDataFrame([("a", "c1"), ("b", ""), ("c", "c3")], "address string, city string")
    cache = spark.createDataFrame([("a", 1.0, 2.0, None, None, "市", "ok", T1),
                                   ("b", None, None, None, None, None, "fail", T1)], GEO)
    assert [r[0] for r in geo.geocode_queue(src, cache).collect()] == ["c"]
    assert sorted(r[0] for r in geo.geocode_queue(src, cache, retry_fail=True).collect()) == ["b", "c"]
    assert geo.geocode_queue(src, cache, retry_fail=True, limit=1).collect()[0][0] == "b"
    hist, coarse = geo.geo_quality(cache)
    assert [tuple(r) for r in hist.collect()] == [("市", 1)] and coarse.first()[0] == 1


def test_classify_responses(spark):
    ok = {"status": "1", "geocodes": [{"location": "116.1,39.2", "adcode": "110101", "formatted_address": "F", "level": ""}]}
    rows = [("a", json.dumps(ok), T1),
            ("b", json.dumps({"status": "1", "geocodes": []}), T1),
            ("c", json.dumps({"status": "1", "geocodes": [{"location": "bad"}]}), T1),
            ("d", json.dumps({"status": "0", "info": "x", "infocode": "10003"}), T1)]
    df = spark.createDataFrame(rows, "address string, body string, received_at timestamp")
    got = {r["address"]: r for r in geo.classify_responses(df).collect()}
    assert (got["a"]["status"], got["a"]["lng"], got["a"]["level"]) == ("ok", 116.1, None)
    assert [got[k]["error"] for k in "bcd"] == ["no match", "bad location", "api"]
    assert got["d"]["fatal"] is True and got["b"]["fatal"] is False


def test_map_points_and_counts(spark):
    stores = spark.createDataFrame(
        [("S1", "C1", "P", "X", " addr1 ", None, "j1", "m1"), ("S2", "C1", "P", "X", "addr2", "闭店", None, None)],
        "store_name string, customer_name string, province string, city string, store_address string, "
        "remark string, jd_id string, meituan_id string")
    jdo = spark.createDataFrame([("j1", "J1", "C1", "X", "addr1", "启用")],
                                "store_code string, store_name string, dealer string, city string, store_address string, store_status string")
    mto = spark.createDataFrame([("m1", "M1", "C1", "X", "nowhere", "营业中")],
                                "store_id string, store_name string, dealer string, city string, store_address string, business_status string")
    cache = spark.createDataFrame([("addr1", 1.0, 2.0, "110101", None, None, "ok", T1)], GEO)
    jd_stock = spark.createDataFrame([("j1", "p1"), ("j1", "p1"), ("j1", "p2")], "store_code string, product_code string")
    mt_stock = spark.createDataFrame([("m1", "p1")], "store_id string, product_code string")
    pts = geo.map_points(stores, jdo, mto, cache, geo.point_sku_counts(jd_stock, mt_stock))
    rows = pts.withColumn("t", geo.point_type_index()).collect()
    by = {(r["point_type"], r["name"]): r for r in rows}
    own = by[(POINT_TYPES[0], "S1")]
    assert (own["lng"], own["jd_sku_cnt"], own["mt_sku_cnt"], own["t"]) == (1.0, 2, 1, 0)
    assert by[(POINT_TYPES[2], "M1")]["lng"] is None and by[(POINT_TYPES[2], "M1")]["t"] == 2
    loc = geo.located_count(pts).first()
    assert (loc["total"], loc["located"]) == (3, 2)


LOGIN = ("event_id bigint, ts timestamp, open_id string, union_id string, feishu_user_id string, name string, avatar_url string, "
         "email string, enterprise_email string, mobile string")


def test_profiles_and_merge(spark):
    a = spark.createDataFrame([
        (1, T1, "u1", "on1", "7", "Ann", "av1", "a@x", None, "111"),
        (2, T2, "u1", None, "", "Ann B", "av2", None, "a@corp", None),
    ], LOGIN)
    p = {r["open_id"]: r for r in lg.profile_from_logins(a).collect()}["u1"]
    assert (p["union_id"], p["name"], p["email"], p["mobile"], p["login_count"]) == (None, "Ann B", "a@corp", "111", 2)
    b = spark.createDataFrame([(3, T3, "u1", "on3", "8", "Ann C", "av3", None, None, None),
                               (4, T1, "u2", None, None, None, None, None, None, "222")], LOGIN)
    merged = {r["open_id"]: r for r in lg.merge_profiles(lg.profile_from_logins(a), lg.profile_from_logins(b)).collect()}
    allin = {r["open_id"]: r for r in lg.profile_from_logins(a.unionByName(b)).collect()}
    for k in ("u1", "u2"):
        for c in lg.PROFILE_COLS:
            assert merged[k][c] == allin[k][c], (k, c)
    assert (allin["u1"]["feishu_user_id"], p["feishu_user_id"], p["source"], p["is_admin"], p["is_active"]) == (
        "8", None, "feishu", False, True)
    top = lg.user_list(lg.profile_from_logins(a.unionByName(b)), limit=1).collect()
    assert [r["open_id"] for r in top] == ["u1"] and top[0]["last_login_at"] == "2024-03-01 00:00"
    assert lg.profile(lg.profile_from_logins(a), "nobody").count() == 0


def test_folding_order_does_not_change_kept_values(spark):
    """Email set on days 1 and 5, a login without one on day 10: day 5's stays, in any order."""
    import datetime as dt
    from itertools import permutations

    ev = [(i, dt.datetime(2024, 1, d), "u", None, None, "n", "a", e, None, m)
          for i, (d, e, m) in enumerate([(1, "e1", "m1"), (10, None, None), (5, "e3", None)])]
    want = lg.profile_from_logins(spark.createDataFrame(ev, LOGIN)).first()
    assert (want["email"], want["mobile"]) == ("e3", "m1")
    for order in permutations(ev):
        p = lg.profile_from_logins(spark.createDataFrame([order[0]], LOGIN))
        for e in order[1:]:
            p = lg.merge_profiles(p, lg.profile_from_logins(spark.createDataFrame([e], LOGIN)))
        assert p.first() == want


def test_geo_batch_with_ok_then_fail_keeps_the_new_coordinates(spark):
    cache = spark.createDataFrame([("a", 9.0, 9.0, "1", "f", "l", "ok", T1)], GEO)
    res = spark.createDataFrame([("b", 1.0, 2.0, "2", "g", None, "ok", T2), ("b", None, None, None, None, None, "fail", T3),
                                 ("a", None, None, None, None, None, "fail", T2)], GEO)
    got = {r["address"]: tuple(r)[1:] for r in ch.upsert_geo(cache, res).collect()}
    assert got == {"a": (9.0, 9.0, "1", "f", "l", "fail", T2), "b": (1.0, 2.0, "2", "g", None, "fail", T3)}


def test_misses_follow_the_sequence(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id bigint, name string")
    rows = [(1, "delete", 1), (2, "update", 1), (3, "update", 9), (4, "insert", 9), (5, "update", 9), (6, "delete", 9),
            (7, "update", 2), (8, "delete", 2), (9, "insert", 2), (10, "update", 2), (11, "delete", 77), (300_001, "update", 1)]
    changes = spark.createDataFrame([(s, o, i, {"name": f"n{s}"}) for s, o, i in rows],
                                    "seq bigint, op string, id bigint, fields map<string,string>")
    new, misses = ch.apply_changes(table, changes)
    assert {tuple(r) for r in new.collect()} == {(2, "n10"), (3, "z")}
    assert sorted(r["seq"] for r in misses.collect()) == [2, 3, 11, 300_001]


def test_every_change_is_clean_or_rejected(spark):
    rows = [(1, None, {"name": "a"}), (2, "upsert", {"name": "a"}), (3, "insert", {"x": "a"}), (4, "insert", {"name": " "}),
            (5, "update", {"name": ""}), (6, "update", None), (7, "insert", None), (8, "delete", None), (9, "insert", {"name": " a "})]
    changes = spark.createDataFrame([(s, o, s, f) for s, o, f in rows], "seq bigint, op string, id bigint, fields map<string,string>")
    clean, rejects = ch.clean_changes(changes, ["name"], "name")
    assert sorted(r["seq"] for r in clean.collect()) == [6, 8, 9]
    assert {r["seq"]: r["reason"] for r in rejects.collect()} == {
        1: "unknown op", 2: "unknown op", 3: "name empty", 4: "name empty", 5: "name empty", 7: "name empty"}


def test_shared_folder_is_required_beyond_one_machine():
    import pytest

    from shelfcheck.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        class Session:
            sparkContext = Context(master)
        with pytest.raises(RuntimeError):
            checkpoint_root(Session())


def test_export_and_load_log(spark, tmp_dir):
    df = spark.createDataFrame([(2, "B", None), (1, None, None), (3, None, "x")], "id bigint, store_name string, dealer string")
    df = df.withColumn("store_code", F.lit(None).cast("string"))
    out = tbl.export_table(df.select("id", "store_name", "store_code", "dealer"), "jd_outlet")
    assert out.columns[:2] == ["门店编号", "门店名称"] and out.count() == 2
    row = tbl.load_log_row(spark, "label", "f.csv", 10, "error", "x" * 600, "")
    tbl.append_load_log(row, tmp_dir)
    tbl.append_load_log(tbl.load_log_row(spark, "label2", None, None, "success", "", "ops"), tmp_dir)
    log = spark.read.parquet(f"{tmp_dir}/upload_log")
    hist = tbl.load_history(log).collect()
    assert len(hist) == 2 and max(len(r["message"] or "") for r in hist) == 500
    assert {r["operator"] for r in hist} == {None, "ops"}
    runs = spark.createDataFrame([(1, True, ["start", "meituan_store_inventory: 12 rows, 8 cols loaded"]),
                                  (2, False, ["Warning x", "boom", "  ", "Warning y"])],
                                 "run_id int, ok boolean, lines array<string>")
    msgs = {r["run_id"]: r["message"] for r in tbl.load_log_message(runs).collect()}
    assert msgs == {1: "loaded 12 rows", 2: "failed: boom"}
