"""Merge-on-read tables (M1, M2, M5): what a change writes, versions, replays, compaction."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from shelfcheck.operators import changes as ch
from shelfcheck.operators import logins as lg
from shelfcheck.streaming.logins import fold_batch, latest_profiles, profile_table, run_profile_stream

COLUMNS = "id bigint, name string, remark string"
CHANGES = "seq bigint, op string, id bigint, fields map<string, string>"


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def table_of(df):
    return {r["id"]: (r["name"], r["remark"]) for r in df.collect()}


def edits(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def test_one_change_writes_one_bucket(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    table = ch.edit_table(spark, root, COLUMNS, buckets=16)
    table.replace(spark.range(500).selectExpr("id", "concat('n', id) AS name", "cast(null AS string) AS remark"))
    before = tree(f"{root}/data")
    assert len(before) == 16
    table.append(edits(spark, [(1, "update", 7, {"remark": "moved"})]))
    appended = tree(f"{root}/data") - before
    assert len(appended) == 1  # the change itself
    assert table_of(table.read())[7] == ("n7", "moved") and table.read().count() == 500
    plan = table.read()._jdf.queryExecution().optimizedPlan().toString()
    clean = plan.split("\n")[1]  # what has no changes is passed on as it is
    assert plan.startswith("Union") and clean.startswith(":- Relation")
    table.compact()
    compacted = tree(f"{root}/data") - before - appended
    assert len(compacted) == 1
    (bucket,) = {f.split("_bucket=")[1].split("/")[0] for f in appended | compacted}
    assert not [p for p in table.pointers() if p.part]
    table.vacuum(keep=1)
    left = tree(f"{root}/data")
    assert len(left) == 16 and compacted < left and not [f for f in left & before if f"_bucket={bucket}/" in f]
    assert table_of(table.lookup(7)) == {7: ("n7", "moved")} and table.lookup(9999).count() == 0
    assert len(table.lookup(7).inputFiles()) == 1


def test_batches_equal_one_pass_over_all_changes(spark, tmp_dir):
    rnd = random.Random(5)
    rows = [(i, f"n{i}", None) for i in range(40)] + [(None, "keyless", None)]
    log = []
    for seq in range(300):
        op = rnd.choice(["insert", "update", "update", "delete"])
        fields = {k: rnd.choice([None, f"v{seq}"]) for k in rnd.sample(["name", "remark"], rnd.randint(0, 2))}
        log.append((seq, op, rnd.randrange(60), fields if op != "delete" else None))
    base = spark.createDataFrame(rows, COLUMNS)
    want = table_of(ch.changed_table(base, edits(spark, log)))
    table = ch.edit_table(spark, f"{tmp_dir}/t", COLUMNS, buckets=5)
    table.replace(base)
    for at in range(0, 300, 60):
        batch = edits(spark, log[at:at + 60])
        table.append(batch, compact_after=1)
    assert table_of(table.read()) == want
    # The sequence restarts with each batch: a later batch still comes after.
    table.append(edits(spark, [(0, "update", 3, {"name": "late"}), (1, "insert", 77, {"name": "new"})]))
    table.append(edits(spark, [(0, "delete", 77, None), (0, "insert", 3, {"name": "again"})]))
    got = table_of(table.read())
    assert got[3] == ("again", None) and 77 not in got


def test_versions_and_replays(spark, tmp_dir):
    table = ch.edit_table(spark, f"{tmp_dir}/t", COLUMNS, buckets=3)
    assert table.read().count() == 0 and table.version() is None
    table.append(edits(spark, [(1, "insert", 1, {"name": "a"})]), version=4)
    table.append(edits(spark, [(1, "insert", 2, {"name": "b"})]), version=4)  # there already
    assert table_of(table.read()) == {1: ("a", None)} and table.version() == 4
    table.append(edits(spark, []), version=5)
    open(f"{tmp_dir}/t/_versions/6.0.draft", "w").close()  # a run that died before its version was whole
    assert ch.edit_table(spark, f"{tmp_dir}/t", COLUMNS).version() == 5
    assert table_of(table.read()) == {1: ("a", None)}
    assert table_of(table.read(before=5)) == {1: ("a", None)} and table.read(before=4).count() == 0


def test_geocode_batches_in_turn(spark, tmp_dir):
    at = dt.datetime(2024, 1, 1)

    def row(address, status, lng, day):
        return (address, lng, lng, "11", address, "x", status, at + dt.timedelta(days=day))

    batches = [[row("a", "ok", 1.0, 1), row("b", "fail", None, 1), row(None, "ok", 5.0, 1)],
               [row("a", "fail", None, 2), row("b", "ok", 2.0, 2), row("b", "ok", 3.0, 1)],
               [row("a", "fail", None, 0), row("c", "ok", 4.0, 0), row("b", "fail", None, 0)]]
    frames = [spark.createDataFrame(b, ch.GEO_COLUMNS) for b in batches]
    want = frames[0].limit(0)
    table = ch.geo_table(spark, f"{tmp_dir}/g", buckets=4)
    for f in frames:
        want = ch.upsert_geo(want, f)
        table.append(f)
    pick = lambda df: sorted(map(tuple, df.select("address", "lng", "status", "updated_at").collect()), key=repr)
    merged = pick(table.read())
    assert merged == [r for r in pick(want)]
    assert {r[0]: (r[1], r[2]) for r in merged}["b"] == (2.0, "fail")
    table.compact()
    assert pick(table.read()) == merged


LOGIN = ("event_id bigint, ts timestamp, open_id string, union_id string, feishu_user_id string, name string, "
         "avatar_url string, email string, enterprise_email string, mobile string")


def login(event, ts, user, name="n"):
    return (event, ts, user, None, None, name, None, None, None, None)


def test_stream_with_null_ids_null_times_and_changed_redeliveries(spark, tmp_dir):
    """The four deliveries of the stream give what the batch form gives."""
    t = dt.datetime(2024, 3, 1)
    deliveries = [
        [login(None, t, "u1"), login(None, t, "u1")],
        [login(None, t, "u2"), login(7, None, "u3"), login(8, t, "u4", "first")],
        [login(7, None, "u3"), login(8, t + dt.timedelta(days=9), "u4", "changed")],
        [login(9, t, "u4", "older")],
    ]
    land, root = f"{tmp_dir}/land", f"{tmp_dir}/table"
    schema = spark.createDataFrame([], LOGIN).schema
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, LOGIN).coalesce(1).write.parquet(f"{land}/d{k}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{land}/*")
        run_profile_stream(stream, root, f"{tmp_dir}/ckpt", buckets=4, compact_after=1).awaitTermination()
    got = {r["open_id"]: (r["login_count"], r["name"], r["last_login_at"]) for r in latest_profiles(spark, root).collect()}
    assert got == {"u1": (2, "n", t), "u2": (1, "n", t), "u3": (1, "n", None), "u4": (2, "older", t)} or \
        got == {"u1": (2, "n", t), "u2": (1, "n", t), "u3": (1, "n", None), "u4": (2, "first", t)}
    events = spark.createDataFrame([r for d in (deliveries[:2] + deliveries[3:]) for r in d], LOGIN)
    batch = {r["open_id"]: r["login_count"] for r in lg.profile_from_logins(lg.accepted(events)).collect()}
    assert batch == {u: n for u, (n, _, _) in got.items()}


def test_files_stay_bounded_over_100_batches(spark, tmp_dir):
    root, t = f"{tmp_dir}/p", dt.datetime(2024, 1, 1)
    fold = fold_batch(root, buckets=2, compact_after=9)
    most = []
    for k in range(100):
        rows = [login(1000 * k + i, t + dt.timedelta(hours=(k * 7) % 100, minutes=i), f"u{(k + i) % 6}") for i in range(4)]
        fold(spark.createDataFrame(rows, LOGIN).coalesce(1), k)
        most.append(len(tree(root)))
    assert max(most) <= 2 * 2 * (9 + 1)  # two versions of two buckets: a base and nine batches each
    table = profile_table(spark, root)
    assert sum(r["login_count"] for r in table.read().collect()) == 400 and len(table.versions()) == 2
    fold(spark.createDataFrame([login(5, t, "u0")], LOGIN), 99)  # a batch that runs again
    assert table.read().agg(F.sum("login_count")).first()[0] == 400
