"""M5 streaming form: several landed files, a re-delivered event, equal to the batch profile."""

import datetime as dt
import os

from shelfcheck.operators.logins import PROFILE_COLS, profile_from_logins
from shelfcheck.streaming.logins import profiles_via_stream

EV = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def to_logins(ev):
    from shelfcheck.sources.testbind import logins_from_events

    return logins_from_events(ev)


def test_stream_equals_batch_with_redelivery(spark, tmp_dir):
    t = dt.datetime(2024, 1, 1)
    batches = [
        [(1, t, 7, "signup", 50.0), (2, t + dt.timedelta(hours=1), 8, "view", 1.0)],
        [(3, t + dt.timedelta(hours=2), 7, "purchase", 10.0), (2, t + dt.timedelta(hours=1), 8, "view", 1.0)],
        [(4, t + dt.timedelta(hours=3), 7, "error", 99.0)],
    ]
    land = os.path.join(tmp_dir, "events")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EV).coalesce(1).write.parquet(os.path.join(land, f"part{i}"))
    # files land in sub-folders; move them up as one landing folder
    for i in range(len(batches)):
        sub = os.path.join(land, f"part{i}")
        for f in os.listdir(sub):
            if f.endswith(".parquet"):
                os.link(os.path.join(sub, f), os.path.join(land, f"f{i}.parquet"))
    streamed = profiles_via_stream(spark, land, to_logins, files_per_batch=1, file_glob="f*.parquet")
    all_events = spark.read.parquet(land, pathGlobFilter="f*.parquet").dropDuplicates(["event_id"])
    batch = profile_from_logins(to_logins(all_events))
    got = {r["open_id"]: tuple(r[c] for c in PROFILE_COLS) for r in streamed.collect()}
    want = {r["open_id"]: tuple(r[c] for c in PROFILE_COLS) for r in batch.collect()}
    assert got == want
    assert got["ou_8"][PROFILE_COLS.index("login_count")] == 1  # re-delivered event counted once
    assert got["ou_7"][PROFILE_COLS.index("union_id")] is None  # latest login had no union id


def test_late_events_count(spark, tmp_dir):
    """One event a file, far out of order: nothing is dropped for being late."""
    land = os.path.join(tmp_dir, "late")
    for i, day in enumerate([20, 25, 2, 3]):
        spark.createDataFrame([(i, dt.datetime(2024, 1, day), 7, "signup", 1.0)], EV).coalesce(1).write.parquet(
            os.path.join(land, f"d{i}"))
    (p,) = profiles_via_stream(spark, f"{land}/*", to_logins, files_per_batch=1).collect()
    assert (p["login_count"], p["first_login_at"].day, p["last_login_at"].day) == (4, 2, 25)


def _write_csv(path, header, rows):
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_arrival_stream_publishes_good_batches_only(spark, tmp_dir):
    """File arrival stream: each landed file is loaded once; a file that breaks the
    contract publishes nothing and is logged as failed; replays do not reload."""
    from shelfcheck.contracts import HEADER_MAPS
    from shelfcheck.sources import ingest
    from shelfcheck.streaming.ingest import run_arrival_stream

    table = "meituan_store_inventory"
    cols = list(HEADER_MAPS[table])
    land, root, ckpt = (os.path.join(tmp_dir, x) for x in ("land", "root", "ckpt"))
    os.makedirs(land)

    def row(store, qty, header=cols):
        return [{"门店ID": store, "库存": qty}.get(c, "v") for c in header]

    def run():
        run_arrival_stream(spark, land, root, table, ckpt).awaitTermination()

    _write_csv(os.path.join(land, "a.csv"), cols, [row("101", "12"), row("102", "3")])
    run()
    first = ingest.current_path(spark, root, table)
    t = spark.read.parquet(first)
    assert t.count() == 2 and dict(t.dtypes)["stock_qty"] == "bigint"

    short = [c for c in cols if c != "库存"]
    _write_csv(os.path.join(land, "b.csv"), short, [row("103", "1", short)])
    run()
    assert ingest.current_path(spark, root, table) == first

    _write_csv(os.path.join(land, "c.csv"), cols, [row("104", "7")])
    run()
    run()  # nothing new: no batch, no reload
    cur = ingest.current_path(spark, root, table)
    assert cur != first
    assert [(r["store_id"], r["stock_qty"]) for r in spark.read.parquet(cur).collect()] == [("104", 7)]
    log = {r["filename"]: r["state"] for r in spark.read.parquet(os.path.join(root, "upload_log")).collect()}
    assert log == {"a.csv": "success", "b.csv": "failed", "c.csv": "success"}


def test_replayed_batches_log_once(spark, tmp_dir):
    """A batch that runs again, failed or published, adds no second row to the history."""
    from shelfcheck.contracts import HEADER_MAPS
    from shelfcheck.streaming.ingest import load_arrivals

    table = "meituan_store_inventory"
    cols, root = list(HEADER_MAPS[table]), os.path.join(tmp_dir, "root")
    good, bad = os.path.join(tmp_dir, "good.csv"), os.path.join(tmp_dir, "bad.csv")
    _write_csv(good, cols, [["v"] * len(cols)])
    _write_csv(bad, cols[:-1], [["v"] * (len(cols) - 1)])
    apply = load_arrivals(root, table)
    for batch, path in ((0, good), (1, bad), (0, good), (1, bad)):
        apply(spark.createDataFrame([(path, 10)], "path string, length long"), batch)
    log = sorted((r["filename"], r["state"]) for r in spark.read.parquet(os.path.join(root, "upload_log")).collect())
    assert log == [("bad.csv", "failed"), ("good.csv", "success")]
