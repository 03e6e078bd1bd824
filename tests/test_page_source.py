"""Landed pages as a data source: batch equals the text reader, the stream publishes whole pulls only."""

import json
import os

from shelfcheck.sources import ingest, pages
from shelfcheck.sources.page_source import Landing, read_landing
from shelfcheck.streaming.pages import TABLE, run_pull_stream


def land(root, pull, page, total, records, code=200):
    os.makedirs(f"{root}/{pull}", exist_ok=True)
    body = {"code": code, "msg": "", "data": {"current": page, "pageSize": 2, "total": 0, "totalPage": total, "records": records}}
    with open(f"{root}/{pull}/p{page}.json", "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False)


def record(code, qty="3.7"):
    return {"cstoreCode": "s1", "cStore": "仓", "cproductCode": code, "cProductCode": code, "qty": qty}


def test_batch_equals_the_text_reader(spark, tmp_dir):
    for k in range(1, 41):
        land(tmp_dir, "2024-01-01", k, 40, [record(f"a{k}"), record(f"b{k}")], code=500 if k == 7 else 200)
    land(tmp_dir, "2024-01-02", 1, 1, [])
    with open(f"{tmp_dir}/2024-01-02/p2.json", "w") as f:
        f.write("{ broken")
    rows = lambda p: sorted(map(tuple, pages.inventory_rows(p).drop("pull").collect()), key=repr)
    source, text = read_landing(spark, tmp_dir), pages.read_pages(spark, f"{tmp_dir}/*")
    assert rows(source) == rows(text) and len(rows(source)) == 78
    missing = lambda p: [(os.path.basename(r["pull"]), r["page_no"]) for r in pages.page_completeness(p).collect()]
    assert missing(source) == missing(text) == [("2024-01-01", 7)]
    assert source.rdd.getNumPartitions() == 4  # forty pages by sixteen, and the second pull
    assert read_landing(spark, f"{tmp_dir}/none").count() == 0


def test_stream_publishes_a_pull_only_when_it_is_whole(spark, tmp_dir):
    landing, root = f"{tmp_dir}/land", f"{tmp_dir}/root"

    def run():
        run_pull_stream(spark, landing, root, f"{tmp_dir}/ckpt").awaitTermination()
        path = ingest.current_path(spark, root, TABLE)
        return None if path is None else sorted(r["product_code"] for r in spark.read.parquet(path).collect())

    def log():
        return {r["filename"]: r["state"] for r in spark.read.parquet(f"{root}/upload_log").collect()}

    field = next(iter(pages.PAGE_TEXT_FIELDS["product_code"]))
    rec = lambda c: {**record(c), field: c}
    land(landing, "p1", 1, 2, [rec("a")])
    assert run() is None  # still landing
    land(landing, "p1", 2, 2, [rec("b")])
    assert run() == ["a", "b"] and log() == {"p1": "success"}
    land(landing, "p2", 1, 2, [rec("c")])
    assert run() == ["a", "b"]
    land(landing, "p2", 2, 2, [], code=500)  # landed, but rejected
    assert run() == ["a", "b"] and log() == {"p1": "success", "p2": "failed"}
    land(landing, "p3", 1, 3, [rec("x")])  # passed over: the next one is whole
    land(landing, "p4", 1, 1, [rec("d")])
    assert run() == ["d"] and run() == ["d"]
    assert log() == {"p1": "success", "p2": "failed", "p4": "success"}
    assert not Landing({"path": landing}).whole("p3") and not Landing({"path": landing}).whole("none")
