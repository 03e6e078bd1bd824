"""Exact dedup against a persistent index: brute force, deliveries, reopening, compaction."""

import hashlib
import re

from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ROWS = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, "É same"), (4, "é same"), (5, ""), (6, None),
        (7, "x" * 300_000), (8, "X" * 300_000), (10, "alone"), (None, "alone"), (None, "nameless"), (None, "Nameless"),
        (11, "twice"), (11, "twice")] + [(100 + i, "hot copy") for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'clash' AS row", "1 AS digest", "2 AS delivery", "3 AS n", "4 AS keep")


def brute(rows):
    sha = [hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() for _, t in rows]
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [j for j, h in enumerate(sha) if h == sha[i]]
        keep = max(same, key=lambda j: (rows[j][0] is not None, rows[j][0] or 0, -j))
        out.append((doc, rows[keep][0], len(same), keep == i, sha[i]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_dedupe_matches_brute_force(spark, tmp_dir):
    from shelfcheck.llm import digest_index as di

    index = di.DigestIndex(spark, f"{tmp_dir}/a")
    assert got(di.dedupe(frame(spark, ROWS).coalesce(1), index)) == brute(ROWS)
    assert got(di.dedupe(frame(spark, ROWS[:0]), di.DigestIndex(spark, f"{tmp_dir}/b"))) == []


def test_deliveries_reopening_and_compaction(spark, tmp_dir):
    from shelfcheck.llm import digest_index as di

    def delivery(name, rows):
        return di.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(name))

    path = f"{tmp_dir}/index"
    first = delivery("monday", [(5, "a"), (6, "A"), (7, "b")])
    index = di.DigestIndex(spark, path, buckets=3)
    index.add(first)
    index.add(first)  # a delivery that comes again changes nothing
    assert index.table.frame().count() == 2
    index = di.DigestIndex(spark, path)  # another session finds the same table
    assert index.table.buckets == 3
    second = delivery("tuesday", [(90, "a"), (91, "b"), (92, "b"), (93, "c")])
    index.add(second)
    at = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.resolve(second).collect()}
    assert at == {90: (6, 1, False), 91: (7, 2, False), 92: (7, 2, False), 93: (93, 1, True)}
    before = sorted(map(tuple, index.table.frame().collect()))
    index.compact(buckets=5)
    again = di.DigestIndex(spark, path)
    assert again.table.buckets == 5 and sorted(map(tuple, again.table.frame().collect())) == before
    again.add(delivery("wednesday", [(1, "c"), (2, "d")]))
    assert again.table.frame().count() == 4
    files = [r[0] for r in again.table.frame().select(F.input_file_name()).distinct().collect()]
    assert len({re.search(r"_(\d{5})\.c000", f)[1] for f in files}) <= 5


def test_anti_join_reads_the_index_without_a_shuffle(spark, tmp_dir):
    from shelfcheck.llm import digest_index as di

    index = di.DigestIndex(spark, f"{tmp_dir}/index", buckets=6)
    rows = di.digests(spark.createDataFrame(ROWS, "doc_id bigint, text string"), F.lit("x"))
    index.add(rows)
    frame = index.unseen(rows)
    assert frame.count() == 0
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    right = plan[plan.index("Bucketed: true") - 600:plan.index("Bucketed: true")]
    assert "Exchange" not in right and "python" not in plan.lower()
