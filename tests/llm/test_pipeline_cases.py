"""Every pipeline stage on odd documents: nulls, empty and long texts, ties, repeated rows, further
columns with names the operators use, and an empty table."""

import pytest

import corpus_pipeline as cp
from tests.conftest import SF_SMALL

LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, "   \t"), (4, "plain words that say nothing at all about anything"), (4, "plain words that say nothing at all about anything"),
       (5, "plain words that say nothing at all about anything"), (None, "nameless text of its own with several words in it"),
       (None, None), (6, LONG), (7, "write to a.b@c.org or +1 (555) 555-0100 today"), (8, "é" * 5000), (9, "\u0000 control \u0001 signs")]
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, score double, __row string, ids string, "
           "component_id string, p int, n_hit string, digest string")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), 0.5, "r", "i", "c", 1, "h", "d") for i, t in rows], COLUMNS)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_on_odd_documents(spark, name, stage):
    frame = docs(spark, ODD)
    out = stage(spark, frame, SF_SMALL)
    rows = out.collect()
    if name != "bpe":
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        assert all(r["component_id"] == "c" and r["score"] == 0.5 and r["digest"] == "d" for r in rows)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    every = sorted((i is None, i or 0) for i, _ in ODD)
    if name in ("decontamination", "personal-data", "bpe"):
        assert ids == every
    if name == "toxicity":
        assert set(ids) <= set(every) and (False, 4) in ids
        assert ids.count((False, 4)) == 2  # repeated rows share their fate
    if name == "near-duplicates":  # texts without words are one component, copies another
        assert [i for none, i in ids if not none and i in (1, 2, 3)] == [1]
        assert [i for none, i in ids if not none and i in (4, 5)] == [4]
        assert sum(none for none, _ in ids) == 1
    if name == "personal-data":
        text = {r["doc_id"]: r for r in rows}
        assert text[7]["text"] == "write to <EMAIL> or <PHONE> today" and text[7]["n_chars"] == len(text[7]["text"])
        assert text[1]["text"] is None and text[2]["text"] == "" and text[6]["text"] == LONG
    if name == "bpe":
        by = {r["doc_id"]: r for r in rows}
        assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[6]["n_tokens"] > 50_000


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_on_an_empty_table(spark, name, stage):
    frame = docs(spark, [])
    out = stage(spark, frame, SF_SMALL)
    assert out.count() == 0 and (name == "bpe" or out.columns == frame.columns)


def test_stages_in_a_row_on_odd_documents(spark, tmp_dir):
    frame = docs(spark, ODD)
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frame, SF_SMALL).write.parquet(f"{tmp_dir}/{k}")
        frame = spark.read.parquet(f"{tmp_dir}/{k}")
    left = {r["doc_id"] for r in frame.collect()}
    assert {1, 4, 6, 7} <= left and not left & {2, 3, 5}


def test_near_duplicates_never_broadcast_the_copies(spark, monkeypatch):
    from shelfcheck.llm import simhash as sh

    plans, real = [], sh.components

    def components(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return real(edges)

    monkeypatch.setattr(sh, "components", components)
    kept = cp.near_duplicates(spark, docs(spark, ODD), SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 6, 7, 8, 9]
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
