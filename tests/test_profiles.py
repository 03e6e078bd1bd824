"""Mergeable column profiles: a reload reads new files only and infers what a full pass does."""

import csv
import os

from shelfcheck.sources import ingest
from shelfcheck.sources.profiles import ProfileStore, file_profiles, typed_export


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def test_reload_profiles_new_files_only(spark, tmp_dir, monkeypatch):
    folder, store = f"{tmp_dir}/in", ProfileStore(spark, f"{tmp_dir}/store")
    head = ["n", "mixed", "when", "shelf", "blank"]
    write(f"{folder}/a.csv", [head, ["1", "2", "2024-01-01", "7", ""], ["", "3", "2024-01-02", "8", ""]])
    write(f"{folder}/b.csv", [head, ["9007199254740993", "4", "", "9", ""]])

    def full():
        return ingest.infer_types(ingest.normalize_frame(ingest.read_export(spark, folder)))

    read = []
    monkeypatch.setattr("shelfcheck.sources.profiles.file_profiles", lambda df: read.append(sorted(df.inputFiles())) or file_profiles(df))
    df, types = typed_export(spark, folder, store)
    assert types == full() == {"n": "bigint", "mixed": "bigint", "when": "timestamp", "shelf": "bigint", "blank": "double"}
    assert sorted(r["n"] or 0 for r in df.collect()) == [0, 1, 9007199254740993]
    write(f"{folder}/c.csv", [["mixed", "n", "when", "shelf", "blank"], ["x", "5", "2024-01-03", "007", ""]])
    _, types = typed_export(spark, folder, store)
    assert types == full() == {"n": "bigint", "mixed": "string", "when": "timestamp", "shelf": "string", "blank": "double"}
    typed_export(spark, folder, store)  # nothing new
    assert [[os.path.basename(f) for f in files] for files in read] == [["a.csv", "b.csv"], ["c.csv"]]
    write(f"{folder}/c.csv", [head, ["5", "6.5", "", "1", "2"]])  # changed
    os.remove(f"{folder}/a.csv")
    _, types = typed_export(spark, folder, store)
    assert types == full() and types["mixed"] == "double" and types["shelf"] == "bigint"
    assert [os.path.basename(f) for f in read[-1]] == ["c.csv"]


def test_profiles_merge_to_the_stats_of_one_pass(spark, tmp_dir):
    rows = [[str(i), "" if i % 3 else f"{i}.5", f"0{i}"] for i in range(30)]
    for k in range(3):
        write(f"{tmp_dir}/in/f{k}.csv", [["a", "b", "c"], *rows[k::3]])
    store = ProfileStore(spark, f"{tmp_dir}/s")
    typed_export(spark, f"{tmp_dir}/in", store)
    assert store.merged(f"{tmp_dir}/in") == ingest.column_stats(ingest.read_export(spark, f"{tmp_dir}/in"))
