"""Exports of many files: headers in one pass, mixed orders, differences as findings, file order."""

import csv
import os

import pytest

from shelfcheck.contracts import HEADER_MAPS
from shelfcheck.sources import ingest
from shelfcheck.sources.headers import header_groups, parse_record


def write(path, rows, **kw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding=kw.pop("encoding", "utf-8")) as f:
        csv.writer(f, **kw).writerows(rows)


def jobs_of(spark, run, group):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_thousand_files_take_as_many_jobs_as_ten(spark, tmp_dir):
    for i in range(1000):
        head, row = ["a", "b", ""], [str(i), f"b{i}", ""]
        if i % 3 == 1:
            head, row = [" b", "a"], [f"b{i}", str(i)]
        write(f"{tmp_dir}/many/f{i:04}.csv", [head, row])
    for i in range(10):
        write(f"{tmp_dir}/few/f{i}.csv", [["a", "b"] if i % 2 else ["b", "a"], ["x", "x"]])
    few, n_few = jobs_of(spark, lambda: ingest.read_export(spark, f"{tmp_dir}/few"), "few")
    many, n_many = jobs_of(spark, lambda: ingest.read_export(spark, f"{tmp_dir}/many"), "many")
    # Listing a thousand paths is itself a job where they are named one by one.
    assert n_few <= 8 and n_many <= n_few + 3
    many = ingest.normalize_frame(many)
    assert many.columns == ["a", "b", "_blank"]
    assert sorted((int(r["a"]), r["b"]) for r in many.collect()) == [(i, f"b{i}") for i in range(1000)]
    assert few.count() == 10


def test_differing_headers_become_findings(spark, tmp_dir):
    table = "meituan_store_inventory"
    cols = list(HEADER_MAPS[table])
    row = ["v"] * len(cols)
    write(f"{tmp_dir}/x/a.csv", [cols, row])
    write(f"{tmp_dir}/x/b.csv", [cols[::-1], row])
    export = ingest.open_export(spark, f"{tmp_dir}/x")
    assert len(export.groups) == 2 and ingest.header_findings(export.groups, table) == []
    assert not [f for f in ingest.validate_contract(export.frame, table) if f.severity == "error"]
    write(f"{tmp_dir}/x/c.csv", [[*cols[1:], "extra"], row])
    write(f"{tmp_dir}/x/d.csv", [[*cols[1:], "extra"], row])
    export = ingest.open_export(spark, f"{tmp_dir}/x")
    found = {(f.check, f.column, f.severity) for f in ingest.header_findings(export.groups, table)}
    assert found == {("missing_in_2_files", cols[0], "error"), ("missing_in_2_files", "extra", "warning")}
    with pytest.raises(ingest.ContractError, match="missing_in_2_files"):
        ingest.validate_all(spark, {table: export.frame}, ingest.header_findings(export.groups, table))


def test_header_records_of_any_form(spark, tmp_dir):
    write(f"{tmp_dir}/q.csv", [["a\nb", 'say "x"', "c"], ["1", "2", "3"]])
    assert ingest.read_export(spark, f"{tmp_dir}/q.csv", multi_line=True).columns == ["a\nb", 'say "x"', "c"]
    assert ingest.read_export(spark, f"{tmp_dir}/q.csv", multi_line=True).first()[2] == "3"
    write(f"{tmp_dir}/s.csv", [["é", "b"], ["ü", "2"]], delimiter=";", encoding="latin-1")
    got = ingest.read_export(spark, f"{tmp_dir}/s.csv", sep=";", encoding="iso-8859-1")
    assert got.columns == ["é", "b"] and got.first()[0] == "ü"
    write(f"{tmp_dir}/bom.csv", [["a", "b"], ["1", "2"]], encoding="utf-8-sig")
    assert ingest.read_export(spark, f"{tmp_dir}/bom.csv").columns == ["a", "b"]
    write(f"{tmp_dir}/only.csv", [["a", "b"]])
    assert ingest.read_export(spark, f"{tmp_dir}/only.csv").count() == 0
    open(f"{tmp_dir}/empty.csv", "w").close()
    assert header_groups(spark, f"{tmp_dir}/empty.csv") == []
    assert parse_record('a,"b,c",') == ["a", "b,c", ""]


def test_status_headers_keep_their_platform_across_orders(spark, tmp_dir):
    write(f"{tmp_dir}/c/a.csv", [["京东ID", "营业状态", "美团ID", "营业状态"], ["j1", "开", "m1", "关"]])
    write(f"{tmp_dir}/c/b.csv", [["美团ID", "营业状态", "京东ID", "营业状态"], ["m2", "开", "j2", "关"]])
    export = ingest.open_export(spark, f"{tmp_dir}/c", context_headers=True)
    df = ingest.normalize_frame(export.frame, context_headers=True)
    assert sorted((r["京东ID"], r["京东营业状态"], r["美团营业状态"]) for r in df.collect()) == [("j1", "开", "关"), ("j2", "关", "开")]


def test_differences_keep_the_order_of_their_lists():
    assert ingest.header_difference(["z", "a", "m"], ["m", "y", "b"]) == (["z", "a"], ["y", "b"])
