"""Workbooks: cells as text, and every dataset loaded from xlsx as from CSV."""

import os
import zipfile
from xml.sax.saxutils import escape

import pytest

from shelfcheck.contracts import ADDRESS_HEADERS, ADDRESS_STEM, DATASET_TABLES, HEADER_MAPS, SOURCE_STEMS
from shelfcheck.sources import ingest
from tests.test_load_folder import export, write_csv

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def column(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def cell(ref, value, strings):
    if value in (None, ""):
        return ""
    if isinstance(value, tuple):  # raw: (attributes, inner XML)
        return f'<c r="{ref}" {value[0]}>{value[1]}</c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    strings.append(value)
    return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'


def write_xlsx(path, sheets, date1904=False):
    """``sheets``: name -> rows. Strings are shared, formats hold two date styles (1, 2)."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    strings, parts = [], {}
    for k, rows in enumerate(sheets.values()):
        body = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{column(i)}{r + 1}", v, strings) for i, v in enumerate(row)) + "</row>"
                       for r, row in enumerate(rows))
        parts[f"xl/worksheets/sheet{k + 1}.xml"] = f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(sheets))
    parts["xl/workbook.xml"] = (f'<workbook {NS} xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/>'
                                f"<sheets>{listed}</sheets></workbook>")
    parts["xl/_rels/workbook.xml.rels"] = (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
    parts["xl/styles.xml"] = (f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm;@"/>'
                              '<numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts>'
                              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
    parts["xl/sharedStrings.xml"] = f"<sst {NS}>" + "".join(
        f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_cells_as_text(spark, tmp_dir):
    rows = [
        [], ["name", "a", "", "a"],
        ["whole", 12345, None, 12345.0], ["parts", 1.5, 3.0, 1e20], ["text", "007", " x ", "9007199254740993"],
        ["flags", ("t=\"b\"", "<v>1</v>"), ("t=\"e\"", "<v>#N/A</v>"), ("t=\"str\"", "<v>f</v>")],
        ["dates", ("s=\"1\"", "<v>45292</v>"), ("s=\"2\"", "<v>45292.5</v>"), ("s=\"3\"", "<v>2.5</v>")],
        [None, None, ""], ["rich", ("t=\"inlineStr\"", "<is><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></is>")],
    ]
    path = f"{tmp_dir}/b.xlsx"
    write_xlsx(path, {"First": rows, "二": [["only"], [1]]})
    df = ingest.normalize_frame(ingest.read_export(spark, path, "xlsx"))
    assert df.columns == ["name", "a", "_blank", "a_2"]
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert got == {
        "whole": ("12345", None, "12345"), "parts": ("1.5", "3", "1e+20"), "text": ("007", " x ", "9007199254740993"),
        "flags": ("TRUE", None, "f"), "dates": ("2024-01-01 00:00:00", "2024-01-01 12:00:00", "2.5"), "rich": ("two runs", None, None)}
    other = ingest.read_export(spark, path, "xlsx", sheet="二")
    assert other.columns == ["only"] and other.first()[0] == "1"
    with pytest.raises(Exception, match="no sheet"):
        ingest.read_export(spark, path, "xlsx", sheet="三").collect()
    write_xlsx(path, {"S": [["d"], [("s=\"1\"", "<v>0</v>")]]}, date1904=True)
    assert ingest.read_export(spark, path, "xlsx").first()[0] == "1904-01-01 00:00:00"
    write_xlsx(path, {"S": []})
    assert ingest.read_export(spark, path, "xlsx").count() == 0


def test_a_sheet_is_read_row_by_row(tmp_dir):
    """Peak memory does not follow the number of rows."""
    import tracemalloc

    from shelfcheck.sources.xlsx import Workbook

    peak = {}
    for n in (2_000, 40_000):
        write_xlsx(f"{tmp_dir}/{n}.xlsx", {"S": [["a", "b"]] + [[i, i + 0.5] for i in range(n)]})
        with open(f"{tmp_dir}/{n}.xlsx", "rb") as f:
            book = Workbook(f)
            tracemalloc.start()
            assert sum(1 for _ in book.rows()) == n + 1
            peak[n] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
    assert peak[40_000] < 2 * peak[2_000] + 200_000


def test_workbooks_of_a_folder_unite_by_header(spark, tmp_dir):
    write_xlsx(f"{tmp_dir}/w/a.xlsx", {"S": [["x", "y"], [1, 2]]})
    write_xlsx(f"{tmp_dir}/w/b.xlsx", {"S": [["y", "x"], [4, 3], [6, 5]]})
    made = ingest.open_export(spark, f"{tmp_dir}/w", "xlsx")
    assert sorted((r["x"], r["y"]) for r in made.frame.collect()) == [("1", "2"), ("3", "4"), ("5", "6")]
    assert sorted(g.count for g in made.groups) == [1, 1]
    path, _ = ingest.prefer_source(spark, [f"{tmp_dir}/w/none.xlsx", f"{tmp_dir}/w/a.xlsx"], "xlsx")
    assert path.endswith("a.xlsx")


@pytest.mark.parametrize("key", list(DATASET_TABLES))
def test_every_dataset_key_loads_as_from_csv(spark, tmp_dir, key):
    address = [["x", *ADDRESS_HEADERS], ["1", " v1 ", " "], ["2", "v1", "Road 1"], ["3", "v1", "Road 9"]]
    for table, stems in SOURCE_STEMS.items():
        rows = export(table)
        write_csv(f"{tmp_dir}/csv/{stems[0]}.csv", rows)
        write_xlsx(f"{tmp_dir}/xlsx/{stems[0]}.xlsx", {"Sheet1": [[int(v) if str(v).isdigit() else v for v in r] for r in rows]})
    write_csv(f"{tmp_dir}/csv/{ADDRESS_STEM}.csv", address)
    write_xlsx(f"{tmp_dir}/xlsx/{ADDRESS_STEM}.xlsx", {"Sheet1": address})
    made = {fmt: ingest.load_folder(spark, f"{tmp_dir}/out-{fmt}", f"{tmp_dir}/{fmt}", "1", [key], fmt) for fmt in ("csv", "xlsx")}
    assert made["csv"].rows == made["xlsx"].rows
    for table in DATASET_TABLES[key]:
        a, b = (spark.read.parquet(made[fmt].tables[table]) for fmt in ("csv", "xlsx"))
        # A sheet's last column without a header or a value is no column of the sheet.
        assert a.dtypes == b.dtypes and set(a.columns) == set(HEADER_MAPS[table].values())
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
