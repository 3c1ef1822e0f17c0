"""Workbooks written in the test as zipped XML."""

import io
import zipfile

import pytest

from clausemill.sources import readers
from clausemill.sources.workbook import column_of, header_of, workbook_sheet

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, strings):
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{LINKS}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


STRINGS = ["<t>Code</t>", "<t>Meaning</t>", "<r><t>rich </t></r><r><rPr/><t>text</t></r><rPh><t>no</t></rPh>", "<t>a &amp; b</t>"]
VARIABLES = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="s"><v>3</v></c><c r="D2"><v>7</v></c></row>'
    '<row r="4"><c r="A4" t="inlineStr"><is><t>in line</t></is></c><c r="B4" t="b"><v>1</v></c><c r="C4" t="str"><v>made</v></c><c r="D4"><v>45000.5</v></c></row>'
    "<row><c><v>1</v></c><c/></row>"
)


def test_a_sheet_by_name(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(book({"Other": "<row/>", "Variables": VARIABLES}, STRINGS))
    df = readers.excel_sheet(spark, f"{tmp_path}/book.xlsx", "Variables")
    assert df.columns == ["Code", "Meaning", "Unnamed: 2", "Code.1"]
    assert [tuple(r) for r in df.collect()] == [("rich text", "a & b", None, "7"), ("in line", "True", "made", "45000.5"), ("1", None, None, None)]
    some = workbook_sheet(spark, f"{tmp_path}/book.xlsx", "Variables", columns=["Meaning"], row="at")
    assert [tuple(r) for r in some.collect()] == [(2, "a & b"), (4, "True"), (5, None)]
    filled = readers.forward_filled(some, ["Meaning"], "at").orderBy("at").collect()
    assert filled[-1].Meaning == "True"
    assert workbook_sheet(spark, f"{tmp_path}/book.xlsx", "Other").columns == []
    with pytest.raises(ValueError, match="no columns"):
        workbook_sheet(spark, f"{tmp_path}/book.xlsx", "Variables", columns=["None"])
    with pytest.raises(Exception, match="no sheet Lost among Other, Variables"):
        workbook_sheet(spark, f"{tmp_path}/book.xlsx", "Lost").collect()


def test_all_workbooks_of_a_folder_by_column_name(spark, tmp_path):
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(2, 25_002))
    (tmp_path / "a.xlsx").write_bytes(book({"S": '<row r="1"><c r="A1" t="s"><v>0</v></c></row>' + rows}, STRINGS))
    (tmp_path / "b.xlsx").write_bytes(book({"S": '<row r="1"><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>99</v></c></row>'}, STRINGS))
    got = sorted(int(r.Code) for r in workbook_sheet(spark, str(tmp_path), "S").collect())
    assert got == sorted([*range(2, 25_002), 99])


def test_names():
    assert [column_of(x) for x in ("A1", "Z9", "AA10", "AZ1", "BA1")] == [0, 25, 26, 51, 52]
    assert header_of({}) == [] and header_of({0: "a", 2: "a"}) == ["a", "Unnamed: 1", "a.1"]
