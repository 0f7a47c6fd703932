"""Workbooks, folders of texts and their index, records paired with documents."""

import io
import zipfile

from billspark.sources import files

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Plan</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet10.xml", f'<worksheet {NS}><sheetData><row><c t="inlineStr"><is><t>last sheet</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row><c t="s"><v>0</v></c><c><v>12.5</v></c><c/><c t="b"><v>1</v></c></row><row><c t="inlineStr"><is><t> </t></is></c></row><row><c t="str"><f>A1</f><v>shown</v></c><c t="s"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook_lines():
    assert files.workbook_lines(workbook()) == ["Plan | 12.5 | True", "shown | two runs", "last sheet"]


def test_folder_and_index(spark, tmp_path):
    docs, index = tmp_path / "docs", f"{tmp_path}/index"
    docs.mkdir()
    (docs / "a.txt").write_text("one two three four five")
    (docs / "b.xlsx").write_bytes(workbook())
    (docs / "c.xlsx").write_bytes(b"no workbook")
    (docs / "d.png").write_bytes(b"x")
    (docs / "e.md").write_text(" \n")
    got = {r["source"]: (r["kind"], r["text"], r["_error"]) for r in files.read_texts(spark, str(docs)).collect()}
    assert got["a.txt"] == ("text", "one two three four five", None) and got["b.xlsx"][1].startswith("Plan | 12.5") and got["c.xlsx"][2].startswith("unreadable") and got["d.png"] == ("image", None, None) and got["e.md"][1] == " \n"
    done = {r["source"]: (r["n_chunks"], r["_error"]) for r in files.index_folder(spark, str(docs), index, size=3, overlap=1).collect()}
    assert done["a.txt"] == (3, None) and done["b.xlsx"][0] == 6 and done["c.xlsx"][0] == 0 and done["c.xlsx"][1] and done["e.md"] == (0, None)
    # a file that comes again replaces its chunks, the others stay
    (docs / "a.txt").write_text("only this")
    (docs / "b.xlsx").unlink()
    files.index_folder(spark, str(docs), index, size=3, overlap=1)
    t = spark.read.parquet(index)
    assert [r["content"] for r in t.where("source = 'a.txt'").collect()] == ["only this"] and t.where("source = 'b.xlsx'").count() == 6
    files.index_folder(spark, str(docs), index, size=3, overlap=1, reset=True)
    assert {r["source"] for r in spark.read.parquet(index).collect()} == {"a.txt"}


def test_pairs(spark):
    schema = "file_name string, summary_of_services struct<line_items:array<struct<code:string>>>"
    r = spark.createDataFrame([("x.json", ([("1",)],)), ("y.json", ([],)), ("z.json", None), ("w.json", ([("2",)],))], schema)
    d = spark.createDataFrame([("x.pdf",), ("x.png",), ("y.pdf",)], "source string")
    assert {(p["file_name"], p["document"]) for p in files.pair_records(r, d).collect()} == {("x.json", "x.pdf"), ("w.json", None)}
