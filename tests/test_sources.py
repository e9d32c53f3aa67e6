"""Order of lines, sheets by the workbook's list, and URLs typed in."""

import io
import zipfile

import pytest

from folioscope.sources import urls as sources


@pytest.mark.parametrize("size", ["128m", "64"])
def test_lines_are_numbered_alike_however_files_are_split(spark, tmp_path, size):
    """Two files at one split each and at splits of 64 bytes."""
    lines = {f: [f"https://{f}.org/{i}" if i % 7 else "" for i in range(60)] for f in ("b", "a")}
    for f, rows in lines.items():
        (tmp_path / f"{f}.txt").write_text("\n".join(rows) + "\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", size)
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    found = sources.numbered(session, str(tmp_path))
    assert (session.read.text(str(tmp_path)).rdd.getNumPartitions() > 8) == (size == "64")
    assert [tuple(r) for r in found.orderBy("ord").collect()] == list(enumerate(lines["a"] + lines["b"]))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.csv").write_text("n,url\n" + "".join(f"{i},https://a.org/{i}\n" for i in range(80)))
    rows = sources.from_sheet(session, str(tmp_path / "s" / "x.csv")).orderBy("ord").collect()
    assert [(r.ord, r.url) for r in rows] == [(i + 1, f"https://a.org/{i}") for i in range(80)]


def workbook(sheets, order, listed=True):
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        for n, text in sheets.items():
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>url</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>')
        if listed:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{n}" sheetId="{n}" r:id="rId{n + 5}"/>' for n in order) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{n + 5}" Type="t" Target="{"/xl/" if n % 2 else ""}worksheets/sheet{n}.xml"/>' for n in order) + "</Relationships>")
    return out.getvalue()


def test_first_sheet_is_the_one_listed_first(spark, tmp_path):
    sheets = {1: "http://one.org", 2: "http://two.org", 10: "http://ten.org"}
    for order, listed, want in (([2, 1, 10], True, "two"), ([10, 2, 1], True, "ten"), ([1], True, "one"), ([2], False, "one")):
        path = tmp_path / f"{order[0]}{listed}.xlsx"
        path.write_bytes(workbook(sheets, order, listed))
        assert [r.url for r in sources.from_sheet(spark, str(path)).collect()] == [f"http://{want}.org"]


def test_added(spark):
    loaded = spark.createDataFrame([(4, "http://a.org"), (2, "http://b.org")], "ord long, url string")
    new = spark.createDataFrame([(f" http://c.org/{i:03d} ",) for i in range(200)] + [("http://a.org",), (" ",), (None,), ("http://c.org/007",)], "url string")
    got = sorted(tuple(r) for r in sources.added(loaded, new).collect())
    assert got == [(2, "http://b.org"), (4, "http://a.org"), *((5 + i, f"http://c.org/{i:03d}") for i in range(200))]
    assert sorted(tuple(r) for r in sources.added(loaded.where("false"), new.limit(0)).collect()) == []
