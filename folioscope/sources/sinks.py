"""Results as JSON, CSV and workbooks."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import csv_escape, header_label
from ..operators.results import social_string

#: Rows that a sheet can hold, and the widest column.
SHEET_ROWS, WIDEST = 1_048_576, 60
#: Fields whose values of several authors are joined in an export.
JOINED = ["name", "email", "linkedin", "twitter", "job_title", "organization", "location"]


def to_json(results: DataFrame, ord_column: str = "ord") -> DataFrame:
    """One row: the object itself if there is one result, else all under `results`. For reports, not corpora."""
    body = F.array_sort(F.collect_list(F.struct(ord_column, F.struct(*[c for c in results.columns if c != ord_column]).alias("r"))))
    only = F.transform(body, lambda s: s["r"])
    return results.agg(only.alias("r")).select(F.when(F.size("r") == 1, F.to_json(F.element_at("r", 1))).otherwise(F.to_json(F.struct(F.col("r").alias("results")))).alias("json"))


def has_article_urls(results: DataFrame) -> bool:
    """Whether any row has article_urls."""
    if "article_urls" not in results.columns:
        return False
    return bool(results.agg(F.bool_or(F.size("article_urls") > 0)).first()[0])


def export_rows(results: DataFrame, article_urls: bool | None = None) -> DataFrame:
    """The flat export columns with their labels; Article URLs second if any row has them. Of several authors the values are joined."""
    flat = results
    if "authors" in results.columns:
        several = F.size(F.coalesce("authors", F.array().cast(results.schema["authors"].dataType))) > 1
        have = {f.name for f in results.schema["authors"].dataType.elementType.fields}
        every = lambda f: F.array_join(F.filter(F.transform("authors", lambda a: a[f]), lambda v: v != ""), "; ")
        flat = flat.withColumns({f: F.when(several, every(f)).otherwise(F.col(f)) for f in JOINED if f in results.columns and f in have})
        linked = F.filter(F.transform("authors", lambda a: social_string(a["social_links"])), lambda v: v != "")
        if "social_links" in results.columns:
            flat = flat.withColumn("social_links", F.when(several, F.array_join(linked, "; ")).otherwise(social_string(F.col("social_links"))) if "social_links" in have else social_string(F.col("social_links")))
    elif "social_links" in results.columns:
        flat = flat.withColumn("social_links", social_string(F.col("social_links")))
    shown = has_article_urls(results) if article_urls is None else article_urls
    fields = [*lists.EXPORT_FIELDS[:1], *(["article_urls"] if shown else []), *lists.EXPORT_FIELDS[1:]]
    one = F.array_join(F.when(F.size("article_urls") > 0, F.col("article_urls")).otherwise(F.array("article_url")), "; ") if shown else None
    return flat.select(*[(one if f == "article_urls" else F.col(f)).alias(header_label(f)) for f in fields if f in flat.columns])


def csv_lines(results: DataFrame) -> DataFrame:
    """(ord, line): the web export's ten columns, quoted where needed, the header at ord -1."""
    body = results.select("ord", F.array_join(F.array(*[csv_escape(F.col(f)) for f in lists.CSV_FIELDS]), ",").alias("line"))
    return results.sparkSession.createDataFrame([(-1, ",".join(lists.CSV_FIELDS))], "ord long, line string").unionByName(body)


def write_csv(results: DataFrame, path: str) -> None:
    export_rows(results).write.option("header", True).option("escape", '"').csv(path)


def write_workbook(results: DataFrame, path: str) -> int:
    """The export rows as an .xlsx file: header row, wrapped cells, first row frozen, widths by content. Returns the number of rows.

    One file holds one sheet's rows at most; they stream to the driver a partition at a time. More raise an error."""
    rows = export_rows(results)
    names = rows.columns
    widths = [len(n) for n in names]
    count = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in PARTS.items():
            book.writestr(name, body)
        with _Held() as held:
            held.add(_row(1, names, 1))
            for r in rows.toLocalIterator():
                count += 1
                if count >= SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows at most")
                held.add(_row(count + 1, r, 2))
                widths = [max(w, max(map(len, str(v or "").splitlines() or [""]))) for w, v in zip(widths, r)]
            columns = "".join(f'<col min="{i}" max="{i}" width="{min(w + 2, WIDEST)}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write((HEAD + f"<cols>{columns}</cols><sheetData>").encode())
                for part in held.parts():
                    sheet.write(part)
                sheet.write(b"</sheetData></worksheet>")
    return count


class _Held:
    """Rows wait in a temporary file of the driver, as widths stand before them in a sheet."""

    def __enter__(self):
        import tempfile

        self.file = tempfile.TemporaryFile()
        return self

    def add(self, row: str) -> None:
        self.file.write(row.encode("utf-8", "replace"))

    def parts(self):
        self.file.seek(0)
        while part := self.file.read(1 << 20):
            yield part

    def __exit__(self, *_):
        self.file.close()


def _column(i: int) -> str:
    return chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)


def _row(number: int, values, style: int) -> str:
    clean = lambda v: escape("".join(c for c in str(v) if c >= " " or c in "\t\n"))
    cells = "".join(f'<c r="{_column(i)}{number}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{clean(v)}</t></is></c>' for i, v in enumerate(values) if v not in (None, ""))
    return f'<row r="{number}">{cells}</row>'


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
HEAD = f'<?xml version="1.0" encoding="UTF-8"?><worksheet {MAIN}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: The other parts of a workbook of one sheet; cell styles 1 for the header and 2 for wrapped text.
PARTS = {
    "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook {MAIN} xmlns:r="{_REL}"><sheets><sheet name="Results" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><styleSheet {MAIN}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>',
}
