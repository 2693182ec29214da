"""Workbooks without a library: sheets of text cells, read and written as the XML that a workbook is.

Written sheets are review sheets: a bold, frozen header, choices for the columns that people fill in,
and a colour for cells that are still blank.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from rubrica.sources.schemas import text_schema
from rubrica.sources.store import Store

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Characters that XML cannot hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def column_name(n: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value: object, style: int) -> str:
    text = escape(_BAD.sub("", "" if value is None else str(value)))
    return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{text}</t></is></c>'


def sheet_xml(columns: Sequence[str], rows: Sequence[Sequence[object]], choices: Mapping[str, Sequence[str]], inputs: Sequence[str]) -> str:
    names = [column_name(i) for i in range(len(columns))]
    body = ["<row r=\"1\">" + "".join(_cell(f"{a}1", c, 1) for a, c in zip(names, columns, strict=True)) + "</row>"]
    for k, row in enumerate(rows, 2):
        body.append(f'<row r="{k}">' + "".join(_cell(f"{a}{k}", v, 2) for a, v in zip(names, row, strict=True)) + "</row>")
    last = len(rows) + 1
    span = lambda c: f"{names[list(columns).index(c)]}2:{names[list(columns).index(c)]}{max(2, last)}"
    rules = [f'<dataValidation type="list" allowBlank="1" showErrorMessage="1" sqref="{span(c)}"><formula1>{escape(chr(34) + ",".join(v) + chr(34))}</formula1></dataValidation>' for c, v in choices.items() if c in columns]
    blank = [f'<conditionalFormatting sqref="{span(c)}"><cfRule type="containsBlanks" dxfId="0" priority="{i}"><formula>LEN(TRIM({span(c).split(":")[0]}))=0</formula></cfRule></conditionalFormatting>' for i, c in enumerate((c for c in inputs if c in columns), 1)]
    return (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols><col min="1" max="{max(1, len(columns))}" width="24" customWidth="1"/></cols><sheetData>{"".join(body)}</sheetData><autoFilter ref="A1:{names[-1] if names else "A"}{last}"/>'
        + "".join(blank) + (f'<dataValidations count="{len(rules)}">{"".join(rules)}</dataValidations>' if rules else "") + "</worksheet>")


_STYLES = (
    f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDDEBF7"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf xfId="0"/><xf xfId="0" fontId="1" fillId="2" applyFont="1" applyFill="1"/>'
    '<xf xfId="0" numFmtId="49" applyNumberFormat="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs>'
    '<dxfs count="1"><dxf><fill><patternFill><bgColor rgb="FFFFF2CC"/></patternFill></fill></dxf></dxfs></styleSheet>')


def workbook_bytes(sheets: Mapping[str, tuple[Sequence[str], Sequence[Sequence[object]]]], *, choices: Mapping[str, Sequence[str]] | None = None, inputs: Sequence[str] = ()) -> bytes:
    """A workbook of these sheets (name: columns and rows); every cell is text, so nothing is a formula."""
    names, out = list(sheets), io.BytesIO()
    links = "".join(f'<Relationship Id="r{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="r0" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet_xml(*sheets[n], choices or {}, inputs))
    return out.getvalue()


def write_workbook(sheet: DataFrame, path: str, name: str, *, choices: Mapping[str, Sequence[str]], inputs: Sequence[str], notes: Sequence[Sequence[str]] = (), most_rows: int = 5000) -> None:
    """A review sheet, and a sheet of notes, as a workbook; a sheet is for people, so its rows are bounded."""
    rows = sheet.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a workbook holds at most {most_rows} rows")
    sheets = {name: (sheet.columns, [tuple(r) for r in rows])} | ({"notes": (("topic", "text"), notes)} if notes else {})
    Store(sheet.sparkSession).write(path, workbook_bytes(sheets, choices=choices, inputs=inputs))


def read_cells(data: bytes, name: str | None = None) -> list[list[str]]:
    """The cells of a sheet (the first, or the one of this name) as text, '' where there is none."""
    tag = lambda t: f"{{{_MAIN}}}{t}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{{{_LINKS}}}id")] for s in book.iter(tag("sheet"))}
        if name is not None and name not in sheets:
            raise ValueError(f"no sheet {name!r}; there are {sorted(sheets)}")
        target = sheets[name] if name is not None else next(iter(sheets.values()))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(tag("t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        page = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out: list[list[str]] = []
    for row in page.iter(tag("row")):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.iter(tag("c"))):
            letters = re.match("[A-Z]+", c.get("r") or "")
            at = k
            if letters:
                at = 0
                for x in letters[0]:
                    at = at * 26 + ord(x) - 64
                at -= 1
            value = c.find(tag("v"))
            text = "" if value is None else value.text or ""
            cells[at] = shared[int(text)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(tag("t"))) if c.get("t") == "inlineStr" else text
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


def read_workbook(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A sheet as a table of text; its first row names the columns, rows without a value are left out."""
    head, *rows = read_cells(Store(spark).read(path), name) or [[]]
    if not head:
        raise ValueError(f"{path}: the sheet is empty")
    return spark.createDataFrame([(r + [""] * len(head))[: len(head)] for r in rows if any(r)], text_schema(*head))
