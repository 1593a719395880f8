"""Spreadsheets (XLSX) by the standard library: a reader for review sheets and a writer for exports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="export" sheetId="1" r:id="r1"/></sheets></workbook>'


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out = chr(65 + n % 26) + out
        n = n // 26 - 1
    return out


def write(path: str, header: list[str], rows: Iterable[Iterable[object]]) -> None:
    """A workbook of one sheet of texts; rows are streamed."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml"))
        z.writestr("xl/workbook.xml", _BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"))
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for r, row in enumerate(_chain(header, rows), 1):
                cells = "".join(f'<c r="{_letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(row) if v is not None)
                f.write(f'<row r="{r}">{cells}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


def _chain(header: list[str], rows: Iterable) -> Iterator:
    yield header
    yield from rows


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name as they end; each is dropped from the tree before the next is read, so that a sheet of any length
    needs the memory of one row."""
    open_ones: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            open_ones.append(element)
            continue
        open_ones.pop()
        if element.tag == tag:
            yield element
            if open_ones:
                open_ones[-1].remove(element)


def read(path: str, columns: list[str]) -> Iterator[dict[str, str]]:
    """The named columns of the first sheet's rows, found by its header; a missing column aborts. Rows are streamed."""
    text = f"{{{_NS['m']}}}t"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(text)) for si in _elements(f, f"{{{_NS['m']}}}si")]
        header: dict[str, str] | None = None
        with z.open(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))) as sheet:
            for row in _elements(sheet, f"{{{_NS['m']}}}row"):
                cells = {}
                for c in row.findall("m:c", _NS):
                    place = "".join(x for x in c.get("r", "") if x.isalpha())
                    if c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(text))
                    else:
                        v = c.find("m:v", _NS)
                        value = "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells[place] = value
                if header is None:
                    header = {v: k for k, v in cells.items()}
                    if missing := [c for c in columns if c not in header]:
                        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
                    continue
                yield {c: cells.get(header[c], "") for c in columns}


def review_rows(path: str) -> Iterator[dict[str, str]]:
    """id and alt_text_edited of a sheet, or of all sheets of a folder in order of name."""
    place = Path(path)
    for p in sorted(place.glob("*.xlsx")) if place.is_dir() else [place]:
        yield from read(str(p), ["id", "alt_text_edited"])
