"""Minimal OOXML writers, for exports and for the synthetic packages of queries and tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_CT = "http://schemas.openxmlformats.org/package/2006/content-types"
_PR = "http://schemas.openxmlformats.org/package/2006/relationships"
_OR = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def zipped(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rels(rows: list[tuple[str, str, str]], external: tuple[str, ...] = ()) -> str:
    """(id, type suffix, target) as a relationship part."""
    items = "".join(f'<Relationship Id={quoteattr(i)} Type="{_OR}/{t}" Target={quoteattr(x)}{" TargetMode=" + chr(34) + "External" + chr(34) if i in external else ""}/>' for i, t, x in rows)
    return f'<Relationships xmlns="{_PR}">{items}</Relationships>'


def types(defaults: dict[str, str], overrides: dict[str, str] | None = None) -> str:
    body = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in defaults.items())
    body += "".join(f'<Override PartName="/{p}" ContentType="{t}"/>' for p, t in (overrides or {}).items())
    return f'<Types xmlns="{_CT}">{body}</Types>'


def letters(col: int) -> str:
    """Column letters of a 1-based index."""
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell_xml(row: int, col: int, value: object, formula: str | None = None) -> str:
    at, f = f"{letters(col)}{row}", f"<f>{escape(formula)}</f>" if formula else ""
    if value is None and not formula:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}">{f}<v>{value!r}</v></c>'
    if formula:
        return f'<c r="{at}" t="str">{f}' + (f"<v>{escape(str(value))}</v>" if value is not None else "") + "</c>"
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _frame(sheets: list[dict]) -> dict[str, str]:
    """The parts of a workbook besides its sheets."""
    listed = "".join(f'<sheet name={quoteattr(s["name"])} sheetId="{k}"' + (f' state="{s["state"]}"' if s.get("state") else "") + f' r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
    return {
        "[Content_Types].xml": types({"xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml"}, {"xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"}),
        "xl/workbook.xml": f'<workbook xmlns="{_SS}" xmlns:r="{_OR}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels([(f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)]),
    }


def _top(sheet: dict) -> str:
    cols = "".join(f'<col min="{c}" max="{c}" hidden="1"/>' for c in sheet.get("hidden_cols", ()))
    return f'<worksheet xmlns="{_SS}" xmlns:r="{_OR}">' + (f"<cols>{cols}</cols>" if cols else "") + "<sheetData>"


def _end(sheet: dict) -> str:
    merges = "".join(f'<mergeCell ref="{m}"/>' for m in sheet.get("merges", ()))
    return "</sheetData>" + (f"<mergeCells>{merges}</mergeCells>" if merges else "") + sheet.get("tail", "") + "</worksheet>"


def xlsx(sheets: list[dict], extra: dict[str, bytes | str] | None = None) -> bytes:
    """A workbook. A sheet is {name, rows: {row: [value or (value, formula)]}, merges, hidden_rows, hidden_cols, state, tail}."""
    parts: dict[str, bytes | str] = {**_frame(sheets)}
    for k, s in enumerate(sheets, 1):
        rows = []
        hidden = set(s.get("hidden_rows", ()))
        for r in sorted(set(s.get("rows", {})) | hidden):
            cells = "".join(cell_xml(r, c, *(v if isinstance(v, tuple) else (v,))) for c, v in enumerate(s.get("rows", {}).get(r, ()), 1))
            rows.append(f'<row r="{r}"' + (' hidden="1"' if r in hidden else "") + f">{cells}</row>")
        parts[f"xl/worksheets/sheet{k}.xml"] = _top(s) + "".join(rows) + _end(s)
    return zipped(parts | (extra or {}))


class Growing:
    """A workbook of one sheet that is written as its rows come: only what is compressed stays in memory."""

    def __init__(self, name: str):
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        for part, data in _frame([{"name": name}]).items():
            self.zip.writestr(zipfile.ZipInfo(part), data, zipfile.ZIP_STORED)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(_top({}).encode())

    def add(self, rows: bytes | memoryview) -> None:
        """Rows as XML."""
        self.sheet.write(rows)

    def close(self, merges: list[str] = ()) -> bytes:
        self.sheet.write(_end({"merges": merges}).encode())
        self.sheet.close()
        self.zip.close()
        return self.out.getvalue()


def paragraph(text: str = "", style: str | None = None, inner: str = "") -> str:
    prop = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    run = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""
    return f"<w:p>{prop}{run}{inner}</w:p>"


def ole(rid: str) -> str:
    return f'<w:r><w:object><o:OLEObject xmlns:o="urn:schemas-microsoft-com:office:office" Type="Embed" r:id="{rid}"/></w:object></w:r>'


def blip(rid: str) -> str:
    return f'<w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="{rid}"/></w:drawing></w:r>'


def word_table(rows: list[list[str]]) -> str:
    """A table of cells, each a text or the XML of blocks (when it starts with <)."""
    cell = lambda c: f"<w:tc>{c if c.startswith('<w:') else paragraph(c)}</w:tc>"
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


def docx(body: str, relations: list[tuple[str, str, str]] = (), extra: dict[str, bytes | str] | None = None, external: tuple[str, ...] = ()) -> bytes:
    parts: dict[str, bytes | str] = {
        "[Content_Types].xml": types({"xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml", "png": "image/png", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}, {"word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"}),
        "word/document.xml": f'<w:document xmlns:w="{_W}" xmlns:r="{_OR}"><w:body>{body}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(list(relations), external),
    }
    return zipped(parts | (extra or {}))
