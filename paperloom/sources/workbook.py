"""Workbook reader: one pass over the sheet parts gives formulas and cached values together."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections import deque
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from functools import lru_cache
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .ooxml import UNREADABLE, local, parse, relationships, rels_part, unreadable
from .writers import letters

#: Every fact that a workbook yields, in one long relation: cells, merged ranges, hidden rows and columns, sheets, assets.
FACTS = (
    "workbook string, fact string, sheet_idx int, sheet string, state string, row int, col int, ref string, value string, value_num double, value_bool boolean, data_type string, "
    "number_format string, formula string, hyperlink string, comment string, first_row int, last_row int, from_row int, from_col int, to_row int, to_col int, kind string, filename string, "
    "sha256 string, size_bytes long, title string, series array<string>, categories array<string>, text string, warning string"
)
#: What a cell gives, in this order.
CELL = ("workbook", "sheet_idx", "sheet", "state", "row", "col", "ref", "value", "value_num", "value_bool", "data_type", "number_format", "formula", "hyperlink", "comment")
#: Bytes of a sheet that are parsed at a time; a smaller one is parsed at once.
CHUNK = 1 << 18
#: Facts in a batch.
FLUSH = 4096
_BUILTIN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}


def python_text(value: object) -> str | None:
    """A value as Python prints it; dates in ISO form, with a space before the time."""
    return None if value is None else str(value)


@lru_cache(4096)
def _is_date(fmt: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\[[^\]hms]*\]', "", fmt.lower())
    return fmt not in ("General", "@") and bool(re.search(r"[ymdhs]", bare)) and not re.search(r"[#?%e]", bare)


def serial(value: float, fmt: str, base_1904: bool) -> datetime | time:
    if 0 <= value < 1 and not re.search(r"[yd]", fmt.lower()):
        seconds = round(value * 86400)
        return time(seconds // 3600 % 24, seconds // 60 % 60, seconds % 60)
    base = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 31) if value < 60 else datetime(1899, 12, 30)
    return base + timedelta(milliseconds=round(value * 86400000))


def split_ref(ref: str) -> tuple[int, int]:
    """(row, column) of an A1 reference."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    if not m:
        return 0, 0
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def shifted(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads some rows down and columns right."""

    def move(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        row, col = split_ref(m[2] + m[4])
        return f"{m[1]}{m[2] if m[1] else letters(max(1, col + cols))}{m[3]}{m[4] if m[3] else max(1, row + rows)}"

    return re.sub(r'"[^"]*"|(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])', move, formula)


def _texts(e, name: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if local(x.tag) == name)


_local = lru_cache(4096)(local)
_INTEGER = re.compile(r"\s*-?\d+\s*").fullmatch


@lru_cache(4096)
def _column(letters_: str) -> int:
    return split_ref(f"{letters_}1")[1]


def _sound(sheet: BinaryIO) -> tuple[bool, bool]:
    """Whether a part is XML, and whether it may have hyperlinks; nothing of it is kept."""
    p, rest, linked = expat.ParserCreate(None, "}"), b"", False

    def skipped(name: str, parameter: bool) -> None:
        if not parameter:
            raise expat.ExpatError(f"undefined entity {name}")

    p.SkippedEntityHandler = skipped
    try:
        while data := sheet.read(CHUNK):
            p.Parse(data, False)
            near = rest + data
            linked = linked or b"hyperlink" in near or b"\0" in near
            rest = data[-16:]
        p.Parse(b"", True)
    except expat.ExpatError:
        return False, False
    return True, linked


def _below(root: ET.Element) -> Iterator[ET.Element]:
    """root and the elements below it, but for what rows hold."""
    yield root
    for child in root:
        if _local(child.tag) == "sheetData":
            for e in child:
                yield from (e,) if _local(e.tag) == "row" else e.iter()
        else:
            yield from child.iter()


def _elements(sheet: BinaryIO) -> Iterator[ET.Element]:
    """The elements of a sheet, but for what rows hold. Rows go from the tree once they were given, so it never holds more than a chunk's."""
    part = sheet.read(CHUNK)
    if len(part) < CHUNK:
        yield from _below(ET.fromstring(part))
        return
    p = ET.XMLPullParser(("start",))
    root = data = None
    while part:
        p.feed(part)
        part = sheet.read(CHUNK)
        if data is None:
            for _, e in p.read_events():
                root = e if root is None else root
                if _local(e.tag) == "sheetData":
                    data = e
                    break
        deque(p.read_events(), 0)
        if data is not None and len(data) > 1:  # the last may go on
            for e in data[:-1]:
                yield from (e,) if _local(e.tag) == "row" else e.iter()
            del data[:-1]
    p.close()
    yield from _below(root)


class _Book:
    """sound has what _sound() says of each streamed part of the open package; parts has the others."""

    def __init__(self, workbook: str | None, parts: dict[str, bytes], package: zipfile.ZipFile, sound: dict[str, tuple[bool, bool]]):
        self.workbook, self.parts, self.package, self.sound = workbook, parts, package, sound
        root = parse(parts.get("xl/workbook.xml"))
        self.rels = {r["rel_id"]: r for r in relationships(parts.get("xl/_rels/workbook.xml.rels"), "xl/workbook.xml")}
        self.sheets, self.base_1904 = [], False
        for e in root.iter() if root is not None else ():
            if local(e.tag) == "workbookPr":
                self.base_1904 = e.get("date1904") in ("1", "true")
            if local(e.tag) == "sheet":
                rid = next((v for k, v in e.attrib.items() if local(k) == "id"), None)
                self.sheets.append((e.get("name", ""), e.get("state", "visible"), self.rels.get(rid, {}).get("part")))
        strings = parse(parts.get("xl/sharedStrings.xml"))
        self.strings = [_texts(e) for e in strings] if strings is not None else []
        styles = parse(parts.get("xl/styles.xml"))
        custom, self.formats = {}, []
        for e in styles if styles is not None else ():
            if local(e.tag) == "numFmts":
                custom = {int(f.get("numFmtId", 0)): f.get("formatCode", "General") for f in e}
            if local(e.tag) == "cellXfs":
                self.formats = [int(f.get("numFmtId", 0)) for f in e]
        self.formats = [custom.get(k, _BUILTIN.get(k, "General")) for k in self.formats]

    def opened(self, part: str) -> BinaryIO:
        return self.package.open(part) if part in self.sound else io.BytesIO(self.parts.get(part, b""))

    def related(self, part: str) -> dict[str, dict]:
        return {r["rel_id"]: r for r in relationships(self.parts.get(rels_part(part)), part)}

    def cells(self, idx: int) -> Iterator[dict | tuple]:
        """Facts of a sheet: cells as tuples of CELL, others as dicts. The part is read as a stream."""
        name, state, part = self.sheets[idx]
        base = {"sheet_idx": idx, "sheet": name, "state": state}
        sound, linked = self.sound[part] if part in self.sound else _sound(self.opened(part or ""))
        yield base | {"fact": "sheet", "warning": None if sound else f"Sheet part is missing or no XML: {name}"}
        if not sound:
            return
        related = self.related(part)
        links: dict[str, str] = {}
        if linked:
            with self.opened(part) as sheet:
                links = {e.get("ref"): (related.get(next((v for k, v in e.attrib.items() if local(k) == "id"), ""), {}).get("target") or e.get("location")) for e in _elements(sheet) if _local(e.tag) == "hyperlink"}
        comments: dict[str, str] = {}
        for r in related.values():
            if r["rel_type"].endswith("/comments") and (c := parse(self.parts.get(r["part"] or ""))) is not None:
                comments |= {e.get("ref"): _texts(e) for e in c.iter() if local(e.tag) == "comment"}
        shared: dict[str, tuple[str, int, int]] = {}
        noted = set(links) | set(comments)
        seen: set[str] = set()
        row_no = 0
        with self.opened(part) as sheet:
            for e in _elements(sheet):
                kind = _local(e.tag)
                if kind == "col" and e.get("hidden") in ("1", "true"):
                    for c in range(int(e.get("min", 1)), min(int(e.get("max", 1)), 16384) + 1):
                        yield base | {"fact": "hidden_col", "col": c, "ref": letters(c)}
                elif kind == "mergeCell":
                    first, _, last = e.get("ref", "").partition(":")
                    yield base | {"fact": "merge", "ref": e.get("ref"), "first_row": split_ref(first)[0], "last_row": split_ref(last or first)[0]}
                elif kind == "row":
                    row_no = int(e.get("r", row_no + 1))
                    if e.get("hidden") in ("1", "true"):
                        yield base | {"fact": "hidden_row", "row": row_no}
                    col_no, digits = 0, str(row_no)
                    for c in e:
                        ref = c.get("r") or f"{letters(col_no + 1)}{row_no}"
                        bare = ref.removesuffix(digits)
                        col_no = _column(bare) if bare.isalpha() else split_ref(ref)[1]
                        if ref in noted:
                            seen.add(ref)
                            yield (self.workbook, idx, name, state, row_no, col_no, ref, *self.cell(c, row_no, col_no, shared), links.get(ref), comments.get(ref))
                        else:
                            yield (self.workbook, idx, name, state, row_no, col_no, ref, *self.cell(c, row_no, col_no, shared), None, None)
        for ref in noted - seen:
            if ref and ":" not in ref:
                row, col = split_ref(ref)
                yield (self.workbook, idx, name, state, row, col, ref, None, None, None, "n", "General", None, links.get(ref), comments.get(ref))

    def cell(self, c, row: int, col: int, shared: dict) -> tuple:
        """value, value_num, value_bool, data_type, number_format, formula"""
        kind, style = c.get("t", "n"), c.get("s")
        raw = f = None
        for x in reversed(c):  # the first of a name counts
            tag = _local(x.tag)
            if tag == "v":
                raw = x.text
            elif tag == "f":
                f = x
        style = int(style) if style else 0
        fmt = self.formats[style] if style < len(self.formats) else "General"
        text, number, truth, code = raw, None, None, kind
        if kind == "n":
            if raw is not None:
                number = float(raw)
                if fmt != "General" and _is_date(fmt):
                    text, number, code = python_text(serial(number, fmt, self.base_1904)), None, "d"
                else:
                    text = str(int(raw) if _INTEGER(raw) else number)
        elif kind == "s":
            text, code = self.strings[int(raw)] if raw is not None and int(raw) < len(self.strings) else None, "s"
        elif kind == "inlineStr":
            text, code = _texts(c), "s"
        elif kind == "b":
            truth = None if raw is None else raw.strip() == "1"
            text = python_text(truth)
        elif kind == "str":
            code = "s"
        if f is None:
            return text, number, truth, code, fmt, None
        formula = f.text or ""
        if f.get("t") == "shared":
            if formula:
                shared[f.get("si", "")] = (formula, row, col)
            elif f.get("si", "") in shared:
                base, r0, c0 = shared[f.get("si", "")]
                formula = shifted(base, row - r0, col - c0)
        return text, number, truth, "f", fmt, "=" + formula

    def assets(self) -> Iterator[dict]:
        """Images, charts and embedded objects, in sheet order; a payload that was already seen is dropped, whatever its kind."""
        seen: set[str] = set()
        for idx, (name, state, part) in enumerate(self.sheets):
            related = self.related(part or "")
            base = {"fact": "asset", "sheet_idx": idx, "sheet": name, "state": state}
            for r in related.values():
                if (r["part"] or "").startswith("xl/embeddings/"):
                    yield from self.asset(base, "attachment", r["part"], seen, {})
            for r in related.values():
                if r["rel_type"].endswith("/drawing") and (drawing := parse(self.parts.get(r["part"] or ""))) is not None:
                    inner = self.related(r["part"])
                    for anchor in drawing:
                        where = _anchor(anchor)
                        if where is None:
                            continue
                        for e in anchor.iter():
                            rid = next((v for k, v in e.attrib.items() if local(k) in ("embed", "id") and k.startswith("{")), None)
                            target = inner.get(rid, {}).get("part") if rid else None
                            if not target:
                                continue
                            kind = {"blip": "image", "chart": "chart", "oleObj": "attachment"}.get(local(e.tag))
                            if kind:
                                yield from self.asset(base, kind, target, seen, where)
                    for eq in drawing.iter():
                        if local(eq.tag) == "oMath":
                            yield base | {"kind": "equation", "text": _texts(eq)}

    def asset(self, base: dict, kind: str, part: str, seen: set[str], where: dict) -> Iterator[dict]:
        data = self.parts.get(part)
        if data is None:
            yield base | {"kind": kind, "filename": posixpath.basename(part), "warning": f"Asset part is missing: {part}"} | where
            return
        sha = hashlib.sha256(data).hexdigest()
        if sha in seen:
            return
        seen.add(sha)
        row = base | {"kind": kind, "filename": posixpath.basename(part), "sha256": sha, "size_bytes": len(data)} | where
        if kind == "chart" and (root := parse(data)) is not None:
            row |= chart_facts(root)
        yield row


def _anchor(e) -> dict | None:
    """0-based corner cells of a one-cell or two-cell anchor."""
    if local(e.tag) not in ("oneCellAnchor", "twoCellAnchor"):
        return None
    out = {}
    for side in e:
        if local(side.tag) in ("from", "to"):
            for x in side:
                if local(x.tag) in ("row", "col"):
                    out[f"{local(side.tag)}_{local(x.tag)}"] = int(x.text or 0)
    return out


def chart_facts(root) -> dict:
    """Title, names of the series, and categories of a chart."""
    title, series, categories = "", [], []
    for e in root.iter():
        if local(e.tag) == "title" and not title:
            title = _texts(e) or _texts(e, "v")
        if local(e.tag) == "ser":
            for x in e:
                if local(x.tag) == "tx":
                    series.append(_texts(x, "v") or _texts(x, "f"))
                if local(x.tag) == "cat" and not categories:
                    categories = [v.text or "" for v in x.iter() if local(v.tag) == "v"] or [v.text or "" for v in x.iter() if local(v.tag) == "f"]
    return {"title": title, "series": series, "categories": categories}


def _facts(workbook: str | None, data: bytes | None, assets: bool) -> Iterator[dict | tuple]:
    book, error = None, None
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            names = [n for n in z.namelist() if n.startswith("xl/") and not n.endswith("/")]
            streamed = {n for n in names if n.startswith("xl/worksheets/") and not n.endswith(".rels")}
            parts = {n: z.read(n) for n in names if n not in streamed}
            sound = {}
            for n in sorted(streamed):
                with z.open(n) as sheet:
                    sound[n] = _sound(sheet)
            if "xl/workbook.xml" in parts:
                book = _Book(workbook, parts, z, sound)
                parts |= {n: z.read(n) for n in streamed - {part for *_, part in book.sheets}}
                for k in range(len(book.sheets)):
                    yield from book.cells(k)
                if assets:
                    yield from book.assets()
    except UNREADABLE as e:
        if book:
            raise  # every part was read through before
        error = unreadable(e)
    if not book:
        yield {"fact": "warning", "warning": error or "Workbook part is missing: xl/workbook.xml"}


def facts_of(data: bytes | None, assets: bool = True) -> Iterator[dict]:
    for f in _facts(None, data, assets):
        yield f if isinstance(f, dict) else {"fact": "cell", **dict(zip(CELL[1:], f[1:], strict=True))}


def facts(workbooks: DataFrame, assets: bool = True) -> DataFrame:
    """(workbook, content) -> FACTS. Cells become columns by the batch, without a dict each."""
    kind = _parse_datatype_string(FACTS)
    arrow = to_arrow_schema(kind)

    def of_cells(cells: list[tuple]) -> pa.RecordBatch:
        n, got = len(cells), dict(zip(CELL, zip(*cells, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("cell"), n) if f.name == "fact" else pa.array(got[f.name], f.type) if f.name in got else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches):
        cells, others = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("workbook")[k].as_py()
                for f in _facts(name, batch.column("content")[k].as_py(), assets):
                    if isinstance(f, tuple):
                        cells.append(f)
                        if len(cells) >= FLUSH:
                            yield of_cells(cells)
                            cells = []
                    else:
                        others.append({"workbook": name} | f)
                        if len(others) >= FLUSH:
                            yield pa.RecordBatch.from_pylist(others, schema=arrow)
                            others = []
        if cells:
            yield of_cells(cells)
        if others:
            yield pa.RecordBatch.from_pylist(others, schema=arrow)

    return workbooks.select("workbook", "content").mapInArrow(run, kind)
