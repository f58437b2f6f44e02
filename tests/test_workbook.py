import json
import tracemalloc

import pytest

from paperloom.operators import workbook as X
from paperloom.plans import synthetic as S
from paperloom.sources import workbook as B
from paperloom.sources import writers as W


def facts(spark, *sheets, extra=None):
    return B.facts(spark.createDataFrame([("w", bytearray(W.xlsx(list(sheets), extra)))], "workbook string, content binary")).cache()


def split(spark, rows, **kw):
    return X.tables(facts(spark, {"name": "S", "rows": rows, **kw})).orderBy("table_no").collect()


def test_repeated_header(spark):
    head = ["name", "city", "note"]
    data = {1: head, 2: ["a", "b", "c"], 3: ["d", "e", "f"], 4: head, 5: ["g", "h", "i"], 6: head, 7: ["j", "k", "l"]}
    t = split(spark, data)
    assert [(r["start_row"], r["row_count"], r["boundary_signals"]) for r in t] == [(1, 3, ["header_repeat"]), (4, 2, ["header_repeat"]), (6, 2, [])]


@pytest.mark.parametrize(("gap", "starts"), [(2, [1, 5]), (1, [1])])
def test_blank_rows(spark, gap, starts):
    assert [r["start_row"] for r in split(spark, {1: ["a", "b"], 2: ["c", "d"], 3 + gap: ["e", "f"], 4 + gap: ["g", "h"]})] == starts


def test_sparse_columns_go(spark):
    [t] = split(spark, {1: ["h", None, "k", ""], 2: ["a", None, "b", ""], 4: ["c", "", "d"]})
    assert t["rows"] == [["h", "k"], ["a", "b"], ["c", "d"]] and t["end_row"] == 4


def test_metadata_merges_and_hidden(spark):
    f = facts(spark, {"name": "Fin", "rows": {1: ["Region", "Q1", "Q2", "Total"], 2: ["North", 10, 15, (25, "SUM(B2:C2)")], 3: ["South", 8, 11, (19, "SUM(B3:C3)")]}, "merges": ["A5:D5", "A1:B2"], "hidden_rows": [2], "hidden_cols": [3]}, {"name": "Hid", "rows": {1: [True, 1.5, "x"]}, "state": "hidden"}, {"name": "Empty", "rows": {}})
    m = {r["ref"]: r for r in X.cell_metadata(f).filter("sheet = 'Fin'").collect()}
    assert (m["D2"]["formula"], m["D2"]["display_value"], m["D2"]["data_type"]) == ("=SUM(B2:C2)", "25", "f")
    j = json.loads(X.table_json(f).filter("table_idx = 1").first()["json"])
    assert j["merged_ranges"] == ["A1:B2"] and j["hidden_rows"] == [2] and j["hidden_columns"] == ["C"] and j["cells"]["D3"]["formula"] == "=SUM(B3:C3)"
    w = json.loads(X.workbook_json(f).first()["json"])
    assert w["sheet_count"] == 3 and [s["state"] for s in w["sheets"]] == ["visible", "hidden", "visible"]
    assert X.cells(f).filter("sheet = 'Hid' and value_bool").count() == 1 and X.warnings(f).count() == 0
    from pyspark.sql import functions as F

    md = X.markdown(f, F.lit("w.xlsx")).first()["content"]
    assert "## Sheet: Fin" in md and "| North | 10 | 15 | 25 |" in md


def test_drawing_assets(spark):
    ns = 'xmlns:xdr="urn:xdr" xmlns:a="urn:a" xmlns:c="urn:c" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    anchor = lambda row, inner: f"<xdr:oneCellAnchor><xdr:from><xdr:col>3</xdr:col><xdr:row>{row}</xdr:row></xdr:from>{inner}</xdr:oneCellAnchor>"
    extra = {
        "xl/worksheets/_rels/sheet1.xml.rels": W.rels([("rId1", "drawing", "../drawings/drawing1.xml")]),
        "xl/drawings/drawing1.xml": f"<xdr:wsDr {ns}>" + anchor(1, '<c:chart r:id="rId1"/>') + anchor(2, '<a:blip r:embed="rId2"/>') + anchor(4, '<a:blip r:embed="rId3"/>') + "</xdr:wsDr>",
        "xl/drawings/_rels/drawing1.xml.rels": W.rels([("rId1", "chart", "../charts/chart1.xml"), ("rId2", "image", "../media/i.png"), ("rId3", "image", "../media/same.png")]),
        "xl/charts/chart1.xml": "<c><title><t>T</t></title></c>", "xl/media/i.png": b"pix", "xl/media/same.png": b"pix",
    }
    f = facts(spark, {"name": "S", "rows": {1: ["a", "b"], 2: ["c", "d"]}}, extra=extra)
    a = {r["asset_ref"]: r for r in X.assets(f).collect()}
    assert set(a) == {"chart_01", "image_01"} and a["chart_01"]["cell"] == "D2" and a["chart_01"]["title"] == "T"
    t = X.tables(f).first()
    assert t["end_row"] == 3
    j = json.loads(X.table_json(f).first()["json"])
    assert j["chart_count"] == 1 and j["image_count"] == 1


def test_bad_and_empty_workbooks(spark):
    f = B.facts(spark.createDataFrame([("bad", bytearray(b"x")), ("none", None), ("empty", bytearray(W.xlsx([{"name": "S", "rows": {}}])))], "workbook string, content binary"))
    w = {r["workbook"]: r["warning"] for r in X.warnings(f).collect()}
    assert set(w) == {"bad", "none", "empty"} and "did not contain" in w["empty"]
    assert X.tables(f).collect() == []


def test_formulas_and_dates():
    assert B.shifted("A1+$B$2*SUM(C3:D$4)&\"A1\"", 2, 1) == "B3+$B$2*SUM(D5:E$4)&\"A1\""
    assert str(B.serial(45000.5, "yyyy-mm-dd hh:mm", False)) == "2023-03-15 12:00:00" and str(B.serial(0.25, "h:mm", False)) == "06:00:00"
    assert B.split_ref("$AB$12") == (12, 28) and W.letters(28) == "AB"


def test_large_sheets_are_streamed():
    n = 40_000
    tail = '<hyperlinks><hyperlink ref="A3" location="here"/><hyperlink ref="Z9" location="there"/></hyperlinks>'
    data = W.xlsx([{"name": "S", "rows": {r: [r, r + 0.5, "t<", (r * 2, f"A{r}*2")] for r in range(1, n + 1)}, "merges": ["A1:B2"], "hidden_cols": [2], "hidden_rows": [7], "tail": tail}])
    tracemalloc.start()
    seen = {"cell": 0}
    for f in B.facts_of(data):
        seen[f["fact"]] = seen.get(f["fact"], 0) + 1
        if f["fact"] == "cell":
            assert f["ref"] == "Z9" or f["value"] == (str(f["row"]), f"{f['row'] + 0.5}", "t<", str(f["row"] * 2))[f["col"] - 1]
            assert f["hyperlink"] == {"A3": "here", "Z9": "there"}.get(f["ref"])
            assert f["formula"] == (f"=A{f['row']}*2" if f["col"] == 4 else None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == {"sheet": 1, "hidden_col": 1, "hidden_row": 1, "merge": 1, "cell": 4 * n + 1} and peak < 12 << 20


@pytest.mark.parametrize("n", [3, 20_000])
def test_broken_sheets_give_no_cells(n):
    sheet = "".join(f'<row r="{r}"><c r="A{r}"><v>1</v></c></row>' for r in range(1, n))
    parts = {"xl/workbook.xml": W._frame([{"name": "S"}])["xl/workbook.xml"], "xl/_rels/workbook.xml.rels": W.rels([("rId1", "worksheet", "worksheets/sheet1.xml")]), "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{sheet}</sheetData>"}
    assert [(f["fact"], bool(f["warning"])) for f in B.facts_of(W.zipped(parts))] == [("sheet", True)]


def test_synthetic_workbooks_by_the_batch(spark):
    values = [["1", "2.5", "a<b&", "1"], ["x", "NaN", "", None], [None, "7", None, "-3"], ["-4", "1.0E10", "é", "5"]]
    df = spark.createDataFrame([(w, r, v) for w in ("b", "a", None) for r, v in zip((9, 1, 4, 30), values, strict=True)], "workbook string, row int, values array<string>")
    books = S.workbooks(df, "idsi", formula=(3, "A{r}<B{r}"), merges=lambda at: [f"A{at[0]}:B{at[-1]}"])
    got = sorted(((r["workbook"] or "", r["row"], r["col"], r["value"], r["formula"]) for r in X.cells(B.facts(books)).collect()))
    rows = [(1, 1, "x", None), (1, 2, "nan", None), (1, 3, "", None), (1, 4, None, "=A1<B1"), (4, 2, "7.0", None), (4, 4, "-3", "=A4<B4"), (9, 1, "1", None), (9, 2, "2.5", None), (9, 3, "a<b&", None), (9, 4, "1", "=A9<B9"), (30, 1, "-4", None), (30, 2, "10000000000.0", None), (30, 3, "é", None), (30, 4, "5", "=A30<B30")]
    assert got == [(w, *r) for w in ("", "a", "b") for r in rows]
    assert {r["merge_ref"] for r in X.merged(B.facts(books)).collect()} == {"A1:B30"}
