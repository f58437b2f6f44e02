import json
import time

import pytest
from pyspark.sql import functions as F

from paperloom import __main__ as cli
from paperloom.functions import text as T
from paperloom.operators import evaluation as V
from paperloom.operators import fidelity as E
from paperloom.operators import markdown as M
from paperloom.plans import synthetic as S

PACKAGE = "doc_id string, method string, body string, extra array<struct<ref:string,text:string>>, manifest struct<" + "embedded_objects:array<struct<ref:string,path:string,markdown_reference:string,filename:string>>,images:array<struct<ref:string,path:string,markdown_reference:string,filename:string>>>, files array<string>"


def dims(spark, body, expected, extra=(), objects=(), images=(), files=()):
    asset = lambda r: {"ref": r, "path": f"assets/images/{r}.png", "markdown_reference": None, "filename": f"{r}.png"}
    p = spark.createDataFrame([{"doc_id": "d", "method": "m", "body": body, "extra": [{"ref": r, "text": t} for r, t in extra], "manifest": {"embedded_objects": [asset(r) for r in objects], "images": [asset(r) for r in images]}, "files": list(files)}], PACKAGE)
    e = spark.createDataFrame([("d", json.dumps(expected))], "doc_id string, expected string")
    c = E.checks(p, e)
    return {r["dimension"]: r["score"] for r in E.scores(c).collect()}, [r["miss"] for r in E.misses(c).collect()]


def test_table_parsers():
    grid = "+---+---+---+\n| a | b | c |\n+===+===+===+\n| 1 | 2 | 3 |\n+---+---+---+\n| 4 | 5     |\n|   +---+---+\n|   | 6 | 7 |\n+---+---+---+"
    [t] = M.parse_tables("text\n\n" + grid.partition("\n")[2])[:1]
    assert t[2] == 3
    assert M.parse_tables("| a | b |\n|---|:-:|\n| x \\| y | z |") == [("pipe", 2, 2, [["a", "b"], ["x | y", "z"]])]
    assert M.parse_tables("a      b\n-----  -----\n1      2\n3\n-------------") == [("simple", 3, 2, [["a", "b"], ["1", "2"], ["3", ""]])]
    multi = "-----------------\nName   Age  Note\n-----  ---  -----\nAnn    5    long\n            text\n\nBob    6    x\n-----------------"
    assert M.parse_tables(multi)[0][:3] == ("simple", 3, 3)
    assert M.parse_tables('<table><tr><td>一级</td><td colspan="2">指标项</td></tr></table>') == [("html", 1, 3, [["一级", "指标项", "指标项"]])]
    assert M.parse_tables("above\n\n---\n\nbelow") == []
    nested = M.parse_tables("| outer | +---+---+ |\n|       | | a | b | |\n|       | +---+---+ |\n|       | | c | d | |\n|       | +---+---+ |")
    assert [t[0] for t in nested] == ["pipe", "grid"]


def test_markdown_table_is_linear(spark):
    n = 24_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.array(F.concat(F.lit("a|"), k), k.cast("string"), F.lit(None))).alias("r"))
    began = time.monotonic()
    got = rows.select(T.markdown_table(F.concat(F.array(F.array(F.lit("h"))), F.col("r"))).alias("t")).first()["t"]
    assert time.monotonic() - began < 40
    assert got[:3] == ["| h |  |  |", "| --- | --- | --- |", "| a\\|1 | 1 |  |"] and len(got) == n + 2
    one = spark.createDataFrame([([],), (None,), ([["x"]],)], "r array<array<string>>").select(T.markdown_table(F.col("r")).alias("t")).collect()
    assert [x["t"] for x in one] == [[], [], ["| x |", "| --- |"]]


def test_plain_html_as_in_sql(spark):
    pages = ["<p>a &amp b &copy</p>", "&amp;quot; &lt; &quot;x&quot;", "\u00a0 \x0bx\x0b\u2003\n", None, "<b\n>y</b>&middot;&copy;<"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = [r["t"] for r in df.orderBy("i").select(T.plain_html_col(F.col("html")).alias("t")).collect()]
    assert got == ["a &amp b &copy", '&quot; &lt; "x"', "\x0bx\x0b", None, "y·©<"]


def test_normal_forms():
    assert T.semantic("CO<sub>2</sub> &gt; x² and S_{\\mathbf{down}} group \\_ loss") == "co2 > x2 and s_{down}} group_loss"
    assert T.loose("## **1.1 Education**") == "## 1.1 education"
    assert T.strip_marks("a\\\\_b `c` *d*") == "a_b c d"
    assert T.semantic("<3800 and >2100 A\\times B × C — d") == "<3800 and >2100 a\\times b times c - d".replace("\\times", "times")


def test_recalls(spark):
    body = "# Doc\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n□ yes ■ no\n□ yes\n\n[^1] see https://X.org/a ![](assets/images/image_01.png)\n\n## Table of Contents\n\nIntro\n\n## Intro\n\n1. First\n\n| 2. | anchor two |\n"
    expected = {
        "embedded_objects": [{"ref": "attachment_01"}, {"ref": "attachment_02"}], "images": [{"ref": "image_01"}], "tables": [{"index": 0, "rows": 2, "cols": 3}, {"index": 1, "rows": 9, "cols": 9}],
        "headings": [{"level": 1, "text": "Doc"}, {"level": 2, "text": "Intro"}], "key_texts": ["see https", "absent"], "checkboxes": [{"text": "□ yes"}, {"text": "□ yes"}, {"text": "□ yes"}, {"text": "plain"}],
        "footnotes": [{"id": "1", "text": "see", "anchor_before": "YES", "anchor_after": "see"}], "hyperlinks": [{"url": "https://x.org/a"}], "toc": [{"text": "Intro"}, {"text": "First"}], "textboxes": [],
        "numbered_items": [{"number": "1", "text": "First"}, {"number": "3", "text": "First"}], "table_numbered_items": [{"number": "2", "anchor": "anchor two"}], "formulas": [{"label": "f", "tokens": ["a b", "zz"]}],
        "table_cell_checks": [{"table_index": 0, "cells": [{"row": 1, "col": 1, "text": "2"}, {"row": 7, "col": 0, "text": "x"}]}], "asset_anchors": [{"ref": "image_01", "before": "see", "after": "Table"}],
        "embedded_content": [{"ref": "attachment_01", "texts": ["Revenue", "Loss"]}], "charts": [{"texts": ["Revenue", "Q9"]}], "smartarts": [{"texts": ["Revenue"]}, {"texts": []}], "nested_tables": [{"rows": 2, "cols": 2, "texts": ["a", "b"]}], "markdown_portability": True,
    }
    got, miss = dims(spark, body, expected, extra=[("attachment_01", "Revenue 1200")], objects=["attachment_01"], images=["image_01"], files=["structured/assets/images/image_01.png"])
    want = {
        "embedded_object_recall": 0.5, "image_recall": 1.0, "table_recall": 0.5, "heading_recall": 1.0, "heading_tree_score": 1.0, "key_text_hit": 0.5, "checkbox_recall": 2 / 3, "footnote_recall": 1.0,
        "footnote_anchor_accuracy": 1.0, "hyperlink_recall": 1.0, "toc_recall": 0.5, "numbering_recall": 0.5, "table_numbering_recall": 1.0, "formula_recall": 0.5, "table_cell_match": 0.5, "asset_anchor_accuracy": 1.0,
        "embedded_content_hit": 0.5, "chart_text_recall": 0.5, "smartart_text_recall": 1.0, "nested_table_recall": 1.0, "markdown_portability": 1.0,  # one image, and it exists
    }
    assert got == pytest.approx(want)
    assert "absent" in miss and "f" not in miss


def test_heading_shift(spark):
    exp = lambda *hs: {"headings": [{"level": lv, "text": t} for lv, t in hs]}
    assert dims(spark, "## A\n\n### B\n", exp((1, "A"), (2, "B")))[0]["heading_tree_score"] == 1.0
    assert dims(spark, "## A\n\n## B\n", exp((1, "A"), (2, "B")))[0]["heading_tree_score"] < 1.0
    assert dims(spark, "## A\n", exp((1, "A")))[0]["heading_tree_score"] == pytest.approx(2 / 3)
    assert dims(spark, "A\n===\n", exp((1, "Z"), (1, "A")))[0]["heading_recall"] == 0.0  # a miss uses the list up


def test_summary(spark):
    c = spark.createDataFrame([("d", "m", "toc_recall", 0, 1.0, 1.0, None), ("d", "m", "image_recall", 1, 0.0, 1.0, "x")], "doc_id string, method string, dimension string, seq int, ok double, total double, miss string")
    p = spark.createDataFrame([("d", "m"), ("e", "m")], "doc_id string, method string")
    s = E.scores(c)
    gt = spark.createDataFrame([("d", "{}"), ("e", "{}")], "doc_id string, expected string")
    d = E.doc_scores(s, p.unionByName(spark.createDataFrame([("no ground truth", "m")], p.schema)), gt)
    assert {r["doc_id"]: r["doc_score"] for r in d.collect()} == {"d": 0.5, "e": 0.0}
    row = E.summary(s, d).first()
    assert row["n_docs"] == 2 and row["toc_recall"] == 1.0 and row["key_text_hit"] is None
    assert E.misses_report(E.misses(c)).first()["report"] == "## m\n\n### d\n\n- image_recall: x"


def test_gold_metrics(spark):
    df = spark.createDataFrame([("a b c", "b c d", [1, 2, 2], [1, 2])], "g string, c string, gl array<int>, cl array<int>")
    r = df.select(E.token_f1(F.col("g"), F.col("c")).alias("f1"), E.level_similarity(F.col("gl"), F.col("cl")).alias("lv")).first()
    assert r["f1"] == pytest.approx(2 / 3) and r["lv"] == pytest.approx(2 / 3)
    cells = lambda rows: spark.createDataFrame([("d", "m", 0, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], "doc_id string, method string, table_idx int, row_idx int, col_idx int, cell string")
    assert E.cell_match(cells([["A", "b"], ["1", "2"]]), cells([["a", "b"], ["1", "3"]])).first()["ratio"] == 0.75


def test_levels_are_compared_after_the_common_shift(spark):
    rows = [([1, 2, 2], [2, 3, 3], 1.0), ([1, 2], [3, 4], 1.0), ([1, 2, 3], [2, 2, 5], 1 / 3), ([1], [2], 0.0), ([1, 2, 1, 2], [2, 3, 1, 2], 0.5), ([], [1], None), ([1, 2], [], 0.0), ([1, 1, 2], [2, 2], 2 / 3)]
    got = spark.createDataFrame([(k, g, c) for k, (g, c, _) in enumerate(rows)], "k int, g array<int>, c array<int>").select("k", E.level_similarity(F.col("g"), F.col("c")).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [pytest.approx(x) if x is not None else None for _, _, x in rows]


def test_evaluation_of_folders(spark, tmp_path):
    pack, gt, out = tmp_path / "packages", tmp_path / "gt", tmp_path / "out"
    for doc, method in (("a", "m1"), ("a", "m2"), ("unknown", "m1")):
        at = pack / doc / method / "structured"
        (at / "resources" / "attachment_01").mkdir(parents=True)
        (at / "content.md").write_text("# Title\n\nkey one\n\n![](assets/x.png)\n" if method == "m1" else "nothing")
        (at / "resources" / "attachment_01" / "preview.md").write_text("key two")
        (at / "assets").mkdir()
        (at / "assets" / "x.png").write_bytes(b"\x89PNG")
        (at.parent / "manifest.json").write_text(json.dumps({"content_map": {"embedded_objects": [{"ref": "attachment_01", "path": "p"}], "images": []}}))
    gt.mkdir()
    expected = {"embedded_objects": [{"ref": "attachment_01"}], "headings": [{"level": 1, "text": "Title"}], "key_texts": ["key one", "key two"], "markdown_portability": True}
    (gt / "a.json").write_text(json.dumps({"doc_id": "", "expected": expected}, indent=1))
    (gt / "b.json").write_text(json.dumps({"doc_id": "never converted", "expected": {}}))
    assert cli.main(["eval", str(pack), str(gt), str(out)], spark) == 0
    tsv = lambda name: [r.asDict() for r in spark.read.option("sep", "\t").option("header", True).csv(str(out / name)).collect()]
    rows = {(r["doc_id"], r["method"]): r for r in tsv("results")}
    assert set(rows) == {("a", "m1"), ("a", "m2")}
    assert {k: v for k, v in rows["a", "m1"].items() if v != "-"} == {"doc_id": "a", "method": "m1", "embedded_object_recall": "1.0000", "heading_recall": "1.0000", "heading_tree_score": "1.0000", "key_text_hit": "1.0000", "markdown_portability": "1.0000", "doc_score": "1.0000"}
    assert rows["a", "m2"]["key_text_hit"] == "0.5000" and rows["a", "m2"]["heading_recall"] == "0.0000"
    assert {r["method"]: r["n_docs"] for r in tsv("summary")} == {"m1": "1", "m2": "1"}
    assert {(r["method"], r["missing"]) for r in tsv("misses")} >= {("m2", "key one"), ("m2", "L1 Title")} and "## m2" in spark.read.text(str(out / "misses_report")).first()["value"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.json").write_text(json.dumps({"doc_id": "c", "expected": {}}))
    assert cli.main(["eval", str(pack), str(tmp_path / "none"), str(tmp_path / "out2")], spark) == 1


def test_parents(spark):
    docs = spark.createDataFrame([("d", "# A\n\ntext\n\n### B\n\nC\n---\n\n#### E\n\n# D\n\n### F\n\n## G\n\n### H")], "doc_id string, content string")
    h = M.parents(M.headings(M.lines(docs, "content", "doc_id"), "doc_id"), "doc_id")
    assert [(r["level"], r["text"], r["parents"]) for r in h.orderBy("line_no").collect()] == [(1, "A", []), (3, "B", ["A"]), (2, "C", ["A"]), (4, "E", ["A", "C"]), (1, "D", []), (3, "F", ["D"]), (2, "G", ["D"]), (3, "H", ["D", "G"])]


def many(spark, n=40):
    return S.converted(spark.range(n).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal")).coalesce(1))


def test_conversions_are_spread(spark):
    at = E.checks(*many(spark)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert at == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_wide_scores_take_one_pass(spark):
    packages, expected = many(spark)
    scores = E.scores(E.checks(packages, expected))
    packages = packages.unionByName(packages.limit(1).withColumn("doc_id", F.lit("no checks")))
    expected = expected.unionByName(spark.createDataFrame([("no checks", "{}")], expected.schema))
    wide = E.doc_scores(scores, packages, expected, E.DIMENSIONS)
    summary, results = E.wide_summary(wide), V.wide_results(wide)
    for df in (summary, results):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    docs = E.doc_scores(scores, packages, expected)
    shown = lambda df, by: [[f"{x:.9g}" if isinstance(x, float) else x for x in r] for r in df.orderBy(by).collect()]
    assert shown(summary, "method") == shown(E.summary(scores, docs).select(summary.columns), "method")
    assert shown(results, "doc_id") == shown(V.results(scores, docs), "doc_id") and len(shown(results, "doc_id")) == 41


def test_normal_forms_of_odd_texts():
    assert T.semantic(" A\x1cb　 C ") == T.loose(" A\x1cb　 C ") == "a b c"
    assert T.semantic("a -- b ― c &amp;lt; x^2 _ y <b>z</b>") == "a - b - c &lt; x2_y z"
