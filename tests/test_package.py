import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.functions import text as T
from paperloom.operators import fidelity as E
from paperloom.operators import images as I
from paperloom.operators import package as P
from paperloom.plans import registry
from paperloom.sources import cfb, docx, ooxml
from paperloom.sources import services as V
from paperloom.sources import writers as W
from paperloom.streaming import ingest

CHART = (
    '<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><c:title><c:tx><c:rich><a:p><a:r><a:t>A [title]</a:t></a:r></a:p></c:rich></c:tx></c:title>'
    "<c:ser><c:tx><c:strRef><c:strCache><c:pt><c:v>One</c:v></c:pt></c:strCache></c:strRef></c:tx><c:cat><c:pt><c:v>x</c:v></c:pt><c:pt><c:v>y</c:v></c:pt></c:cat><c:val><c:pt><c:v>4.3</c:v></c:pt><c:pt><c:v>2</c:v></c:pt></c:val></c:ser></c:chartSpace>"
)
DIAGRAM = '<d xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:t>Plan</a:t><a:t>Do</a:t><a:t>Plan</a:t></d>'
BOOK = W.xlsx([{"name": "Q3", "rows": {1: ["Metric", "Value"], 2: ["Revenue", 1200], 3: ["Profit", 320]}}])


def frame(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "doc_id string, content binary")


def full():
    dm = '<w:r><w:drawing><dgm:relIds xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram" r:dm="rId4"/></w:drawing></w:r>'
    ch = '<w:r><w:drawing><c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" r:id="rId3"/></w:drawing></w:r>'
    body = W.paragraph("Top", "H1") + W.paragraph("Intro") + W.paragraph("See", inner=W.ole("rId2")) + W.paragraph("", inner=W.blip("rId1")) + W.paragraph("", inner=ch) + W.paragraph("", inner=dm) + W.word_table([["a|b", "c"], ["d", W.word_table([["□ in", "e"]])]]) + W.paragraph("■ yes")
    rels = [("rId1", "image", "media/image1.png"), ("rId2", "package", "embeddings/profit.xlsx"), ("rId3", "chart", "charts/chart1.xml"), ("rId4", "diagramData", "diagrams/data1.xml"), ("rId5", "hyperlink", "https://x.org"), ("rId6", "image", "media/gone.png")]
    styles = f'<w:styles xmlns:w="{ooxml.WORD}"><w:style w:styleId="H1"><w:name w:val="My own"/><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Base"><w:name w:val="heading 2"/></w:style></w:styles>'
    extra = {"word/media/image1.png": b"\x89PNG\r\n\x1a\nxx", "word/embeddings/profit.xlsx": BOOK, "word/charts/chart1.xml": CHART, "word/diagrams/data1.xml": DIAGRAM, "word/diagrams/layout1.xml": "<x/>", "word/embeddings/copy.xlsx": BOOK, "word/embeddings/other.txt": b"plain", "word/styles.xml": styles}
    return W.docx(body, rels, extra, external=("rId5",))


def test_assets_of_all_kinds(spark):
    a = P.assets(frame(spark, d=full(), bad=b"no zip")).cache()
    got = {r["ref"]: r for r in P.found(a).collect()}
    assert [(r["position"], r["ref"]) for r in sorted(got.values(), key=lambda r: r["position"])] == [(1, "attachment_01"), (2, "image_01"), (3, "chart_01"), (4, "diagram_01"), (5, "attachment_02")]
    assert got["attachment_01"]["detected_mime"] == docx.XLSX_MIME and got["attachment_01"]["anchor"]["paragraph_text"] == "See" and got["attachment_02"]["filename"] == "other.txt"
    assert "| Revenue | 1200 |" in got["attachment_01"]["preview_md"] and json.loads(got["attachment_01"]["preview_json"])["sheets"][0]["preview_rows"][1] == ["Revenue", 1200]
    assert json.loads(got["chart_01"]["preview_json"])["data_rows"] == [{"category": "x", "values": {"One": 4.3}}, {"category": "y", "values": {"One": 2}}]
    assert got["chart_01"]["markdown_reference"] == "[Chart 01: A \\[title\\]](resources/chart_01/preview.md)" and got["diagram_01"]["markdown_reference"] == "[SmartArt 01: Plan / Do](resources/diagram_01/preview.md)"
    assert got["diagram_01"]["related_parts"] == ["word/diagrams/layout1.xml"] and got["attachment_02"]["rel_id"] == "scan:word/embeddings/other.txt"
    assert got["image_01"]["sha256"] == hashlib.sha256(b"\x89PNG\r\n\x1a\nxx").hexdigest() and got["image_01"]["parse_status"]["status"] == "preserved"
    w = {(r["doc_id"], r["warning"][:20]) for r in P.warnings(a).collect()}
    assert w == {("d", "External relationshi"), ("d", "Embedded relationshi"), ("bad", "Input is not a reada")}
    docs = P.parse_main(frame(spark, d=full())).first()
    assert docs["content"].startswith("## Top\n\nIntro\n\nSee[profit.xlsx](resources/attachment_01/preview.md)\n\n![](assets/images/image_01.png)") and docs["content"].endswith("[other.txt](resources/attachment_02/preview.md)\n")
    assert "| a\\|b | c |" in docs["content"]
    m = json.loads(P.manifests(a.filter("doc_id = 'd'"), P.parse_main(frame(spark, d=full()))).first()["manifest"])
    assert m["parse_status"] == "partial" and m["content_stats"]["embedded_object_count"] == 2 and [x["ref"] for x in m["content_map"]["charts"]] == ["chart_01"]
    assert "  - ref: \"attachment_01\"" in P.child_files(a).filter("doc_id = 'd'").first()["child_files"] and "child_files: []" in P.child_files(a).filter("doc_id = 'bad'").first()["child_files"]
    entry = json.loads(P.resource_entries(a).orderBy("position").first()["json"])
    assert entry["risk"] == {"risk_level": "unassessed", "flags": []} and entry["path"] == "raw/embedded/attachment_01.xlsx"
    assert P.deduplicated(a).count() == 5 and P.embedded_workbooks(frame(spark, d=full())).count() == 1
    assert P.parse_logs(P.parse_main(frame(spark, d=W.docx(W.paragraph("x"))))).first()["log"] == "status: success\nwarnings: []\n"


def test_preview_images_of_objects_are_no_images(spark):
    run = W.ole("rId1").replace("</w:object>", '<v:imagedata xmlns:v="urn:v" r:id="rId2"/></w:object>')
    data = W.docx(W.paragraph("x", inner=run), [("rId1", "oleObject", "embeddings/a.txt"), ("rId2", "image", "media/p.png")], {"word/embeddings/a.txt": b"t", "word/media/p.png": b"p"})
    assert [r["ref"] for r in P.found(P.assets(frame(spark, d=data))).collect()] == ["attachment_01"]


def test_payload_ladder():
    native = cfb.write({"\x01Ole10Native": cfb.write_native("C:\\a\\report 1.pdf", b"%PDF-1")})
    assert docx.unwrap("oleObject1.bin", native) == ("report 1.pdf", b"%PDF-1", None)
    assert docx.unwrap("o.bin", cfb.write({"Package": BOOK}))[0] == "o.xlsx" and docx.unwrap("a.pdf", b"x") == ("a.pdf", b"x", None)
    assert docx.unwrap("o.bin", b"junk")[2].startswith("Unknown OLE")
    bare = cfb.MAGIC + b"\0\0\0\0notes.txt\0C:\\x\0" + b"\0" * 8 + b"x\0" + (5).to_bytes(4, "little") + b"hello"
    assert docx.unwrap("o.bin", bare, unsafe=True)[:2] == ("notes.txt", b"hello")
    assert docx.unwrap("o.bin", b"\x01\x02%PDF-1.4", unsafe=True)[:2] == ("o.pdf", b"%PDF-1.4") and docx.unwrap("o.bin", b"only text here", unsafe=True)[0] == "o.txt"
    big = bytes(range(256)) * 400
    assert cfb.streams(cfb.write({"a": big, "b": b"x"}))["a"] == big


def test_notes():
    foot = f'<w:footnotes xmlns:w="{ooxml.WORD}"><w:footnote w:id="-1" w:type="separator"><w:p/></w:footnote><w:footnote w:id="1">{W.paragraph("First  note")}</w:footnote></w:footnotes>'
    end = foot.replace("footnote", "endnote").replace("First", "Last")
    ref = lambda k: f'<w:r><w:{k}Reference w:id="1"/></w:r><w:r><w:t> tail.</w:t></w:r>'
    parts = docx.read_zip(W.docx(W.paragraph("Alpha", inner=ref("footnote")) + W.paragraph("Omega", inner=ref("endnote")), [], {"word/footnotes.xml": foot, "word/endnotes.xml": end}))[0]
    found = docx.notes(parts)
    assert [(n["sequence"], n["kind"], n["text"], n["before_context"]) for n in found] == [(1, "footnote", "First note", "Alpha"), (2, "endnote", "Last note", "Omega")]
    assert docx.with_notes("Alpha tail.\n\nOmega tail.\n", found) == "Alpha [^1] tail.\n\nOmega [^2] tail.\n\n[^1]: First note\n\n[^2]: Last note\n"
    broken = "Alpha[[1]](#footnote-1) tail.\n\nOmega<sup><a href=\"#endnote-1\">[1]</a></sup> tail.\n\n1. First note [↑](#footnote-ref-1)\n"
    assert docx.with_notes(broken, found).startswith("Alpha[^1] tail.\n\nOmega[^2] tail.\n\n[^1]: First")
    done = docx.with_notes(broken, found)
    assert docx.with_notes(done, found) == done and docx.with_notes("x", []) == "x"


def test_sentinels_resolve_whatever_the_escapes():
    refs = {"image_01": "![](i)", "chart_01": "[c](c)", "attachment_01": "[a](a)"}
    out = docx.placed("x [[LOOM_ASSET:image_01]] y [[LOOM\\_ASSET:chart\\_01]] \\[\\[LOOM_ASSET:none\\]\\]", refs)
    assert out == "x ![](i) y [c](c) \\[\\[LOOM_ASSET:none\\]\\]\n\n[a](a)\n"


def test_marked_documents_are_placed(spark):
    d = frame(spark, d=full())
    m = P.marked(d)
    assert P.found(P.assets(m)).filter("rel_id not like 'scan:%'").count() == 4
    text = P.parse_main(m, "native-pure")
    assert "See[[LOOM_ASSET:attachment_01]]" in text.first()["content"]
    done = P.place(text, P.assets(d)).first()["content"]
    assert "See[profit.xlsx](resources/attachment_01/preview.md)" in done and "LOOM" not in done and done.endswith("[other.txt](resources/attachment_02/preview.md)\n")


def test_command_line(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(W.docx(W.paragraph("fine")))
    assert main(["batch", str(src), str(tmp_path / "o1")], spark) == 0
    (src / "b.docx").write_bytes(b"bad")
    assert main(["batch", str(src), str(tmp_path / "o2"), "--main-parser", "sectioned"], spark) == 2
    assert main(["pipeline", str(src / "a.docx"), str(tmp_path / "o3")], spark) == 0 and main(["parser", "pandoc", str(src / "a.docx"), str(tmp_path / "o4")], spark) == 1


def test_groundtruth_scores_its_own_package(spark):
    gt = P.groundtruth(frame(spark, **{"a/d.docx": full()}))
    row = gt.first()
    e = json.loads(row["expected"])
    assert row["doc_id"] == "d" and e["tables"] == [{"index": 0, "rows": 2, "cols": 2}] and e["nested_tables"][0]["depth"] == 1 and e["headings"] == [{"level": 2, "text": "Top"}]
    assert [c["text"] for c in e["checkboxes"]] == ["□ in", "■ yes"] and e["charts"][0]["texts"] == ["A [title]", "One", "x", "y"] and e["smartarts"][0]["texts"] == ["Plan", "Do"] and e["embedded_objects"][0]["sheets"] == 1
    content = P.parse_main(frame(spark, d=full())).first()["content"]
    p = spark.createDataFrame([("d", "m", content, [("attachment_01", "Revenue"), ("chart_01", "A [title] One x y"), ("diagram_01", "Plan Do")], ([("attachment_01", "p", None, "f")], [("image_01", "p", None, "f")]), [])], "doc_id string, method string, body string, extra array<struct<ref:string,text:string>>, manifest struct<" + E.MANIFEST.replace(" ARRAY", ":array").replace(" STRING", ":string").replace(" INT", ":int") + ">, files array<string>")
    s = {r["dimension"]: r["score"] for r in E.scores(E.checks(p, gt)).collect()}
    assert s["embedded_object_recall"] == s["table_recall"] == s["heading_recall"] == s["checkbox_recall"] == s["chart_text_recall"] == s["smartart_text_recall"] == 1.0
    assert P.new_groundtruth(gt, gt).count() == 0 and P.new_groundtruth(gt, gt, force=True).count() == 1


def test_parsers(spark):
    d = frame(spark, **{"x/d.docx": full()})
    for name in ("markitdown", "native", "ragflow", "sectioned-pure"):
        assert P.parse_main(d, name).first()["parser"] == name
    assert "<table>" in P.parse_main(d, "ragflow").first()["content"] and "Table Location: d &gt; Top" in P.parse_main(d, "ragflow").first()["content"]
    for name in ("pandoc", "docling", "mineru-pipeline", "nonsense"):
        r = P.parse_main(d, name).first()
        assert r["content"] == "" and len(r["warnings"]) == 1
    P.register_parser("own", lambda p: p.select("doc_id", F.lit("").alias("parser"), F.lit("hi").alias("content"), F.array().cast("array<string>").alias("warnings")))
    assert P.parse_main(d, "own").first()["content"] == "hi"


def test_scan_write_and_stream(spark, tmp_path):
    src = tmp_path / "in" / "sub"
    src.mkdir(parents=True)
    (src / "a.docx").write_bytes(full())
    (src / "~$a.docx").write_bytes(b"lock")
    (src / "b.txt").write_bytes(b"no")
    found = ooxml.scan(spark, str(tmp_path / "in"))
    assert found.count() == 1 and ooxml.parts(found).filter("part = 'word/document.xml'").count() == 1
    P.write(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/manifests")).count() == 1 and len(spark.read.text(str(tmp_path / "out/embedded_resources")).collect()) == 5
    for want in (1, 2):
        ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "sink")).count() == want
        (src / "c.docx").write_bytes(W.docx(W.paragraph("new")))


def test_sql_functions(spark):
    registry.register(spark)
    frame(spark, d=full()).createOrReplaceTempView("pk")
    assert spark.sql("select part from pk, lateral docx_parts(content)").count() == 11
    assert spark.sql("select n_rows from parse_tables('| a | b |\n|---|---|\n| 1 | 2 |')").first()["n_rows"] == 2
    spark.createDataFrame([(bytearray(BOOK),)], "b binary").createOrReplaceTempView("bk")
    assert spark.sql("select value from bk, lateral xlsx_cells(b) where ref = 'B2'").first()["value"] == "1200"


def test_statuses_and_empty_inputs(spark):
    codes = lambda *c: E.exit_status(spark.createDataFrame([(x,) for x in c], "code int")).first()["status"]
    assert codes(0, 0) == 0 and codes(0, 2) == 2 and codes(2, 1) == 1
    s = spark.createDataFrame([("logo", "failed"), ("failed", "generated"), ("failed", "x"), ("not_configured", "not_configured"), ("x", "not_configured")], "o string, c string")
    assert [r[0] for r in s.select(I.combined_status(F.col("o"), F.col("c"))).collect()] == ["logo", "generated", "partial_failed", "not_configured", "not_generated"]
    none = spark.createDataFrame([], "doc_id string, content binary")
    assert P.assets(none).collect() == [] and P.parse_main(none).collect() == [] and P.groundtruth(none).collect() == []
    nulls = spark.createDataFrame([("n", None), (None, bytearray(b"x"))], "doc_id string, content binary")
    assert P.warnings(P.assets(nulls)).count() == 2 and P.parse_main(nulls).count() == 2
    assert spark.range(1).select(T.safe_filename(F.lit("a\\b/ü x?.txt"))).first()[0] == docx.safe_name("a\\b/ü x?.txt") == "_ x_.txt"
    with pytest.raises(ValueError):
        docx.chart(b"no xml")


def test_services(spark):
    reply = W.zipped({"out/deep/z.md": "no", "out/d.md": "# D\n\n![a](images/p.png) ![b](https://x/y.png) ![c](gone.png)", "out/images/p.png": b"pix"})
    env = {"MINERU_AUTHORIZATION": "k", "MINERU_ENDPOINT": "http://nowhere"}
    assert set(V.services(env)) == set(V.BACKENDS) and V.services({}) == {}
    r = V.services(env, lambda url, head, body, wait: (reply, "application/zip"))["mineru-pipeline"](frame(spark, **{"x/d.docx": b"data"})).first()
    assert r["content"] == "# D\n\n![a](assets/images/mineru-pipeline/images/p.png) ![b](https://x/y.png) ![c](gone.png)\n" and r["images"][0]["content"] == b"pix" and r["warnings"] == []

    def lost(url, head, body, wait):
        raise OSError("no route")

    assert V.services(env, lost)["mineru"](frame(spark, d=b"x")).first()["warnings"] == ["mineru service request failed: no route"]
    ok = json.dumps({"status": "completed", "results": {"other": {"md_content": "o"}, "d": {"md_content": "mine"}}}).encode()
    assert V.decode(ok, "application/json", "d")[0] == "mine\n" and V.decode(json.dumps({"status": "success", "document": {"md_content": "doc"}}).encode(), "", "d")[0] == "doc\n"
    for bad in (b"nope", b"{}", json.dumps({"status": "failure"}).encode(), W.zipped({"a.txt": "x"}), W.zipped({"../a.md": "x"}), b"PK\x03\x04junk"):
        with pytest.raises(ValueError):
            V.decode(bad, "", "d")
    body, kind = V.multipart("d.docx", b"data", {"a": ["1", "2"], "b": "c"})
    assert body.count(kind.partition("=")[2].encode()) == 5 and b'filename="d.docx"' in body
    assert V.best_markdown(["b/x/d.md", "a.md", "d.txt"], "d") == "b/x/d.md" and V.best_markdown(["b/c.md", "a.md"], "d") == "a.md"


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (400).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (40).to_bytes(2, "big") + (2000).to_bytes(2, "big")
    assert I.dimensions(png) == (300, 400) and I.dimensions(jpg) == (2000, 40) and I.dimensions(b"x") is I.dimensions(None) is None
    rows = [("w", "S", "image_01", "B2", "image_01.png", bytearray(png)), ("w", "数据表", "image_02", None, "image_02.jpg", bytearray(jpg)), ("w", "S", "image_03", None, "my-logo.png", None), ("w", "数据表", "image_04", None, "x.bin", None)]
    got = {r["asset_ref"]: r for r in I.described(spark.createDataFrame(rows, "workbook string, sheet string, asset_ref string, cell string, filename string, content binary")).collect()}
    assert [got[f"image_0{k}"]["semantic_status"] for k in (1, 2, 3, 4)] == ["not_configured", "logo", "logo", "not_configured"]
    assert "anchored at cell B2" in got["image_01"]["description"] and got["image_02"]["description"] is None
