"""Office packages made of relational tables, one a group: the inputs of queries over tables that hold no packages."""

from __future__ import annotations

import json

from collections.abc import Callable
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flat_map import flat_map
from ..sources import cfb
from ..sources import writers as W

_KINDS = {"s": str, "i": int, "d": float}


def _typed(kind: str, text: str | None) -> object:
    try:
        return None if text is None else _KINDS[kind](text)
    except ValueError:
        return text


def line(*cols: Column) -> Column:
    """A sheet's row as texts."""
    return F.array(*(c.cast("string") for c in cols))


#: Texts that Python's int() or float() reads as a number of their kind: they are written as they are.
_PLAIN = {"i": r"^-?[0-9]+$", "d": r"^-?[0-9]+\.[0-9]+(E-?[0-9]+)?$"}


def _cells(rows: pa.Array, values: pa.Array, col: int, kind: str, formula: str | None) -> pa.Array:
    """The XML of a column's cells; '' where there is none."""
    at, join = W.letters(col), lambda *parts: pc.binary_join_element_wise(*parts, "", null_handling="emit_null")
    ref = pc.cast(rows, pa.string())
    if kind in _PLAIN and pc.all(pc.match_substring_regex(values, _PLAIN[kind]), min_count=0).as_py() and not (formula and values.null_count):
        f = [] if formula is None else ["<f>", *[x for k, part in enumerate(escape(formula).split("{r}")) for x in ([ref] if k else []) + [part]], "</f>"]
        xml = join(f'<c r="{at}', ref, '">', *f, "<v>", values, "</v></c>")
    elif kind == "s" and formula is None:
        for char, name in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
            values = pc.replace_substring(values, char, name)
        xml = join(f'<c r="{at}', ref, '" t="inlineStr"><is><t xml:space="preserve">', values, "</t></is></c>")
    else:
        xml = pa.array([W.cell_xml(r, col, _typed(kind, v), formula and formula.format(r=r)) for r, v in zip(rows.to_pylist(), values.to_pylist(), strict=True)], pa.string())
    return pc.fill_null(xml, "")


def workbooks(rows: DataFrame, kinds: str, formula: tuple[int, str] | None = None, merges: Callable[[list[int]], list[str]] | None = None) -> DataFrame:
    """(workbook, row, values) -> (workbook, content): one sheet each. kinds has a letter a column: s, i or d.

    formula (n, text) makes column n (from 0) a formula, {r} being its row, with the value that it has as its cached one; merges gives the
    merged ranges of a sheet's rows. Rows go to Python in order and into the sheet by the batch, so no workbook is ever whole as objects.
    """
    schema = pa.schema([("workbook", pa.string()), ("content", pa.binary())])

    def run(batches):
        name, book, seen = None, None, []
        done = lambda: pa.RecordBatch.from_pylist([{"workbook": name, "content": book.close(merges(seen) if merges else [])}], schema)
        for batch in batches:
            at, values = batch.column("row"), batch.column("values")
            flat, n = values.flatten(), len(kinds)
            if len(flat) != n * len(at):
                raise ValueError(f"rows must have {n} values")
            column = lambda k: flat.take(pa.array(np.arange(k, len(flat), n)))  # noqa: E731, B023
            cells = [_cells(at, column(k), k + 1, kind, formula[1] if formula and formula[0] == k else None) for k, kind in enumerate(kinds)]
            xml = pc.cast(pc.binary_join_element_wise('<row r="', pc.cast(at, pa.string()), '">', *cells, "</row>", ""), pa.large_string())
            ends = np.frombuffer(xml.buffers()[1], np.int64)
            for first, last, key in _runs(batch.column("workbook")):
                if book is None or key != name:
                    if book:
                        yield done()
                    name, book, seen = key, W.Growing("Data"), []
                book.add(memoryview(xml.buffers()[2])[ends[first] : ends[last]])
                if merges:
                    seen += at.slice(first, last - first).to_pylist()
        if book:
            yield done()

    # the number of rows of a workbook isn't known before: a partition has whole workbooks, one after the other
    ordered = rows.select("workbook", "row", "values").repartition("workbook").sortWithinPartitions("workbook", "row")
    return ordered.mapInArrow(run, "workbook string, content binary")


def _runs(keys: pa.Array):
    """(first, last, key) of each run of equal keys."""
    runs = pc.run_end_encode(keys)
    first = 0
    for last, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
        yield first, last, key
        first = last


def numbered(df: DataFrame, group: str, *order: Column | str, name: str = "k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def documents(items: DataFrame, key: str) -> DataFrame:
    """(key, k, name, text, payload) -> DOCX (doc_id, content): a paragraph an item, in order of k, with its payload as a text attachment;
    and a logo that nothing refers to."""
    docs = items.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("k", "name", "text", "payload"))).alias("items"))

    def decode(x: dict):
        body, rels, extra = W.paragraph("Items"), [], {"word/media/logo.png": f"PNG {x['doc_id']}".encode()}
        for it in x["items"]:
            rid = f"rId{it['k']}"
            body += W.paragraph(it["text"], inner=W.ole(rid))
            rels.append((rid, "package", f"embeddings/{it['name']}"))
            extra[f"word/embeddings/{it['name']}"] = it["payload"]
        yield {"doc_id": x["doc_id"], "content": W.docx(body, [*rels, ("rIdLogo", "image", "media/logo.png")], extra)}

    return flat_map(docs, decode, "doc_id string, content binary", flush=16)


def scanned(items: DataFrame, key: str) -> DataFrame:
    """(key, name, payload) -> DOCX whose attachments nothing refers to."""
    docs = items.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.collect_list(F.struct("name", "payload")).alias("items"))

    def decode(x: dict):
        yield {"doc_id": x["doc_id"], "content": W.docx(W.paragraph("Scan"), [], {f"word/embeddings/{i['name']}": i["payload"] for i in x["items"]})}

    return flat_map(docs, decode, "doc_id string, content binary", flush=16)


def noted(items: DataFrame, key: str) -> DataFrame:
    """(key, k, text, note) -> DOCX with a footnote a paragraph."""
    docs = items.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("k", "text", "note"))).alias("items"))

    def decode(x: dict):
        body = "".join(W.paragraph(i["text"], inner=f'<w:r><w:footnoteReference w:id="{i["k"]}"/></w:r>') for i in x["items"])
        foot = "".join(f'<w:footnote w:id="{i["k"]}">{W.paragraph(i["note"])}</w:footnote>' for i in x["items"])
        sep = '<w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote>'
        yield {"doc_id": x["doc_id"], "content": W.docx(body, [], {"word/footnotes.xml": f'<w:footnotes xmlns:w="{W._W}">{sep}{foot}</w:footnotes>'})}

    return flat_map(docs, decode, "doc_id string, content binary", flush=16)


def nested(items: DataFrame, key: str) -> DataFrame:
    """(key, k, cells) -> DOCX with a table of a row an item, whose second cell holds a table of the item's cells."""
    docs = items.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("k", "cells"))).alias("items"))

    def decode(x: dict):
        body = W.word_table([[str(i["k"]), W.word_table([i["cells"]])] for i in x["items"]])
        yield {"doc_id": x["doc_id"] + ".docx", "content": W.docx(body)}

    return flat_map(docs, decode, "doc_id string, content binary", flush=16)


def ole(items: DataFrame) -> DataFrame:
    """(doc_id, name, payload) -> DOCX with the payload inside a compound file."""

    def decode(x: dict):
        data = cfb.write({"\x01Ole10Native": cfb.write_native(x["name"], x["payload"])})
        yield {"doc_id": str(x["doc_id"]), "content": W.docx(W.paragraph("OLE", inner=W.ole("rId1")), [("rId1", "oleObject", "embeddings/oleObject1.bin")], {"word/embeddings/oleObject1.bin": data})}

    return flat_map(items.select("doc_id", "name", "payload"), decode, "doc_id string, content binary", flush=16)


def converted(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Converted packages and their expectations, one a customer; some expectations aren't met."""
    empty = "cast(array() as array<struct<ref: string, text: string>>)"
    c = customers.filter("c_custkey is not null")
    body = F.concat(F.lit("# "), "c_name", F.lit("\n\n| segment | balance |\n| --- | --- |\n| "), "c_mktsegment", F.lit(" | "), F.col("c_acctbal").cast("string"), F.lit(" |\n\n□ "), "c_mktsegment", F.lit("\n\nsee https://x.org/"), F.col("c_custkey").cast("string"), F.lit("\n"))
    manifest = F.expr("named_struct('embedded_objects', cast(array() as array<struct<ref:string,path:string,markdown_reference:string,filename:string>>), 'images', cast(array() as array<struct<ref:string,path:string,markdown_reference:string,filename:string>>))")
    packages = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_mktsegment").alias("method"), body.alias("body"), F.expr(empty).alias("extra"), manifest.alias("manifest"), F.array().cast("array<string>").alias("files"))
    link = F.concat(F.lit("https://x.org/"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("none"))
    box = F.struct(F.concat(F.lit("□ "), "c_mktsegment").alias("text"))
    expected = F.struct(
        F.array(F.struct(F.lit(0).alias("index"), F.lit(2).alias("rows"), F.lit(2).alias("cols"))).alias("tables"), F.array(F.struct(F.lit(1).alias("level"), F.col("c_name").alias("text"))).alias("headings"),
        F.array(F.col("c_name"), F.col("c_mktsegment"), F.lit("not in the text")).alias("key_texts"), F.array(box, box).alias("checkboxes"), F.array(F.struct(link.alias("url"), F.lit("see").alias("anchor"))).alias("hyperlinks"),
    )
    return packages, c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(expected).alias("expected"))


_BODY = """# @n

| name | key |
| --- | --- |
| @n | seg @k |

\u25a1 yes

key @k, chart @k, alpha @k, box @k; see https://x.org/@k here

art @k; before note[^1] after note

see image ![](assets/images/image_01.png) end image

1. item @k

| 2. | anchor @k |

## Table of Contents

chapter @k

## End

[^1]: note @k
"""
#: @k is the key, @x the key of even ones and a word that no text has for the others, @n the name.
_EXPECTED = {
    "embedded_objects": [{"ref": "attachment_01"}, {"ref": "attachment_02"}], "images": [{"ref": "image_01"}], "tables": [{"index": 0, "rows": 2, "cols": 2}, {"index": 1, "rows": 9, "cols": 9}],
    "nested_tables": [{"index": 0, "rows": 2, "cols": 2, "texts": ["seg @x"]}], "nested_table_assets": [{"table_index": 0, "kind": "object", "texts": ["att @x"]}], "headings": [{"level": 1, "text": "@n"}, {"level": 2, "text": "Absent"}],
    "key_texts": ["key @k", "nowhere"], "checkboxes": [{"text": "\u25a1 yes"}, {"text": "\u25a1 yes"}], "charts": [{"texts": ["chart @k", "q9 gone"]}], "smartarts": [{"texts": ["art @x"]}],
    "footnotes": [{"id": "1", "text": "note @x", "anchor_before": "before note", "anchor_after": "after note"}], "hyperlinks": [{"url": "https://x.org/@x", "anchor": "see"}], "toc": [{"text": "chapter @k"}, {"text": "gone"}],
    "textboxes": [{"text": "box @x"}], "numbered_items": [{"number": "1", "text": "item @x"}], "table_numbered_items": [{"number": "2", "anchor": "anchor @x"}], "formulas": [{"label": "f", "tokens": ["alpha @x"]}],
    "table_cell_checks": [{"label": "t", "table_index": 0, "cells": [{"row": 1, "col": 0, "text": "@n"}, {"row": 1, "col": 1, "text": "other"}]}], "asset_anchors": [{"ref": "image_01", "before": "see image", "after": "end image"}],
    "embedded_content": [{"ref": "attachment_01", "texts": ["att @k", "gone"]}], "markdown_portability": True,
}


def converted_in_full(suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A converted package a supplier, and an expectation of each of the 23 dimensions."""
    key = F.col("s_suppkey").cast("string")
    other = F.when(F.col("s_suppkey") % 2 == 0, key).otherwise("none")
    fill = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("@k"), key), F.lit("@x"), other), F.lit("@n"), F.col("s_name"))
    asset = lambda ref, path: F.struct(F.lit(ref).alias("ref"), F.lit(path).alias("path"), F.lit(None).cast("string").alias("markdown_reference"), F.lit(None).cast("string").alias("filename"))
    manifest = F.struct(F.array(asset("attachment_01", "structured/resources/attachment_01/preview.md")).alias("embedded_objects"), F.array(asset("image_01", "assets/images/image_01.png")).alias("images"))
    extra = F.array(F.struct(F.lit("attachment_01").alias("ref"), fill("att @k").alias("text")))
    packages = suppliers.select(key.alias("doc_id"), F.lit("m").alias("method"), fill(_BODY).alias("body"), extra.alias("extra"), manifest.alias("manifest"), F.array(F.lit("structured/assets/images/image_01.png")).alias("files"))
    return packages, suppliers.select(key.alias("doc_id"), fill(json.dumps(_EXPECTED, ensure_ascii=False)).alias("expected"))
