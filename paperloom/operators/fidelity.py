"""Fidelity of converted packages against ground truth: 23 dimensions in one pass.

A package is a row (doc_id, method, body, extra ARRAY<STRUCT<ref, text>>, manifest STRUCT<embedded_objects, images>, files); the
expectation is a JSON text per doc_id. Texts are normalized once a package. Every scorer gives an array of checks
(dimension, ok, total, miss), built next to the texts, so no text is shipped with a check; one explode makes the long relation.
Containment, counts and positions are native expressions; only the ordered greedy matches are folds in Python.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as T
from . import markdown as M

DIMENSIONS = (
    "embedded_object_recall", "image_recall", "table_recall", "nested_table_recall", "nested_table_asset_recall", "heading_recall", "heading_tree_score", "key_text_hit",
    "checkbox_recall", "chart_text_recall", "smartart_text_recall", "footnote_recall", "footnote_anchor_accuracy", "hyperlink_recall", "toc_recall", "textbox_recall",
    "numbering_recall", "table_numbering_recall", "formula_recall", "table_cell_match", "asset_anchor_accuracy", "embedded_content_hit", "markdown_portability",
)
_TABLE = "index INT, rows INT, cols INT, depth INT, texts ARRAY<STRING>"
EXPECTED = (
    f"embedded_objects ARRAY<STRUCT<ref STRING, source_path STRING, type STRING, sheets INT>>, images ARRAY<STRUCT<ref STRING, filename STRING, source_path STRING>>, "
    f"tables ARRAY<STRUCT<{_TABLE}>>, nested_tables ARRAY<STRUCT<{_TABLE}>>, nested_table_assets ARRAY<STRUCT<table_index INT, kind STRING, rel_id STRING, texts ARRAY<STRING>>>, "
    "checkboxes ARRAY<STRUCT<text STRING>>, charts ARRAY<STRUCT<index INT, source_path STRING, title STRING, series ARRAY<STRING>, categories ARRAY<STRING>, texts ARRAY<STRING>>>, "
    "smartarts ARRAY<STRUCT<index INT, source_path STRING, texts ARRAY<STRING>>>, headings ARRAY<STRUCT<level INT, text STRING>>, key_texts ARRAY<STRING>, "
    "footnotes ARRAY<STRUCT<id STRING, text STRING, anchor_before STRING, anchor_after STRING>>, hyperlinks ARRAY<STRUCT<url STRING, anchor STRING>>, toc ARRAY<STRUCT<text STRING>>, "
    "textboxes ARRAY<STRUCT<text STRING>>, numbered_items ARRAY<STRUCT<number STRING, text STRING>>, table_numbered_items ARRAY<STRUCT<number STRING, anchor STRING>>, "
    "formulas ARRAY<STRUCT<label STRING, latex STRING, tokens ARRAY<STRING>>>, table_cell_checks ARRAY<STRUCT<label STRING, table_index INT, parsed_table_index INT, cells ARRAY<STRUCT<row INT, col INT, text STRING>>>>, "
    "asset_anchors ARRAY<STRUCT<ref STRING, before STRING, after STRING>>, embedded_content ARRAY<STRUCT<ref STRING, texts ARRAY<STRING>>>, markdown_portability BOOLEAN"
)
MANIFEST = "embedded_objects ARRAY<STRUCT<ref STRING, path STRING, markdown_reference STRING, filename STRING>>, images ARRAY<STRUCT<ref STRING, path STRING, markdown_reference STRING, filename STRING>>"
CHECK = "struct<dimension: string, ok: double, total: double, miss: string>"


def _check(dimension: str, ok: Column, miss: Column, total: Column | float = 1.0) -> Column:
    total = total if isinstance(total, Column) else F.lit(total)
    hit = ok.cast("double") if not isinstance(ok, bool) else F.lit(float(ok))
    return F.struct(F.lit(dimension).alias("dimension"), hit.alias("ok"), total.cast("double").alias("total"), F.when(hit < total, miss).alias("miss"))


def _each(items: Column, f) -> Column:
    return F.coalesce(F.transform(items, f), F.expr(f"cast(array() as array<{CHECK}>)"))


def _has(haystack: Column, needle: Column) -> Column:
    return F.coalesce((needle != "") & F.contains(haystack, needle), F.lit(False))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, T.WS, "")


def _between(content: Column, before: Column, after: Column, positions: Column) -> Column:
    """Whether a position (from 1) lies between the first `before` and the `after` that follows it."""
    at = F.when(F.coalesce(before, F.lit("")) != "", F.instr(content, before)).otherwise(0)
    then = F.when((at > 0) & (F.coalesce(after, F.lit("")) != ""), F.call_function("locate", after, content, at + F.length(before))).otherwise(0)
    return (at > 0) & (then > 0) & F.exists(positions, lambda p: (p >= at) & (p <= then))


def _occurrences(content: Column, needle: Column) -> Column:
    """1-based starts of the needle, without overlap."""
    pieces = F.split(content, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * F.length(needle) + 1)
    return F.when((needle != "") & (F.size(pieces) > 1), starts).otherwise(F.array().cast("array<int>"))


def _capped(dimension: str, items: Column, found: Column, label) -> Column:
    """One check an expected item; the first `found` of them count as recovered."""
    return _each(items, lambda x, k: _check(dimension, k < found, label(x)))


def _close(n: int, m: int, want: dict) -> bool:
    return n == want["rows"] and abs(m - (want["cols"] or 0)) <= 1


def match_tables(shapes: list[tuple[int, int]], wanted: list[dict]) -> list[int | None]:
    """For each wanted table the first parsed one, not taken yet, of its shape."""
    free, out = list(range(len(shapes))), []
    for w in wanted:
        k = next((k for k in free if _close(*shapes[k], w)), None)
        if k is not None:
            free.remove(k)
        out.append(k)
    return out


def _alike(a: str, b: str) -> bool:
    return bool(a) and (a in b or b in a)


def _nodes(pairs: list[tuple[int, str]]) -> list[tuple[int, str, list[str]]]:
    out, stack = [], []
    for level, text in pairs:
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append((level, text, [t for _, t in stack]))
        stack.append((level, text))
    return out


def level_offset(pairs: list[tuple[int, int]]) -> int:
    """The most frequent difference of levels, the least in size on a tie; 0 where no two agree."""
    n = Counter(got - want for want, got in pairs)
    most = max(n.values(), default=0)
    return min((d for d in n if n[d] == most), key=abs) if most > 1 else 0


def _ordered_one(parsed: list, spans: list, e: dict):
    shapes = [(n, m) for _, n, m, _ in parsed]
    wanted = e.get("tables") or []
    places = match_tables(shapes, wanted)
    for w, k in zip(wanted, places, strict=True):
        yield "table_recall", float(k is not None), 1.0, None if k is not None else f"index={w['index']} rows={w['rows']} cols={w['cols']}"

    got = [(level, T.loose(text), text) for _, _, level, text in spans]
    expected = [(h["level"] or 1, h["text"] or "") for h in e.get("headings") or []]
    at = 0
    for level, text in expected:
        k = next((k for k in range(at, len(got)) if _alike(T.loose(text), got[k][1])), None)
        at = len(got) if k is None else k + 1
        yield "heading_recall", float(k is not None), 1.0, None if k is not None else f"L{level} {text}"
    actual, at, found = _nodes([(lv, t) for lv, _, t in got]), 0, []
    for node in _nodes(expected):
        k = next((k for k in range(at, len(got)) if _alike(T.loose(node[1]), got[k][1])), None)
        if k is None:
            yield "heading_tree_score", 0.0, 3.0, f"L{node[0]} {node[1]}"
        else:
            at = k + 1
            found.append((node, actual[k]))
    shift = level_offset([(a[0], b[0]) for a, b in found])
    for want, have in found:
        level = have[0] - shift == want[0]
        chain = [*map(T.loose, have[2])] == [*map(T.loose, want[2])]
        miss = None if level and chain else f"parent {want[1]}" if level else f"level {want[1]} expected=L{want[0]} actual=L{have[0]} offset={shift:+d}"
        yield "heading_tree_score", 1.0 + level + chain, 3.0, miss

    for check in e.get("table_cell_checks") or []:
        k = check.get("parsed_table_index")
        if k is None:
            k, own = check.get("table_index"), [p for w, p in zip(wanted, places, strict=True) if w["index"] == check.get("table_index")]
            if k is None or not wanted:
                k = k or 0
            elif own:
                k = own[0] if own[0] is not None else len(parsed)
        label, cells = check.get("label") or f"table_index={k}", check.get("cells") or []
        if k >= len(parsed):
            yield "table_cell_match", 0.0, float(len(cells)), f"{label} missing table"
            continue
        grid = parsed[k][3]
        for c in cells:
            row, col, want = c["row"] or 0, c["col"] or 0, T.semantic(c["text"] or "")
            have = T.semantic(grid[row][col]) if row < len(grid) and col < len(grid[row]) else ""
            yield "table_cell_match", float(bool(want) and want in have), 1.0, None if want and want in have else f"{label} row={row} col={col} expected={c['text']}"


def _portability(c: Column, files: Column) -> Column:
    d = "markdown_portability"
    where = lambda link: F.aggregate(F.split(F.concat(F.lit("structured/"), link), "/"), F.array(F.lit("")), lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s))))
    escapes = lambda link: F.size(where(link)) == 0
    exists = lambda link: F.array_contains(files, F.array_join(F.filter(where(link), lambda _, k: k > 0), "/"))
    images = _each(M.image_links(c), lambda x: F.when(x.startswith("data:"), _check(d, False, F.concat(F.lit("base64 image "), F.substring(x, 1, 24)))).when(x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^/"), _check(d, False, F.concat(F.lit("non-relative image path "), x))).when(escapes(x), _check(d, False, F.concat(F.lit("image path escapes package "), x))).otherwise(_check(d, F.coalesce(exists(x), F.lit(False)), F.concat(F.lit("image exists "), x))))
    flags = F.array_compact(F.array(F.when(c.rlike(r"(?i)<table\b"), _check(d, False, F.lit("html table"))), F.when(c.rlike(r"(?i)\bfile://"), _check(d, False, F.lit("file url")))))
    ls = F.col("ls")
    rules = F.filter(F.transform(ls, lambda x, k: F.when((k > 0) & T.strip(x).rlike("^(=+|-+)$"), T.strip(F.get(ls, k - 1)))), lambda x: x.isNotNull() & (x != ""))
    all_ = F.concat(images, flags, _each(rules, lambda x: _check(d, False, F.concat(F.lit("setext heading "), F.substring(x, 1, 40)))))
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(_check(d, True, F.lit(None).cast("string"))))


def prepared(packages: DataFrame, expected: DataFrame) -> DataFrame:
    """packages with their expectation and every normalized form that scorers use, each computed once, in one pass through Python."""
    texts = ", ".join(f"{k}: array<string>" for k in ("key", "box", "foot", "toc", "tb", "tn", "nt", "na", "chart", "art", "formula", "embedded"))
    raw = ", ".join(f"{k}: array<string>" for k in ("chart", "formula"))
    # Neither side is broadcast, whatever size is guessed for the texts, and the number of partitions is a given one: few bytes make much work here.
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    joined = spread(packages.select("doc_id", "method", "body", "extra", "manifest", "files")).join(spread(expected.select("doc_id", "expected")).hint("merge"), "doc_id")
    joined = joined.select(*joined.columns[:-1], F.from_json("expected", EXPECTED).alias("e"))
    made = StructType()
    for name, ddl in (("full", "string"), ("nbody", "string"), ("nfull", "string"), ("ntoc", "string"), ("nrefs", "array<string>"), ("ls", "array<string>"), ("nlines", "array<string>"), ("shapes", "array<struct<n: int, m: int>>"), ("ordered", f"array<{CHECK}>"), ("n", f"struct<{texts}>"), ("raw", f"struct<{raw}>")):
        made = made.add(name, _parse_datatype_string(ddl))

    def decode(row: dict) -> dict:
        x, body, extra = row["e"] or {}, row["body"] or "", row["extra"] or []
        items = lambda name: x.get(name) or []
        norm = lambda values: [T.semantic(v or "") for v in values]
        nested = lambda name, key: [t for i in items(name) for t in i.get(key) or []]
        chart = [t or "" for c in items("charts") for t in (c["texts"] if c["texts"] is not None else [c["title"], *(c["series"] or []), *(c["categories"] or [])])]
        full = "\n".join([body, *(y["text"] or "" for y in extra)])
        ls, nbody, tables, spans = body.splitlines(), T.semantic(body), M.parse_tables(body), M.heading_spans(body)
        of_ref = lambda ref: "\n".join(y["text"] or "" for y in extra if y["ref"] == ref)
        return {
            "full": full, "nbody": nbody, "nfull": T.semantic(full) if extra else nbody, "ntoc": T.semantic(M.toc(body, spans)), "nrefs": norm(of_ref(c["ref"]) for c in items("embedded_content")), "ls": ls, "nlines": norm(ls),
            "shapes": [{"n": n, "m": m} for _, n, m, _ in tables], "ordered": [dict(zip(("dimension", "ok", "total", "miss"), c, strict=True)) for c in _ordered_one(tables, spans, x)],
            "n": {
                "key": norm(items("key_texts")), **{k: norm(i[f] for i in items(name)) for k, name, f in (("box", "checkboxes", "text"), ("foot", "footnotes", "text"), ("toc", "toc", "text"), ("tb", "textboxes", "text"), ("tn", "table_numbered_items", "anchor"))},
                **{k: norm(nested(name, f)) for k, name, f in (("nt", "nested_tables", "texts"), ("na", "nested_table_assets", "texts"), ("art", "smartarts", "texts"), ("formula", "formulas", "tokens"), ("embedded", "embedded_content", "texts"))}, "chart": norm(chart),
            },
            "raw": {"chart": chart, "formula": nested("formulas", "tokens")},
        }

    kind, arrow = StructType([*joined.schema.fields, *made.fields]), to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                more = pa.RecordBatch.from_pylist([decode(row) for row in part.select(["body", "extra", "e"]).to_pylist()], schema=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, *more.columns], names=kind.names)

    return joined.mapInArrow(run, kind)


def checks(packages: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, method, dimension, seq, ok, total, miss: one row a check."""
    p = prepared(packages, expected)
    body, full, nbody, nfull = (F.col(c) for c in ("body", "full", "nbody", "nfull"))
    lower, s = F.lower(body), lambda c: F.coalesce(c, F.lit("?"))
    n = lambda name, k: F.get(F.col(f"n.{name}"), k)
    before = lambda items, k, f: F.aggregate(F.slice(F.col(items), 1, k), F.lit(0), lambda a, x: a + F.coalesce(F.size(f(x)), F.lit(0)))
    own = lambda items, name, x, k, f: F.slice(F.col(f"n.{name}"), before(items, k, f) + 1, F.greatest(F.coalesce(F.size(f(x)), F.lit(0)), F.lit(0)))
    texts = lambda x: F.filter(x["texts"], lambda t: t != "")
    every = lambda needles, hay: F.forall(needles, lambda t: _has(hay, t))
    cut = lambda c, m: F.substring(F.coalesce(c, F.lit("")), 1, m)
    has_image = F.size(M.image_links(full)) > 0
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    shapes = F.col("shapes")
    nested = _each(F.col("e.nested_tables"), lambda x, k: _check("nested_table_recall", F.exists(shapes, lambda g: ((g["n"] == x["rows"]) | (g["n"] == x["rows"] + 1)) & (F.abs(g["m"] - x["cols"]) <= 1)) & every(own("e.nested_tables", "nt", x, k, lambda y: y["texts"]), nbody), F.concat(F.lit("index="), s(x["index"].cast("string")), F.lit(" rows="), s(x["rows"].cast("string")), F.lit(" cols="), s(x["cols"].cast("string")))))
    nested_assets = _each(F.col("e.nested_table_assets"), lambda x, k: _check("nested_table_asset_recall", F.when(F.coalesce(F.size(texts(x)), F.lit(0)) > 0, every(own("e.nested_table_assets", "na", x, k, lambda y: y["texts"]), nfull)).otherwise((x["kind"] == "image") & has_image), F.concat(F.lit("table="), s(x["table_index"].cast("string")), F.lit(" kind="), s(x["kind"]), F.lit(" rel="), s(x["rel_id"]))))
    loosely = lambda hay, needle: _has(hay, needle) | _has(_squeezed(hay), _squeezed(needle))
    keys = _each(F.col("e.key_texts"), lambda x, k: _check("key_text_hit", loosely(nfull, n("key", k)), x))
    marked = F.filter(F.col("n.box"), lambda t: t.rlike("[□■☑☒☐]"))
    counted = F.when(nbody.rlike("[□■☑☒☐]"), nbody).otherwise("")
    boxes = _each(F.array_distinct(marked), lambda t: _check("checkbox_recall", F.least(F.size(F.filter(marked, lambda u: u == t)), (F.length(counted) - F.length(F.replace(counted, t, F.lit("")))) / F.length(t)), t, F.size(F.filter(marked, lambda u: u == t))))
    flat = lambda name, d, hay, raw: F.filter(_each(F.col(f"n.{name}"), lambda t, k: F.when(t != "", _check(d, _has(hay, t), F.get(raw, k)))), lambda c: c.isNotNull())
    charts = flat("chart", "chart_text_recall", nfull, F.col("raw.chart"))
    arts = F.filter(_each(F.col("e.smartarts"), lambda x, k: F.when(F.coalesce(F.size(x["texts"]), F.lit(0)) > 0, _check("smartart_text_recall", every(own("e.smartarts", "art", x, k, lambda y: y["texts"]), nfull), F.array_join(x["texts"], " / ")))), lambda c: c.isNotNull())
    notes = _each(F.col("e.footnotes"), lambda x, k: _check("footnote_recall", _has(nbody, n("foot", k)), F.concat(F.lit("id="), s(x["id"]), F.lit(" text="), cut(x["text"], 40))))
    forms = lambda i: F.array(F.concat(F.lit("[^"), i, F.lit("]")), F.concat(F.lit("[["), i, F.lit("]](#footnote-"), i, F.lit(")")), F.concat(F.lit("[["), i, F.lit("]](#endnote-"), i, F.lit(")")), F.concat(F.lit("#footnote-ref-"), i), F.concat(F.lit("#endnote-ref-"), i))
    anchors = _each(F.col("e.footnotes"), lambda x: _check("footnote_anchor_accuracy", F.coalesce(_between(lower, F.lower(x["anchor_before"]), F.lower(x["anchor_after"]), F.flatten(F.transform(forms(F.lower(T.strip(x["id"]))), lambda m: _occurrences(lower, m)))), F.lit(False)), F.concat(F.lit("id="), s(x["id"]), F.lit(" anchor="), F.coalesce(x["anchor_before"], F.lit("")), F.lit("..."))))
    links = _each(F.col("e.hyperlinks"), lambda x: _check("hyperlink_recall", _has(lower, F.lower(T.strip(x["url"]))), F.concat(F.lit("url="), s(x["url"]), F.lit(" anchor="), F.coalesce(x["anchor"], F.lit("")))))
    toc = _each(F.col("e.toc"), lambda x, k: _check("toc_recall", _has(F.col("ntoc"), n("toc", k)), F.concat(F.lit("toc entry="), cut(x["text"], 50))))
    textboxes = _each(F.col("e.textboxes"), lambda x, k: _check("textbox_recall", _has(nbody, n("tb", k)), F.concat(F.lit("textbox text="), cut(x["text"], 50))))
    numbered = _each(F.col("e.numbered_items"), lambda x: _check("numbering_recall", F.coalesce((x["number"] != "") & (x["text"] != "") & F.rlike(body, F.concat(F.lit(r"(?m)^\s*"), quoted(T.strip(x["number"])), F.lit(r"\s*[.)\]]\s*"), quoted(x["text"]))), F.lit(False)), F.concat(F.lit("number="), s(x["number"]), F.lit(" text="), cut(x["text"], 40))))
    ls = F.col("ls")
    in_tables = _each(F.col("e.table_numbered_items"), lambda x, k: _check("table_numbering_recall", F.coalesce((x["number"] != "") & (x["anchor"] != "") & F.exists(F.arrays_zip(ls.alias("l"), F.col("nlines").alias("m")), lambda r: F.rlike(r["l"], F.concat(F.lit(r"(?:^|\||<td[^>]*>(?:<p>)?)\s*"), quoted(T.strip(x["number"])), F.lit(r"\s*\."))) & F.contains(r["m"], n("tn", k))), F.lit(False)), F.concat(F.lit("table_numbering number="), s(x["number"]), F.lit(" anchor="), cut(x["anchor"], 40))))
    formulas = _each(F.col("n.formula"), lambda t, k: _check("formula_recall", loosely(nbody, t), F.get(F.col("raw.formula"), k)))
    manifest = F.concat(F.coalesce("manifest.images", F.expr("cast(array() as array<struct<ref:string,path:string,markdown_reference:string,filename:string>>)")), F.coalesce("manifest.embedded_objects", F.expr("cast(array() as array<struct<ref:string,path:string,markdown_reference:string,filename:string>>)")))
    needles = lambda ref: F.array_distinct(F.filter(F.concat(F.array(ref), F.flatten(F.transform(F.filter(manifest, lambda m: m["ref"] == ref), lambda m: F.array(m["path"], m["markdown_reference"], m["filename"])))), lambda t: t.isNotNull() & (t != "")))
    placed = _each(F.col("e.asset_anchors"), lambda x: _check("asset_anchor_accuracy", F.coalesce(_between(body, x["before"], x["after"], F.flatten(F.transform(needles(x["ref"]), lambda t: _occurrences(body, t)))), F.lit(False)), F.concat(s(x["ref"]), F.lit(" between="), cut(x["before"], 30), F.lit("..."), cut(x["after"], 30))))
    content = F.flatten(_each2(F.col("e.embedded_content"), lambda x, k: F.transform(own("e.embedded_content", "embedded", x, k, lambda y: y["texts"]), lambda t, j: _check("embedded_content_hit", _has(F.get(F.col("nrefs"), k), t), F.concat(s(x["ref"]), F.lit(" text="), cut(F.get(x["texts"], j), 40))))))
    counts = _capped("embedded_object_recall", F.col("e.embedded_objects"), F.coalesce(F.size("manifest.embedded_objects"), F.lit(0)), lambda x: F.concat(F.coalesce(x["ref"], x["source_path"], F.lit("?")), F.lit(" type="), s(x["type"])))
    images = _capped("image_recall", F.col("e.images"), F.greatest(F.size(F.array_distinct(M.image_links(body))), F.coalesce(F.size("manifest.images"), F.lit(0))), lambda x: T.strip(F.concat(F.coalesce(x["ref"], x["filename"], F.lit("?")), F.lit(" "), F.coalesce(x["filename"], F.lit("")))))
    portable = F.when(F.coalesce("e.markdown_portability", F.lit(False)), _portability(body, F.col("files"))).otherwise(F.expr(f"cast(array() as array<{CHECK}>)"))
    ordered = F.col("ordered")
    all_ = F.concat(counts, images, ordered, nested, nested_assets, keys, boxes, charts, arts, notes, anchors, links, toc, textboxes, numbered, in_tables, formulas, placed, content, portable)
    out = p.select("doc_id", "method", F.posexplode(all_).alias("seq", "c"))
    return out.select("doc_id", "method", "c.dimension", "seq", "c.ok", "c.total", "c.miss")


def _each2(items: Column, f) -> Column:
    return F.coalesce(F.transform(items, f), F.expr(f"cast(array() as array<array<{CHECK}>>)"))


def scores(checks_: DataFrame) -> DataFrame:
    """doc_id, method, dimension, score. A dimension without an expectation has no row: it is not applicable, not zero."""
    return checks_.groupBy("doc_id", "method", "dimension").agg((F.sum("ok") / F.sum("total")).alias("score")).filter("score is not null")


def doc_scores(scores_: DataFrame, packages: DataFrame, expected: DataFrame, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """The mean of a package's applicable dimensions, 0.0 where there is none. Packages without ground truth aren't scored.

    dimensions: their scores as columns, null where one isn't applicable, from the same pass over the scores.
    """
    mean = scores_.groupBy("doc_id", "method").agg(F.avg("score").alias("doc_score"), *(F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in dimensions))
    judged = packages.select("doc_id", "method").distinct().join(expected.select("doc_id").hint("merge"), "doc_id", "left_semi")
    return judged.join(mean, ["doc_id", "method"], "left").withColumn("doc_score", F.coalesce("doc_score", F.lit(0.0)))


def summary(scores_: DataFrame, doc_scores_: DataFrame) -> DataFrame:
    """A row a method: number of documents, mean doc_score and mean of each dimension over the documents that have it."""
    wide = scores_.groupBy("method").pivot("dimension", list(DIMENSIONS)).agg(F.avg("score"))
    return doc_scores_.groupBy("method").agg(F.count("*").alias("n_docs"), F.avg("doc_score").alias("doc_score")).join(wide, "method", "left")


def wide_summary(wide: DataFrame) -> DataFrame:
    """summary() of doc_scores() with all dimensions, without a second pass over the scores."""
    return wide.groupBy("method").agg(F.count("*").alias("n_docs"), *(F.avg(c).alias(c) for c in ("doc_score", *DIMENSIONS)))


def misses(checks_: DataFrame) -> DataFrame:
    return checks_.filter("miss is not null").select("doc_id", "method", "dimension", "seq", "miss")


def misses_report(misses_: DataFrame) -> DataFrame:
    """method and its Markdown report: documents under the method, misses under the document."""
    doc = misses_.groupBy("method", "doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "dimension", "miss"))), lambda x: F.concat(F.lit("- "), x["dimension"], F.lit(": "), x["miss"])), "\n").alias("t"))
    return doc.groupBy("method").agg(F.concat(F.lit("## "), F.col("method"), F.lit("\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t"))), lambda x: F.concat(F.lit("### "), x["doc_id"], F.lit("\n\n"), x["t"])), "\n\n")).alias("report"))


def formatted(score: Column) -> Column:
    """Four decimals; a null is a dash."""
    return F.when(score.isNull(), "-").otherwise(F.format_string("%.4f", score))


def token_f1(gold: Column, content: Column) -> Column:
    """F1 of the sets of words, loosely normalized."""
    words = lambda c: F.array_distinct(F.filter(F.split(T.loose_col(c), " "), lambda w: w != ""))
    g, c = words(gold), words(content)
    both = F.size(F.array_intersect(g, c))
    return F.when((F.size(g) == 0) & (F.size(c) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(g) + F.size(c)))


def level_similarity(gold: Column, content: Column) -> Column:
    """1 - edit distance of two sequences of heading levels over the longer one's length; null without gold levels.

    The content's levels are first moved by the most frequent difference of the levels in the same place (the least in size on a
    tie, none where no two agree): a converter that shifts every heading alike keeps the tree.
    """
    pairs = F.filter(F.arrays_zip(gold.alias("g"), content.alias("c")), lambda x: x["g"].isNotNull() & x["c"].isNotNull())
    moves = F.transform(pairs, lambda x: x["c"] - x["g"])
    votes = F.transform(F.array_distinct(moves), lambda m, k: F.struct(F.size(F.filter(moves, lambda x: x == m)).alias("n"), (-F.abs(m)).alias("near"), (-k).alias("first"), m.alias("m")))
    best = F.array_max(votes)
    offset = F.when(best["n"] > 1, best["m"]).otherwise(0)
    text = lambda a, by: F.array_join(F.transform(a, lambda x: F.char(x - by + 77)), "")
    distance = F.levenshtein(text(gold, F.lit(0)), text(content, offset))
    return F.when(F.size(gold) > 0, 1.0 - distance / F.greatest(F.size(gold), F.size(content)))


def cell_match(gold: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, method, table_idx, row_idx, col_idx, cell) twice -> the share of equal cells of each gold table's full grid.

    Cells that only one side has are compared with ''; a table that wasn't parsed scores 0.
    """
    keys = ["doc_id", "method", "table_idx"]
    size = lambda d, p: d.groupBy(*keys).agg((F.max("row_idx") + 1).alias(f"{p}r"), (F.max("col_idx") + 1).alias(f"{p}c"))
    grid = size(gold, "g").join(size(parsed, "p"), keys, "left")
    cells = gold.withColumn("g", T.loose_col("cell")).drop("cell").join(parsed.withColumn("p", T.loose_col("cell")).drop("cell"), [*keys, "row_idx", "col_idx"], "full")
    differ = cells.groupBy(*keys).agg(F.count_if(F.coalesce("g", F.lit("")) != F.coalesce("p", F.lit(""))).alias("bad"))
    area = F.greatest("gr", "pr") * F.greatest("gc", "pc")
    return grid.join(differ, keys).select(*keys, F.when(F.col("pr").isNull(), 0.0).otherwise((area - F.col("bad")) / area).alias("ratio"))


def embedded_object_recall(found: Column, expected: Column, has_manifest: Column) -> Column:
    """The first layer's metric: 1 where nothing is expected, 0 without a manifest."""
    return F.when(expected == 0, 1.0).when(~has_manifest, 0.0).otherwise(F.least(found, expected) / expected)


def exit_status(codes: DataFrame) -> DataFrame:
    """0 if all are 0; 2 if some are 2 and none is anything else but 0; else 1."""
    return codes.agg(F.when(F.max((~F.col("code").isin(0, 2)).cast("int")) == 1, 1).when(F.max((F.col("code") == 2).cast("int")) == 1, 2).otherwise(0).alias("status"))


