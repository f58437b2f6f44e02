"""Document packages: assets with their numbering, previews and references, the Markdown body, and the indexes built of them.

A document's archive is decoded once, in one narrow pass: everything that its relationships join with lies in the same row, so
no payload is shuffled. What goes across documents or is aggregated (indexes, manifests, statistics) is native.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.flat_map import flat_map
from ..sources import docx as D
from ..sources.services import services

ASSETS = (
    "doc_id string, position int, ref string, kind string, filename string, type string, rel_id string, source_path string, content_type string, relationship_type string, detected_mime string, "
    "extension string, size_bytes long, sha256 string, anchor struct<block_id: string, paragraph_text: string, page: int>, parse_policy struct<mode: string, reason: string>, "
    "parse_status struct<status: string, preview_path: string, preview_json_path: string, full_parse: boolean>, related_parts array<string>, preview_md string, preview_json string, title string, "
    "markdown_reference string, target_path string, entry_point string, path string, payload binary, warning string, seq int"
)
DOCUMENTS = "doc_id string, parser string, content string, warnings array<string>"
POSITION_MAP = ("position", "ref", "kind", "filename", "type", "source_path", "markdown_reference", "target_path", "entry_point", "tables")
VERSION = "0.1.0"

Parser = Callable[[DataFrame], DataFrame]


def assets(packages: DataFrame, unsafe: bool = False, payloads: bool = True) -> DataFrame:
    """(doc_id, content) -> ASSETS: a row an asset in order of position, then a row a warning (ref is null, seq counts them)."""

    def decode(row: dict):
        p = D.Package(row["content"])
        for a in p.assets(unsafe):
            yield {"doc_id": row["doc_id"], **a, **({} if payloads else {"payload": None})}
        for k, w in enumerate(p.warnings):
            yield {"doc_id": row["doc_id"], "warning": w, "seq": k}

    return flat_map(packages.select("doc_id", "content"), decode, ASSETS, flush=64)


def found(assets_: DataFrame) -> DataFrame:
    return assets_.filter("ref is not null")


def warnings(assets_: DataFrame) -> DataFrame:
    return assets_.filter("warning is not null").select("doc_id", "seq", "warning")


def embedded_workbooks(packages: DataFrame) -> DataFrame:
    """doc_id, ref, workbook, content of the attachments that are sound workbooks, numbered among themselves."""

    def decode(row: dict):
        p = D.Package(row["content"])
        books = (a for a in p.assets() if a["kind"] == "attachment" and D.is_xlsx(a["payload"]))
        for k, a in enumerate(books, 1):
            yield {"doc_id": row["doc_id"], "ref": f"attachment_{k:02d}", "filename": a["filename"], "content": a["payload"]}

    return flat_map(packages.select("doc_id", "content"), decode, "doc_id string, ref string, filename string, content binary", flush=16).withColumn("workbook", F.concat_ws("/", "doc_id", "ref"))


def notes(packages: DataFrame) -> DataFrame:
    def decode(row: dict):
        for n in D.notes(D.read_zip(row["content"], "^word/(document|footnotes|endnotes)[.]xml$")[0]):
            yield {"doc_id": row["doc_id"], **n}

    return flat_map(packages.select("doc_id", "content"), decode, "doc_id string, sequence int, kind string, source_id string, text string, before_context string, after_context string")


def with_notes(markdown: DataFrame, notes_: DataFrame) -> DataFrame:
    """(doc_id, content) of any converter, with markers and definitions of the document's notes."""
    own = notes_.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "kind", "source_id", "text", "before_context", "after_context"))).alias("notes"))

    def decode(row: dict):
        yield {"doc_id": row["doc_id"], "content": D.with_notes(row["content"] or "", row["notes"] or [])}

    return flat_map(markdown.select("doc_id", "content").join(own, "doc_id", "left"), decode, "doc_id string, content string")


def blocks(packages: DataFrame) -> DataFrame:
    """doc_id, seq, style, level, text, rows (of a table's cells): the body in order, with sentinels where assets are."""

    def decode(row: dict):
        p = D.Package(row["content"])
        refs = {a["rel_id"]: a["ref"] for a in p.assets()}
        for b in D.blocks(p.body, D._style_levels(p.parts.get("word/styles.xml")), refs):
            yield {"doc_id": row["doc_id"], **b}

    return flat_map(packages.select("doc_id", "content"), decode, "doc_id string, seq int, style string, level int, text string, rows array<array<string>>")


def _local(parser: str, with_assets: bool) -> Parser:
    def parse(packages: DataFrame) -> DataFrame:
        def decode(row: dict):
            p = D.Package(row["content"])
            own = list(p.assets()) if with_assets else []
            name = posixpath.splitext(posixpath.basename(row["doc_id"] or ""))[0] or "Untitled Document"
            yield {"doc_id": row["doc_id"], "parser": parser, "content": D.markdown_of(row["content"], name, parser, own, p), "warnings": p.warnings if with_assets else []}

        return flat_map(packages.select("doc_id", "content"), decode, DOCUMENTS, flush=64)

    return parse


def _absent(name: str, why: str) -> Parser:
    return lambda packages: packages.select("doc_id", F.lit(name).alias("parser"), F.lit("").alias("content"), F.array(F.lit(why)).alias("warnings"))


#: Parsers by name. Services and programs that aren't here give an empty text and a warning, as an unknown name does.
PARSERS: dict[str, Parser] = {
    "native": _local("native", True), "sectioned": _local("sectioned", True), "native-pure": _local("native", False), "sectioned-pure": _local("sectioned", False),
    "pandoc": _absent("pandoc", "pandoc executable was not found"), "mineru": _absent("mineru", "mineru service is not configured"), "docling": _absent("docling", "docling service is not configured"),
}
ALIASES = {"markitdown": "native", "ragflow": "sectioned", "mineru-pipeline": "mineru", "mineru-vlm-engine": "mineru", "mineru-hybrid-engine": "mineru"}


def register_parser(name: str, parser: Parser) -> None:
    """Makes (doc_id, content) -> DOCUMENTS known by name, e.g. a client of a conversion service by mapInArrow."""
    PARSERS[name] = parser


def parse_main(packages: DataFrame, parser: str = "native") -> DataFrame:
    f = services().get(parser) or PARSERS.get(parser) or PARSERS.get(ALIASES.get(parser, ""))
    return (f or _absent(parser, f"Unsupported main parser: {parser}"))(packages).withColumn("parser", F.lit(parser)).select("doc_id", "parser", "content", "warnings")


def marked(packages: DataFrame) -> DataFrame:
    """(doc_id, content): the documents with a sentinel for each asset, to be converted by any parser."""

    def decode(row: dict):
        p = D.Package(row["content"])
        yield {"doc_id": row["doc_id"], "content": D.with_sentinels(row["content"], {a["rel_id"]: a["ref"] for a in p.assets()}) if row["content"] else None}

    return flat_map(packages.select("doc_id", "content"), decode, "doc_id string, content binary", flush=16)


def place(documents: DataFrame, assets_: DataFrame) -> DataFrame:
    """documents with references for sentinels, whatever escapes the converter put there; assets without one follow at the end."""
    refs = found(assets_).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "ref", "markdown_reference"))).alias("refs"))

    def decode(row: dict):
        own = {r["ref"]: r["markdown_reference"] for r in row.pop("refs") or []}
        yield row | {"content": D.placed(row["content"] or "", own)}

    return flat_map(documents.select("doc_id", "parser", "content", "warnings").join(refs, "doc_id", "left"), decode, DOCUMENTS)


# ---- indexes --------------------------------------------------------------------------------------------------------------


def _ordered(items: str = "e") -> Column:
    return F.sort_array(F.collect_list(F.struct("position", "ref", F.col(items))))


def position_map(assets_: DataFrame) -> DataFrame:
    return found(assets_).select("doc_id", *(F.lit("").alias(c) if c == "tables" else F.col(c) for c in POSITION_MAP))


def resource_entries(assets_: DataFrame) -> DataFrame:
    """doc_id, position, ref, and the JSON line of each asset."""
    risk = F.struct(F.lit("unassessed").alias("risk_level"), F.array().cast("array<string>").alias("flags"))
    anchor = F.coalesce("anchor", F.lit(None).cast("struct<block_id:string,paragraph_text:string,page:int>"))
    entry = F.struct(
        F.col("ref").alias("resource_id"), "ref", "kind", F.col("source_path").alias("container_path"), "relationship_type", "filename", F.col("filename").alias("original_filename"), "content_type", "detected_mime", "extension",
        "size_bytes", "sha256", "position", F.when(F.col("anchor").isNull(), F.from_json(F.lit("{}"), "struct<block_id:string,paragraph_text:string,page:int>")).otherwise(anchor).alias("anchor"), "parse_policy", "parse_status", risk.alias("risk"), "path",
    )
    return found(assets_).select("doc_id", "position", "ref", F.to_json(entry).alias("json"))


def child_files(assets_: DataFrame) -> DataFrame:
    """doc_id and the Markdown index of its assets: a table, and the same as YAML."""
    cell = lambda c: F.regexp_replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\n", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in ("ref", "kind", "filename", "target_path", "entry_point")), F.lit("")), F.lit(" |"))
    yaml = F.concat(*(x for lead, key, c in (("  - ", "ref", "ref"), ("    ", "kind", "kind"), ("    ", "filename", "filename"), ("    ", "markdown_reference", "markdown_reference"), ("    ", "path", "target_path"), ("    ", "entry_point", "entry_point")) for x in (F.lit(f"{lead}{key}: "), T.json_text(F.col(c)), F.lit("\n"))), F.lit("    tables: []"))
    e = found(assets_).withColumn("e", F.struct(row.alias("row"), yaml.alias("yaml"))).groupBy("doc_id").agg(_ordered().alias("all"))
    part = lambda f: F.array_join(F.transform("all", lambda x: x["e"][f]), "\n")
    head = "# Child Files\n\n| ref | kind | filename | path | entry point | tables |\n| --- | --- | --- | --- | --- | --- |\n"
    full = F.concat(F.lit(head), part("row"), F.lit("\n\n## YAML Index\n\n```yaml\nchild_files:\n"), part("yaml"), F.lit("\n```\n"))
    empty = f"{head}|  |  |  |  |  |  |\n\n## YAML Index\n\n```yaml\nchild_files: []\n```\n"
    return assets_.select("doc_id").distinct().join(e.select("doc_id", full.alias("child_files")), "doc_id", "left").withColumn("child_files", F.coalesce("child_files", F.lit(empty)))


def manifests(assets_: DataFrame, documents: DataFrame, stamp: Column | None = None) -> DataFrame:
    """doc_id, parse_status, counts, and the manifest as JSON. Any warning makes a package partial."""
    kinds = {"embedded_objects": "attachment", "images": "image", "charts": "chart", "diagrams": "diagram"}
    has = F.col("parse_status.preview_path").isNotNull()
    what = F.when(F.col("kind") == "attachment", F.when(has, "Embedded attachment with shallow preview").otherwise("Embedded attachment preserved without parsing")).when(F.col("kind") == "chart", F.when(has, "Word chart with shallow preview").otherwise("Word chart preserved without preview")).when(F.col("kind") == "diagram", F.when(has, "Word SmartArt with shallow preview").otherwise("Word SmartArt preserved without preview"))
    image = F.col("kind") == "image"
    item = F.struct("position", "ref", F.struct("ref", "filename", "type", what.alias("description"), F.when(image, F.col("content_type")).alias("content_type"), "path", F.when(~image, F.col("parse_status.preview_path")).alias("entry_point"), F.when(F.col("kind") != "attachment", F.col("source_path")).alias("source_path")).alias("e"))
    per = assets_.groupBy("doc_id").agg(
        *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()), *(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))), lambda x: x["e"]).alias(f"{n}_") for n, k in kinds.items()),
    )
    d = documents.select("doc_id", "parser", "warnings", F.octet_length("content").alias("bytes"), F.when(F.size("warnings") > 0, "partial").otherwise("success").alias("parse_status")).join(per, "doc_id", "left")
    stats = F.struct(F.coalesce("embedded_objects", F.lit(0)).alias("embedded_object_count"), F.coalesce("images", F.lit(0)).alias("image_count"), F.coalesce("charts", F.lit(0)).alias("chart_count"), F.coalesce("diagrams", F.lit(0)).alias("diagram_count"), F.col("bytes").alias("content_md_bytes"))
    at = {"main": "structured/content.md", "child_files": "structured/child_files.md", "position_map": "structured/position_map.csv", "embedded_resources": "structured/embedded_resources.jsonl"}
    content_map = F.struct(*(F.lit(v).alias(k) for k, v in at.items()), F.col("parser").alias("main_parser"), *(F.col(f"{n}_").alias(n) for n in kinds))
    body = F.struct("doc_id", F.lit("raw/original.docx").alias("original_file"), *([stamp.alias("parse_timestamp")] if stamp is not None else []), F.lit(VERSION).alias("pipeline_version"), "parse_status", stats.alias("content_stats"), F.col("warnings").alias("parse_warnings"), content_map.alias("content_map"))
    return d.select("doc_id", "parse_status", stats.alias("content_stats"), F.to_json(body).alias("manifest"))


def pure_status(documents: DataFrame) -> DataFrame:
    """doc_id and the status of a package that holds a parser's text only: failed where it is empty."""
    return documents.select("doc_id", F.when(F.coalesce("content", F.lit("")) == "", "failed").when(F.size("warnings") > 0, "partial").otherwise("success").alias("parse_status"))


def parse_logs(documents: DataFrame) -> DataFrame:
    lines = F.concat(F.array(F.lit("warnings:")), F.transform("warnings", lambda w: F.concat(F.lit("- "), w)))
    status = F.when(F.size("warnings") > 0, "status: partial").otherwise("status: success")
    return documents.select("doc_id", F.concat(status, F.lit("\n"), F.when(F.size("warnings") > 0, F.array_join(lines, "\n")).otherwise("warnings: []"), F.lit("\n")).alias("log"))


def deduplicated(assets_: DataFrame) -> DataFrame:
    """The first asset of each payload within a document: one file a content."""
    w = Window.partitionBy("doc_id", "sha256").orderBy("position")
    return found(assets_).withColumn("copy", F.row_number().over(w)).filter("copy = 1").drop("copy")


def groundtruth(packages: DataFrame) -> DataFrame:
    """doc_id, source_file, expected (JSON), auto_warnings."""

    def decode(row: dict):
        e, w = D.expectations(row["content"])
        yield {"doc_id": posixpath.splitext(posixpath.basename(row["doc_id"]))[0], "source_file": posixpath.basename(row["doc_id"]), "expected": json.dumps(e, ensure_ascii=False), "auto_warnings": w}

    return flat_map(packages.filter("doc_id is not null").select("doc_id", "content"), decode, "doc_id string, source_file string, expected string, auto_warnings array<string>")


def new_groundtruth(found_: DataFrame, written: DataFrame, force: bool = False) -> DataFrame:
    """What to append: documents whose ground truth isn't written yet, or all."""
    return found_ if force else found_.join(written.select("doc_id").distinct(), "doc_id", "left_anti")


def write(packages: DataFrame, path: str, parser: str = "native", unsafe: bool = False) -> None:
    """The package tables under a folder: assets (payloads included), documents, manifests, indexes, logs."""
    spark = packages.sparkSession
    assets(packages, unsafe).write.parquet(f"{path}/assets")
    parse_main(packages, parser).write.parquet(f"{path}/documents")
    a, d = spark.read.parquet(f"{path}/assets"), spark.read.parquet(f"{path}/documents")
    position_map(a).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "position", "ref").write.option("header", True).csv(f"{path}/position_map")
    resource_entries(a).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "position", "ref").select(F.col("json").alias("value")).write.text(f"{path}/embedded_resources")
    child_files(a).write.parquet(f"{path}/child_files")
    manifests(a, d, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).write.parquet(f"{path}/manifests")
    parse_logs(d).write.parquet(f"{path}/parse_logs")
