"""What is known of a workbook's images: their size, whether they look like logos, and the status of texts made of them."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T

MAX_LOGO_AREA = 40_000
_LOGO = "(^|-)(logo|brand|icon|favicon|symbol|mark|badge|emblem|crest|insignia)"


def dimensions(data: bytes | None) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, GIF, BMP or JPEG."""
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", data, 16)
        if data[:4] == b"GIF8":
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return w, abs(h)
        at = 2 if data[:2] == b"\xff\xd8" else len(data)
        while at < len(data):
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return w, h
            at += 2 + size
    except (struct.error, IndexError):
        pass
    return None


@F.arrow_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def size_of(data: pa.Array) -> pa.Array:
    got = [dimensions(d) for d in data.to_pylist()]
    return pa.array([None if g is None else {"width": g[0], "height": g[1]} for g in got], pa.struct([("width", pa.int32()), ("height", pa.int32())]))


def is_logo(filename: Column, width: Column, height: Column, most: int = MAX_LOGO_AREA) -> Column:
    """By name; else, where the size is known and most > 0, by a small area or a short side."""
    small = (F.lit(most) > 0) & ((width.cast("long") * height < most) | (F.least(width, height) < 50))
    return F.lower(filename).rlike(_LOGO) | F.coalesce(small, F.lit(False))


def combined_status(ocr: Column, caption: Column) -> Column:
    both = lambda s: (ocr == s) | (caption == s)
    return F.when(both("logo"), "logo").when(both("generated"), "generated").when(both("failed"), "partial_failed").when((ocr == "not_configured") & (caption == "not_configured"), "not_configured").otherwise("not_generated")


def described(images: DataFrame) -> DataFrame:
    """(workbook, sheet, asset_ref, cell, filename, content) with sizes, statuses and a description; no reader of images is configured."""
    d = images.withColumn("s", size_of("content")).select("workbook", "sheet", "asset_ref", "cell", "filename", "s.width", "s.height")
    status = F.when(is_logo(F.col("filename"), F.col("width"), F.col("height")), "logo").otherwise("not_configured")
    d = d.withColumn("ocr_status", status).withColumn("caption_status", status).withColumn("semantic_status", combined_status(F.col("ocr_status"), F.col("caption_status")))
    place = F.concat(F.lit("XLSX sheet '"), "sheet", F.lit("'"), F.when(F.col("cell").isNotNull(), F.concat(F.lit(", anchored at cell "), "cell")).otherwise(""))
    zh = F.length(F.regexp_replace(place, "[^一-鿿]", "")) >= 0.3 * F.greatest(F.length(F.regexp_replace(place, r"[^\p{L}]", "")), F.lit(1))
    say = lambda en, cn: F.when(zh, F.lit(cn)).otherwise(F.lit(en))
    line = lambda en, cn, v: F.concat(say(en, cn), F.lit(": `"), F.coalesce(v, F.lit("None")), F.lit("`"))
    none = say("_Not generated._", "未生成")
    text = F.concat_ws("\n", F.concat(F.lit("# Image Description "), "asset_ref"), F.lit(""), line("Source file", "源文件", F.col("filename")), line("Location", "位置", place), line("Semantic status", "语义状态", F.col("semantic_status")), F.lit(""), F.concat(F.lit("## "), say("Caption", "图片描述")), F.lit(""), none, F.lit(""), F.concat(F.lit("## "), say("OCR Text", "OCR文字")), F.lit(""), none, F.lit(""))
    return d.withColumn("description", F.when(F.col("semantic_status") != "logo", T.strip(text)))
