"""Table functions for SQL: parts, assets and tables of documents without Python at the call site."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """parse_tables(markdown), docx_parts(bytes), xlsx_cells(bytes) and ole_streams(bytes), for LATERAL joins."""
    from ..operators.markdown import parse_tables
    from ..sources import cfb
    from ..sources.ooxml import read_zip
    from ..sources.workbook import facts_of

    @udtf(returnType="table_idx int, parser string, n_rows int, n_cols int, cells array<array<string>>")
    class ParseTables:
        def eval(self, markdown: str):
            for k, t in enumerate(parse_tables(markdown or "")):
                yield (k, *t)

    @udtf(returnType="part string, content binary")
    class DocxParts:
        def eval(self, data: bytes):
            yield from read_zip(data)[0].items()

    @udtf(returnType="sheet string, row int, col int, ref string, value string, formula string")
    class XlsxCells:
        def eval(self, data: bytes):
            for f in facts_of(data, assets=False):
                if f["fact"] == "cell":
                    yield f["sheet"], f["row"], f["col"], f["ref"], f.get("value"), f.get("formula")

    @udtf(returnType="stream string, content binary")
    class OleStreams:
        def eval(self, data: bytes):
            yield from cfb.streams(bytes(data or b"")).items()

    for name, f in (("parse_tables", ParseTables), ("docx_parts", DocxParts), ("xlsx_cells", XlsxCells), ("ole_streams", OleStreams)):
        spark.udtf.register(name, f)
