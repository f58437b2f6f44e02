"""Resumable ingestion: new packages under a folder are decoded as they arrive; the checkpoint holds what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import package as P

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """doc_id, content of each package that appears; lock files are skipped."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.filter(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^~(\$|%24)")).select(F.col("path").alias("doc_id"), "content")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, parser: str = "native") -> StreamingQuery:
    """Documents of all that is new, appended to a Parquet folder, once each; then it ends."""
    return P.parse_main(stream(spark, source), parser).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
