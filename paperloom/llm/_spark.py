"""Session helpers of the llm operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times their width beyond which a side isn't broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Without one, executors couldn't read what others write, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local"):
        # one machine, one process: its folder is shared by definition
        spark.sparkContext.setCheckpointDir(f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/paperloom")
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can read and write")
    return named


def delete_on_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written in the shared folder: computed once, and safe when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df (a cut table: counting reads footers only) has at most limit bytes at width bytes a row."""
    return df.count() * width <= limit


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, width: int) -> DataFrame:
    """left joined to a cut table: broadcast where it is small, else shuffled (Spark's sort-merge join)."""
    return left.join(F.broadcast(right) if small(right, width) else right.hint("merge"), on, how)


_built: dict[str, object] = {}


class Shared:
    """A broadcast value, and what build() makes of it, kept once in each worker."""

    def __init__(self, spark: SparkSession, value: object, build: Callable):
        self.value, self.build, self.key = spark.sparkContext.broadcast(value), build, uuid.uuid4().hex

    def get(self):
        if self.key not in _built:
            if len(_built) > 1:
                _built.clear()
            _built[self.key] = self.build(self.value.value)
        return _built[self.key]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and an executor's add up."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the batches of each partition."""

    def run(batches):
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of node's connected component, for nodes of edges(a, b).

    Alternates large-star and small-star contraction, so rounds grow with the logarithm of the longest path; each round is cut
    to the shared folder.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u").select(F.col("v").alias("x"), "u", "m").select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e"))
        now = cut(small_.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            break
        before = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
