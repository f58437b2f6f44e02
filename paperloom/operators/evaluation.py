"""Evaluation of written packages: folders of packages and of ground truth in, four reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fidelity as E

_TEXTS = ("structured/attachments/[^/]+/content[.]md", "structured/resources/[^/]+/preview[.]md", "structured/resources/[^/]+/preview[.]json")


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """name (below the folder) and content of each file; the content is read only where it is selected."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.ltrim(F.expr(f"substring(path, {len(root) + 1})"), F.lit("/")).alias("name"), "content")


def groundtruth(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and expected (JSON): a document a *.json file, and a document a line of the part files that `groundtruth` writes."""
    whole = _files(spark, folder, "*.json").select(F.regexp_extract("name", r"([^/]*)[.]json$", 1).alias("stem"), F.decode("content", "UTF-8").alias("value"))
    lines = _files(spark, folder, "part-*.txt").select(F.lit(None).cast("string").alias("stem"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value")).filter("value <> ''")
    named = F.get_json_object("value", "$.doc_id")
    both = whole.unionByName(lines).select(F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.col("stem")).alias("doc_id"), F.get_json_object("value", "$.expected").alias("expected"))
    return both.filter("doc_id is not null")


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages at <doc_id>/<method>/ below the folder, in the columns that fidelity.checks() reads."""
    part = F.split("name", "/")
    named = lambda df: df.select(F.get(part, F.lit(0)).alias("doc_id"), F.get(part, F.lit(1)).alias("method"), F.array_join(F.filter(part, lambda _, k: k > 1), "/").alias("at"), *[c for c in df.columns if c != "name"]).filter("at <> ''")
    every = named(_files(spark, folder, "*").select("name")).groupBy("doc_id", "method").agg(F.sort_array(F.collect_list("at")).alias("files"))
    kind = F.coalesce(*(F.when(F.col("at").rlike(f"^{p}$"), k) for k, p in enumerate(_TEXTS)))
    texts = named(_files(spark, folder, "*.{md,json}")).withColumn("kind", F.when(F.col("at") == "structured/content.md", -2).when(F.col("at") == "manifest.json", -1).otherwise(kind)).filter("kind is not null")
    texts = texts.select("doc_id", "method", F.struct("kind", "at", F.decode("content", "UTF-8").alias("text")).alias("t")).groupBy("doc_id", "method").agg(F.sort_array(F.collect_list("t")).alias("t"))
    one = lambda k: F.get(F.filter("t", lambda x: x["kind"] == k), F.lit(0))["text"]
    extra = F.transform(F.filter("t", lambda x: x["kind"] >= 0), lambda x: F.struct(F.get(F.split(x["at"], "/"), F.lit(2)).alias("ref"), x["text"].alias("text")))
    manifest = F.from_json(F.get_json_object(one(-1), "$.content_map"), E.MANIFEST)
    rows = every.join(texts, ["doc_id", "method"], "left")
    return rows.select("doc_id", "method", F.coalesce(one(-2), F.lit("")).alias("body"), F.coalesce(extra, F.expr("cast(array() as array<struct<ref: string, text: string>>)")).alias("extra"), manifest.alias("manifest"), "files")


def results(scores: DataFrame, doc_scores: DataFrame) -> DataFrame:
    """A row a package: every dimension and the doc_score, as texts of four decimals, a dash where one doesn't apply."""
    wide = scores.groupBy("doc_id", "method").pivot("dimension", list(E.DIMENSIONS)).agg(F.first("score"))
    return wide_results(doc_scores.join(wide, ["doc_id", "method"], "left"))


def wide_results(wide: DataFrame) -> DataFrame:
    """results() of fidelity.doc_scores() with all dimensions."""
    return wide.select("doc_id", "method", *(E.formatted(F.col(c)).alias(c) for c in (*E.DIMENSIONS, "doc_score")))


def evaluate(spark: SparkSession, packages_folder: str, groundtruth_folder: str, out: str) -> int:
    """Scores every package whose document has ground truth. Writes results, summary and misses as tab-separated tables, and the
    report of misses as Markdown, each a folder under `out`; the checks stay beside them as Parquet. 1 where no package matches."""
    gt = groundtruth(spark, groundtruth_folder)
    found = packages(spark, packages_folder)
    E.checks(found, gt).write.parquet(f"{out}/checks")
    checks = spark.read.parquet(f"{out}/checks")
    scores = E.scores(checks)
    docs = E.doc_scores(scores, found, gt)
    docs.write.parquet(f"{out}/doc_scores")
    docs = spark.read.parquet(f"{out}/doc_scores")
    tsv = lambda df, name: df.write.option("sep", "\t").option("header", True).csv(f"{out}/{name}")
    tsv(results(scores, docs).orderBy("doc_id", "method"), "results")
    number: list[Column] = [E.formatted(F.col(c)).alias(c) for c in (*E.DIMENSIONS, "doc_score")]
    tsv(E.summary(scores, docs).select("method", "n_docs", *number).orderBy("method"), "summary")
    misses = E.misses(checks)
    tsv(misses.orderBy("doc_id", "method", "seq").select("doc_id", "method", "dimension", F.col("miss").alias("missing")), "misses")
    E.misses_report(misses).orderBy("method").select("report").write.text(f"{out}/misses_report")
    return 0 if docs.limit(1).count() else 1
