"""python -m paperloom pipeline|parser|batch|groundtruth|eval: packages of documents, and their evaluation. Exit status 0: clean; 2: with warnings; 1: a parser gave nothing."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .operators import fidelity as E
from .operators import package as P
from .sources import ooxml


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    cli = argparse.ArgumentParser(prog="paperloom")
    commands = cli.add_subparsers(dest="command", required=True)
    for name, what in (("pipeline", "one DOCX as a package"), ("batch", "every DOCX under a folder"), ("parser", "one DOCX by a parser alone")):
        c = commands.add_parser(name, help=what)
        if name == "parser":
            c.add_argument("main_parser")
        c.add_argument("input")
        c.add_argument("output")
        if name != "parser":
            c.add_argument("--main-parser", default="native")
            c.add_argument("--unsafe-unwrap-embedded", action="store_true")
    c = commands.add_parser("groundtruth", help="expectations of every DOCX under a folder, a JSON line each")
    c.add_argument("input")
    c.add_argument("output")
    c = commands.add_parser("eval", help="scores of written packages against ground truth")
    c.add_argument("packages")
    c.add_argument("groundtruth")
    c.add_argument("output")
    args = cli.parse_args(argv)
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    if args.command == "eval":
        return evaluation.evaluate(spark, args.packages, args.groundtruth, args.output)
    if args.command == "groundtruth":
        found = P.groundtruth(ooxml.scan(spark, args.input, "*.docx"))
        body = F.struct("doc_id", "source_file", F.from_json("expected", E.EXPECTED).alias("expected"), "auto_warnings")
        found.select(F.to_json(body).alias("value")).write.text(args.output)
        return 0
    folder, glob = (args.input, "*.docx") if args.command == "batch" else (os.path.dirname(args.input) or ".", os.path.basename(args.input))
    docs = ooxml.scan(spark, folder, glob)
    if args.command == "parser":
        P.parse_main(docs, args.main_parser).write.parquet(f"{args.output}/documents")
        status = P.pure_status(spark.read.parquet(f"{args.output}/documents"))
    else:
        P.write(docs, args.output, args.main_parser, args.unsafe_unwrap_embedded)
        status = spark.read.parquet(f"{args.output}/manifests")
    codes = status.select(F.when(F.col("parse_status") == "success", 0).when(F.col("parse_status") == "partial", 2).otherwise(1).alias("code"))
    return E.exit_status(codes).first()["status"]


if __name__ == "__main__":
    sys.exit(main())
