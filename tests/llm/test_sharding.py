from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import sharding as S


def test_matches_sql(docs, same):
    d = docs([(i, "t") for i in range(500)] + [(3, "t"), (None, "t"), (None, "u")], clash=True)
    same(S.assign(d.select("doc_id"), "doc_id", S.SHARDS), S.SQL, documents=d)


def test_shares_and_moves(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"))
    of = lambda shards: {r["doc_id"]: r["shard"] for r in S.assign(df, "doc_id", shards).collect()}
    old = of([(0, 1.0), (1, 1.0), (2, 2.0)])
    n = Counter(old.values())
    assert abs(n[2] / 40_000 - 0.5) < 0.02 and abs(n[0] / 40_000 - 0.25) < 0.02
    new = of([(0, 1.0), (1, 1.0), (2, 2.0), (3, 1.0)])
    moved = [i for i in old if old[i] != new[i]]
    assert all(new[i] == 3 for i in moved) and abs(len(moved) / 40_000 - 0.2) < 0.02
    less = of([(0, 1.0), (2, 2.0)])
    assert all(less[i] == old[i] for i in old if old[i] != 1)


def test_cases(docs, spark, tmp_path):
    assert S.assign(docs([]), "doc_id", S.SHARDS).collect() == []
    with pytest.raises(ValueError):
        S.assign(docs([]), "doc_id", [(0, 0.0)])
    d = docs([(1, "t"), (None, "t"), (None, None)], clash=True).withColumn("shard", F.lit("old"))
    got = S.assign(d, "doc_id", [(9, 0.0), (4, 1.0)]).collect()
    assert {r["shard"] for r in got} == {4} and len(got) == 3
    S.write(d, "doc_id", S.SHARDS, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
