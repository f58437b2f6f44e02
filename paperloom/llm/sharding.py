"""Sharding by weighted rendezvous hashing.

A record's key is hashed once (the first 64 bits of the MD5 of its text form) and mixed with each shard's seed; the shard with
the greatest -weight / ln(u) takes it, u being the mix as a number in (0, 1). Shares follow the weights, and since a record's
scores for the other shards don't change, adding a shard moves only the records that it takes, and removing one only those that
it had. It needs no shuffle and reads only the key.

Cases. A null key is hashed like the text `\\N`, so all its records share a shard. Repeated keys share a shard. Ties, which need
equal 64-bit mixes, go to the shard listed first. An empty table gives no rows. Shards of weight 0 take nothing; without any
shard of positive weight a ValueError is raised. Other columns pass through assign() untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import U, mix

#: Shard and weight. Every fourth one is twice as large.
SHARDS = [(k, 2.0 if k % 4 == 3 else 1.0) for k in range(64)]


def seed(shard: int) -> int:
    return int(hashlib.md5(f"shard {shard}".encode()).hexdigest()[:16], 16)


def choose(keys: np.ndarray, shards: list[tuple[int, float]]) -> np.ndarray:
    best, score = np.zeros(len(keys), np.int32), np.full(len(keys), -np.inf)
    for shard, weight in shards:
        u = ((mix(keys ^ U(seed(shard))) >> U(11)).astype(np.float64) + 0.5) / 2.0**53
        s = -weight / np.log(u)
        better = s > score
        best[better], score[better] = shard, s[better]
    return best


def shard_of(key: Column, shards: list[tuple[int, float]]) -> Column:
    shards = [(k, w) for k, w in shards if w > 0]
    if not shards:
        raise ValueError("no shard has a positive weight")

    @F.arrow_udf("int")
    def rendezvous(hashes: pa.Array) -> pa.Array:
        h = np.frombuffer(b"".join(bytes.fromhex(x) for x in hashes.to_pylist()), ">u8").astype(U)
        return pa.array(choose(h, shards))

    return rendezvous(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\\N")).cast("binary")), 1, 16))


def assign(df: DataFrame, key: str, shards: list[tuple[int, float]], out: str = "shard") -> DataFrame:
    """df with the shard of each row; a column already called out is replaced."""
    return df.withColumn(out, shard_of(F.col(key), shards))


def write(df: DataFrame, key: str, shards: list[tuple[int, float]], path: str) -> None:
    """One folder a shard."""
    assign(df, key, shards).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


SQL = f"""
WITH shards(shard, weight, seed) AS (VALUES {", ".join(f"({k}, {w}, {seed(k)}::UBIGINT)" for k, w in SHARDS)}),
keys AS (SELECT row_number() OVER () AS r, doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 16))::UBIGINT AS h FROM documents),
a AS (SELECT r, doc_id, shard, weight, xor(h, seed) AS h FROM keys CROSS JOIN shards),
b AS (SELECT r, doc_id, shard, weight, (((xor(h, h >> 30))::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM a),
c AS (SELECT r, doc_id, shard, weight, (((xor(h, h >> 27))::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM b),
d AS (SELECT r, doc_id, shard, -weight / ln(((xor(h, h >> 31) >> 11)::DOUBLE + 0.5) / 9007199254740992.0) AS score FROM c)
SELECT doc_id, shard FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, shard) AS k FROM d) WHERE k = 1
"""
