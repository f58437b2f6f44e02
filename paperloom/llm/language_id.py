"""Language ID: multinomial naive Bayes over hashed character n-grams.

The 1- to 3-grams of a lower-cased text's code points are hashed into BUCKETS. Counts by language are taken over all rows that
name a language; the matrix of log-probabilities (with ALPHA added to each count) is rounded to fixed point and broadcast, and a
batch of texts is scored in numpy: a text's grams pick rows of the matrix, whose sum, with the log prior, is its score for each
language. Integer sums make results independent of the partitioning. The matrix has BUCKETS rows whatever the corpus.

Cases. Null and empty texts have no grams: their language and margin are null. Rows with a null language aren't counted but are
classified. Null doc_ids pass through. Repeated rows count, and come out, each time. Ties go to the first language in
alphabetical order. Without any named language every prediction is null; with just one the margin is null. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Shared, arrow_map, table
from ._text import Chunk, chunks

BUCKETS, ALPHA, SCALE = 1 << 16, 0.5, 1024
#: A gram of code points a, b, c has bucket (a * F[0] + b * F[1] + c * F[2] + its length * SALT) mod BUCKETS.
FACTORS, SALT = (7919, 104729, 1299709), 15485863


def _grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram, sorted by text, and bounds."""
    cp = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum((c.data & 0xC0) != 0x80)))[c.offs]
    lens = np.diff(chars)
    left = np.repeat(chars[1:], lens) - np.arange(len(cp))  # code points from here to the text's end
    grid = np.full((3, len(cp)), -1, np.int64)
    total = np.zeros(len(cp), np.int64)
    for n in range(3):
        total = total[: len(cp) - n] + cp[n:] * FACTORS[n] if len(cp) > n else total[:0]
        grid[n, : len(total)] = np.where(left[: len(total)] > n, (total + (n + 1) * SALT) % BUCKETS, -1)
    flat = grid.T.ravel()
    count = 3 * lens - np.minimum(lens, 1) - np.minimum(lens, 2)
    return flat[flat >= 0], np.concatenate(([0], np.cumsum(count)))


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for c in chunks(b.column("text")):
            g, bounds = _grams(c)
            own = langs[c.first : c.first + c.n]
            for lang in set(own):
                rows = np.array([x == lang for x in own])
                n = np.bincount(g[np.repeat(rows, np.diff(bounds))], minlength=BUCKETS + 1)
                n[BUCKETS] += rows.sum()
                counts[lang] = counts.get(lang, 0) + n
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(some)), "bucket": some.astype(np.int32), "n": n[some]})


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Languages, and a row of fixed-point scores a bucket; the last row has the priors."""
    rows = arrow_map(docs.filter("lang is not null").select("lang", "text"), _count, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    if not langs:
        return None
    n = np.zeros((BUCKETS + 1, len(langs)))
    n[np.asarray(got["bucket"]), np.searchsorted(np.array(langs), np.asarray(got["lang"].to_pylist()))] = np.asarray(got["n"])
    grams, prior = n[:-1] + ALPHA, n[-1:]
    p = np.concatenate((grams / (n[:-1].sum(axis=0) + ALPHA * BUCKETS), prior / prior.sum()))
    return langs, np.floor(SCALE * np.log(p) + 0.5).astype(np.int32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """doc_id, predicted and margin (over the second-best language, in 1/SCALE nats)."""
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("long").alias("margin"))
    shared = Shared(docs.sparkSession, model, lambda m: (m[0], np.ascontiguousarray(m[1].T)))

    @F.arrow_udf("struct<predicted: string, margin: long>")
    def classify(texts: pa.Array) -> pa.Array:
        langs, matrix = shared.get()
        score, some = np.zeros((len(texts), len(langs)), np.int64), np.zeros(len(texts), bool)
        for c in chunks(texts):
            g, bounds = _grams(c)
            full = np.flatnonzero(np.diff(bounds))
            some[c.first + full] = True
            for k, row in enumerate(matrix):
                if len(full):
                    score[c.first + full, k] = np.add.reduceat(row[g], bounds[full], dtype=np.int64) + row[BUCKETS]
        best = score.argmax(axis=1)
        top = np.sort(score, axis=1)
        margin = top[:, -1] - top[:, -2] if len(langs) > 1 else np.zeros(len(top), np.int64)
        none = ~some
        return pa.StructArray.from_arrays([pa.array(np.array(langs, object)[best], pa.string(), mask=none), pa.array(margin, pa.int64(), mask=none | (len(langs) < 2))], ["predicted", "margin"])

    return docs.select("doc_id", classify("text").alias("r")).select("doc_id", "r.predicted", "r.margin")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


SQL = f"""
WITH chars AS (SELECT row_number() OVER () AS r, doc_id, lang, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(lower(text), ''), lambda c: unicode(c)::BIGINT) END AS cs FROM documents),
pos AS (SELECT r, lang, cs, unnest(range(1, len(cs) + 1)) AS i FROM chars WHERE len(cs) > 0),
grams AS (
  SELECT r, lang, (cs[i] * {FACTORS[0]} + {SALT}) % {BUCKETS} AS g FROM pos
  UNION ALL SELECT r, lang, (cs[i] * {FACTORS[0]} + cs[i + 1] * {FACTORS[1]} + {2 * SALT}) % {BUCKETS} FROM pos WHERE i + 1 <= len(cs)
  UNION ALL SELECT r, lang, (cs[i] * {FACTORS[0]} + cs[i + 1] * {FACTORS[1]} + cs[i + 2] * {FACTORS[2]} + {3 * SALT}) % {BUCKETS} FROM pos WHERE i + 2 <= len(cs)),
freq AS (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
langs AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang),
totals AS (SELECT lang, count(*) AS total FROM grams WHERE lang IS NOT NULL GROUP BY lang),
counts AS (SELECT lang, g, count(*) AS n FROM grams WHERE lang IS NOT NULL GROUP BY lang, g),
seen AS (SELECT DISTINCT g FROM grams),
m AS (SELECT l.lang, s.g, floor({SCALE} * ln((coalesce(c.n, 0) + {ALPHA}) / (coalesce(t.total, 0) + {ALPHA * BUCKETS})) + 0.5)::BIGINT AS w
  FROM langs l CROSS JOIN seen s LEFT JOIN counts c ON c.lang = l.lang AND c.g = s.g LEFT JOIN totals t ON t.lang = l.lang),
scores AS (SELECT f.r, m.lang, sum(f.n * m.w)::BIGINT + any_value(floor({SCALE} * ln(l.docs / (SELECT sum(docs) FROM langs)) + 0.5)::BIGINT) AS s
  FROM freq f JOIN m USING (g) JOIN langs l ON l.lang = m.lang GROUP BY f.r, m.lang),
ranked AS (SELECT r, lang, s - lead(s) OVER (PARTITION BY r ORDER BY s DESC, lang) AS margin, row_number() OVER (PARTITION BY r ORDER BY s DESC, lang) AS k FROM scores)
SELECT c.doc_id, x.lang AS predicted, x.margin FROM chars c LEFT JOIN ranked x ON x.r = c.r AND x.k = 1
"""
