"""Exact top-k search by MaxScore.

Every row of the queries is a query; documents are scored with BM25 over their words, in fixed point (1/SCALE), so sums are exact.
Collection statistics (documents, average length, document frequencies of the query terms) are counted over all documents. Each
task cuts its documents into shards of SHARD rows and keeps postings of the query terms only. For a query, a term's bound is its
greatest score in the shard. The k-th best score so far, or the k-th best impact of any one term where that is greater, is what a
document must reach. Terms are sorted by bound; those whose bounds together stay under that are non-essential: a document without
an essential term can't win, so their postings aren't traversed. Essential postings are, that of the greatest bound first, and
the threshold rises after each, so fewer terms stay essential; candidates probe the other terms,
greatest bound first, while their score plus the bounds that are left can still compete. The threshold rises from shard to shard.
A task's best k per query are merged with the others' in one small shuffle. Queries are sent in blocks of about BLOCK.

Cases. A query's repeated words count once. Queries and documents without words, or null, match nothing, and documents that
share no word with a query aren't reported, so a query may have fewer than k rows. Equal scores rank by doc_id, nulls last.
Repeated documents are ranked each by itself. Queries with a null item_id are left out; those that share
an item_id are one query of all their words. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Shared, arrow_map, cut, table
from ._text import Table, U, chunks

K, K1, B = 10, 1.2, 0.75
SCALE = 1_000_000
#: Documents of a shard, and queries of a pass over the documents.
SHARD, BLOCK = 2_000, 20_000


def _statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with words, their words together, and each term's document frequency."""
    shared = Shared(docs.sparkSession, terms, Table)

    def run(batches):
        t = shared.get()
        df, n, words = np.zeros(len(t.keys), np.int64), 0, 0
        for b in batches:
            for c in chunks(b.column("text")):
                at, _, of = _postings(t, c)
                df += np.bincount(at, minlength=len(df))
                lens = np.diff(of)
                n, words = n + int((lens > 0).sum()), words + int(lens.sum())
        some = np.flatnonzero(df)
        yield pa.record_batch({"term": np.concatenate((some, [-1, -2])).astype(np.int32), "n": np.concatenate((df[some], [n, words]))})

    got = arrow_map(docs.select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = np.asarray(got["term"]), np.asarray(got["n"])
    df = np.zeros(len(terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term == -1].sum()), int(n[term == -2].sum()), df


def _postings(t: Table, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term of each (text, term) cell; the cells as text << 32 | term with counts in parallel; word bounds of the texts."""
    _, _, h, bounds = c.words()
    at = t.find(h).astype(np.int64)
    of = np.repeat(np.arange(c.n, dtype=np.int64), np.diff(bounds))
    cell, tf = np.unique((of << 32 | at)[at >= 0], return_counts=True)
    return cell & 0xFFFFFFFF, np.stack((cell >> 32, tf)), bounds


class _Shard:
    """Postings by term: documents ascending, with scores."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.bound = np.zeros(n_terms, np.int64)
        full = np.flatnonzero(np.diff(self.at))
        if len(full):
            self.bound[full] = np.maximum.reduceat(self.impact, self.at[full])
        self.score = np.zeros(n_docs, np.int64)
        self.floors: dict[int, int] = {}
        self.traversed = 0  # postings that searches went through, for tests

    def floor(self, t: int, k: int) -> int:
        """The k-th best impact of a term: k documents score at least this much."""
        if t not in self.floors:
            own = self.impact[self.at[t] : self.at[t + 1]]
            self.floors[t] = int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else 0
        return self.floors[t]

    def search(self, terms: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score at least `least`, a superset of this shard's part of the best k, with exact scores."""
        terms = terms[self.bound[terms] > 0]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = terms[np.argsort(self.bound[terms], kind="stable")]
        least = max(least, *(self.floor(t, k) for t in terms.tolist() if self.bound[t] > least), 1)
        below = np.concatenate(([0], np.cumsum(self.bound[terms])))  # bounds of the terms before each
        split = len(terms)  # the first `split` terms together may stay under least: they aren't traversed
        while split and below[split] >= least:
            split -= 1
            own = slice(self.at[terms[split]], self.at[terms[split] + 1])
            self.score[self.doc[own]] += self.impact[own]
            self.traversed += own.stop - own.start
            if len(self.score) >= k and split:
                least = max(least, int(np.partition(self.score, len(self.score) - k)[len(self.score) - k]))
        docs = np.flatnonzero(self.score)
        score = self.score[docs]
        self.score[:] = 0
        for j in range(split - 1, -1, -1):
            if len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
            ok = score + below[j + 1] >= least
            docs, score = docs[ok], score[ok]
            if not len(docs):
                break
            own = slice(self.at[terms[j]], self.at[terms[j] + 1])
            at = np.minimum(np.searchsorted(self.doc[own], docs), own.stop - own.start - 1)
            score = score + np.where(self.doc[own][at] == docs, self.impact[own][at], 0)
            self.traversed += len(docs)
        ok = score >= least
        return docs[ok], score[ok]


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, doc_id, score (in 1/SCALE) and rank of the k best documents of each query."""
    spark = docs.sparkSession

    def hashes(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                _, _, h, bounds = c.words()
                of = np.repeat(np.arange(c.n), np.diff(bounds))
                row = pa.array(of + c.first)
                yield pa.record_batch({"item": b.column("item").take(row), "term": h.view(np.int64)})

    rows = queries.filter("item_id is not null and text is not null").select(F.col("item_id").alias("item"), "text")
    named = rows.schema["item"].dataType.simpleString()
    words = arrow_map(rows, hashes, f"item {named}, term long")
    sets = cut(words.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {named}, doc_id {kind}, score long"
    out = spark.createDataFrame([], schema)
    blocks = -(-sets.count() // BLOCK)
    for block in range(blocks):
        got = sets.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == block).orderBy("item", "terms").toArrow()
        items = got["item"].combine_chunks()
        own = [np.asarray(x, np.int64).view(U) for x in got["terms"].to_pylist()]
        if not own:
            continue
        terms = np.unique(np.concatenate(own))
        n, total, df = _statistics(docs, terms)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        value = (terms, idf, total / max(n, 1), items, [np.searchsorted(terms, x) for x in own])
        out = out.unionByName(_pass(docs, Shared(spark, value, lambda v: (Table(v[0]), *v[1:])), schema, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pass(docs: DataFrame, shared: Shared, schema: str, k: int) -> DataFrame:
    def run(batches):
        t, idf, average, items, queries = shared.get()
        best: list[tuple[np.ndarray, pa.Array] | None] = [None] * len(queries)
        parts, ids, n = [], [], 0

        def flush():
            if not parts:
                return
            term, doc, tf, lens = (np.concatenate(x) for x in zip(*parts, strict=True))
            impact = np.floor(SCALE * (idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens / average)))) + 0.5).astype(np.int64)
            shard = _Shard(term, doc, impact, len(t.keys), n)
            names = pa.concat_arrays(ids)
            for q, own in enumerate(queries):
                had = best[q]
                least = int(had[0].min()) if had is not None and len(had[0]) >= k else 1
                docs_, score = shard.search(own, least, k)
                if not len(docs_):
                    continue
                name = names.take(pa.array(docs_))
                if had is not None:
                    score, name = np.concatenate((had[0], score)), pa.concat_arrays([had[1], name])
                if len(score) > k:
                    top = np.asarray(pc.sort_indices(pa.table({"s": score, "d": name}), [("s", "descending"), ("d", "ascending")])[:k])
                    score, name = score[top], name.take(pa.array(top))
                best[q] = (score, name)

        for b in batches:
            col = b.column("doc_id")
            for c in chunks(b.column("text")):
                term, cell, bounds = _postings(t, c)
                parts.append((term, cell[0] + n, cell[1], np.diff(bounds)[cell[0]]))
                ids.append(col.slice(c.first, c.n))
                n += c.n
                if n >= SHARD:
                    flush()
                    parts, ids, n = [], [], 0
        flush()
        for q, had in enumerate(best):
            if had is not None:
                yield pa.record_batch({"item_id": items.take(pa.array([q] * len(had[0]))), "doc_id": had[1], "score": had[0]})

    return arrow_map(docs.select("doc_id", "text"), run, schema)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda w: w <> '')"
SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS average FROM d WHERE len(ws) > 0),
tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY r, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
impact AS (SELECT tf.r, tf.w, floor({SCALE} * (ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len(ws) / average)))) + 0.5)::BIGINT AS s
  FROM tf JOIN df USING (w) JOIN d USING (r) CROSS JOIN stats),
scores AS (SELECT item_id, r, sum(s)::BIGINT AS score FROM impact JOIN q USING (w) GROUP BY item_id, r)
SELECT item_id, doc_id, score, rank FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores JOIN d USING (r)) WHERE rank <= {K}
"""
