"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark is taken in blocks of about BLOCK_ITEMS passages, by hash. Terms are the words of a block; their document
   frequencies are counted over all documents and the block. Other words have no weight.
2. A block's passages, as TF-IDF rows, are decomposed by a randomised SVD whose products (A'A times a block of vectors)
   are summed over the rows' partitions; RANK right singular vectors span the latent space. An item of more than PASSAGE words
   is cut into overlapping passages, each of which counts as an item of its own until the last step.
3. Every document is read in overlapping windows of WINDOW words, at a step of STEP. RANK vectors can't hold a benchmark of
   many more than RANK dissimilar passages, and a threshold of the cosine would tighten with the words around a copy, so
   candidates are found exactly. To cover PARAPHRASE of a passage of n words, m = ceil(PARAPHRASE n) of them must lie in the span
   of step 4; n - m are free to be missing, so of its n - m + t rarest words at least t are there. Postings of these words give,
   with t = HITS (m if that is less), every window and passage that step 4 could accept.
4. A candidate is checked around the window, as far as the item is long: the longest common subsequence of words must cover
   VERBATIM of the item, or PARAPHRASE of it with ANSWER of the words of its answer (its last sentence) present too. A match is reported with the cosine
   of window and passage in the latent space, which ranks matches and excludes none.

Windows cover whole texts, every document is a query, and nothing is capped. A block has BLOCK_ITEMS * PASSAGE terms at most, so
the matrix of terms x (RANK + OVERSAMPLE) that the driver holds and the terms and vectors that are broadcast have a bound however
large the benchmark is; each block costs two passes over the documents (frequencies, matches).

Cases. Null and empty texts, and texts or items without words, match nothing. Rows with a null doc_id can't be named: clean()
judges them like any other row, pairs() leaves them out. Rows with a null item_id are matched under the null id by clean() and
left out by pairs(). Repeated rows give one pair. An empty benchmark or table gives no pairs. Other columns are ignored by
pairs() and kept by clean().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Shared, arrow_map, cut, release, table
from ._text import Table, U, chunks

WINDOW, STEP, PASSAGE = 32, 16, 128
RANK, OVERSAMPLE, POWER = 128, 16, 2
VERBATIM, PARAPHRASE, ANSWER = 0.7, 0.5, 0.6
BLOCK_ITEMS = 4000
#: Of a passage's rarest words, so many must lie around a window; passages whose postings are read at a time.
HITS, SLICE = 4, 2000
#: Passages whose words' bits form a table, such tables that a worker keeps, and candidates that are compared at a time.
GROUP, TABLES, BATCH = 64, 8, 1 << 15
_PASS = "item long, text string, answer string"


def _words(text: str) -> np.ndarray:
    c = next(chunks(pa.array([text])))
    return c.words()[2]


def passages(benchmark: DataFrame) -> DataFrame:
    """(item, words, answer) hashes of each passage; at most PASSAGE words, overlapping by half."""

    def run(batches):
        for b in batches:
            out = {"item": [], "words": [], "answer": []}
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = _words(text)
                sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if len(_words(s))]
                answer = _words(sentences[-1]) if len(sentences) > 1 else h[-max(1, len(h) // 4) :]
                for k in range(0, max(1, len(h) - PASSAGE // 2), PASSAGE // 2) if len(h) > PASSAGE else (0,):
                    part = h[k : k + PASSAGE]
                    if len(part):
                        out["item"].append(item)
                        out["words"].append(part.view(np.int64))
                        out["answer"].append((answer if len(h) <= PASSAGE else part[-(PASSAGE // 4) :]).view(np.int64))
            yield pa.record_batch({"item": pa.array(out["item"], b.schema.field("item").type), "words": pa.array(out["words"], pa.list_(pa.int64())), "answer": pa.array(out["answer"], pa.list_(pa.int64()))})

    rows = benchmark.select(F.col("item_id").alias("item"), "text").filter("text is not null")
    return arrow_map(rows, run, f"item {rows.schema['item'].dataType.simpleString()}, words array<long>, answer array<long>")


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    shared = Shared(docs.sparkSession, terms, Table)

    def run(batches):
        t = shared.get()
        df, n = np.zeros(len(t.keys), np.int64), 0
        for b in batches:
            n += len(b)
            for c in chunks(b.column("text")):
                _, _, h, bounds = c.words()
                at = t.find(h)
                of = np.repeat(np.arange(c.n), np.diff(bounds))[at >= 0]
                key = np.sort(of.astype(np.int64) << 32 | at[at >= 0])
                key = key[np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]]
                df += np.bincount(key & 0xFFFFFFFF, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch({"term": np.append(some, -1).astype(np.int32), "df": np.append(df[some], n)})

    rows = arrow_map(docs.select("text").filter("text is not null"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, count = np.asarray(rows["term"]), np.asarray(rows["df"])
    df = np.zeros(len(terms), np.int64)
    df[term[term >= 0]] = count[term >= 0]
    return df, int(count[term < 0].sum())


def _tfidf(words: list[np.ndarray], terms: Table, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and values of a matrix of unit rows."""
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    at = terms.find(np.concatenate([np.asarray(w).view(U) for w in words])).astype(np.int64)
    cell, n = np.unique(row * len(idf) + at, return_counts=True)
    row, at = cell // len(idf), cell % len(idf)
    value = np.sqrt(n) * idf[at]
    norm = np.sqrt(np.bincount(row, value**2, len(words)))
    return row, at, value / np.maximum(norm[row], 1e-12)


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], a.ravel())


def latent_space(items: DataFrame, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """terms x rank right singular vectors of the passages' TF-IDF matrix, by randomised subspace iteration."""
    spark = items.sparkSession
    size = RANK + OVERSAMPLE
    rows = items.select("words")

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        """A'(A q), or (A q)'(A q), summed over the partitions."""
        shared = Shared(spark, (terms, idf, q), lambda v: (Table(v[0]), v[1], v[2]))

        def run(batches):
            t, w, x = shared.get()
            total = np.zeros((x.shape[1] if gram else x.shape[0], x.shape[1]))
            for b in batches:
                words = b.column("words").to_numpy(zero_copy_only=False)
                if len(words):
                    r, c, v = _tfidf(list(words), t, w)
                    y = np.zeros((len(words), x.shape[1]))
                    np.add.at(y, r, v[:, None] * x[c])
                    if gram:
                        total += y.T @ y
                    else:
                        np.add.at(total, c, v[:, None] * y[r])
            some = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch({"row": some, "part": _lists(total[some])})

        def add(batches):
            got = [(np.asarray(b.column("row")), np.asarray(b.column("part").flatten()).reshape(len(b), -1)) for b in batches if len(b)]
            if got:
                row, at = np.unique(np.concatenate([r for r, _ in got]), return_inverse=True)
                total = np.zeros((len(row), got[0][1].shape[1]))
                np.add.at(total, at, np.concatenate([x for _, x in got]))
                yield pa.record_batch({"row": row, "part": _lists(total)})

        summed = arrow_map(arrow_map(rows, run, "row long, part array<double>").repartition("row"), add, "row long, part array<double>").toArrow()
        out = np.zeros((q.shape[1] if gram else q.shape[0], q.shape[1]))
        if len(summed):
            out[np.asarray(summed["row"])] = np.asarray(summed["part"].combine_chunks().flatten()).reshape(-1, q.shape[1])
        return out

    q = np.random.default_rng(7).standard_normal((len(terms), min(size, len(terms))))
    for _ in range(POWER):
        q, _ = np.linalg.qr(product(q, False))
    value, vector = np.linalg.eigh(product(q, True))
    keep = np.argsort(value)[::-1][:RANK]
    keep = keep[value[keep] > 1e-9 * value.max()]
    return (q @ vector[:, keep]).astype(np.float32)


class _Probe:
    def __init__(self, v: dict):
        self.terms, self.idf, self.space = Table(v["terms"]), v["idf"], v["space"]
        self.item, self.words, self.answer = v["item"], v["words"], v["answer"]
        row, at, value = _tfidf(self.words, self.terms, self.idf)
        self.latent = np.zeros((len(self.words), self.space.shape[1]), np.float32)
        np.add.at(self.latent, row, value[:, None].astype(np.float32) * self.space[at])
        self.latent /= np.maximum(np.linalg.norm(self.latent, axis=1, keepdims=True), 1e-12)
        self.masks: dict[int, tuple] = {}
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        need = np.ceil(PARAPHRASE * self.sizes - 1e-9).astype(np.int64)
        self.hits = np.minimum(HITS, need)
        self.postings = [self._postings(k, self.sizes - need + self.hits) for k in range(0, len(self.words), SLICE)]

    def _postings(self, lo: int, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First posting of each term, and the passages of a slice, by term, that have it among their rarest words."""
        cells = []
        for k in range(lo, min(lo + SLICE, len(self.words))):
            at = self.terms.find(self.words[k]).astype(np.int64)
            cells.append(np.unique(at[np.argsort(-self.idf[at], kind="stable")[: rarest[k]]]) << 32 | k)
        cells = np.sort(np.concatenate(cells))
        return np.searchsorted(cells >> 32, np.arange(len(self.idf) + 1)), cells & 0xFFFFFFFF

    def near(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """window << 32 | passage of each window around which enough of the passage's words occur for a match; at: terms, or -1."""
        lens = np.diff(bounds)
        of, windows = np.repeat(np.arange(len(lens)), lens), _window_counts(lens)
        first = np.cumsum(windows) - windows
        pos, out = np.flatnonzero(at >= 0), [np.zeros(0, np.int64)]
        for ptr, passage in self.postings:
            begin = ptr[at[pos]]
            n = ptr[at[pos] + 1] - begin
            hit = np.sort(passage[_ranges(begin, n)] << 32 | np.repeat(pos, n))
            k, x = hit >> 32, hit & 0xFFFFFFFF
            last = np.arange(len(hit)) + self.hits[k] - 1
            some = np.flatnonzero(last < len(hit))
            k, x, z, same = k[some], x[some], x[last[some]], k[last[some]] == k[some]
            ok = same & (of[z] == of[x]) & (z - x < WINDOW + 2 * self.sizes[k])
            k, x, z = k[ok], x[ok], z[ok]
            text, size = of[x], self.sizes[k]
            lo = np.maximum(0, (z - bounds[text] - WINDOW - size) // STEP + 1)
            hi = np.minimum(windows[text] - 1, (x - bounds[text] + size) // STEP)
            n = np.maximum(0, hi - lo + 1)
            out.append(np.unique(_ranges(first[text] + lo, n) << 32 | np.repeat(k, n)))
        return np.concatenate(out)

    def _bits(self, g: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Column of each term, bits of the places of a column's term within a row's passage (64 places a limb), and columns, of a group."""
        if g not in self.masks:
            if len(self.masks) >= TABLES:
                self.masks.clear()
            words = self.words[g * GROUP : (g + 1) * GROUP]
            size = self.sizes[g * GROUP : (g + 1) * GROUP]
            row, place = np.repeat(np.arange(len(words)), size), _ranges(np.zeros_like(size), size)
            terms, col = np.unique(self.terms.find(np.concatenate(words)), return_inverse=True)
            column = np.zeros(len(self.idf), np.int64)
            column[terms] = np.arange(1, len(terms) + 1)
            bits = np.zeros((-(-int(size.max()) // 64), len(words), len(terms) + 1), U)
            np.bitwise_or.at(bits, (place >> 6, row, col + 1), U(1) << (place & 63).astype(U))
            self.masks[g] = column, bits.reshape(len(bits), -1), len(terms) + 1
        return self.masks[g]

    def lcs(self, k: np.ndarray, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each passage k and terms[lo:hi], bit-parallel over the passage, many at a time."""
        out = np.zeros(len(k), np.int64)
        if not len(k):
            return out
        order = np.lexsort((lo - hi, k // GROUP))
        heads = np.flatnonzero(np.diff(k[order] // GROUP, prepend=-1))
        for x, y in zip(heads, np.append(heads[1:], len(k)), strict=True):
            column, bits, width = self._bits(int(k[order[x]]) // GROUP)
            for z in range(x, y, BATCH):
                some = order[z : min(z + BATCH, y)]  # the longest span first
                at, n, base = lo[some], (hi - lo)[some], k[some] % GROUP * width
                left = [np.full(len(some), ~U(0)) for _ in bits]
                live = np.searchsorted(-n, -np.arange(n[0]), "left")
                for t, m in enumerate(live.tolist()):
                    cell, carry = base[:m] + column[terms[at[:m] + t]], None
                    for v, mask in zip(left, bits, strict=True):
                        v = v[:m]
                        u = v & mask[cell]
                        total = v + u
                        if len(bits) > 1:
                            over = total < v
                            if carry is not None:
                                total += carry
                                over |= total < carry
                            carry = over.astype(U)
                        v ^= u
                        v |= total
                out[some] = sum(np.bitwise_count(~v).astype(np.int64) for v in left)
        return out


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of n numbers."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def _window_counts(lens: np.ndarray) -> np.ndarray:
    return np.where(lens > 0, 1 + np.maximum(0, -(-(lens - WINDOW) // STEP)), 0)


def _windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each window, and its first word within the text."""
    n = _window_counts(lens)
    return np.repeat(np.arange(len(lens)), n), _ranges(np.zeros_like(n), n) * STEP


def _latent(p: _Probe, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Latent vector of each window lo:hi of terms (-1 for none)."""
    n = hi - lo
    pos, row = _ranges(lo, n), np.repeat(np.arange(len(n)), n)
    cell, count = np.unique((row.astype(np.int64) << 32 | at[pos])[at[pos] >= 0], return_counts=True)
    out = np.zeros((len(n), p.space.shape[1]), np.float32)
    np.add.at(out, cell >> 32, (np.sqrt(count) * p.idf[cell & 0xFFFFFFFF])[:, None].astype(np.float32) * p.space[cell & 0xFFFFFFFF])
    return out


def _matches(p: _Probe, c) -> dict[tuple[int, int], tuple[float, float]]:
    """(text, passage) -> greatest share of the passage in a common subsequence, and its cosine."""
    _, _, h, bounds = c.words()
    found: dict[tuple[int, int], tuple[float, float]] = {}
    if not len(h):
        return found
    at = p.terms.find(h)
    of, start = _windows(np.diff(bounds))
    lo = bounds[of] + start
    hi = np.minimum(lo + WINDOW, bounds[of + 1])
    near = p.near(at, bounds)
    window, k = near >> 32, near & 0xFFFFFFFF
    text, size = of[window], p.sizes[k]
    begin, end = np.maximum(bounds[text], lo[window] - size), np.minimum(bounds[text + 1], hi[window] + size)
    known = np.concatenate(([0], np.cumsum(at >= 0)))  # other words are in no passage
    share = p.lcs(k, at[at >= 0], known[begin], known[end]) / size
    hits = []
    for i in np.flatnonzero(share >= min(VERBATIM, PARAPHRASE)).tolist():
        if share[i] >= VERBATIM or share[i] >= PARAPHRASE and np.isin(p.answer[k[i]], h[begin[i] : end[i]]).mean() >= ANSWER:
            hits.append((int(text[i]), int(window[i]), int(k[i]), float(share[i])))
    if hits:
        windows, row = np.unique([w for _, w, _, _ in hits], return_inverse=True)
        latent = _latent(p, at, lo[windows], hi[windows])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        for (text, _, k, share_), r in zip(hits, row, strict=True):
            found[text, k] = max(found.get((text, k), (0.0, 0.0)), (share_, float(latent[r] @ p.latent[k])))
    return found


def _blocks(docs: DataFrame, benchmark: DataFrame) -> list[Shared]:
    all_ = cut(passages(benchmark))
    blocks = -(-all_.count() // BLOCK_ITEMS)
    each = [all_] if blocks == 1 else [cut(all_.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)) for k in range(blocks)]
    return [x for x in (_block(docs, items) for items in each) if x]


def _block(docs: DataFrame, items: DataFrame) -> Shared | None:
    vocabulary = items.select(F.explode("words").alias("w"), F.xxhash64("item", "words").alias("row")).distinct().groupBy("w").agg(F.count("*").alias("n")).orderBy("w").toArrow()
    terms, own = np.asarray(vocabulary["w"]).view(U), np.asarray(vocabulary["n"])
    if not len(terms):
        return None
    df, n = _frequencies(docs, terms)
    rows = items.count()
    idf = np.log((n + rows + 1) / (np.minimum(df + own, n + rows) + 0.5))
    space = latent_space(items, terms, idf)
    got = items.orderBy("item", "words").toArrow()
    as_list = lambda name: [np.asarray(x, np.int64).view(U) for x in got[name].to_pylist()]
    value = {"terms": terms, "idf": idf, "space": space, "item": got["item"].combine_chunks(), "words": as_list("words"), "answer": as_list("answer")}
    return Shared(docs.sparkSession, value, _Probe)


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share and cosine of each document that holds a benchmark item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, lcs_share double, cosine double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(docs, benchmark):

        def run(batches, shared=shared):
            p = shared.get()
            for b in batches:
                ids = b.column("doc_id")
                for c in chunks(b.column("text")):
                    if got := _matches(p, c):
                        yield pa.record_batch({"doc_id": ids.take(pa.array([t + c.first for t, _ in got])), "item_id": p.item.take(pa.array([k for _, k in got])), "lcs_share": [x for x, _ in got.values()], "cosine": [x for _, x in got.values()]})

        out = out.unionByName(arrow_map(docs.select("doc_id", "text").filter("doc_id is not null and text is not null"), run, schema))
    best = out.filter("item_id is not null").groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine")).alias("m"))
    return best.select("doc_id", "item_id", "m.lcs_share", "m.cosine")


def _leaks(shared: Shared):
    """A column function: text -> whether it holds an item of the block."""

    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        p, out = shared.get(), np.zeros(len(texts), bool)
        for c in chunks(texts):
            for t, _ in _matches(p, c):
                out[c.first + t] = True
        release()
        return pa.array(out)

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    for shared in _blocks(docs, benchmark):
        docs = docs.filter(~_leaks(shared)("text"))
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
