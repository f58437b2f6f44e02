"""Token counts without token ids.

A byte-level BPE splits a text into pre-tokens first and merges within each, so a text's count is a sum over its pre-tokens.
1. Each task finds the distinct pre-tokens of its texts; one shuffle makes them distinct over the corpus, and the tokenizer
   counts the pieces of each just once.
2. The counts are joined to the pre-token frequencies of each document, and summed. A dictionary of up to DICTIONARY_BYTES is
   broadcast and joined within the batch; a larger one is joined by a shuffle on the pre-token's hash.
Pre-tokens are found without a regular expression: code points are classed by a table (letter, number, white space, other), and
the pattern's alternatives follow from runs of classes, for a whole batch at a time. Only hashes of pre-tokens leave a batch.

Cases. Null texts have a null count, empty ones 0. Strings of special tokens are ordinary text. Every row has its own count, so
repeated rows repeat, and null doc_ids pass through. A text of any length is taken whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Shared, arrow_map, cut, table
from ._text import Chunk, Table, U, chunks, i64, mix, substrings
from ._text import _pow as powers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DICTIONARY_BYTES = 96 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)
_cache: dict[str, object] = {}


def _classes() -> np.ndarray:
    if "classes" not in _cache:
        kinds = {"L": LETTER, "N": NUMBER}
        table_ = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table_[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _cache["classes"] = table_
    return _cache["classes"]


def pretokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, start of each pre-token and the end of the last, hash of each, and bounds of each text's pre-tokens."""
    cp = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    offs = np.concatenate(([0], np.cumsum((c.data & 0xC0) != 0x80)))[c.offs]
    n = len(cp)
    if not n:
        return cp, np.zeros(1, np.int64), np.zeros(0, U), np.zeros(c.n + 1, np.int64)
    kind = _classes()[cp]
    head = np.zeros(n + 1, bool)
    head[offs] = True
    change = head[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.append(np.flatnonzero(change), n)
    a, b, k = run[:-1], run[1:], kind[run[:-1]]
    begins = head[a]  # the run starts a text
    ends = head[b]  # the run ends a text
    start = np.zeros(n + 1, bool)
    word = k != SPACE
    joined = word & ~begins & (cp[a - 1] == 32)  # the space before belongs to it
    start[a[word] - joined[word]] = True
    blank = ~word
    start[a[blank & (ends | (b - a >= 2))]] = True
    start[b[blank & ~ends & (cp[b - 1] != 32)] - 1] = True
    # 's, 't, 'm, 'd, 're, 've, 'll where a lone apostrophe, without a space of its own, precedes letters
    lone = np.flatnonzero(word & ~joined & (cp[a] == 39) & (b - a == 1) & ~ends)
    lone = lone[k[lone + 1] == LETTER] if len(lone) else lone
    for i in lone:
        p, stop = b[i], b[i + 1]
        one, two = chr(cp[p]), "".join(map(chr, cp[p : min(p + 2, stop)]))
        m = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if m:
            start[p] = False
            start[p + m] = start[p + m] or p + m < stop
    at = np.flatnonzero(start[:n])
    prefix = np.zeros(n + 1, U)
    np.cumsum((cp.astype(U) + U(1)) * powers(n, "base"), out=prefix[1:])
    edge = np.append(at, n)
    return cp, edge, substrings(prefix, edge[:-1], edge[1:]), np.searchsorted(at, offs)


def _distinct(batches):
    seen = np.zeros(0, U)
    for b in batches:
        for c in chunks(b.column("text"), lower=False):
            cp, edge, h, _ = pretokens(c)
            h, first = np.unique(h, return_index=True)
            if len(seen):
                new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                h, first = h[new], first[new]
            if len(h):
                raw = cp.tobytes()
                text = [raw[4 * i : 4 * j].decode("utf-32-le") for i, j in zip(edge[first], edge[first + 1], strict=True)]
                yield pa.record_batch({"h": i64(h), "text": pa.array(text)})
                seen = np.sort(np.concatenate((seen, h)))


def _encoder(path: str):
    if path not in _cache:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _cache[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _cache[path]


def dictionary(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(h, n): the number of pieces of each distinct pre-token of the corpus."""

    def pieces(batches):
        encode = _encoder(vocabulary).encode_ordinary
        for b in batches:
            yield pa.record_batch({"h": b.column("h"), "n": pa.array([len(encode(x)) for x in b.column("text").to_pylist()], pa.int32())})

    words = arrow_map(docs.select("text").filter("text is not null"), _distinct, "h long, text string")
    return cut(arrow_map(words.groupBy("h").agg(F.first("text").alias("text")), pieces, "h long, n int"))


def count(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = DICTIONARY_BYTES) -> DataFrame:
    """doc_id and n_tokens of each row."""
    words = dictionary(docs, vocabulary)
    if words.count() * 12 <= limit:
        return _count_broadcast(docs, words)
    rows = docs.select(F.monotonically_increasing_id().alias("r"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def frequencies(batches):
        """(r, doc_id, none, h, f): a text's pre-tokens, after a row that stands for the text itself, of frequency 0."""
        for b in batches:
            r, ids, none = b.column("r"), b.column("doc_id"), b.column("text").is_null()
            for c in chunks(b.column("text"), lower=False):
                _, _, h, bounds = pretokens(c)
                own = np.arange(c.n)
                of = np.repeat(own, np.diff(bounds))
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))[: len(h)])
                f = np.concatenate((np.zeros(c.n, np.int32), np.diff(np.append(at, len(h))).astype(np.int32)))
                row = pa.array(np.concatenate((own, of[at])) + c.first)
                spread = mix(np.asarray(r.slice(c.first, c.n)).astype(U))  # else these rows would meet in one partition
                yield pa.record_batch({"r": r.take(row), "doc_id": ids.take(row), "none": none.take(row), "h": i64(np.concatenate((spread, h[at]))), "f": f})

    found = arrow_map(rows, frequencies, f"r long, doc_id {kind}, none boolean, h long, f int").join(words, "h", "left")
    sums = found.groupBy("r").agg(F.first("doc_id").alias("doc_id"), F.first("none").alias("none"), F.sum(F.col("f") * F.coalesce("n", F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", F.when(~F.col("none"), F.col("n_tokens")).cast("long").alias("n_tokens"))


def _count_broadcast(docs: DataFrame, words: DataFrame) -> DataFrame:
    got = words.toArrow()
    value = (np.asarray(got["h"]).view(U), np.asarray(got["n"]).astype(np.int32))
    shared = Shared(docs.sparkSession, value, lambda v: (Table(v[0]), v[1]))

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        t, pieces = shared.get()
        out = np.zeros(len(texts), np.int64)
        for c in chunks(texts, lower=False):
            _, _, h, bounds = pretokens(c)
            if len(h):
                known, back = np.unique(h, return_inverse=True)
                n = pieces[t.find(known)].astype(np.int64)[back]
                total = np.concatenate(([0], np.cumsum(n)))
                out[c.first : c.first + c.n] = total[bounds[1:]] - total[bounds[:-1]]
        return pa.array(out, mask=np.asarray(texts.is_null()))

    return docs.select("doc_id", n_tokens("text").alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
