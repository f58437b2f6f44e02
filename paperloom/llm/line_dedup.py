"""Line dedup: an edit-distance self-join of lines by segments.

By the pigeonhole principle, of TAU + 1 segments of a line at least one survives TAU edits. Each line is cut into TAU + 1 even
segments, indexed by (line length, segment number, hash of the segment); each line probes the substrings that can align with a
segment of a line of its length or up to TAU shorter (the multi-match-aware windows of partition-based similarity joins). A
prefix hash gives every substring's hash in O(1). Pairs that share a key, and whose byte histograms differ by 2 TAU at most, are
verified with a banded bit-parallel edit distance. The join is exact.

A line is what lies between newlines, without surrounding ASCII white space; distances count UTF-8 bytes, and case matters. A
line of one byte or more is a repeat if an equal line occurs earlier in the order of (doc_id, line number), or if both have
MIN_NEAR bytes at least and lie within TAU edits. Shorter lines are compared for equality only, as two edits can make any short
line of any other. Blank lines are no lines.

Cases. Null and empty texts have no lines and stay as they are. Rows with a null doc_id have no place in the order: they are
neither repeats nor originals, and pass unchanged. Rows that share a doc_id and differ in their text are taken apart by a hash
of the text, which breaks ties in the order: each loses its own repeats only. Rows that share both are one occurrence, and keep
equal lines. A line of any length is taken whole. A document that had lines and is left without any word is dropped by clean().
Columns other than doc_id, text and n_chars (which clean() counts anew) pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_map, cut, free_name, join_small, table
from ._text import SPACE, Chunk, U, chunks, i64, mix, substrings

TAU = 2
#: Lines of fewer bytes are compared for equality only.
MIN_NEAR = 20
#: Pairs that a bucket makes at a time.
BLOCK = 1 << 20


def lines_of(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (trimmed), text and number (from 0) of each line of a chunk."""
    if not len(c.data):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    newline = np.flatnonzero(c.data == 10)
    full = np.flatnonzero(np.diff(c.offs) > 0)
    starts = np.sort(np.concatenate((c.offs[full], newline + 1)), kind="stable")
    ends = np.sort(np.concatenate((c.offs[full + 1], newline)), kind="stable")
    at = np.sort(np.concatenate((full, np.searchsorted(c.offs, newline, "right") - 1)), kind="stable")
    first = np.searchsorted(at, np.arange(c.n))
    number = np.arange(len(at)) - first[at]
    solid = np.append(np.flatnonzero(~SPACE[c.data]), len(c.data))
    s = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    before = np.concatenate(([-1], solid[:-1]))
    e = np.maximum(before[np.searchsorted(solid, ends)] + 1, s)
    return s, e, at, number


def _entries(prefix: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of each index entry and probe. The line's low bits: 0 index, 1 probe of a shorter line, 3 of one as long."""
    keys, lines = [], []
    for delta in range(TAU + 1):
        size = e - s - delta
        base, even = size // (TAU + 1), TAU + 1 - size % (TAU + 1)
        for i in range(TAU + 1):
            p, w = s + base * i + np.maximum(0, i - even), base + (i >= even)
            salt = mix((size.astype(U) << U(8)) | U(i))
            kinds = [(0, 0)] if not delta else []
            kinds += [(shift, 1 if delta else 3) for shift in range(max(-i, delta - (TAU - i)), min(i, delta + TAU - i) + 1)]
            for shift, kind in kinds:
                at = p + shift
                ok = (at >= s) & (at + w <= e)
                at, w_ = at[ok], w[ok]
                keys.append(mix(substrings(prefix, at, at + w_) ^ salt[ok]))
                lines.append(h[ok] | U(kind))
    return np.concatenate(keys), np.concatenate(lines)


def _solid_lines(c: Chunk, least: int) -> tuple[np.ndarray, ...]:
    """Start, end, text, number and hash (its two lowest bits 0) of the lines of at least so many bytes, and the prefix hash."""
    s, e, at, number = lines_of(c)
    ok = e - s >= least
    s, e, at, number = s[ok], e[ok], at[ok], number[ok]
    prefix = c.prefix()
    return s, e, at, number, substrings(prefix, s, e) & ~U(3), prefix


def _keys(batches):
    for b in batches:
        for c in chunks(b.column("text"), lower=False):
            s, e, _, _, h, prefix = _solid_lines(c, MIN_NEAR)
            if len(s):
                h, once = np.unique(h, return_index=True)
                keys, lines = _entries(prefix, s[once], e[once], h)
                yield pa.record_batch({"key": i64(keys), "line": i64(lines)})


#: Each byte's class as one of 8 lanes of a 64-bit sum. Lanes may overflow; differences of up to 127 still come out exact.
_LANES = U(1) << (U(8) * (np.arange(256).astype(U) & U(7)))


def _occurrences(batches):
    for b in batches:
        ids, version = b.column("doc_id"), b.column("version")
        for c in chunks(b.column("text"), lower=False):
            s, e, at, number, h, _ = _solid_lines(c, 1)
            lanes = np.concatenate((np.zeros(1, U), np.cumsum(_LANES[c.data], dtype=U)))
            row = pa.array(at + c.first)
            yield pa.record_batch({"line": i64(h), "doc_id": ids.take(row), "line_no": number.astype(np.int32), "version": version.take(row), "size": (e - s).astype(np.int32), "sketch": i64(lanes[e] - lanes[s])})


def histogram_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the byte classes of the absolute difference of counts; an edit changes it by 2 at most."""
    d = a.view(U) - b.view(U) + U(0x8080808080808080)
    return np.abs(d.view(np.uint8).reshape(-1, 8).astype(np.int16) - 128).sum(axis=1)


def _pairs(batches):
    """All pairs of an index entry and a probe with the same key, in a partition that holds each of its keys whole."""
    keys, lines = [], []
    for b in batches:
        keys.append(np.asarray(b.column("key")))
        lines.append(np.asarray(b.column("line")))
    if not keys:
        return
    key, line = np.concatenate(keys), np.concatenate(lines).view(U)
    del keys, lines
    order = np.argsort(key)
    key, line = key[order], line[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(heads, len(key)))
    for lo, hi in _blocks(sizes):
        own = np.concatenate([np.arange(h, h + n) for h, n in zip(heads[lo:hi], sizes[lo:hi], strict=True) if n > 1] or [np.zeros(0, np.int64)])
        group = np.repeat(np.arange(lo, hi), sizes[lo:hi])[np.repeat(sizes[lo:hi] > 1, sizes[lo:hi])]
        x = line[own]
        index, probe = own[x & U(1) == 0], own[x & U(1) == 1]
        gi, gp = group[x & U(1) == 0], group[x & U(1) == 1]
        begin, end = np.searchsorted(gi, gp), np.searchsorted(gi, gp, "right")
        for k in range(0, len(probe), max(1, BLOCK // max(1, int((end - begin).max(initial=1))))):
            part = slice(k, k + max(1, BLOCK // max(1, int((end - begin).max(initial=1)))))
            n = end[part] - begin[part]
            total = int(n.sum())
            i = index[np.repeat(begin[part], n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)]
            a, p = line[i], line[np.repeat(probe[part], n)]
            b_, alike = p & ~U(3), p & U(3) == 3
            ok = (a != b_) & (~alike | (a < b_))
            a, b_ = np.minimum(a[ok], b_[ok]), np.maximum(a[ok], b_[ok])
            if len(a):
                both = np.unique(np.stack((a, b_), axis=1), axis=0) if len(a) < 1 << 16 else np.stack((a, b_), axis=1)
                yield pa.record_batch({"a": i64(np.ascontiguousarray(both[:, 0])), "b": i64(np.ascontiguousarray(both[:, 1]))})


def _blocks(sizes: np.ndarray):
    """Runs of groups with at most 2 ** 18 rows together."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 18), "right")))
        yield lo, hi
        lo = hi


def edit_distance(data: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, tau: int) -> np.ndarray:
    """Edit distance of data[a0:a1] and data[b0:b1], each longer than tau, for many pairs at once; tau + 1 means more than tau.

    Bit-parallel over the 2 tau + 1 diagonals around the main one: a column of the matrix is one machine word whose band
    slides down a row at each step.
    """
    swap = (b1 - b0) > (a1 - a0)
    a0, a1, b0, b1 = np.where(swap, b0, a0), np.where(swap, b1, a1), np.where(swap, a0, b0), np.where(swap, a1, b1)
    la, lb = a1 - a0, b1 - b0
    out = np.full(len(la), tau + 1, np.int64)
    live = np.flatnonzero(la - lb <= tau)
    n = len(live)
    vp, vn = np.full(n, np.uint64((((1 << 64) - 1) << (63 - tau)) & ((1 << 64) - 1)), U), np.zeros(n, U)
    dist = np.full(n, tau, np.int64)
    la, lb, a0, b0 = la[live], lb[live], a0[live], b0[live]
    step = 0
    while len(live):
        over = step >= lb
        if over.any() or not step % 32:
            out[live[over]] = np.minimum(dist[over], tau + 1)
            keep = ~over & (dist <= 2 * tau + lb - la + tau)
            live, la, lb, a0, b0, vp, vn, dist = (x[keep] for x in (live, la, lb, a0, b0, vp, vn, dist))
            if not len(live):
                break
        y, x = data[b0 + step], np.zeros(len(live), U)
        for k in range(2 * tau + 1):
            i = step + tau - k
            if i >= 0:
                x |= np.where((i < la) & (data[np.minimum(a0 + i, len(data) - 1)] == y), U(1) << U(63 - k), U(0))
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        late = step - (la - tau)
        bit = (U(62) - np.clip(late, 0, 62).astype(U)).astype(U)
        dist = dist + np.where(late < 0, (d0 >> U(63)) == 0, ((hp >> bit) & U(1)).astype(np.int64) - ((hn >> bit) & U(1)).astype(np.int64))
        vp, vn = hn | ~((d0 >> U(1)) | hp), (d0 >> U(1)) & hp
        step += 1
    return out


def _wanted(batches):
    """(doc_id, text, lines) -> the text of each of these lines."""
    for b in batches:
        want = b.column("lines").combine_chunks() if isinstance(b.column("lines"), pa.ChunkedArray) else b.column("lines")
        row = np.repeat(np.arange(len(want)), np.diff(np.asarray(want.offsets)))
        keys = np.unique(mix(np.asarray(want.flatten()).view(U) ^ mix(row.astype(U))))
        for c in chunks(b.column("text"), lower=False):
            s, e, at, _, h, _ = _solid_lines(c, MIN_NEAR)
            ok = np.isin(mix(h ^ mix((at + c.first).astype(U))), keys)
            s, e, h = s[ok], e[ok], h[ok]
            if len(s):
                yield pa.record_batch({"line": i64(h), "bytes": pa.array([c.data[i:j].tobytes() for i, j in zip(s, e, strict=True)], pa.binary())})


def _verify(batches):
    for b in batches:
        at, data = [], []
        for name in ("x", "y"):
            col = b.column(name).cast(pa.large_binary())
            at.append(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] + sum(map(len, data)))
            data.append(np.frombuffer(col.buffers()[2], np.uint8))
        if not len(b):
            continue
        d = edit_distance(np.concatenate(data), at[0][:-1], at[0][1:], at[1][:-1], at[1][1:], TAU)
        ok = pa.array(d <= TAU)
        yield pa.record_batch({"a": b.column("a").filter(ok), "b": b.column("b").filter(ok), "d": pa.array(d.astype(np.int32)).filter(ok)})


def _repeats(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and version (hash of the text) of each repeated line, and orig: the earliest line like it, with its distance."""
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("version"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = cut(arrow_map(texts, _occurrences, f"line long, doc_id {kind}, line_no int, version long, size int, sketch long"))
    place = F.struct("doc_id", "line_no", "version")
    first = cut(seen.groupBy("line").agg(F.min(place).alias("at"), F.max(place).alias("last"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))

    @F.arrow_udf("int")
    def gap(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(histogram_gap(np.asarray(a), np.asarray(b)).astype(np.int32))

    entries = arrow_map(texts.select("text"), _keys, "key long, line long").repartition("key")
    pairs = arrow_map(entries, _pairs, "a long, b long").distinct()
    side = lambda c: first.filter(F.col("size") >= MIN_NEAR).select(F.col("line").alias(c), F.col("at").alias(f"{c}_at"), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.abs(F.col("a_size") - F.col("b_size")) <= TAU)
    pairs = cut(pairs.filter(gap("a_sketch", "b_sketch") <= 2 * TAU).select("a", "b", "a_at", "b_at"))
    want = pairs.select(F.explode(F.array(F.struct(F.col("a_at.doc_id").alias("doc_id"), F.col("a").alias("line")), F.struct(F.col("b_at.doc_id").alias("doc_id"), F.col("b").alias("line")))).alias("w"))
    want = cut(want.select("w.*").distinct().groupBy("doc_id").agg(F.collect_list("line").alias("lines")))
    found = arrow_map(join_small(texts, want, "doc_id", "inner", 200).select("text", "lines"), _wanted, "line long, bytes binary").dropDuplicates(["line"])
    found = cut(found)
    both = pairs.select("a", "b").join(found.select(F.col("line").alias("a"), F.col("bytes").alias("x")), "a").join(found.select(F.col("line").alias("b"), F.col("bytes").alias("y")), "b")
    near = arrow_map(both, _verify, "a long, b long, d int").join(pairs, ["a", "b"])
    a_first = F.col("a_at") < F.col("b_at")
    near = near.select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("line"), F.struct(F.least("a_at", "b_at").alias("at"), "d").alias("orig")).groupBy("line").agg(F.min("orig").alias("orig"))
    # a line that occurs once and is near no earlier one has no repeat
    best = first.join(near, "line", "left").filter(F.col("orig").isNotNull() | (F.col("at") != F.col("last")))
    best = best.select("line", F.coalesce(F.col("orig"), F.struct("at", F.lit(0).alias("d"))).alias("orig"))
    out = seen.select("line", "doc_id", "line_no", "version").join(best, "line").filter(place != F.col("orig.at"))
    return out.select("doc_id", "line_no", "version", "orig")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), kept_doc_id, kept_line_no, distance: each repeated line, and the earliest line like it."""
    return _repeats(docs).select("doc_id", "line_no", F.col("orig.at.doc_id").alias("kept_doc_id"), F.col("orig.at.line_no").alias("kept_line_no"), F.col("orig.d").alias("distance")).distinct()


def clean(docs: DataFrame) -> DataFrame:
    """docs, all columns, without repeated lines; documents of which no word is left are dropped."""
    gone, key, version = (free_name(docs, f"paperloom_{x}") for x in ("gone", "key", "version"))
    lines = cut(_repeats(docs).groupBy(F.col("doc_id").alias(key), F.col("version").alias(version)).agg(F.collect_set("line_no").alias(gone)))
    named = docs.filter("doc_id is not null and text is not null")
    rows = named.join(lines, (named["doc_id"] == lines[key]) & (F.xxhash64(named["text"]) == lines[version]), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    rows = rows.filter(F.col(gone).isNull() | F.col("text").rlike("[\\p{L}\\p{N}]")).select(*docs.columns)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # rows without a name or text pass beside the join, where they would all meet in one task
    return rows.unionByName(docs.filter("doc_id is null or text is null"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


SQL = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT DISTINCT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(ls[i], '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS l
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
long AS (SELECT *, strlen(l) AS n FROM lines WHERE l <> ''),
firsts AS (SELECT l, n, min({{'d': doc_id, 'k': line_no}}) AS at FROM long GROUP BY l, n),
close AS (SELECT x.l, {{'at': y.at, 'd': CAST(levenshtein(x.l, y.l) AS INTEGER)}} AS orig FROM firsts x
  JOIN (SELECT *, unnest(range(n - {TAU}, n + {TAU} + 1)) AS m FROM firsts WHERE n >= {MIN_NEAR}) y ON x.n = y.m AND x.n >= {MIN_NEAR} AND y.at <= x.at
  WHERE levenshtein(x.l, y.l) <= {TAU}),
near AS (SELECT l, min(orig) AS orig FROM (SELECT * FROM close UNION ALL SELECT l, {{'at': firsts.at, 'd': 0::INTEGER}} FROM firsts WHERE n < {MIN_NEAR}) GROUP BY l)
SELECT doc_id, line_no, orig.at.d AS kept_doc_id, orig.at.k AS kept_line_no, orig.d AS distance
FROM long JOIN near USING (l) WHERE (doc_id, line_no) <> (orig.at.d, orig.at.k)
"""
