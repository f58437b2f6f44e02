"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least THRESHOLD are linked.

1. Documents with equal sets collapse to one representative, which counts as many documents as it stands for.
2. Representatives form families: those that share one of BANDS keys of ROWS min-wise hashes take the least of them as leader, and
   a leader's members of one size band (a power of 2) are a family. Families only save work: near copies meet as families, so
   neither their common n-grams nor their pairs are listed one by one. They decide nothing.
3. Prefix filter, exact: n-grams are ordered by the number of representatives that hold them (then by hash), counted over all of
   them. Of two sets A and B at the threshold, the first |A| - ceil(THRESHOLD |A|) + 1 n-grams of A and as many of B have one in
   common. N-grams that one representative holds can't be that one. So the families of each other n-gram within a prefix are
   paired, if their size bands are compatible; so are the families of one leader. No pair of sets at the threshold is lost.
4. Families of more than TILE sets are cut into units by hash, others are units themselves. A group of linked families puts its
   units into slots, by hash, and the pairs of units of two slots form a tile: a pair of units is in one tile, and a set travels
   only to tiles that pair it, once to each. In a tile with few pairs for its sets, each set has a hashed bitmap; an element of A
   without its bit in B's bitmap is not in B, so popcounts bound the overlap from above, and pairs that can still reach the
   threshold are decided exactly, by intersecting sorted arrays. In a tile with many, the overlaps of all its sets are counted at
   once, n-gram by n-gram: n-grams of many sets as columns of a matrix product, others by listing their pairs. A tile hands on one
   row a set: the number of documents that it is linked to in the tile, and the least set of its component there; the pairs
   themselves are written only where they are asked for.

Similarities are exact over 47-bit n-gram hashes, and recall is complete. Nothing is capped.

Counting and shuffling cells (n-gram, set) in Spark's rows would cost many times the text. They travel as binary blobs, a row a
bucket and about FLUSH cells of a task: 4 bytes a cell, and the sets by run length.

Cases. Null and empty texts, and texts without words, have no n-grams and are linked to nothing. A text of fewer than N words has
one n-gram, all its words. Rows with a null doc_id can't be named and take no part (group() keeps them). Repeated rows collapse.
A doc_id with several texts has the links of each of them: classes() gives the least class and the most links. Ids are of any
type that can be ordered. Other columns are ignored by classes() and join(), and kept by group(), whatever their names.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow_map, components, cut, free_name, join_small, release, table
from ._text import U, chunks, i64, mix, ngrams, sets

N, THRESHOLD = 3, 0.5
ROWS, BANDS = 4, 4
#: Cells (n-gram, set) of a bucket on average, cells after which a task sends what it has, and cells that are sorted at a time.
CELLS, FLUSH, SORT = 1 << 22, 1 << 20, 1 << 20
#: N-grams by which prefixes are longer than they must be: as many of a set may collide in their 40-bit names.
SLACK = 2
#: Bits of a set's bitmap, and sets of a slot, on average, and of a unit at most, as far as hashes are even.
BITMAP, TILE = 2048, 512
#: Pairs of sets a set from which on a tile's overlaps are counted at once, sets of such a tile at most, and columns of a product.
DENSE, WIDEST, COLUMNS = 4, 4096, 1024
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def _sets(c) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, bounds = c.words()
    return sets(*ngrams(h, bounds, N), c.n)


def _named(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have n-grams, the first n-gram of each, and the 64-bit name of each one's set."""
    full = np.flatnonzero(np.diff(bounds))
    at = bounds[full]
    if not len(full):
        return full, at, np.zeros(0, U)
    one, two = np.add.reduceat(mix(g), at), np.add.reduceat(mix(g ^ U(0x5DEECE66D)), at)
    return full, at, mix(one ^ mix(two + np.diff(bounds)[full].astype(U)))


def _signatures(batches):
    """doc_id, the name and size of its set, and the keys that make families."""
    for b in batches:
        ids = b.column("doc_id")
        for c in chunks(b.column("text")):
            g, bounds = _sets(c)
            full, at, rep = _named(g, bounds)
            if not len(full):
                continue
            low = (mix(g) >> U(32)).astype(np.uint32)
            keys = np.empty((len(full), BANDS), U)
            for band in range(BANDS):
                h = np.full(len(full), band, U)
                for k in range(band * ROWS, (band + 1) * ROWS):
                    v = low * _MUL[k]
                    v += _ADD[k]
                    v ^= v >> np.uint32(15)
                    h = mix(h * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, at).astype(U))
                keys[:, band] = h
            yield pa.record_batch({"doc_id": ids.take(pa.array(full + c.first)), "rep": i64(rep), "size": np.diff(bounds)[full].astype(np.int32), "keys": pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * BANDS, i64(keys.ravel()))})


# ---- cells in blobs -------------------------------------------------------------------------------------------------------

_BLOB = "bucket int, reps binary, counts binary, grams binary, ranks binary"
_RUN = (1 << 16) - 1


def _blobs(bucket: np.ndarray, owner: np.ndarray, rep: np.ndarray, gram: np.ndarray, rank: np.ndarray | None):
    """A row a bucket; cells come in the order of (bucket, owner), owner being an index into rep. A run of a set is cut where 16 bits end."""
    if not len(bucket):
        return
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))
    runs = np.flatnonzero(new)
    if len(bucket) > _RUN:
        new |= (np.arange(len(bucket)) - np.repeat(runs, np.diff(np.append(runs, len(bucket))))) % _RUN == 0
        runs = np.flatnonzero(new)
    counts, reps = np.diff(np.append(runs, len(bucket))).astype(np.uint16), rep[owner[runs]]
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends, first, last = np.append(heads[1:], len(bucket)), np.searchsorted(runs, heads), np.searchsorted(runs, np.append(heads[1:], len(bucket)))
    for k in range(0, len(heads), 256):
        span = range(k, min(k + 256, len(heads)))
        binary = lambda a, lo, hi: pa.array([a[lo[i] : hi[i]].tobytes() for i in span], pa.binary())  # noqa: B023, E731
        yield pa.record_batch({
            "bucket": bucket[heads[k : k + 256]].astype(np.int32), "reps": binary(reps, first, last), "counts": binary(counts, first, last),
            "grams": binary(gram, heads, ends), "ranks": binary(rank, heads, ends) if rank is not None else pa.nulls(len(span), pa.binary()),
        })


def _by_bucket(batches):
    """(bucket, rows of its columns as lists) of each bucket of a partition that is sorted by bucket."""
    now, held = None, []
    for b in batches:
        bucket = np.asarray(b.column("bucket"))
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and bucket[lo] != now:
                yield now, held
                held = []
            now = bucket[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def _joined(held: list[pa.RecordBatch], name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for b in held for x in b.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _cells(buckets: int):
    """Texts -> blobs of the cells of their sets, by bucket of the n-gram."""

    def flush(held):
        g, rep, size = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.repeat(np.arange(len(rep), dtype=np.uint32), size)
        once = np.zeros(len(rep), bool)
        once[np.unique(rep, return_index=True)[1]] = True
        g, at = g[once[at]], at[once[at]]
        h = mix(g)
        bucket = (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        yield from _blobs(bucket[order], at[order], rep, h[order].astype(np.uint32), None)
        release()

    def run(batches):
        held, total = [], 0
        for b in batches:
            for c in chunks(b.column("text")):
                g, bounds = _sets(c)
                full, _, rep = _named(g, bounds)
                held.append((g, rep, np.diff(bounds)[full]))
                total += len(g)
                if total >= FLUSH:
                    yield from flush(held)
                    held, total = [], 0
        if total:
            yield from flush(held)

    return run


def _shared(slots: int):
    """Blobs by n-gram -> blobs by set, of the n-grams that several sets hold, with their rank (a coarse logarithm of how many)."""

    def flush(out):
        names = np.unique(np.concatenate([rep for rep, _, _, _ in out]))
        slot = (i64(names) % slots).astype(np.uint32)
        names, slot = names[order := np.argsort(slot, kind="stable")], slot[order]
        place = np.argsort(order)  # of the sorted names
        owner = np.concatenate([place[np.searchsorted(np.sort(names), rep)].astype(np.uint32)[own] for rep, own, _, _ in out])
        order = np.argsort(owner, kind="stable")
        owner, gram = owner[order], mix(np.concatenate([gram for _, _, gram, _ in out])[order]) >> U(24)
        both = (np.concatenate([rank for _, _, _, rank in out])[order].astype(np.uint16) << np.uint16(8)) | (gram >> U(32)).astype(np.uint16)
        yield from _blobs(slot[owner], owner, names, gram.astype(np.uint32), both)
        release()

    def run(batches):
        out, total = [], 0
        for bucket, held in _by_bucket(batches):
            names, own = np.unique(_joined(held, "reps", U), return_inverse=True)
            own, grams = np.repeat(own.astype(np.uint32), _joined(held, "counts", np.uint16)), _joined(held, "grams", np.uint32)
            held.clear()
            low, high = (int(x(grams)) for x in (np.min, np.max))
            parts = max(1, -(-len(grams) // SORT))
            edges = [low + (high + 1 - low) * k // parts for k in range(parts)] + [high + 1]
            for lo, hi in zip(edges, edges[1:], strict=False):  # n-grams are hashes, so parts are even
                some = slice(None) if parts == 1 else (grams >= lo) & (grams < hi)
                cell = (grams[some].astype(U) << U(32)) | own[some]
                if not len(cell):
                    continue
                cell.sort()
                cell = cell[np.concatenate(([True], cell[1:] != cell[:-1]))]
                gram = (cell >> U(32)).astype(np.uint32)
                heads = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
                n = np.diff(np.append(heads, len(gram)))
                several = np.repeat(n > 1, n)
                rank = np.minimum(255, 8 * np.log2(n[n > 1])).astype(np.uint8)
                out.append((names, cell[several].astype(np.uint32), (U(bucket) << U(32)) | gram[several], np.repeat(rank, n[n > 1])))
                total += len(out[-1][1])
                if total >= FLUSH:
                    yield from flush(out)
                    out, total = [], 0
        if total:
            yield from flush(out)

    return run


def _prefixes(batches):
    """Blobs by set, and rows (rep, size, family) of the sets -> (gram, family) of the n-grams within prefixes."""
    for _, held in _by_bucket(batches):
        named = [b.filter(b.column("family").is_valid()) for b in held]
        rep, size, family = (np.concatenate([np.asarray(b.column(c)) for b in named]) for c in ("rep", "size", "family"))
        order = np.argsort(rep)
        rep, size, family = rep[order], size[order].astype(np.int64), family[order]
        count = _joined(held, "counts", np.uint16)
        if not len(count):
            continue
        own = np.repeat(np.searchsorted(rep, _joined(held, "reps", np.int64)), count)
        rank = _joined(held, "ranks", np.uint16)
        gram, rank = (rank & np.uint16(255)).astype(U) << U(32) | _joined(held, "grams", np.uint32).astype(U), rank >> np.uint16(8)
        order = np.lexsort((gram, rank, own))
        own, gram = own[order], gram[order]
        n = np.bincount(own, minlength=len(rep))
        place = np.arange(len(own)) - (np.cumsum(n) - n)[own] + (size - n)[own]  # n-grams of one set come first
        ok = place < size[own] - np.ceil(THRESHOLD * size[own] - 1e-9) + 1 + SLACK
        gram, family_ = gram[ok], family[own[ok]]
        order = np.lexsort((family_, gram))
        gram, family_ = gram[order], family_[order]
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (family_[1:] != family_[:-1])))[: len(gram)]
        yield pa.record_batch({"gram": i64(gram[new]), "family": family_[new]})


def _family_pairs(batches):
    """(a, b), a < b, of the families of compatible size bands (the low 6 bits) that share an n-gram; the partition holds its n-grams whole."""
    parts = [(np.asarray(b.column("gram")), np.asarray(b.column("family"))) for b in batches]
    if not parts:
        return
    gram, family = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((family, gram))
    gram, family = gram[order], family[order]
    heads = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    n = np.repeat(np.append(heads[1:], len(gram)), np.diff(np.append(heads, len(gram)))) - np.arange(len(gram)) - 1
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right")))
        m = n[lo:hi]
        if m.sum():
            x = np.repeat(np.arange(lo, hi), m)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            a, b = family[x], family[y]
            ok = (np.abs((a & 63) - (b & 63)) <= 1) & (a != b)
            a, b = a[ok], b[ok]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            yield pa.record_batch({"a": a[new], "b": b[new]})
        lo = hi


# ---- tiles ----------------------------------------------------------------------------------------------------------------


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, np.uint8)
    bits[(s & U(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(U)


class _Unit:
    """A tile's sets of one unit: name, documents, sorted n-grams and size of each, and bitmaps where they are asked for."""

    def __init__(self, rows: list):
        self.rep, self.weight = (np.array([r[k] for r in rows], np.int64) for k in range(2))
        self.sets = [r[2] for r in rows]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)

    @cached_property
    def bits(self) -> np.ndarray:
        return np.stack([_bitmap(s) for s in self.sets])


def _alike(s: np.ndarray, bits: np.ndarray, others: _Unit, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `some` of the others are as similar to set s as THRESHOLD asks, and how similar."""
    n, sizes = len(s), others.sizes[some]
    some = some[(sizes >= THRESHOLD * n - 1e-9) & (n >= THRESHOLD * sizes - 1e-9)]
    theirs, sizes = others.bits[some], others.sizes[some]
    bound = np.minimum(n - np.bitwise_count(bits & ~theirs).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(theirs & ~bits).sum(axis=1, dtype=np.int64))
    ok = bound >= np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + sizes) - 1e-9)
    some, sizes = some[ok], sizes[ok]
    if not len(some):
        return some, np.zeros(0)
    joined = np.concatenate([others.sets[k] for k in some])
    hit = s[np.minimum(np.searchsorted(s, joined), n - 1)] == joined
    both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
    j = both / (n + sizes - both)
    return some[j >= THRESHOLD], j[j >= THRESHOLD]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams sets x and y have in common, at [x, y], x < y; other places don't count."""
    n = len(sets)
    out, flat, cols, part = np.zeros((n, n), np.int32), np.zeros(0, np.int64), np.zeros((n, COLUMNS), np.float32), -(-sum(map(len, sets)) // SORT)
    cuts = [np.searchsorted(s, np.array([(k << 47) // part for k in range(part + 1)], U)) for s in sets]
    for k in range(part):
        gram = np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)])
        own = np.repeat(np.arange(n), [c[k + 1] - c[k] for c in cuts])
        order = np.argsort(gram, kind="stable")
        gram, own = gram[order], own[order]
        heads = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))[: len(gram)]
        held = np.diff(np.append(heads, len(gram)))
        dense = held * 9 > n + 72
        of, wide = np.repeat(np.cumsum(dense) - 1, held), np.repeat(dense, held)
        of, at = of[wide], own[wide]
        for lo in range(0, int(dense.sum()), COLUMNS):
            x, y = np.searchsorted(of, (lo, lo + COLUMNS))
            cols[:] = 0
            cols[at[x:y], of[x:y] - lo] = 1
            out += (cols @ cols.T).astype(np.int32)
        few = np.repeat(~dense & (held > 1), held)
        own, size = own[few], held[~dense & (held > 1)]
        left = np.repeat(np.cumsum(size), size) - np.arange(len(own)) - 1
        total, lo = np.cumsum(left), 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SORT, "right")))
            m = left[lo:hi]
            x = np.repeat(np.arange(lo, hi), m)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            flat = own[x] * n + own[y]
            if len(flat) * 4 > n * n:
                out += np.bincount(flat, minlength=n * n).reshape(n, n).astype(np.int32)
            else:
                cell, count = np.unique(flat, return_counts=True)
                out.reshape(-1)[cell] += count.astype(np.int32)
            lo = hi
    return out


def _all_links(units: dict[int, _Unit], pairs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets (by place in the tile), sets and similarities of the linked pairs of a tile, from the overlaps of all its sets."""
    at = {u: k for k, u in enumerate(units)}
    listed = np.zeros((len(at), len(at)), bool)
    for a, b in pairs:
        a, b = sorted((at[a], at[b]))
        listed[a, b] = True
    unit = np.repeat(np.arange(len(at)), [len(x.rep) for x in units.values()])
    sizes = np.concatenate([x.sizes for x in units.values()])
    both = _overlaps([s for x in units.values() for s in x.sets])
    x, y = np.nonzero(np.triu(both, 1))
    ok = listed[unit[x], unit[y]]
    x, y = x[ok], y[ok]
    both = both[x, y].astype(np.int64)
    j = both / (sizes[x] + sizes[y] - both)
    return x[j >= THRESHOLD], y[j >= THRESHOLD], j[j >= THRESHOLD]


def _links(units: dict[int, _Unit], pairs: list):
    """(sets, sets, similarities) arrays of the linked pairs of a tile, sets by their place in it."""
    pairs = [(a, b) for a, b in pairs if a in units and b in units]
    n = sum(len(x.rep) for x in units.values())
    if n <= WIDEST and sum(len(units[a].rep) * len(units[b].rep) for a, b in pairs) > DENSE * n:
        yield _all_links(units, pairs)
        return
    start = dict(zip(units, np.cumsum([0, *(len(x.rep) for x in units.values())])[:-1].tolist(), strict=False))
    for a, b in pairs:
        one, two = units[a], units[b]
        for i in range(len(one.rep)):
            some = np.arange(i + 1 if a == b else 0, len(two.rep))
            for k in range(0, len(some), 512):
                at, j = _alike(one.sets[i], one.bits[i], two, some[k : k + 512])
                if len(at):
                    yield np.full(len(at), start[a] + i), start[b] + at, j


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of the component of each of n sets that links x, y connect."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[x], top[y])
        now = top.copy()
        for at in (x, y, top[x], top[y]):
            np.minimum.at(now, at, low)
        while (now != now[now]).any():
            now = now[now]
        if (now == top).all():
            return top
        top = now


def _verify(listed: bool):
    """Rows sorted by tile: first its texts (bs null), then its pairs of units. listed: give the pairs, not counts and components."""

    def flush(held, pairs):
        units = {u: _Unit(rows) for u, rows in held.items()}
        if not units:
            return
        rep, weight = (np.concatenate([getattr(u, c) for u in units.values()]) for c in ("rep", "weight"))
        links, ends = np.zeros(len(rep), np.int64), []
        for x, y, j in _links(units, pairs):
            if listed:
                yield pa.record_batch({"a": rep[x], "b": rep[y], "jaccard": j})
                continue
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            ends.append((x, y))
        if ends:
            some, root = np.flatnonzero(links), _least(len(rep), *(np.concatenate(e) for e in zip(*ends, strict=True)))
            yield pa.record_batch({"rep": rep[some], "links": links[some], "root": rep[root[some]]})

    def run(batches):
        tile, held, pairs = None, {}, []
        for batch in batches:
            col = {c: np.asarray(batch.column(c).fill_null(0)) for c in ("tile", "rep", "unit", "weight")}
            bs = batch.column("bs")
            is_text = np.asarray(bs.is_null())
            got = {}
            rows = np.flatnonzero(is_text)
            for c in chunks(batch.column("text").filter(pa.array(is_text))) if len(rows) else ():
                g, bounds = _sets(c)
                full, _, name = _named(g, bounds)
                for k, own in zip(full.tolist(), i64(name).tolist(), strict=True):
                    got[rows[c.first + k]] = (own, g[bounds[k] : bounds[k + 1]].copy())
            for i in range(len(is_text)):
                if col["tile"][i] != tile:
                    if pairs:
                        yield from flush(held, pairs)
                    tile, held, pairs = col["tile"][i], {}, []
                if not is_text[i]:
                    a = int(col["unit"][i])
                    pairs += [(a, b) for b in bs[i].as_py()]
                elif i in got and got[i][0] == col["rep"][i]:  # a doc_id may have other texts, too
                    rows_ = held.setdefault(int(col["unit"][i]), [])
                    if not any(r[0] == col["rep"][i] for r in rows_[-1:]):
                        rows_.append((col["rep"][i], col["weight"][i], got[i][1]))
        if pairs:
            yield from flush(held, pairs)

    return run


# ---- the join -------------------------------------------------------------------------------------------------------------


def _representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (doc_id, text); members (doc_id, rep) of the documents that have words; reps (rep, doc, weight, size, family)."""
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(arrow_map(texts, _signatures, f"doc_id {kind}, rep long, size int, keys array<long>"))
    members = signed.select("doc_id", "rep").distinct()
    reps = cut(members.groupBy("rep").agg(F.min("doc_id").alias("doc"), F.count("*").alias("weight")).join(signed.groupBy("rep").agg(F.first("size").alias("size"), F.first("keys").alias("keys")), "rep"))
    by_key = reps.select("rep", F.explode("keys").alias("key"))
    lead = cut(by_key.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead <> last").select("key", "lead"))
    led = join_small(by_key, lead, "key", "inner", 24).groupBy("rep").agg(F.min("lead").alias("lead"))
    band = F.length(F.bin("size")).cast("long")  # exact, unlike a logarithm
    family = F.xxhash64(F.coalesce("lead", "rep")).bitwiseAND(-64).bitwiseOR(band)
    return texts, members, cut(reps.drop("keys").join(led, "rep", "left").select("rep", "doc", "weight", "size", family.alias("family")))


def _candidates(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b), a <= b: the pairs of families that can hold linked sets."""
    size = reps.agg(F.sum("size").alias("cells"), F.count("*").alias("n")).first()
    buckets = max(1, -(-(size["cells"] or 0) // CELLS))
    cells = arrow_map(texts.select("text"), _cells(buckets), _BLOB).repartition("bucket").sortWithinPartitions("bucket")
    shared = arrow_map(cells, _shared(buckets), _BLOB)
    sets_ = reps.select(F.pmod("rep", F.lit(buckets)).cast("int").alias("bucket"), "rep", "size", "family")
    both = shared.unionByName(sets_, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    prefixes = arrow_map(both, _prefixes, "gram long, family long")
    met = arrow_map(prefixes.repartition("gram"), _family_pairs, "a long, b long")
    # families of one leader: each with itself, if it has several sets, and with that of the next size band
    wide = reps.groupBy("family").agg(F.count("*").alias("n"))
    own = wide.filter("n > 1").select(F.col("family").alias("a"), F.col("family").alias("b"))
    name, level = F.col("family").bitwiseAND(-64), F.col("family").bitwiseAND(63)
    here, above = wide.select(name.alias("name"), level.alias("level"), F.col("family").alias("a")), wide.select(name.alias("name"), (level - 1).alias("level"), F.col("family").alias("b"))
    return cut(met.unionByName(own).unionByName(here.join(above, ["name", "level"]).select("a", "b")).distinct())


def _tiles(texts: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows that _verify reads."""
    # a group is named by the least family that its members are paired with
    root = pairs.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("a"), "root")
    rooted = cut(pairs.join(root, "a", "left").select(F.coalesce("root", "a").alias("root"), "a", "b"))
    count = cut(reps.groupBy("family").agg(F.count("*").alias("n")))
    member = rooted.select("root", F.explode(F.array("a", "b")).alias("family")).distinct().join(count, "family")
    wide = cut(member.groupBy("root").agg(F.ceil(F.sum("n") / TILE).alias("wide")).filter("wide > 1"))
    cuts = cut(count.filter(F.col("n") > TILE).select("family", F.ceil(F.col("n") / TILE).alias("parts")))
    parts = lambda df, c, k: join_small(df, cuts.select(F.col("family").alias(c), F.col("parts").alias(k)), c, "left", 16).withColumn(k, F.coalesce(k, F.lit(1)))
    units = lambda c, k: F.explode(F.transform(F.sequence(F.lit(0), F.col(k) - 1), lambda i: F.xxhash64(c, i)))
    met = join_small(parts(parts(rooted, "a", "i"), "b", "j"), wide, "root", "left", 16)
    met = met.withColumn("ua", units("a", "i")).withColumn("ub", units("b", "j")).filter("a <> b or ua <= ub")
    slot = lambda u: F.pmod(u, F.coalesce("wide", F.lit(1)))
    tile = F.xxhash64("root", F.least(slot("ua"), slot("ub")), F.greatest(slot("ua"), slot("ub")))
    met = cut(met.select(tile.alias("tile"), "ua", "ub"))
    lists = met.groupBy("tile", "ua").agg(F.collect_list("ub").alias("bs")).withColumnRenamed("ua", "unit")
    to = met.select("tile", F.explode(F.array("ua", "ub")).alias("unit")).distinct().groupBy("unit").agg(F.collect_list("tile").alias("tiles"))
    sent = parts(reps, "family", "k").withColumn("unit", F.xxhash64("family", F.pmod(F.xxhash64("rep"), "k"))).join(to, "unit")
    needs = sent.groupBy("doc").agg(F.collect_list(F.struct("rep", "unit", "weight", "tiles")).alias("needs"))
    rows = join_small(texts, cut(needs.withColumnRenamed("doc", "doc_id")), "doc_id", "inner", 200).select(F.explode("needs").alias("x"), "text")
    rows = rows.select(F.explode("x.tiles").alias("tile"), "x.rep", "x.unit", "x.weight", F.lit(None).cast("array<long>").alias("bs"), "text")
    return rows.unionByName(lists, allowMissingColumns=True).repartition("tile").sortWithinPartitions("tile", F.col("bs").isNotNull(), "unit", "rep")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, links) of the documents that are linked, by text; and the texts' documents."""
    texts, members, reps = _representatives(docs)
    tiles = _tiles(texts, reps, _candidates(texts, reps))
    near = cut(arrow_map(tiles, _verify(False), "rep long, links long, root long"))
    comp = cut(components(near.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    root = F.coalesce("root", "rep").alias("root")
    links = near.groupBy("rep").agg(F.sum("links").alias("links"))
    some = cut(reps.select("rep", "doc", "weight").join(links, "rep", "left").filter("weight > 1 or links is not null").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", root, "doc", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    first = some.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = cut(some.join(first, "root").select("rep", "class_id", "links"))
    out = join_small(members, named, "rep", "inner", 48)
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links")), texts


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, links: a row a document. The class is the least doc_id of those that links connect it with, itself where
    there are none; links is the number of documents, copies too, that are as similar to it as THRESHOLD asks."""
    linked, _ = _linked(docs)
    every = docs.select("doc_id").filter("doc_id is not null").distinct()
    return every.join(linked, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b, jaccard: the linked pairs of different sets, each set named by its least doc_id; and each other document
    of a set with that one, at 1.0. Pairs of the other copies follow by expanding each name."""
    texts, members, reps = _representatives(docs)
    near = arrow_map(_tiles(texts, reps, _candidates(texts, reps)), _verify(True), "a long, b long, jaccard double")
    name = lambda c: reps.select(F.col("rep").alias(c), F.col("doc").alias(f"doc_{c}"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"), "jaccard").filter("doc_id_a < doc_id_b")
    copies = members.join(reps.filter("weight > 1").select("rep", "doc"), "rep").filter("doc_id > doc").select(F.col("doc").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def group(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each class: the one of the least doc_id.

    Rows of one doc_id stay or go together, but for repeats: of rows with the same doc_id and text one stays.
    """
    key = free_name(docs, "paperloom_gone")
    gone = cut(_linked(docs)[0].filter("class_id <> doc_id").select(F.col("doc_id").alias(key)))
    twice = cut(docs.select(F.col("doc_id").alias(key)).dropna().groupBy(key).count().filter("count > 1").select(key))
    named = docs.filter("doc_id is not null").withColumn(key, F.col("doc_id"))
    kept = join_small(named, gone, key, "left_anti", 16)
    once = join_small(kept, twice, key, "left_anti", 16)
    again = join_small(kept, twice, key, "left_semi", 16).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
texts AS (SELECT doc_id, ws FROM words WHERE len(ws) > 0),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')] ELSE list_transform(list_zip({", ".join(f"ws[{k + 1}:]" for k in range(N))}, true), lambda x: concat_ws(' ', {", ".join(f"x[{k + 1}]" for k in range(N))})) END)) AS gs FROM texts),
whole AS (SELECT DISTINCT doc_id, gs FROM sets),
unit AS (SELECT row_number() OVER () AS u, doc_id, gs, len(gs) AS n FROM whole),
one AS (SELECT u, n, unnest(gs) AS g FROM unit),
link AS (SELECT x.u AS a, y.u AS b FROM one x JOIN one y ON x.g = y.g AND x.u <> y.u GROUP BY x.u, y.u HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= {THRESHOLD}),
reach AS (SELECT u AS a, u AS b FROM unit UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS u, min(doc_id) AS class_id FROM reach JOIN unit ON b = u GROUP BY a),
links AS (SELECT a AS u, count(*) AS n FROM link GROUP BY a),
found AS (SELECT doc_id, min(class_id) AS class_id, max(coalesce(links.n, 0)) AS links FROM unit JOIN class USING (u) LEFT JOIN links USING (u) GROUP BY doc_id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0) AS links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN found USING (doc_id)
"""
