import itertools
import random
import re

from paperloom.llm import ngram_join as J

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + J.N]) for i in range(max(1, len(w) - J.N + 1))} if w else set()


def brute(rows):
    """All pairs of distinct sets' first documents at the threshold, and each copy with its first."""
    sets = {i: grams(t) for i, t in rows if i is not None and grams(t)}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    out = {(first[frozenset(s)], i): 1.0 for i, s in sets.items() if first[frozenset(s)] != i}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= J.THRESHOLD:
            out[a, b] = j
    return out


def brute_classes(rows):
    """(class, links) of each document; doc_ids are unique."""
    sets = {i: grams(t) for i, t in rows if i is not None}
    up, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and len(sets[a] & sets[b]) >= J.THRESHOLD * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (find(i), links[i]) for i in sets}


def classes(df):
    return {r["doc_id"]: (r["class_id"], r["links"]) for r in df.collect()}


def variants(seed=5, families=25):
    rng, words, rows = random.Random(seed), [f"w{k}" for k in range(3000)], []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(20, 300))
        for _ in range(rng.randint(1, 8)):
            own = [rng.choice(words) if rng.random() < rng.choice((0, 0.02, 0.05, 0.12)) else w for w in base]
            rows.append((len(rows), " ".join(own)))
    return rows


CASES = [(900, None), (901, ""), (902, "?!"), (903, "Two words"), (904, "two WORDS!"), (None, "two words"), (905, "long text " * 20_000), (906, "long text " * 20_000), (907, "étude à côté"), (908, "Étude à côté")]


def test_matches_brute_force(docs):
    rows = variants() + CASES
    want = brute(rows)
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in J.join(docs(rows, clash=True)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(want) > 50


def test_large_groups_and_small_tiles(docs, monkeypatch):
    monkeypatch.setattr(J, "TILE", 8)
    rng, base = random.Random(1), [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(60)] + [(100 + k, " ".join(base)) for k in range(300)]
    rng.shuffle(rows)
    want = brute(rows)
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in J.join(docs(rows)).collect()}
    assert set(got) == set(want)
    assert classes(J.classes(docs(rows))) == brute_classes(rows)


def test_classes_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(J, "CELLS", 500)  # many buckets
    rows = variants(8) + CASES
    want = brute_classes(rows)
    assert classes(J.classes(docs(rows, clash=True))) == want and max(n for _, n in want.values()) > 4


def test_passages_that_many_documents_share(docs):
    rng, words = random.Random(3), [f"w{k}" for k in range(2000)]
    passage = rng.choices(words, k=60)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(10, 60)) + passage)) for i in range(80)]
    rows += [(100 + i, " ".join(passage + rng.choices(words, k=rng.randint(0, 25)))) for i in range(40)]
    want = brute_classes(rows)
    assert classes(J.classes(docs(rows))) == want and 0 < sum(n > 0 for _, n in want.values()) < len(rows)


def test_sizes_at_the_limit(docs):
    """Sets at exactly the threshold, with sizes on both sides of a power of 2."""
    rng, rows = random.Random(9), []
    for n in (1, 2, 3, 4, 7, 8, 16, 31, 32, 64, 128):
        words = [f"v{rng.randrange(10**9)}" for _ in range(2 * n + 2)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: n + 2]))]
    assert classes(J.classes(docs(rows))) == {i: (i - i % 2, 1) for i, _ in rows}


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("d2", "one and the same text"), ("d1", "one and the same text"), ("d3", "another")], "doc_id string, text string")
    assert classes(J.classes(d)) == {"d1": ("d1", 1), "d2": ("d1", 1), "d3": ("d3", 0)}
    assert sorted(r["doc_id"] for r in J.group(d).collect()) == ["d1", "d3"]


def test_matches_sql(docs, same):
    d = docs(variants(6, 6) + CASES + [(2000, "one text of an id"), (2000, "other words of it"), (2001, "one text of an id"), (1999, "other words of it")])
    same(J.classes(d), J.SQL, documents=d)


def test_group_keeps_one_of_each(docs):
    rows = variants(7, 10) + CASES + [(50_000, "only one of a kind here"), (50_000, "only one of a kind here"), (50_000, "another text of the same id"), (None, None), (60_000, None), (60_000, "")]
    out = [(r["doc_id"], r["text"]) for r in J.group(docs(rows, clash=True)).collect()]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in brute([r for r in rows if r[0] != 50_000]):
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = [(i, t) for i, t in dict.fromkeys(rows) if i is None or find(i) == i]
    assert sorted(map(repr, out)) == sorted(map(repr, want))


def test_empty(docs):
    assert J.classes(docs([])).collect() == [] and J.join(docs([])).collect() == [] and J.group(docs([])).collect() == []
    assert J.join(docs([(1, None), (2, "")])).collect() == []
    assert classes(J.classes(docs([(1, None), (2, "")]))) == {1: (1, 0), 2: (2, 0)}


def linked_group(n, seed=2):
    """Different texts that each share a third of their words with every other: one group of n families, few of them similar."""
    rng = random.Random(seed)
    core = [f"c{k}" for k in range(60)]
    return [(i, " ".join(core + [f"u{rng.randrange(10**9)}" for _ in range(rng.choice((20, 30, 90)))])) for i in range(n)]


def test_a_pair_of_families_is_listed_in_one_tile(docs, monkeypatch):
    """However many slots their group has, or the lists would grow with the square of the slots."""
    monkeypatch.setattr(J, "TILE", 8)
    rows = linked_group(48)
    texts, _, reps = J._representatives(docs(rows))
    pairs = J._candidates(texts, reps)
    tiles = [r for r in J._tiles(texts, reps, pairs).collect() if r["bs"] is not None]
    units = {r["family"]: -(-r["count"] // 8) for r in reps.groupBy("family").count().collect()}
    met = [(r["a"], r["b"]) for r in pairs.collect()]
    want = sum(units[a] * units[b] if a != b else units[a] * (units[a] + 1) // 2 for a, b in met)
    assert sum(len(r["bs"]) for r in tiles) == want > 100 and len({r["tile"] for r in tiles}) > 8
    assert classes(J.classes(docs(rows))) == brute_classes(rows)


def test_overlaps_of_a_tile_at_once(monkeypatch):
    """The product of columns, the listed pairs of rarer n-grams, and the direct way agree with sets, over many parts and slices."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 47, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(1, 280), False), rng.integers(0, 1 << 47, rng.integers(0, 60), dtype=np.uint64)))) for _ in range(90)]
    sets += [np.unique(np.concatenate((s, rng.integers(0, 1 << 47, 9, dtype=np.uint64)))) for s in sets[:40]]
    units = {u: J._Unit([(k, 1, sets[k]) for k in range(u, len(sets), 7)]) for u in range(7)}
    pairs = [(a, b) for a in range(7) for b in range(a, 7) if (a + b) % 3]
    flat = [k for u in range(7) for k in range(u, len(sets), 7)]
    want = {}
    for x, y in itertools.combinations(range(len(flat)), 2):
        a, b = set(sets[flat[x]].tolist()), set(sets[flat[y]].tolist())
        if (flat[x] % 7, flat[y] % 7) in pairs and len(a & b) >= J.THRESHOLD * len(a | b):
            want[x, y] = len(a & b) / len(a | b)
    for dense, sort, columns in ((0, 1 << 20, 1024), (0, 1000, 16), (10**9, 1 << 20, 1024)):
        for name, value in (("DENSE", dense), ("SORT", sort), ("COLUMNS", columns)):
            monkeypatch.setattr(J, name, value)
        got = {(int(x), int(y)): float(j) for xs, ys, js in J._links(units, pairs) for x, y, j in zip(xs, ys, js, strict=True)}
        assert got == want and len(want) > 100


def test_memory_of_a_bucket():
    """A bucket of about CELLS cells takes a worker some tens of bytes a cell at most."""
    import tracemalloc

    import numpy as np

    rng, n, each = np.random.default_rng(8), 10_000, 400
    reps, grams = np.arange(n, dtype=np.uint64) << np.uint64(40), rng.integers(0, 1 << 22, n * each, dtype=np.uint32) * np.uint32(977)
    batch = next(iter(J._blobs(np.zeros(n * each, np.int64), np.repeat(np.arange(n), each), reps, grams, None)))
    tracemalloc.start()
    cells = sum(len(b.column("grams")[k].as_py()) // 4 for b in J._shared(20)([batch]) for k in range(len(b)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cell = np.unique(grams.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(n), each).astype(np.uint64)) >> np.uint64(32)
    assert cells == sum(c for c in np.unique(cell, return_counts=True)[1].tolist() if c > 1)
    assert peak < 45 * n * each, peak
