import random
from collections import Counter, defaultdict

from paperloom.llm import packing as P


def bfd(sizes):
    return P.best_fit([], [], list(range(len(sizes))), sizes)


def islands(size, epochs=P.EPOCHS):
    """The operator's ring of islands, in this process."""
    now, made = [[] for _ in range(P.ISLANDS)], 0
    for e in range(epochs):
        found = [P.evolve(size, [s.bins for s in now[i]] + [s.bins for s in now[i - 1][: P.ELITE]], hash((0, i, e))) for i in range(P.ISLANDS)]
        now, made = [p for p, _ in found], made + sum(m for _, m in found)
    return min((p[0] for p in now), key=lambda s: s.value), made, now


def test_crossover_keeps_every_piece_once_and_injects_whole_bins():
    rng = random.Random(1)
    size = [rng.randint(1, 1500) for _ in range(200)]
    one = bfd(size)
    two = P.mutate(one, size, rng)
    child = P.cross(one, two, size, rng)
    for s in (two, child):
        assert sorted(p for b in s.bins for p in b) == list(range(200))
        assert all(sum(size[p] for p in b) + r == P.CAPACITY and r >= 0 for b, r in zip(s.bins, s.room, strict=True))
    assert any(b in one.bins for b in child.bins)


def test_best_fit_takes_the_tightest_bin():
    s = P.best_fit([(0,), (1,)], [100, 50], [2], [1948, 1998, 40])
    assert s.bins == [(0,), (1, 2)] and s.room == [100, 10]


def test_beats_best_fit_decreasing():
    rng = random.Random(3)
    size = sorted((rng.randint(410, 1020) for _ in range(300)), reverse=True)
    best, made, populations = islands(size)
    assert made > 300 and all(len(p) == P.POPULATION for p in populations)
    assert -(-sum(size) // P.CAPACITY) <= len(best.bins) < len(bfd(size).bins)


def test_search_goes_on_where_the_bound_is_reached():
    rng = random.Random(4)
    size = sorted((rng.choice((5, 40, 150, 400, 900, 1400)) + rng.randint(0, 60) for _ in range(400)), reverse=True)
    first = bfd(size)
    best, made, _ = islands(size, 2)
    assert len(first.bins) == -(-sum(size) // P.CAPACITY) == len(best.bins) and made > 100 and P.fitness(best.room) > P.fitness(first.room)


def test_populations_resume_from_their_best():
    rng = random.Random(5)
    size = [rng.randint(300, 1000) for _ in range(120)]
    before, _ = P.evolve(size, [], 1)
    after, _ = P.evolve(size, [s.bins for s in reversed(before)], 2)
    assert after[0].value <= before[0].value and len(after) == P.POPULATION


def test_the_operator_makes_crossovers(docs, spark):
    rows = [(i, "w " * random.Random(i).randint(1, 1000)) for i in range(150)]
    sizes = spark.createDataFrame([(0, sorted((len(t.split()) for _, t in rows), reverse=True))], "problem long, sizes array<int>")
    got = P.search(sizes).collect()
    assert len(got) == P.ISLANDS * P.POPULATION and all(r["crossovers"] > 20 for r in got)
    assert {tuple(r["sizes"]) for r in got if r["sizes"]} == {tuple(sizes.first()["sizes"])}


def test_pack_holds_all_pieces(docs):
    rng = random.Random(2)
    texts = ["w " * rng.randint(1, 1800) for _ in range(120)] + ["w " * 5000, "w " * P.CAPACITY, "w " * (2 * P.CAPACITY), "", None, "   \n"]
    rows = list(enumerate(texts)) + [(5, "again " * 40), (5, "again " * 40), (None, "no id here")]
    out = P.pack(docs(rows, clash=True)).collect()
    got, bins = Counter(), defaultdict(int)
    for r in out:
        got[r["doc_id"]] += r["tokens"]
        bins[r["problem"], r["bin"]] += r["tokens"]
    want = Counter()
    for i, t in rows:
        if i is not None and t and t.split():
            want[i] += len(t.split())
    assert got == want
    assert all(v <= P.CAPACITY for v in bins.values()) and all(bins[r["problem"], r["bin"]] == r["bin_tokens"] for r in out)
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in out}) == len(out)
    loose = [r["tokens"] for r in out if r["problem"] >= 0]
    assert len({k for k in bins if k[0] >= 0}) <= len(bfd(loose).bins)
    assert len({k for k in bins if k[0] < 0}) == sum(len(t.split()) // P.CAPACITY for i, t in rows if i is not None and t)
    again = P.pack(docs(rows).repartition(7))
    key = lambda rs: sorted((r["problem"], r["bin"], r["doc_id"], r["copy"], r["piece"]) for r in rs)
    assert key(out) == key(again.collect())


def test_empty_table(docs):
    assert P.pack(docs([])).collect() == []
    assert P.pack(docs([(1, None), (2, "")])).collect() == []


def test_a_long_text_without_spaces_is_one_word(docs):
    got = [(r["doc_id"], r["piece"], r["tokens"]) for r in P.pieces(docs([(1, "x" * 100_000), (2, "\u6587" * 50_000)])).collect()]
    assert sorted(got) == [(1, 0, 1), (2, 0, 1)]
