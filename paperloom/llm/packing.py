"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

A document's length is its number of runs of non-space characters. One longer than CAPACITY is cut: its full bins stand alone,
and the rest is packed like any other piece. Pieces are dealt by hash into problems of about PROBLEM pieces, so the work grows
with the number of documents and each problem fits a task. A problem has ISLANDS populations, each in its own group of the
shuffle, that evolve independently for an epoch; whole populations pass from epoch to epoch, and between epochs each island sends
its ELITE best solutions to the next island of the ring. Chromosomes are lists of bins. Crossover injects some of the best-filled
bins of one parent whole into another, removes the bins that hold duplicates of their pieces, and best-fits the displaced pieces,
largest first; mutation empties some of the worst-filled bins the same way. A solution with fewer bins is better, and of equals
the one with the greater mean square fill, so the search goes on where the number of bins is least: slack gathers in few bins.
The first solution of each population is best-fit decreasing, and the best survive, so no result has more bins than that.

Cases. Null and empty texts have length 0 and aren't packed; nor are rows with a null doc_id. Rows that repeat a doc_id are
distinct pieces, numbered by `copy` in the order of length and text hash. Ties go to the lower piece index, so results don't
depend on the partitioning. Bins are numbered within their problem, full bins in problems below 0. An empty table packs into no
bins. Other columns are ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table

CAPACITY = 2048
PROBLEM = 2000
ISLANDS, EPOCHS = 3, 3
POPULATION, GENERATIONS, ELITE = 8, 100, 2


Bin = tuple[int, ...]


class Solution:
    """Bins of pieces, and the room that each has left. Bins are shared between solutions and never changed in place."""

    __slots__ = ("bins", "room", "value")

    def __init__(self, bins: list[Bin], room: list[int]):
        self.bins, self.room = bins, room
        self.value = (len(bins), -fitness(room))


def best_fit(bins: list[Bin], room: list[int], loose: list[int], size: list[int]) -> Solution:
    """The solution that puts each loose piece, largest first, into the bin with the least room that holds it."""
    order = sorted(zip(room, range(len(room)), strict=True))
    for p in sorted(loose, key=lambda p: (-size[p], p)):
        k = bisect_left(order, (size[p], -1))
        if k == len(order):
            bins.append((p,))
            room.append(CAPACITY - size[p])
            insort(order, (room[-1], len(bins) - 1))
        else:
            r, i = order.pop(k)
            bins[i] += (p,)
            room[i] = r - size[p]
            insort(order, (room[i], i))
    return Solution(bins, room)


def fitness(room: list[int]) -> float:
    """Mean square fill."""
    return sum((CAPACITY - r) ** 2 for r in room) / (max(1, len(room)) * CAPACITY**2)


def cross(a: Solution, b: Solution, size: list[int], rng: random.Random) -> Solution:
    """b with some of a's best-filled bins injected whole."""
    ranked = sorted(range(len(a.bins)), key=a.room.__getitem__)[: max(1, len(a.bins) // 2)]
    taken = rng.sample(ranked, rng.randint(1, max(1, len(ranked) // 2)))
    new = {p for i in taken for p in a.bins[i]}
    bins, room, loose = [a.bins[i] for i in taken], [a.room[i] for i in taken], []
    for own, r in zip(b.bins, b.room, strict=True):
        if new.isdisjoint(own):
            bins.append(own)
            room.append(r)
        else:
            loose += [p for p in own if p not in new]
    return best_fit(bins, room, loose, size)


def mutate(s: Solution, size: list[int], rng: random.Random) -> Solution:
    """s with some of its worst-filled bins, and a few others, emptied and packed again."""
    n = len(s.bins)
    worst = sorted(range(n), key=s.room.__getitem__, reverse=True)[: max(2, n // 10)]
    gone = set(rng.sample(worst, max(1, len(worst) // 2))) | {rng.randrange(n) for _ in range(max(2, n // 50))}
    kept = [i for i in range(n) if i not in gone]
    return best_fit([s.bins[i] for i in kept], [s.room[i] for i in kept], [p for i in gone for p in s.bins[i]], size)


def evolve(size: list[int], start: list[list[Bin]], seed: int) -> tuple[list[Solution], int]:
    """One epoch from some solutions: the population, best first, and the number of crossovers made."""
    rng = random.Random(seed)
    population = [Solution(bins, [CAPACITY - sum(size[p] for p in b) for b in bins]) for bins in start]
    if not population:
        population = [best_fit([], [], list(range(len(size))), size)]
    population.sort(key=lambda s: s.value)
    del population[POPULATION:]
    if len(population[0].bins) < 2:
        return population, 0
    while len(population) < POPULATION:
        population.append(mutate(population[rng.randrange(len(population))], size, rng))
    population.sort(key=lambda s: s.value)
    made = 0
    for _ in range(GENERATIONS):
        a, b = (min(rng.sample(range(POPULATION), 2)) for _ in range(2))  # tournaments: the population is sorted
        child = cross(population[a], population[b], size, rng) if a != b else mutate(population[a], size, rng)
        made += a != b
        if rng.random() < 0.3:
            child = mutate(child, size, rng)
        if child.value < population[-1].value and all(child.value != s.value for s in population):
            population[-1] = child
            population.sort(key=lambda s: s.value)
    return population, made


def _encode(bins: list[Bin], n: int) -> list[int]:
    out = [0] * n
    for i, b in enumerate(sorted(bins, key=min)):
        for p in b:
            out[p] = i
    return out


def _decode(code: list[int]) -> list[Bin]:
    bins: list[list[int]] = [[] for _ in range(max(code, default=-1) + 1)]
    for p, i in enumerate(code):
        bins[i].append(p)
    return [tuple(b) for b in bins if b]


_STATE = "problem long, island int, rank int, bins int, fit double, crossovers int, sizes array<int>, code array<int>"


def _epoch(epoch: int):
    def run(t: pa.Table) -> pa.Table:
        sizes = next(s for s in t["sizes"].to_pylist() if s is not None)
        own, island = int(t["problem"][0].as_py()), int(t["to"][0].as_py())
        codes = sorted({tuple(c) for c in t["code"].to_pylist() if c is not None})
        found, made = evolve(sizes, [_decode(c) for c in codes], hash((own, island, epoch)))
        n = len(found)
        return pa.table({
            "problem": pa.array([own] * n, pa.int64()), "island": pa.array([island] * n, pa.int32()), "rank": pa.array(range(n), pa.int32()), "bins": pa.array([len(s.bins) for s in found], pa.int32()), "fit": pa.array([fitness(s.room) for s in found], pa.float64()),
            "crossovers": pa.array([made] * n, pa.int32()), "sizes": pa.array([sizes] + [None] * (n - 1), pa.list_(pa.int32())), "code": pa.array([_encode(s.bins, len(sizes)) for s in found], pa.list_(pa.int32())),
        })

    return run


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, piece, tokens): each document cut at multiples of CAPACITY."""
    n = docs.filter("doc_id is not null").select("doc_id", F.expr("regexp_count(text, '\\\\S+')").alias("n"), F.xxhash64("text").alias("h")).filter("n > 0")
    n = n.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "h")) - 1)
    full = F.sequence(F.lit(0), F.ceil(F.col("n") / CAPACITY).cast("int") - 1)
    return n.select("doc_id", "copy", F.explode(full).alias("piece"), "n").withColumn("tokens", F.least(F.lit(CAPACITY), F.col("n") - F.col("piece") * CAPACITY)).drop("n")


def search(dealt: DataFrame) -> DataFrame:
    """(problem, sizes) -> the populations after the last epoch, in the columns of _STATE."""
    to_all = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("to")
    state = dealt.select("problem", to_all, "sizes", F.lit(None).cast("array<int>").alias("code"))
    for epoch in range(EPOCHS):
        last = cut(state.groupBy("problem", "to").applyInArrow(_epoch(epoch), _STATE))
        # a population stays on its island; its best go to the next one as migrants, too
        ring = F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
        state = last.select("problem", F.explode(F.when(F.col("rank") < ELITE, ring).otherwise(F.array("island"))).alias("to"), "sizes", "code")
    return last


def pack(docs: DataFrame) -> DataFrame:
    """problem, bin, doc_id, copy, piece, tokens, bin_tokens: the bin of each piece; (problem, bin) names a bin."""
    all_ = cut(pieces(docs))
    dealt_to = lambda rows: F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(max(1, -(-rows.count() // PROBLEM))))
    loose, full = all_.filter(F.col("tokens") < CAPACITY), all_.filter(F.col("tokens") == CAPACITY)
    dealt = cut(loose.groupBy(dealt_to(loose).alias("problem")).agg(F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("less"), "doc_id", "copy", "piece"))).alias("p")))
    last = search(dealt.select("problem", F.transform("p", lambda x: (-x["less"]).cast("int")).alias("sizes")))
    best = last.groupBy("problem").agg(F.min(F.struct("bins", (-F.col("fit")).alias("unfit"), "island", "code")).alias("s")).select("problem", F.col("s.code").alias("code"))
    rows = dealt.join(best, "problem").select("problem", F.explode(F.arrays_zip("p", "code")).alias("x"))
    rows = rows.select("problem", F.col("x.code").cast("long").alias("bin"), "x.p.doc_id", "x.p.copy", "x.p.piece", (-F.col("x.p.less")).alias("tokens"))
    rows = rows.withColumn("bin_tokens", F.sum("tokens").over(Window.partitionBy("problem", "bin")))
    alone = full.withColumn("problem", -1 - dealt_to(full))
    number = F.row_number().over(Window.partitionBy("problem").orderBy("doc_id", "copy", "piece")) - 1
    alone = alone.select("problem", number.cast("long").alias("bin"), "doc_id", "copy", "piece", "tokens", F.col("tokens").cast("long").alias("bin_tokens"))
    return rows.unionByName(alone)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
