"""Toxicity: class-conditional Kneser-Ney bigram models, compared by length-normalised log-likelihood.

Two interpolated models are counted over every labelled document outside the held-out fold, one per class; a document counts a
bigram once. A bigram backs off to its class's continuation counts (in how many contexts a word was seen), and these to
continuation counts pooled over both classes. An expression has probabilities of its own in the two classes only where their
counts differ significantly (likelihood-ratio test at SIGNIFICANCE) and by RATIO; all others share the pooled ones, so rare
words add no noise to a score. A word too rare to reach that even if one class alone had it is the unknown word. Without this
sharing a score drowns in the noise of ordinary words (figures in the README). Models are fitted on LABELLED labelled documents at
most, which bounds what is broadcast; every document is scored. A text's score is (log P_toxic - log P_ordinary) per word; it is toxic above the threshold that has the best
F1 on the held-out fold, or above 0 where that fold has under 5 toxic documents. Scores are sums of fixed-point numbers, so they don't depend on the partitioning.

Cases. Null or empty text, or text without words: score 0.0, not toxic. Null doc_id: scored like any other row, never used for
fitting. A doc_id labelled twice counts as toxic if any label says so; labels that are null are ignored. Repeated rows each get
their own equal result. Without documents of both classes nothing can be fitted: every score is 0.0 and nothing is toxic.
Columns other than doc_id and text pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Shared, arrow_map, cut, join_small, release, table
from ._text import Table, U, chunks, i64, sums

#: Chi-square with one degree of freedom at p = 1e-6.
SIGNIFICANCE = 24.0
#: Labelled documents that the models are fitted on at most, chosen by hash of doc_id where there are more.
LABELLED = 1 << 20
#: Significant differences under this ratio of frequencies are those of length and layout, and are shared too.
RATIO = 4.0
#: One in HOLD_OUT labelled documents, chosen by hash, sets the threshold and isn't counted.
HOLD_OUT = 5
SCALE = 4096
#: Tokens whose counts a task adds up before it sends them on.
FLUSH = 3_000_000


@dataclass
class Model:
    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    threshold: float = float("inf")


def _ids(vocabulary: Table, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 32 | word) of each word, the word ids, bounds; 0 is the unknown word, len + 1 the start of a text."""
    _, _, h, bounds = c.words()
    v = vocabulary.find(h).astype(np.int64) + 1
    u = np.concatenate(([0], v[:-1]))[: len(v)]
    heads = bounds[:-1][np.diff(bounds) > 0]
    u[heads] = len(vocabulary.keys) + 1
    return (u << 32) | v, v, bounds


def _counts(keys: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, toxic = keys[order], toxic[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    t = np.add.reduceat(toxic.astype(np.int64), at)
    n = np.diff(np.append(at, len(keys)))
    return pa.record_batch({"k": i64(keys[at]), "t": t, "o": n - t})


def _counter(of):
    def run(batches):
        keys, toxic, held = [], [], 0
        for b in batches:
            labels = np.asarray(b.column("toxic").fill_null(0)) > 0
            for c in chunks(b.column("text")):
                k, bounds = of(c)
                keys.append(k)
                toxic.append(np.repeat(labels[c.first : c.first + c.n], np.diff(bounds)))
                held += len(k)
                if held > FLUSH:
                    yield _counts(np.concatenate(keys), np.concatenate(toxic))
                    keys, toxic, held = [], [], 0
        if held:
            yield _counts(np.concatenate(keys), np.concatenate(toxic))

    return run


def _tables(m: Model) -> tuple[Model, Table, Table]:
    return m, Table(m.words), Table(m.pairs.view(U))


def _score(shared: Shared, texts: pa.Array) -> np.ndarray:
    m, vocabulary, pairs = shared.get()
    out = np.zeros(len(texts))
    for c in chunks(texts):
        key, v, bounds = _ids(vocabulary, c)
        at = pairs.find(key.view(U))
        value = np.where(at >= 0, m.pair[at] if len(m.pair) else 0, m.word[v] + m.context[key >> 32])
        out[c.first : c.first + c.n] = sums(value.astype(np.int64), bounds) / (SCALE * np.maximum(np.diff(bounds), 1))
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, held) of the documents that have a label."""
    lab = cut(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = -(-lab.count() // LABELLED)
    if share > 1:
        lab = cut(lab.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(share)) == 0))
    rows = join_small(docs.select("doc_id", "text").filter("doc_id is not null and text is not null"), lab, "doc_id", "inner", 16)
    return rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0).alias("held"))


def _differs(t: np.ndarray, o: np.ndarray, p: float) -> np.ndarray:
    """Whether the odds t : o differ significantly, and by RATIO at least, from p : 1 - p."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(t > 0, t * np.log(t / ((t + o) * p)), 0) + np.where(o > 0, o * np.log(o / ((t + o) * (1 - p))), 0)
    ratio = (t + 0.5) * (1 - p) / ((o + 0.5) * p)
    return (2 * g >= SIGNIFICANCE) & (np.maximum(ratio, 1 / ratio) >= RATIO)


def least_count(t: int, o: int) -> int:
    """So often must a word occur to differ significantly from the shares t : o."""
    return max(2, math.ceil(SIGNIFICANCE / (2 * math.log((t + o) / min(t, o)))))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Counts over all labelled documents outside the held-out fold; None where one of the classes has none."""
    spark = docs.sparkSession
    rows = labelled(docs, labels)
    train = rows.filter("not held").select("text", "toxic")
    total = F.expr("t + o")

    def count(of):
        return arrow_map(train, _counter(of), "k long, t long, o long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))

    counted = cut(count(lambda c: c.words()[2:]))
    sums_ = counted.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    if not sums_["t"] or not sums_["o"]:
        return None
    words = np.sort(np.asarray(counted.filter(total >= least_count(sums_["t"], sums_["o"])).select("k").toArrow()["k"]))
    vocabulary = Shared(spark, words.view(U), Table)

    def bigrams(c):
        k, _, bounds = _ids(vocabulary.get(), c)
        of = np.repeat(np.arange(c.n), np.diff(bounds))
        order = np.lexsort((k, of))
        k, of = k[order], of[order]
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (of[1:] != of[:-1])))[: len(k)]
        return k[once], np.searchsorted(of[once], np.arange(c.n + 1))

    pairs = cut(count(bigrams).select(F.shiftright("k", 32).cast("int").alias("u"), F.expr("cast(k & 4294967295 as int)").alias("v"), "t", "o"))
    n = dict(pairs.agg(*(F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "to" for k in (1, 2)), F.sum("t").alias("t"), F.sum("o").alias("o")).first().asDict())
    if not n["t"] or not n["o"]:
        return None
    size = len(words) + 2
    follow = pairs.groupBy("v").agg(F.count_if(F.expr("t > 0")).alias("t"), F.count_if(F.expr("o > 0")).alias("o"), F.count("*").alias("all")).toArrow()

    def full(tab: pa.Table, key: str, col: str) -> np.ndarray:
        out = np.zeros(size)
        out[np.asarray(tab[key])] = np.asarray(tab[col])
        return out

    shared = full(follow, "v", "all") + 1
    shared /= shared.sum()
    seen = {c: full(follow, "v", c) for c in "to"}
    own = _differs(seen["t"], seen["o"], seen["t"].sum() / (seen["t"].sum() + seen["o"].sum()))
    own[0] = False
    discount = {c: n[f"{c}1"] / (n[f"{c}1"] + 2 * n[f"{c}2"]) if n[f"{c}1"] and n[f"{c}2"] else 0.75 for c in "to"}
    word = {c: np.where(own, (np.maximum(seen[c] - d, 0) + d * (seen[c] > 0).sum() * shared) / seen[c].sum(), shared) for c, d in discount.items()}
    odds = cut(spark.createDataFrame([(int(v), float(word["t"][v] / word["o"][v])) for v in np.flatnonzero(own)], "v int, odds double"))
    p = F.expr(f"coalesce(odds, 1) * {n['t'] / n['o']!r} / (1 + coalesce(odds, 1) * {n['t'] / n['o']!r})")
    side = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("t") + F.col("o")) * q))).otherwise(0)
    kept = cut(join_small(pairs, odds, "v", "left", 12).filter((2 * (side("t", p) + side("o", 1 - p)) >= SIGNIFICANCE) & (F.abs(F.log((F.col("t") + 0.5) * (1 - p) / ((F.col("o") + 0.5) * p))) >= F.log(F.lit(RATIO)))).select("u", "v", "t", "o"))
    contexts = join_small(pairs, cut(kept.select("u").distinct()), "u", "inner", 4).groupBy("u").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).toArrow()
    kept = kept.toArrow()
    back, cond = {}, {}
    u, v = np.asarray(kept["u"]), np.asarray(kept["v"])
    for c, d in discount.items():
        held = np.maximum(np.asarray(kept[c]) - d, 0)
        all_ = np.maximum(full(contexts, "u", c), 1)
        back[c] = 1 - np.bincount(u, held, size) / all_
        back[c] = np.where(back[c] > 0, back[c], 1 / (all_ + 1))
        cond[c] = held / all_[u] + back[c][u] * word[c][v]
    fixed = lambda a: np.rint(SCALE * (np.log(a["t"]) - np.log(a["o"]))).astype(np.int32)
    model = Model(words.view(U), fixed(word), fixed(back), (u.astype(np.int64) << 32) | v, fixed(cond))
    best = _threshold(rows.filter("held"), model)
    model.threshold = max(0.0, best or 0.0)  # 0 where the fold is too small; never under 0: a text without words isn't toxic
    return model


def _threshold(rows: DataFrame, model: Model) -> float | None:
    """The score with the best F1; the middle, where several have it. None with under 5 toxic documents."""
    score = scorer(rows.sparkSession, model)
    bins = rows.select(F.floor(score("text") * 500).alias("b"), "toxic").groupBy("b").agg(F.count_if(F.expr("toxic > 0")).alias("t"), F.count_if(F.expr("toxic <= 0")).alias("o")).orderBy(F.desc("b")).collect()
    toxic, hit, wrong, found = sum(r["t"] for r in bins), 0, 0, []
    if toxic < 5:
        return None
    for k, r in enumerate(bins):
        hit, wrong = hit + r["t"], wrong + r["o"]
        below = bins[k + 1]["b"] + 1 if k + 1 < len(bins) else r["b"]
        found.append((2 * hit / (toxic + hit + wrong), (r["b"] + below) / 1000))
    best = max(f for f, _ in found)
    return float(np.median([x for f, x in found if f == best]))


def scorer(spark: SparkSession, model: Model | None):
    """A column function: text -> score."""
    if model is None:
        return lambda text: F.lit(0.0)
    shared = Shared(spark, model, _tables)

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        out = _score(shared, texts)
        release()
        return pa.array(out)

    return toxicity


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and toxic of every row of docs."""
    model = fit(docs, labels)
    out = docs.select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))
    return out.withColumn("toxic", F.col("score") > F.lit(model.threshold if model else float("inf")))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that aren't toxic."""
    model = fit(docs, labels)
    if model is None:
        return docs
    return docs.filter(scorer(docs.sparkSession, model)("text") <= F.lit(model.threshold))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
