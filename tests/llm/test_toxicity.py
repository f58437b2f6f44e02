import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import toxicity as X
from paperloom.llm._spark import Shared
from paperloom.llm._text import Table

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
PLAIN, BAD = [f"p{k}" for k in range(300)], ["vile", "scum", "idiot", "trash", "hate"]


def sample(n, seed, share=0.25):
    rng, rows = random.Random(seed), []
    for k in range(n):
        bad = rng.random() < share
        w = rng.choices(PLAIN, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(20, 80))
        for _ in range(rng.randint(2, 5) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((k, " ".join(w), int(bad)))
    return rows


def tables(spark, docs, rows, **kw):
    labels = spark.createDataFrame([(i, None, y, "x") for i, _, y in rows], "doc_id long, quality int, toxic int, text string")
    return docs([(i, t) for i, t, _ in rows], **kw), labels


def test_held_out_accuracy(spark, docs):
    d, labels = tables(spark, docs, sample(800, 1))
    model = X.fit(d, labels)
    held = [(i + 10_000, t, y) for i, t, y in sample(300, 2)]
    want = {i: y for i, _, y in held}
    got = docs([(i, t) for i, t, _ in held]).select("doc_id", (X.scorer(spark, model)("text") > model.threshold).alias("toxic")).collect()
    hit = sum(r["toxic"] and want[r["doc_id"]] for r in got)
    assert hit >= 0.95 * sum(want.values()) and sum(r["toxic"] for r in got) - hit <= 0.02 * len(got)


def by_hand(rows, held):
    """The models by the book, with dictionaries: scores of texts as the difference of two log-likelihoods."""
    train = [(WORD.findall(t.lower()), y) for i, t, y in rows if i not in held]
    n = Counter(w for ws, _ in train for w in ws)
    words = [sum(len(ws) for ws, y in train if y == c) for c in (1, 0)]
    known = {w for w in n if 2 * n[w] * math.log(sum(words) / min(words)) >= X.SIGNIFICANCE and n[w] > 1}
    ids = lambda ws: [w if w in known else "" for w in ws]
    pairs = defaultdict(lambda: [0, 0])
    for ws, y in train:
        for p in set(zip(["<s>", *ids(ws)], ids(ws))):
            pairs[p][not y] += 1
    d, seen, total = [], [Counter(), Counter()], [sum(p[c] for p in pairs.values()) for c in (0, 1)]
    shared = Counter(v for _, v in pairs)
    for c in (0, 1):
        one, two = (sum(p[c] == k for p in pairs.values()) for k in (1, 2))
        d.append(one / (one + 2 * two) if one and two else 0.75)
        seen[c].update(v for (_, v), p in pairs.items() if p[c])
    size = len(known) + 2
    base = {v: (shared[v] + 1) / (sum(shared.values()) + size) for v in [*known, "", "<s>"]}

    def differs(t, o, p):
        gain = sum(n_ * math.log(n_ / ((t + o) * q)) for n_, q in ((t, p), (o, 1 - p)) if n_)
        ratio = (t + 0.5) / (o + 0.5) * (1 - p) / p
        return 2 * gain >= X.SIGNIFICANCE and not 1 / X.RATIO < ratio < X.RATIO

    sums = [sum(s.values()) for s in seen]
    own = {v for v in known if differs(seen[0][v], seen[1][v], sums[0] / sum(sums))}
    word = [{v: (max(seen[c][v] - d[c], 0) + d[c] * len(seen[c]) * base[v]) / sums[c] if v in own else base[v] for v in base} for c in (0, 1)]
    kept = {}
    for (u, v), (t, o) in pairs.items():
        odds = word[0][v] / word[1][v] * total[0] / total[1]
        if differs(t, o, odds / (1 + odds)):
            kept[u, v] = (t, o)
    context = {u: [sum(p[c] for (a, _), p in pairs.items() if a == u) for c in (0, 1)] for u, _ in kept}
    back = {}
    for u in context:
        for c in (0, 1):
            n_ = max(context[u][c], 1)
            x = 1 - sum(max(p[c] - d[c], 0) for (a, _), p in kept.items() if a == u) / n_
            back[u, c] = x if x > 0 else 1 / (n_ + 1)

    def prob(u, v, c):
        if (u, v) in kept:
            return max(kept[u, v][c] - d[c], 0) / max(context[u][c], 1) + back[u, c] * word[c][v]
        return back.get((u, c), 1) * word[c][v]

    def score(text):
        ws = ids(WORD.findall(text.lower()))
        return sum(math.log(prob(u, v, 0) / prob(u, v, 1)) for u, v in zip(["<s>", *ws], ws)) / max(1, len(ws))

    return score


def test_scores_match_the_models_by_hand(spark, docs):
    rows = sample(300, 5)
    d, labels = tables(spark, docs, rows)
    held = {r["doc_id"] for r in d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(X.HOLD_OUT)) == 0).collect()}
    score = by_hand(rows, held)
    model = X.fit(d, labels)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", X.scorer(spark, model)("text").alias("s")).collect()}
    assert len(model.pairs) and len(model.word) > 150
    for i, t, _ in rows:
        assert abs(got[i] - score(t)) < 1.5 / X.SCALE


def test_cases(spark, docs):
    rows = sample(400, 3)
    d, labels = tables(spark, docs, rows)
    odd = [(5000, None), (5001, ""), (5002, "!?"), (None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1]), (5003, "p1 p2 " * 30_000), (5004, "hate scum trash idiot vile")]
    labels = labels.unionByName(spark.createDataFrame([(1, None, None, "x"), (None, None, 1, "x"), (2, None, 1, "x")], labels.schema))
    got = X.score(docs(odd, clash=True).unionByName(d.selectExpr("*", *(f"'x' as {c}" for c in docs(odd, clash=True).columns if c not in d.columns))), labels).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["score"], r["toxic"]))
    assert by[5000] == by[5001] == by[5002] == [(0.0, False)] and len(set(by[1])) == 1 and len(by[None]) == 1
    assert by[5004][0][1] and not by[5003][0][1] and len(got) == len(rows) + len(odd)


def test_nothing_to_fit(spark, docs):
    rows = sample(30, 4, share=0)
    d, labels = tables(spark, docs, rows)
    assert X.fit(d, labels) is None and X.keep_ordinary(d, labels).count() == 30
    assert {(r["score"], r["toxic"]) for r in X.score(d, labels).collect()} == {(0.0, False)}
    empty = docs([])
    assert X.score(empty, labels).collect() == [] and X.keep_ordinary(empty, labels.limit(0)).collect() == []


def test_keep_ordinary_keeps_nulls(spark, docs):
    d, labels = tables(spark, docs, sample(400, 6))
    more = d.unionByName(docs([(None, None), (9000, ""), (9001, "hate scum vile trash idiot")]))
    kept = {r["doc_id"] for r in X.keep_ordinary(more, labels).collect()}
    assert None in kept and 9000 in kept and 9001 not in kept


def test_lookup_table():
    keys = np.arange(1, 5000, dtype=np.uint64) * np.uint64(2654435761)
    t = Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) == -1).all()
    assert Shared is not None


def test_few_toxic_documents_have_a_threshold(spark, docs):
    """With under 5 toxic documents held out, or in all, the threshold is 0."""
    plain = [r for r in sample(200, 8) if not r[2]][:80]
    bad = [(1000 + k, " ".join(BAD * 4), 1) for k in range(15)]
    d, labels = tables(spark, docs, plain + bad)
    toxic = {r["doc_id"] for r in X.score(d, labels).collect() if r["toxic"]}
    assert X.fit(d, labels).threshold == 0.0 and {r[0] for r in bad} <= toxic
    assert X.fit(*tables(spark, docs, plain + bad[:4])).threshold == 0.0


def test_models_are_fitted_on_a_bounded_sample(spark, docs, monkeypatch):
    d, labels = tables(spark, docs, sample(600, 4))
    assert X.labelled(d, labels).count() == 600
    monkeypatch.setattr(X, "LABELLED", 300)
    assert 200 < X.labelled(d, labels).count() < 400
    got = X.score(d, labels)
    assert got.count() == 600
