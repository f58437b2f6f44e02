import random

import numpy as np

from paperloom.llm import topk as K


def queries(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, score string")


def make(n, rng, words):
    return [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 60)))) for i in range(n)]


def test_matches_sql(spark, docs, same, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 40)  # several shards a task
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["étude", "naïve"]
    rows = make(400, rng, words) + [(1000, None), (1001, ""), (1002, "?!"), (7, "w1 w2"), (7, "w1 w2"), (None, "w1 w59 étude"), (1003, "w3 " * 20_000)]
    q = queries(spark, [(1, "w1 w2 W2, étude"), (2, "w59"), (3, "absent words"), (4, None), (5, ""), (None, "w1"), (2, "w1 w58"), (6, "w0 w10 w20 w30 w40 w50 w5")])
    d = docs(rows, clash=True)
    same(K.search(d, q).drop("x"), K.SQL, documents=d, benchmark=q)


def test_ties_go_to_the_lower_id(spark, docs):
    got = K.search(docs([(i, "same words here") for i in range(30, 0, -1)]), queries(spark, [(1, "words")])).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 11)) and [r["rank"] for r in got] == list(range(1, 11))


def test_empty(spark, docs):
    assert K.search(docs([]), queries(spark, [(1, "a b")])).collect() == []
    assert K.search(docs([(1, "a b")]), queries(spark, [])).collect() == []


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("d1", "one two"), ("d2", "two")], "doc_id string, text string")
    q = spark.createDataFrame([("q1", "two")], "item_id string, text string")
    assert [(r["item_id"], r["doc_id"], r["rank"]) for r in K.search(d, q).orderBy("rank").collect()] == [("q1", "d2", 1), ("q1", "d1", 2)]


def test_skips_postings_at_the_default_shard():
    rng, n = np.random.default_rng(5), 200
    share = 0.6 / np.arange(1, n + 1)  # of documents that hold a term
    shards = []
    for _ in range(5):
        doc, term = np.nonzero(rng.random((K.SHARD, n)) < share)
        idf = np.log(1 / share)[term]
        shards.append(K._Shard(term, doc, np.floor(K.SCALE * idf * rng.uniform(0.8, 1.6, len(term))).astype(np.int64), n, K.SHARD))
    held, through, first = 0, 0, 0
    for _ in range(40):
        own = np.unique(np.concatenate((rng.integers(0, 20, 10), rng.integers(20, n, 5))))
        best = np.zeros(0, np.int64)
        every = np.concatenate([np.bincount(np.concatenate([s.doc[s.at[t] : s.at[t + 1]] for t in own]), np.concatenate([s.impact[s.at[t] : s.at[t + 1]] for t in own]), K.SHARD) for s in shards])
        for k, s in enumerate(shards):
            before = s.traversed
            _, score = s.search(own, int(best.min()) if len(best) >= K.K else 1, K.K)
            held, through, first = held + int(sum(s.at[own + 1] - s.at[own])), through + s.traversed - before, first + (s.traversed - before if not k else 0)
            best = np.sort(np.concatenate((best, score)))[::-1][: K.K]
        assert best.tolist() == np.sort(every)[::-1][: K.K].astype(np.int64).tolist()
    assert through < 0.6 * held and first < 0.8 * held / len(shards)
