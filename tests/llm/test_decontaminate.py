import random
import re

from paperloom.llm import decontaminate as C

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
words = lambda t: WORD.findall((t or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(rows, items):
    """Every window of every document against every item, without a candidate search."""
    out = set()
    for d, t in rows:
        w = words(t)
        for i, text in items:
            b = words(text)
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if words(s)]
            answer = words(sentences[-1]) if len(sentences) > 1 else b[-max(1, len(b) // 4) :]
            for k in range(0, max(1, len(w) - C.WINDOW + C.STEP), C.STEP) if w and b else ():
                span = w[max(0, k - len(b)) : k + C.WINDOW + len(b)]
                share = lcs(b, span) / len(b)
                if d is not None and i is not None and (share >= C.VERBATIM or share >= C.PARAPHRASE and sum(x in span for x in answer) / len(answer) >= C.ANSWER):
                    out.add((d, i))
    return out


def sample(seed=1):
    rng, vocabulary = random.Random(seed), [f"v{k}" for k in range(2500)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, f"{text(rng.randint(15, 60))}? {text(6)}.") for k in range(30)]
    rows = []
    for k in range(90):
        body = words(text(rng.randint(5, 250)))
        if k % 3 == 0:
            own = words(items[k // 3][1])
            kind = k // 3 % 3
            if kind:
                own = [rng.choice(vocabulary) if rng.random() < 0.12 * kind else x for x in own]
            at = rng.randint(0, len(body))
            body[at:at] = own
        rows.append((k, " ".join(body)))
    return rows, items


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


CASES = [(900, None), (901, ""), (902, "..."), (None, "null id")]


def test_matches_brute_force_in_several_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ITEMS", 12)
    rows, items = sample()
    rows, items = rows + CASES + rows[:1], items + [(500, None), (501, ""), (None, "text of a null item")]
    want, got = brute(rows, items), [(r["doc_id"], r["item_id"]) for r in C.pairs(docs(rows, clash=True), bench(spark, items)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 20


def test_long_items_and_long_texts(spark, docs):
    rng = random.Random(2)
    item = " ".join(f"q{rng.randrange(4000)}" for _ in range(700))
    part = " ".join(item.split()[300:430])
    filler = " ".join(f"z{rng.randrange(9000)}" for _ in range(40_000))
    rows = [(1, f"{filler} {part} {filler}"), (2, filler)]
    assert {(r["doc_id"], r["item_id"]) for r in C.pairs(docs(rows), bench(spark, [(7, item)])).collect()} == {(1, 7)}


def test_clean_keeps_the_rest(spark, docs):
    rows, items = sample(3)
    rows += CASES + [(None, items[0][1])]
    hit = {d for d, _ in brute(rows, items)}
    out = [(r["doc_id"], r["text"]) for r in C.clean(docs(rows, clash=True), bench(spark, items)).collect()]
    lost = [d for d, t in rows if (d, t) not in out]
    assert None in lost and {d for d in lost if d is not None} == hit and all(r in out for r in CASES)


def test_ids_of_any_type(spark):
    text = "which river crosses seven old stone bridges before the sea"
    d = spark.createDataFrame([("d1", f"so {text} it is"), ("d2", "nothing here")], "doc_id string, text string")
    b = spark.createDataFrame([("q1", text)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in C.pairs(d, b).collect()] == [("d1", "q1")]


def test_empty(spark, docs):
    rows, items = sample(4)
    assert C.pairs(docs([]), bench(spark, items)).collect() == [] and C.pairs(docs(rows), bench(spark, [])).collect() == []
    assert C.clean(docs(rows), bench(spark, [])).count() == len(rows) and C.clean(docs([]), bench(spark, items)).collect() == []


def test_thousands_of_dissimilar_items(spark, docs):
    """Many more items than latent dimensions: every copy is found, whole or with words replaced."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"v{int(20_000 * rng.random() ** 3)}" for _ in range(n))
    items, rows = [(k, text(rng.randint(15, 59))) for k in range(2000)], []
    for k in range(120):
        body, own = words(text(rng.randint(40, 200))), words(items[15 * k][1])
        at = rng.randint(0, len(body))
        body[at:at] = [f"o{rng.randrange(500)}" if rng.random() < 0.1 * (k % 3) else x for x in own]
        rows.append((k, " ".join(body)))
    got = {(r["doc_id"], r["item_id"]) for r in C.pairs(docs(rows), bench(spark, items)).collect()}
    some = [(k, i) for k in range(120) for i in (items[15 * k], items[15 * k + 1])]
    want = {pair for k, i in some for pair in brute([rows[k]], [i])}
    assert {(k, i) for k, (i, _) in some if (k, i) in got} == want and len(want) >= 100


def probe(items, df, n):
    """What the windows of a benchmark are judged by, with given document frequencies over n documents; no Spark."""
    import numpy as np
    import pyarrow as pa

    from paperloom.llm._text import chunks

    hashes = [next(chunks(pa.array([t]))).words()[2] for _, t in items]
    terms, own = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    idf = np.log((n + len(items) + 1) / (df + own + 0.5))
    space = np.linalg.qr(np.random.default_rng(1).standard_normal((len(terms), C.RANK)))[0].astype(np.float32)
    return C._Probe({"terms": terms, "idf": idf, "space": space, "unseen": np.log((n + len(items) + 1) / 1.5), "item": [i for i, _ in items], "words": hashes, "answer": [h[-6:] for h in hashes]})


def found(p, texts):
    import pyarrow as pa

    from paperloom.llm._text import chunks

    return {(c.first + t, p.item[k]): cosine for c in chunks(pa.array(texts)) for (t, k), (_, cosine) in C._matches(p, c).items()}


def test_copies_are_found_at_every_size():
    """Short items within words outside the benchmark, with the counts of a corpus of 10,000 and of 20,000,000 documents."""
    rng = random.Random(6)
    items = [(k, " ".join(f"v{int(600 * rng.random() ** 2)}" for _ in range(15))) for k in range(100)]
    filler = lambda: " ".join(f"o{rng.randrange(300)}" for _ in range(50))
    texts = [f"{filler()} {i} {filler()}" for _, i in items]
    one, many = (found(probe(items, 1500 * scale, 10_000 * scale), texts) for scale in (1, 2000))
    assert {(k, k) for k in range(100)} <= set(one) == set(many) and all(abs(one[p] - many[p]) < 0.01 for p in one)


def test_subsequences_of_many_candidates_at_once(monkeypatch):
    """Passages of 1 to 128 words (1 or 2 limbs), few different words so that carries run far, several groups and batches."""
    import numpy as np

    rng = random.Random(11)
    sizes = [1, 2, 63, 64, 65, 127, 128, *(rng.randint(1, 128) for _ in range(20))]
    items = [(i, " ".join(f"v{rng.randrange(1 + i % 7 * 4)}" for _ in range(n))) for i, n in enumerate(sizes)]
    stream = [f"v{rng.randrange(26)}" if rng.random() < 0.5 else "v0" for _ in range(600)]
    p = probe(items, 10, 1000)
    code = {w: int(p.terms.find(C._words(w))[0]) for w in set(stream)}
    stream = [w for w in stream if code[w] >= 0]
    k = np.array([rng.randrange(len(items)) for _ in range(400)])
    lo = np.array([rng.randrange(len(stream)) for _ in k])
    hi = np.minimum(len(stream), lo + np.array([rng.choice((0, 1, 40, 64, 150)) for _ in k]))
    want = [lcs(items[i][1].split(), stream[a:b]) for i, a, b in zip(k, lo, hi, strict=True)]
    assert p.lcs(k[:0], np.zeros(0, np.int64), lo[:0], hi[:0]).tolist() == [] and found(p, ["no known word", ""]) == {}
    for group, tables, batch in ((64, 8, 1 << 15), (5, 2, 16)):
        for name, value in (("GROUP", group), ("TABLES", tables), ("BATCH", batch)):
            monkeypatch.setattr(C, name, value)
        p.masks.clear()
        assert p.lcs(k, np.array([code[w] for w in stream]), lo, hi).tolist() == want and max(want) > 64
