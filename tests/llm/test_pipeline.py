import re

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_line_dedup import brute as repeats
from test_ngram_join import brute as near
from test_toxicity import BAD, sample

SENTENCE = "the {} clean line number {} of document {} speaks of {} and {} at length"


def make(tmp_path, spark):
    """Documents with known toxic ones, repeated lines, near copies and a benchmark passage."""
    rows = [(i, t, y) for i, t, y in sample(500, 9)]
    texts = {i: t for i, t, _ in rows}
    nxt = 1000
    for k in range(12):
        lines = [SENTENCE.format(f"a{k}", j, f"b{k * 17 + j}", f"c{j * 31 + k}", f"d{j * k + 3}") for j in range(8)]
        for copy in range(3):
            texts[nxt] = "\n".join([*lines, f"own ending {k} {copy}"])
            nxt += 1
    item = "which river crosses seven old stone bridges before it meets the northern sea near the harbour town? the amber river does."
    texts[2000] = "preface words " + item + " closing words of the page"
    texts[2001] = "one single short page about nothing much"
    texts[2002] = " ".join(BAD * 3)
    texts[2003] = None
    texts[2004] = ""
    out = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x") for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, texts, {i for i, _, y in rows if y}, item


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_match_brute_force(spark, tmp_path):
    sf, texts, toxic, item = make(tmp_path, spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    def step(name, df):
        stage[name](spark, df, sf).write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    clean = step("toxicity", docs)
    assert clean.columns == docs.columns
    kept = rows_of(clean)
    gone = set(texts) - {i for i, _ in kept}
    assert 2002 in gone and len(gone - toxic - {2002}) <= 0.01 * len(texts) and len(toxic - gone) <= 0.05 * len(toxic)

    deduped = step("line_dedup", clean)
    cut = repeats(kept)
    want = []
    for i, t in kept:
        left = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in cut)
        if left == t or re.search(r"[^\W_]", left):
            want.append((i, left))
    after = rows_of(deduped)
    assert sorted(map(repr, after)) == sorted(map(repr, want)) and deduped.columns == docs.columns

    single = step("ngram_join", deduped)
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in near(after):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert sorted(map(repr, rows_of(single))) == sorted(repr((i, t)) for i, t in after if root(i) == i)

    safe = step("decontaminate", single)
    bad = {d for d, _ in leaks(rows_of(single), [(1, item)])}
    assert bad == {2000} and sorted(map(repr, rows_of(safe))) == sorted(repr(r) for r in rows_of(single) if r[0] not in bad)

    packed = stage["packing"](spark, safe, sf).collect()
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["tokens"]
    assert tokens == {i: len(t.split()) for i, t in rows_of(safe) if t and t.split()}
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, packed))
