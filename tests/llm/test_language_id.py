import random

from paperloom.llm import language_id as L

WORDS = {"en": "the quick brown house with other things that were thought about".split(), "de": "der schnelle braune fuchs über die straße ging nicht ohne grüße".split(), "fr": "le garçon était très content où les élèves avaient déjà mangé".split()}


def texts(n, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 30))), lang) for k, lang in enumerate(rng.choices(list(WORDS), k=n))]


def test_held_out_accuracy(docs):
    model = L.fit(docs(texts(300, 1), extra="lang string"))
    held = texts(200, 2)
    want = {i: lang for i, _, lang in held}
    got = L.identify(docs(held, extra="lang string"), model).collect()
    assert sum(r["predicted"] == want[r["doc_id"]] for r in got) >= 0.98 * len(got) and all(r["margin"] >= 0 for r in got)


def test_matches_sql(docs, same):
    rows = texts(60, 3) + [(100, None, "en"), (101, "", "de"), (102, "x", None), (102, "x", None), (None, "le garçon", "fr"), (103, "ab", None), (104, "🎉é", "fr"), (105, "the fox " * 4000, "en")]
    d = docs(rows, extra="lang string", clash=True)
    same(L.identify(d, L.fit(d)), L.SQL, documents=d)


def test_cases(docs):
    assert L.fit(docs([(1, "a", None)], extra="lang string")) is None
    assert L.identify(docs([(1, "a", None)], extra="lang string"), None).first()["predicted"] is None
    one = docs([(1, "abc", "en"), (2, None, "en")], extra="lang string")
    got = {r["doc_id"]: r for r in L.identify(one, L.fit(one)).collect()}
    assert got[1]["predicted"] == "en" and got[1]["margin"] is None and got[2]["predicted"] is None
    assert L.identify(docs([], extra="lang string"), L.fit(one)).collect() == []
