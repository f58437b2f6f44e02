import random

from paperloom.llm import line_dedup as D


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """(doc_id, line_no) of each repeat -> the earliest line like it, and the distance; doc_ids are unique, but for equal rows."""
    lines = sorted({(i, k, s) for i, t in rows if i is not None and t is not None for k, s in enumerate(x.strip("\t\n\x0b\x0c\r ").encode() for x in t.split("\n")) if s})
    firsts, near, out = {}, {}, {}
    for i, k, s in lines:
        firsts.setdefault(s, (i, k))
    for s in firsts:
        others = [o for o in firsts if min(len(o), len(s)) >= D.MIN_NEAR and abs(len(o) - len(s)) <= D.TAU and firsts[o] <= firsts[s]]
        near[s] = min([(firsts[s], 0), *((firsts[o], d) for o in others if (d := distance(o, s)) <= D.TAU)])
    for i, k, s in lines:
        if near[s][0] != (i, k):
            out[i, k] = near[s]
    return out


def sample(seed=1, n=60):
    rng, rows = random.Random(seed), []
    pool = ["".join(rng.choice("abcdef éß") for _ in range(rng.randint(15, 45))) for _ in range(25)]
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice(([], [rng.choice("xyz")], [s[k], "q"]))
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    return rows


CASES = [(500, None), (501, ""), (502, "\n\n"), (503, "  a line that is repeated here \nshort\na line that is repeated here"), (504, "short\nshort"), (None, "a line that is repeated here"), (505, "z" * 60_000), (506, "z" * 60_001), (507, "A line that is repeated here"), (508, "x" * 19 + "\n" + "x" * 20 + "\n" + "x" * 20)]


def test_matches_brute_force(docs):
    rows = sample() + CASES[:6] + CASES[8:]
    got = {(r["doc_id"], r["line_no"]): ((r["kept_doc_id"], r["kept_line_no"]), r["distance"]) for r in D.repeats(docs(rows, clash=True)).collect()}
    assert got == brute(rows) and len(got) > 30 and any(d for _, d in got.values())


def test_long_lines(docs):
    got = [tuple(r) for r in D.repeats(docs(CASES[6:8])).collect()]
    assert got == [(506, 0, 505, 0, 1)]


def test_matches_sql(docs, same):
    d = docs([(i, t if t is None else t.encode("ascii", "ignore").decode()) for i, t in sample(2, 40)] + [(600, "the same line as below it\nthe same line as below it")])
    same(D.repeats(d), D.SQL, documents=d)


def test_clean(docs):
    rows = sample(3) + CASES[:6] + CASES[8:] + [(503, CASES[3][1])]
    gone, want = brute(rows), []
    for i, t in rows:
        if t is None or i is None or not any(k[0] == i for k in gone):
            want.append((i, t))
            continue
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if any(c.isalnum() for c in left):
            want.append((i, left))
    out = D.clean(docs(rows, clash=True))
    assert sorted(repr((r["doc_id"], r["text"])) for r in out.collect()) == sorted(map(repr, want))
    assert out.filter("n_chars <> length(text)").count() == 0


def test_rows_of_one_document_keep_their_own_lines(docs):
    rows = [(0, "this line is repeated here\nfirst"), (1, "a unique line of its own\nfirst"), (1, "this line is repeated here"), (1, "this line is repeated hers\nanother one"), (None, "this line is repeated here")]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in D.clean(docs(rows)).collect())
    assert got == sorted([(False, 0, rows[0][1]), (False, 1, "a unique line of its own"), (False, 1, "another one"), (True, None, rows[4][1])], key=repr)


def test_short_lines_are_compared_for_equality(docs, same):
    rows = [(1, "ab\nabc\n\n\nab"), (2, "abc\nabd\n" + "x" * 19), (3, "x" * 18 + "y\n" + "x" * 20 + "\n" + "x" * 19)]
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in D.repeats(docs(rows)).collect()}
    assert got == {(1, 4): (1, 0), (2, 0): (1, 1), (3, 2): (2, 2)}
    same(D.repeats(docs(rows)), D.SQL, documents=docs(rows))


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("d1", "this line is repeated here"), ("d2", "this line is repeated here\nnot this")], "doc_id string, text string")
    assert sorted(map(tuple, D.clean(d).collect())) == [("d1", "this line is repeated here"), ("d2", "not this")]


def test_empty(docs):
    assert D.repeats(docs([])).collect() == [] and D.clean(docs([])).collect() == []
