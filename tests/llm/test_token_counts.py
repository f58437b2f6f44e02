import pytest

from paperloom.llm import token_counts as T

TEXTS = [
    "Hello world, it's we'll they've I'm he'd 'tis don't 're'", "  leading and   inner  spaces \n\n and\tlines \r\n", "'", "''s", "a'", " 's", "x's's'll", "déjà vu — naïve ½ ²³ 漢字かな🎉🎉 　 x", "12345 67,890.12 $%^&*()", "<|endoftext|> plain", "\n", "   ", "end   ",
    "tab\t\ttab \t mixed", "Ünïcödé'sÜ'll", "", None, "word " * 30_000,
]


@pytest.mark.parametrize("limit", [T.DICTIONARY_BYTES, 0])
def test_equals_the_tokenizer(docs, limit):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, "no id")]
    got = T.count(docs(rows, clash=True), limit=limit).collect()
    encode = T._encoder(T.VOCABULARY).encode_ordinary
    want = sorted((repr(i), -1 if t is None else len(encode(t))) for i, t in rows)
    assert sorted((repr(r["doc_id"]), -1 if r["n_tokens"] is None else r["n_tokens"]) for r in got) == want


def test_empty_table(docs):
    assert T.count(docs([])).collect() == []
    assert T.count(docs([]), limit=0).collect() == []


def test_dictionary_counts_each_pretoken_once(docs):
    words = T.dictionary(docs([(1, "one two one two"), (2, " one two")])).collect()
    assert len(words) == len({r["h"] for r in words}) == 3  # one, ' one', ' two'
