import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm._text import chunks, ngrams, sets

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1é .\n", max_size=30)), max_size=12), st.integers(1, 4), st.integers(1, 64))
def test_words_and_ngrams(texts, n, most):
    seen = 0
    for c in chunks(pa.array(texts, pa.string()), most=most):
        s, e, h, bounds = c.words()
        got = [c.data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
        g, at = ngrams(h, bounds, n)
        own, ends = sets(g, at, c.n)
        for k in range(c.n):
            want = WORD.findall((texts[c.first + k] or "").lower())
            assert got[bounds[k] : bounds[k + 1]] == want
            distinct = {tuple(want[i : i + n]) for i in range(max(1, len(want) - n + 1))} if want else set()
            assert ends[k + 1] - ends[k] == len(distinct)
        seen += c.n
        assert isinstance(own, np.ndarray)
    assert seen == len(texts)
