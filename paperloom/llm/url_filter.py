"""URL filters: all wildcard rules at once, by a bit-parallel automaton.

The states of all rules lie side by side in the bits of a few machine words. Reading a character shifts every word left (bits
carry from word to word) and masks it with the states that the character may enter; states before a `*` also keep themselves.
A batch of URLs advances together, a column of characters at a time, so one numpy operation moves every rule for every URL.

A rule is (id, action, glob): `*` stands for any run of characters, `?` for one character (a code point), everything else for
itself; the glob must match the whole canonical URL. A URL is blocked if it matches a `deny` rule and no `allow` rule.
Canonical form: surrounding white space dropped; scheme and host in lower case; fragment, default port, `www.`, the parameters
`utm_*` and `ref`, and slashes at the end dropped.

Cases. A null URL has a null canonical form and matches nothing: it isn't blocked. An empty URL is matched as it is. Repeated
rows come out each time. Without rules nothing is blocked. Null page_ids pass through. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Shared, table
from ._text import U

RULES = [
    (1, "deny", "*://spam-farm.example.org/*"),
    (2, "deny", "*://*.spam-farm.example.org/*"),
    (3, "deny", "*://*cheap-pills*"),
    (4, "deny", "*casino*"),
    (5, "deny", "*://blog.*.example.net/*"),
    (6, "deny", "*.html"),
    (7, "deny", "http://*/de/*"),
    (8, "deny", "*?page=?&*"),
    (9, "deny", "*?page=*"),
    (10, "deny", "*/??/1*0*"),
    (11, "deny", "*://m.*"),
    (12, "allow", "*://*.example.com/en/*"),
    (13, "allow", "https://th*.example.org/*"),
    (14, "deny", "ftp://*"),
]
#: (pattern, replacement, whether everywhere), in this order; Java and RE2 read them alike.
_STEPS = [
    (r"^[\t-\r ]+|[\t-\r ]+$", "", True),
    (r"#.*$", "", False),
    (r"^(https?://)www\.", r"\1", False),
    (r"^(http://[^/?]*):80(/|\?|$)", r"\1\2", False),
    (r"^(https://[^/?]*):443(/|\?|$)", r"\1\2", False),
    (r"([?&])(utm_[a-z_]*|ref)=[^&]*", r"\1", True),
    (r"([?&])&+", r"\1", True),
    (r"[?&]+$", "", False),
    (r"/+$", "", False),
]


def canonical(url: Column) -> Column:
    head = F.regexp_extract(url, r"^[\t-\r ]*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 0)
    out = F.concat(F.lower(head), F.substring(url, F.length(head) + 1, F.length(url)))
    for pattern, new, _ in _STEPS:
        out = F.regexp_replace(out, pattern, new.replace("\\1", "$1").replace("\\2", "$2"))
    return out


class Automaton:
    def __init__(self, globs: list[str]):
        tokens = [[t for t in g if t != "*"] for g in globs]
        starts = np.cumsum([0] + [len(t) + 1 for t in tokens])
        bits = int(starts[-1])
        self.words = max(1, -(-bits // 64))
        self.alphabet = np.array(sorted({ord(t) for ts in tokens for t in ts if t != "?"}), np.uint32)
        enter = np.zeros((len(self.alphabet) + 1, self.words * 64), bool)
        stay, first, self.last = np.zeros(self.words * 64, bool), np.zeros(self.words * 64, bool), np.zeros(len(globs), np.int64)
        for k_, (g, ts, s) in enumerate(zip(globs, tokens, starts[:-1], strict=True)):
            first[s] = True
            for k, t in enumerate(ts):
                if t == "?":
                    enter[:, s + k + 1] = True
                else:
                    enter[np.searchsorted(self.alphabet, ord(t)), s + k + 1] = True
            done = 0
            for t in g:
                if t == "*":
                    stay[s + done] = True
                else:
                    done += 1
            self.last[k_] = s + len(ts)
        pack = lambda a: np.packbits(a.reshape(-1, 64)[:, ::-1], axis=1).view(">u8").astype(U).reshape(*a.shape[:-1], self.words)
        self.enter, self.stay, self.first = pack(enter), pack(stay), pack(first)

    def match(self, texts: list[str]) -> np.ndarray:
        """texts x globs: whether it matches."""
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, cp)
        if len(self.alphabet):
            at = np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == cp, at, len(self.alphabet))
        begin = (np.cumsum(lens) - lens)[order]
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        active, sorted_lens = len(texts), lens[order]
        for i in range(int(lens.max(initial=0))):
            active = int(np.searchsorted(-sorted_lens[:active], -i, "left"))
            d = state[:active]
            up = d << U(1)
            up[:, 1:] |= d[:, :-1] >> U(63)
            state[:active] = (up & self.enter[at[begin[:active] + i]]) | (d & self.stay)
        out = np.empty((len(texts), len(self.last)), bool)
        out[order] = (state[:, self.last // 64] >> (self.last % 64).astype(U)) & U(1) == 1
        return out


def apply(pages: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """page_id, canonical_url, rules (the ids that match, ascending, with commas) and blocked."""
    rules = sorted(rules)
    shared = Shared(pages.sparkSession, [g for _, _, g in rules], Automaton)
    ids, deny = np.array([str(i) for i, _, _ in rules], object), np.array([a == "deny" for _, a, _ in rules], bool)

    @F.arrow_udf("struct<rules: string, blocked: boolean>")
    def check(urls: pa.Array) -> pa.Array:
        if not len(rules):
            return pa.StructArray.from_arrays([pa.array([""] * len(urls)), pa.array([False] * len(urls))], ["rules", "blocked"])
        texts = urls.to_pylist()
        hit = shared.get().match([t or "" for t in texts])
        hit[[t is None for t in texts]] = False
        kinds, back = np.unique(np.packbits(hit, axis=1), axis=0, return_inverse=True)
        named = [",".join(ids[np.unpackbits(k, count=len(ids)).astype(bool)]) for k in kinds]
        blocked = hit[:, deny].any(axis=1) & ~hit[:, ~deny].any(axis=1)
        return pa.StructArray.from_arrays([pa.array([named[k] for k in back.ravel()], pa.string()), pa.array(blocked)], ["rules", "blocked"])

    rows = pages.select("page_id", canonical(F.col("url")).alias("canonical_url"))
    return rows.withColumn("r", check("canonical_url")).select("page_id", "canonical_url", "r.rules", "r.blocked")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    url = "(lower(head) || substr(url, length(head) + 1))"
    for pattern, new, everywhere in _STEPS:
        url = f"regexp_replace({url}, '{pattern}', '{new}'" + (", 'g')" if everywhere else ")")
    hits = ", ".join(f"CASE WHEN coalesce(u, '') GLOB '{g}' AND u IS NOT NULL THEN {i} END" for i, _, g in RULES)
    some = lambda action: " OR ".join(f"list_contains(hits, {i})" for i, a, _ in RULES if a == action)
    return f"""
WITH heads AS (SELECT page_id, url, regexp_extract(url, '^[\\t-\\r ]*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 0) AS head FROM pages),
urls AS (SELECT page_id, {url} AS u FROM heads),
found AS (SELECT page_id, u, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM urls)
SELECT page_id, u AS canonical_url, array_to_string(hits, ',') AS rules, ({some("deny")}) AND NOT ({some("allow")}) AS blocked FROM found
"""


SQL = _sql()
