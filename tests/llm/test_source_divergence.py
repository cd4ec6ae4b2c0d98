"""Divergences against dictionaries and Python integers."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidewatch.llm import source_divergence as s

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=10, ranks=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [x for y, x in groups if y == lang]
        total = {x: sum(count[lang, x][t] for t in kept) for x in sources}
        share = lambda n, total_: 1 + 1_000_000_000 * (n + 2) // (total_ + 2 * len(kept))  # noqa: E731, B023
        p = {x: {t: share(count[lang, x][t], total[x]) for t in kept} for x in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = {t: share(sum(count[lang, x][t] for x in sources), sum(total.values())) for t in kept}
        for x in sources:
            pairs = [(-sum(f(p[x][t], p[y][t]) for t in kept), y) for y in sources if y != x]
            terms = [(-f(p[x][t], q[t]), t) for t in kept if count[lang, x][t] and p[x][t] > q[t]]
            order = lambda v: (v[0], v[1].encode())
            out += [(lang, x, "pair", y, -v, i + 1) for i, (v, y) in enumerate(sorted(pairs, key=order))]
            out += [(lang, x, "term", t, -v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=order)[:ranks])]
    return sorted(out)


def check(docs, **how):
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = sorted(tuple(r) for r in s.divergences(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(rows, how.get("least", 10), how.get("ranks", 10))
    return got


@pytest.mark.parametrize("block", [1, 40, 500_000])
def test_odd_rows(odd, block):
    assert check(odd, least=2, block_rows=block)


def test_defaults_without_kept_terms_and_empty(odd, none):
    check(odd, least=10_000)
    assert check(none) == []


def test_terms_and_bounds(spark):
    texts = ["Don't stop-ME é9É", "a\x00b\x1fc", "ab", "", None, "日本 語ß", "x" * 100_000 + " x", "A" * 3 + "[a]{a}@`"]
    rows = [(f"l{i % 2}", f"s{i % 3}" if i % 5 else None, t) for i in range(40) for t in texts]
    rows += [("one", "only", "alone alone")] * 12 + [(None, "", "x"), ("", None, "x")]
    check(spark.createDataFrame(rows, "lang string, source string, text string"), least=3)


def test_a_colliding_hash_splits(monkeypatch, odd):
    """With a hash that tells few terms apart, exact bytes do."""
    monkeypatch.setattr(s, "xxh64_intdigest", lambda b: len(b) % 3)
    low, starts, ends = s.slices(np.frombuffer(b"abc ab xyz abc q abd", np.uint8), np.array([0, 20]))
    number, terms = s.grouped(low, starts, ends)
    assert [terms[i] for i in number.tolist()] == [b"abc", b"ab", b"xyz", b"abc", b"q", b"abd"]


def test_shares_are_exact_beyond_64_bits():
    for n, total, kept in ((10**13, 3 * 10**13, 10**6), (5, 10**16, 10**9), (0, 0, 1), (10**16, 10**16, 1)):
        assert int(s.share(np.array([n]), np.array([total]), kept)[0]) == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in s.op13_source_divergence(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == sorted(con.execute(s.ORACLE).fetchall())
