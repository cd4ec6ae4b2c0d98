import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import katz


def tokens(text):
    return [*(text or "").encode().lower().split(), 0]


def brute(train, texts, order):
    """Scores by dictionaries: counts, discounts, back-off weights, recursion."""
    grams = [None] + [Counter() for _ in range(order)]
    for t in train:
        w = [1] * (order - 1) + tokens(t)
        for k in range(1, order + 1):
            for i in range(order - 1, len(w)):
                grams[k][tuple(w[i - k + 1 : i + 1])] += 1
    n = sum(grams[1].values())
    factor = [None] + [katz.good_turing([sum(c == r for c in grams[k].values()) for r in range(1, katz.K + 2)]) for k in range(1, order + 1)]
    disc = lambda k, c: c * (factor[k][c - 1] if c <= katz.K else 1)
    kept = sum(disc(1, c) for c in grams[1].values())
    total = n + (kept >= n)
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g in grams[k]:
            after[g[:-1]].append(g[-1])

    def p(history, w):
        if not history:
            c = grams[1][(w,)]
            return disc(1, c) / total if c else (1 - kept / total if n else 1.0)
        k = len(history) + 1
        follow = after.get(history)
        if not follow:
            return p(history[1:], w)
        size = sum(grams[k][(*history, x)] for x in follow)
        held = sum(disc(k, grams[k][(*history, x)]) for x in follow)
        size += size - held <= 1e-9 * size
        c = grams[k][(*history, w)]
        if c:
            return disc(k, c) / size
        return (1 - held / size) / (1 - sum(p(history[1:], x) for x in follow)) * p(history[1:], w)

    out = []
    for t in texts:
        w = [1] * (order - 1) + tokens(t)
        out.append(sum(math.log10(p(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w))))
    return out, p, grams, after


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_definition(odd, order):
    rows = odd.where("doc_id IS NULL OR doc_id <> 40")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = katz.scores(rows, ~held, order=order, block_tokens=300, bucket_grams=100).collect()
    train = [t for d, t in docs if d is None or d % 5]
    want, *_ = brute(train, [t for _, t in docs], order)
    key = lambda d, s: (str(d), round(s, 6))
    assert sorted(key(r.key, r.score) for r in got) == sorted(key(d, s) for (d, _), s in zip(docs, want, strict=True))
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = sorted(key(d, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in docs)
    assert sorted(key(r.key, r.base_score) for r in got) == base
    assert all(r.train_tokens == n for r in got)


def test_probabilities_add_up_to_one():
    train = ["a b a b c", "a a b d", "c a b e f", "b a", "g", "a b c a"]
    _, p, grams, after = brute(train, [], 3)
    known = [g[0] for g in grams[1]]
    for history in [*after, (b"zz",), (b"zz", b"a")]:
        assert sum(p(history, w) for w in known) + p(history, "unknown") == pytest.approx(1)


def test_nothing_to_learn_and_nothing_to_score(odd, none):
    assert katz.scores(none, F.lit(True)).count() == 0
    rows = katz.scores(odd, F.lit(False)).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in rows)


def test_packing_round_trip():
    import numpy as np

    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (katz.unpack_sorted(katz.pack_sorted(x)) == x).all()
    y = np.random.default_rng(2).normal(size=50)
    assert (katz.unpack(katz.pack(y), np.float64) == y).all()


def test_discounts():
    assert katz.good_turing([100, 40, 20, 12, 8, 6])[0] < 1
    assert katz.good_turing([0] * 6) == [1 - 0.5 / r for r in range(1, 6)]


def test_messages_grow_with_the_text():
    """Blocks times buckets, as the sizes make them: in proportion to the text from BASE_BYTES on."""
    n = lambda size: (size / 6 / katz.sizes(size)[0]) * (size / 6 / katz.sizes(size)[1])
    assert katz.sizes(10**9) == (katz.BLOCK_TOKENS, katz.BUCKET_GRAMS)
    for factor in (4, 100, 1000):
        assert n(factor * katz.BASE_BYTES) / n(katz.BASE_BYTES) == pytest.approx(factor, rel=0.01)
        assert 0.7 * factor * katz.BASE_BYTES / 6 / n(factor * katz.BASE_BYTES) > 50
