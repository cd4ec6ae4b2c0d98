import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_gbt as Q
from tidewatch.llm import rule_ledger as R
from tidewatch.llm.text_stats import NAMES, measure, repeat_words


def slow(text):
    t = text or ""
    w = t.encode().split()
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    rep = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return {
        "n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(rep), "n_alpha_words": sum(any(c.isascii() and c.isalpha() or not c.isascii() for c in x.decode()) for x in w), "n_lines": len(lines),
    }


def test_measures(odd):
    texts = [r.text for r in odd.collect()] + ["a b c a b c a b\na b\n\na b\n # | x", " ", "1 2 3 é"]
    for t in texts:
        got = dict(zip(NAMES, measure(None if t is None else t.encode()), strict=True))
        assert {k: got[k] for k in slow(t)} == slow(t)


def test_repeat_words_of_many_distinct_words():
    ids = np.array([0, (1 << 20) + 1, 5, 0, (1 << 20) + 1, 5, 7])
    assert repeat_words(ids) == 6


def test_ledger_policies_and_ablations(odd, none):
    rows = R.ledger(odd).cache()
    kept = {v: R.apply_policy(rows, v).where("kept").count() for v in R.POLICIES}
    assert kept["v1"] >= kept["v2"] >= kept["v3"] > 0
    for r in R.ablations(rows).collect():
        bit = R.mask([r.rule])
        bits = [x.fail_bits & R.mask(R.POLICIES["v3"]) for x in rows.collect()]
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits))
    assert R.ledger(none).count() == 0
    empty = rows.where("n_words = 0").select("fail_bits").distinct().collect()
    assert [r.fail_bits for r in empty] == [1]


def test_trees_learn_a_rule_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = Q.fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    row = x[7]
    margin = model.prior
    for k in range(len(model.feature)):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + (row[model.feature[k, node]] > model.threshold[k, node])
        margin += model.value[k, node - (2**model.depth - 1)]
    assert abs(1 / (1 + np.exp(-margin)) - model.probability(x[7:8])[0]) < 1e-12


def test_quality_on_the_driver_table(spark, sf):
    """Held-out accuracy, where there is a larger table on that one: the smallest holds out 19 rows."""
    larger = sf.replace("sf0.001", "sf0.01")
    sf = larger if os.path.isdir(larger) else sf
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op4_quality_gbt(spark, sf)
    assert got.count() == docs.count()
    found = got.join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert found >= 0.95


def test_quality_without_labels_and_with_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 0), (3, 5, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(odd, labels)
    rows = Q.score(odd, model, keep=["doc_id"], name="p").collect()
    assert len(rows) == odd.count() and all(0 <= r.p <= 1 for r in rows)
    nothing = Q.train(odd, labels.where("quality > 9"))
    assert {r.p for r in Q.score(odd, nothing, keep=["doc_id"], name="p").collect()} == {0.5}
    assert Q.keep_good(none, labels).count() == 0 and Q.keep_good(odd, labels).columns == odd.columns


def brute_margins(x, y, trees, depth, bins, rate):
    """Boosting by loops: every feature and edge of every node is tried on the rows themselves. Margins of the training rows."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(m)]
    margin = np.full(n, np.log((y.sum() + 1) / (n - y.sum() + 1)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        nodes = [np.arange(n)]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, left = 1e-9, rows
                gt, ht = g[rows].sum(), h[rows].sum()
                for j in range(m):
                    for e in edges[j]:
                        low = rows[x[rows, j] <= e]
                        gl, hl = g[low].sum(), h[low].sum()
                        if hl < Q.MIN_HESSIAN or ht - hl < Q.MIN_HESSIAN:
                            continue
                        gain = gl**2 / (hl + Q.L2) + (gt - gl) ** 2 / (ht - hl + Q.L2) - gt**2 / (ht + Q.L2)
                        if gain > best + 1e-10:
                            best, left = gain, low
                below += [left, np.setdiff1d(rows, left)]
            nodes = below
        for rows in nodes:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + Q.L2)
    return margin


def test_trees_are_those_of_a_loop_over_all_splits():
    rng = np.random.default_rng(4)
    for n, m, trees, depth, bins in ((60, 4, 6, 3, 12), (90, 3, 4, 2, 8), (40, 2, 5, 4, 48)):
        x = np.round(rng.normal(size=(n, m)), 2)
        y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=n) * 0.3 > 0.5).astype(float)
        model = Q.fit(x, y, trees, depth, bins, 0.3)
        got = model.probability(x)
        assert np.allclose(np.log(got / (1 - got)), brute_margins(x, y, trees, depth, bins, 0.3), atol=1e-9)


def test_query_scores_are_walks_of_the_model(spark, sf):
    """Each score of the query against one walk after the other through the trees that the labels give."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)

    def walk(v):
        total = model.prior
        for k in range(len(model.feature)):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + (1 if v[model.feature[k, at]] <= model.threshold[k, at] else 2)
            total += model.value[k, at - (len(model.feature[k]))]
        return 1 / (1 + math.exp(-total))

    got = {r.doc_id: r for r in Q.op4_quality_gbt(spark, sf).collect()}
    for r in docs.collect():
        want = walk(Q.features(np.array([measure((r.text or "").encode())]))[0])
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_ablations_of_every_policy(spark, sf):
    """The counts of the stored ledger against rules that are evaluated for each document and policy again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in R.measured(docs, keep=[]).collect()]
    fails = []
    for r in rows:
        env = {k: v for k, v in r.items()}
        fails.append({name for _, name, condition in R.RULES if eval(condition.replace(" OR ", " or ").replace(" AND ", " and "), {}, env)})
    want = {
        (p, rule): (sum(rule in f for f in fails), sum(f & set(of) == {rule} for f in fails), sum(not f & set(of) for f in fails), sum(not f & (set(of) - {rule}) for f in fails))
        for p, of in R.POLICIES.items() for rule in of
    }
    assert {(r.policy, r.rule): (r.failed, r.failed_alone, r.kept, r.kept_without) for r in R.rule_ablations(spark, sf).collect()} == want


def test_columns_of_the_names_of_measurements(spark):
    from tidewatch.llm import token_counts as K

    df = spark.createDataFrame([(1, "a b", -1, -1)], "doc_id long, text string, n_words long, n_tokens long")
    made = R.measured(df)
    assert len(set(made.columns)) == len(made.columns) and made.first().n_words == 2
    counted = K.token_counts(df, [b"a\0", b"b\0"])
    assert sorted(counted.columns) == ["doc_id", "n_tokens", "n_unknown", "n_words", "text"] and counted.first().n_tokens == 2
