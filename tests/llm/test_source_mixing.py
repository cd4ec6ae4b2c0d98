from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import source_mixing as M


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        new = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not new:
            return {**{s: 3 * sizes[s] for s in stopped}, **share}
        stopped |= new


def test_targets_and_taken(odd):
    rows = M.mix_plan(odd).collect()
    assert len(rows) == odd.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], rel=1e-9, abs=1e-6), s
        assert abs(taken[s] - target[s]) <= max(3 * M.BLOCK_TOKENS, 0.01 * target[s]), s
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_and_partitions_agree(odd):
    key = ["doc_id", "source", "size", "taken"]
    a = sorted(map(str, M.mix_plan(odd).select(*key).collect()))
    assert a == sorted(map(str, M.mix_plan(odd.repartition(5)).select(*key).collect()))


def test_many_shards_keep_the_target(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise("cold").alias("source"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"))
    plan = M.mix_plan(docs, shard_tokens=5000).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.count_distinct("shard").alias("n")).collect()
    for r in plan:
        assert r.n > 5 and abs(r.k - r.t) < 0.005 * r.t


def test_quotas_are_those_of_highest_quotients(spark):
    ideal = {0: 3.7, 1: 0.2, 2: 11.1, 3: 5.0, 4: 0.0}
    most = {0: 9, 1: 5, 2: 8, 3: 9, 4: 9}
    df = spark.createDataFrame([(k, v, most[k]) for k, v in ideal.items()], "rank int, i double, m int")
    got = {r["rank"]: r.quota for r in M.apportion(df, ["rank"], [], F.col("i"), F.lit(20), F.col("m")).collect()}
    bids = sorted(((-v / (2 * j - 1), k, j) for k, v in ideal.items() if v > 0 for j in range(1, most[k] + 1)))[:20]
    assert got == {k: sum(b[1] == k for b in bids) for k in ideal}


def test_texts_are_what_the_plan_takes(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(5 + 7 * i)), f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    plan = M.mix_plan(docs).cache()
    pieces = M.mix_texts(docs, plan).collect()
    words = defaultdict(int)
    text = {r.doc_id: r.text.split() for r in docs.collect()}
    for p in pieces:
        assert p.text.split() == text[p.doc_id][p.first_word : p.first_word + p.n_words]
        words[p.doc_id] += p.copies * p.n_words
    assert words == {r.doc_id: r.taken for r in plan.collect() if r.taken}


def test_given_weights_and_nothing(spark, odd, none):
    weights = spark.createDataFrame([("hot", 1)], "source string, weight int")
    assert {r.source for r in M.mix_plan(odd, weights).where("taken > 0").collect()} == {"hot"}
    assert M.mix_plan(none).count() == 0 and M.mixed(none).count() == 0
