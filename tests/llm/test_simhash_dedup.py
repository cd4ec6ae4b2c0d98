import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import simhash_dedup as S
from tidewatch.operators import components as C


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4)[0]:
            x, y = find(f), find(fps[i + 1 + j])
            parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(odd):
    docs = odd.select("doc_id", "text").collect()
    got = S.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    fp = {r.text: slow_fingerprint(r.text) for r in docs}
    root = roots(fp.values())
    low = {}
    for r in docs:
        k = root[fp[r.text]]
        low[k] = min((x for x in (low.get(k), r.doc_id) if x is not None), default=None)
    want = sorted(str((r.doc_id, fp[r.text], low[root[fp[r.text]]])) for r in docs)
    assert sorted(str((r.doc_id, r.fingerprint % 2**64, r.component_id)) for r in got) == want


def test_dense_clusters_lose_no_link(spark):
    """Fingerprints around a few centres, at all distances, against all pairs."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 9)):
                f ^= 1 << b
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.fp % 2**64: r.root % 2**64 for r in S.fingerprint_components(df).collect()}
    want = roots(fps)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(got) == groups(want)


def test_one_of_each_group_stays(odd, none):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    found = {r.doc_id: r.component_id for r in S.near_duplicates(odd).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(found.values()))
    assert S.keep_one(none).count() == 0 and S.near_duplicates(none).count() == 0


def test_smaller_radius(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (1 << 40,)], "fp long")
    assert S.fingerprint_components(df, radius=0).agg(F.count_distinct("root")).first()[0] == 4
    assert S.fingerprint_components(df, radius=1).agg(F.count_distinct("root")).first()[0] == 1


def test_one_row_of_each_group_stays_where_keys_repeat(spark, words):
    rng = random.Random(4)
    a, b, c, d = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, c), (None, d), (7, d), (None, None), (None, ""), (3, a)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((str(r.doc_id), r.text or "") for r in kept)
    assert found == sorted([("3", a), ("5", b), ("None", c), ("7", d), ("None", "")])


def test_no_side_that_grows_is_broadcast(spark, words, monkeypatch):
    """Spark takes a table of fingerprints for small by its files, and the 35 keys of each for no more than that."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(words) for _ in range(30))
    texts = [text() for _ in range(40)]
    df = spark.createDataFrame([(i, t + (" end" if i % 2 else "")) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    plans, write = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda made, name, **more: plans.setdefault(name, made._jdf.queryExecution().executedPlan().toString()) and write(made, name, **more))
    plans["result"] = S.near_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    S.keep_one(df)
    for name in ("met", "apart", "labels"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], name
    assert "SortMergeJoin" in plans["roots"] and "SortMergeJoin" in plans["result"]


def test_components_of_many_edges_broadcast_nothing(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 7], "src long, dst long")
    want = {r.vertex: r.component for r in C.connected_components(edges).collect()}
    plans, write = [], C.stored
    monkeypatch.setattr(C, "MANY_EDGES", 10)
    monkeypatch.setattr(C, "stored", lambda made, name: plans.append(made._jdf.queryExecution().executedPlan().toString()) or write(made, name))
    found = C.connected_components(edges)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastHashJoin" in p] and "SortMergeJoin" in plans[-1]
    assert {r.vertex: r.component for r in found.collect()} == want
