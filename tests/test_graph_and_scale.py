"""Incremental clusters, campaigns, quantiles, similarity, splits and suffix rules against plain Python."""

import itertools
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import components
from tidewatch.operators import graph as G
from tidewatch.operators import incremental as I
from tidewatch.operators import relational as R
from tidewatch.operators import similarity as Sim
from tidewatch.operators import splits, suffixes
from tidewatch.plans import registry
from tidewatch.plans.tables import CHAT
from tidewatch.streaming import streams

REPORT = "id long, sender string, domains array<string>, tokens array<string>, created_at timestamp"
WORDS = ["zu", "ein", "para", "con", "avec", "dans", "other"]


def reports(rng, n, start=0):
    at = datetime(2024, 1, 1)
    some = lambda: [w for w in WORDS if rng.random() < 0.2]
    return [
        (start + i, rng.choice([None, None, "", f"n{rng.randint(0, 12)}"]), [f"h{rng.randint(0, 2)}.d{rng.randint(0, 25)}.com" for _ in range(rng.choice([0, 0, 1, 2]))], some(), at + timedelta(hours=rng.randint(0, 400)))
        for i in range(n)
    ]


def roots(rows):
    """Union-find over domains, senders and pairs of strong tokens."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, sender, domains, tokens, _ in rows:
        strong = sorted({t for t in tokens if t in CHAT.strong_tokens})
        for k in [("d", ".".join(d.split(".")[-2:])) for d in domains] + ([("s", sender)] if sender else []) + [("p", *p) for p in itertools.combinations(strong, 2)]:
            by[k].append(i)
    for ids in by.values():
        for i in ids[1:]:
            a, b = find(ids[0]), find(i)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.fixture(scope="module")
def some():
    return reports(random.Random(5), 70)


def prepared(spark, rows):
    return G.prepared(spark.createDataFrame(rows, REPORT), CHAT)


def test_batches_give_the_clusters_of_all(spark, some, tmp_path):
    state = str(tmp_path / "state")
    rng = random.Random(9)
    rows = some[:]
    rng.shuffle(rows)  # so that later batches hold smaller ids than earlier ones
    cuts = [0, 20, 21, 45, 45, 70]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        I.add(state, prepared(spark, rows[a:b]), n)
        assert {r.id: r.root for r in I.labels(spark, state).collect()} == roots(rows[:b])
        if n == 1:
            I.compact(state, spark, 1)
            assert {r.id: r.root for r in I.labels(spark, state).collect()} == roots(rows[:b])
    I.add(state, prepared(spark, rows[45:70]), 4)  # a batch that is run again
    assert {r.id: r.root for r in I.labels(spark, state).collect()} == roots(rows)
    once = prepared(spark, rows)
    key = lambda df: sorted((r.id, r.root, r.cluster) for r in df.collect())
    assert key(I.clusters(spark, state)) == key(G.clusters(once))


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """A small batch that joins two large clusters adds its own rows and two merges; no member is written again."""
    state = str(tmp_path / "state")
    many = [(i, "a" if i % 2 else "b", [], [], datetime(2024, 1, 1)) for i in range(400)]
    I.add(state, prepared(spark, many), 0)
    I.add(state, prepared(spark, [(1000, "a", ["x.com"], [], datetime(2024, 1, 1)), (1001, "b", ["x.com"], [], datetime(2024, 1, 1))]), 1)
    assert {t: spark.read.parquet(f"{state}/{t}/batch=1").count() for t in I.TABLES} == {"members": 2, "keys": 1, "merges": 1}
    assert {r.root for r in I.labels(spark, state).collect()} == {0}


def test_stream_follows_reports(spark, some, tmp_path):
    schema = REPORT
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in (some[:30], some[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        streams.follow(spark.readStream.schema(schema).parquet(path), state, str(tmp_path / "ck"), CHAT).awaitTermination()
    assert {r.id: r.root for r in I.labels(spark, state).collect()} == roots(some)


def test_campaigns_count_reports(spark, some):
    """Every count against a loop over the reports of the matched cluster."""
    known = prepared(spark, some).cache()
    members = G.clusters(known)
    inputs = spark.createDataFrame(reports(random.Random(8), 40, 500), REPORT)
    got = {r.id: r for r in G.campaigns(inputs, known, members, "2024-01-10 00:00:00", CHAT).collect()}
    cluster = {r.id: r.cluster for r in members.collect()}
    matched = {r.id: r for r in G.match(inputs, known, members, CHAT).collect()}
    assert got.keys() == matched.keys() and {r.match_type for r in matched.values()} == {"domain", "sender", "strong_phrase"}
    reg = lambda ds: {".".join(d.split(".")[-2:]) for d in ds}
    strong = lambda ts: {t for t in ts if t in CHAT.strong_tokens}
    now = datetime(2024, 1, 10)
    for i, sender, domains, tokens, _ in [tuple(r) for r in inputs.collect()]:
        if i not in got:
            continue
        mine = [r for r in some if cluster[r[0]] == got[i].cluster]
        alike = sum(len(strong(r[3]) & strong(tokens)) >= 2 for r in mine)
        day = sum(r[4] >= now - timedelta(hours=24) for r in mine)
        want = (len(mine), sum(bool(reg(r[2]) & reg(domains)) for r in mine), sum(sender is not None and r[1] == sender for r in mine), alike, min(r[4] for r in mine), max(r[4] for r in mine), day)
        assert tuple(got[i])[3:10] == want
        assert got[i].status == ("rapidly_spreading" if day >= 5 else "active" if day else "historical")
        if matched[i].match_type == "strong_phrase":
            assert matched[i].similar == alike >= 2


def test_cluster_values_are_rows(spark, some):
    known = prepared(spark, some)
    members = G.clusters(known)
    got = Counter((r.cluster, r.kind) for r in G.cluster_values(known, members).collect())
    sizes = Counter(r.cluster for r in members.collect())
    assert all(got[c, "reports"] == n for c, n in sizes.items())
    only = members.where("cluster = 0").select("cluster")
    one = G.cluster_sets(known, members, only).collect()
    assert [r.cluster for r in one] == [0] and one[0].reports == sizes[0] and len(one[0].senders) == got[0, "senders"]


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 3}", None if i % 11 == 0 else rng.choice([1.0, 2.0, 2.5, rng.random() * 9])) for i in range(500)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(x) for x in at])).alias("q")).collect() if r.q is not None}
    got = {r.g: list(r)[1:] for r in R.quantiles(df, ["g"], "v", at).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    assert R.quantiles(df.where("g = 'none'"), ["g"], "v", at).count() == 0


def test_no_task_holds_a_large_group(spark):
    """Half of a million values are one group's; the stored ranges share it out."""
    df = spark.range(200_000).selectExpr("if(id % 2 = 0, 'hot', concat('g', id % 50)) g", "double(id * 7919 % 100003) v")
    got = {r.g: r.q0 for r in R.quantiles(df, ["g"], "v", (0.5,)).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("q")).collect()}
    assert got == want


@pytest.mark.parametrize("few", [0, 60, 500_000])
def test_similar_pairs_by_postings_and_by_prefix(spark, few):
    rng = random.Random(few)
    make = lambda n, k: [(i, rng.sample("abcdefghijklmnopqr", rng.randint(0, k))) for i in range(n)]
    a, b = make(50, 12), make(12, 5)
    left, right = (spark.createDataFrame(x, "id long, tokens array<string>") for x in (a, b))
    for x, y, xs, ys in ((left, right, a, b), (right, left, b, a)):
        for t in (0.1, 0.3, 0.5, 2 / 3, 1.0):
            want = {(i, j): len({*p} & {*q}) / len({*p} | {*q}) for i, p in xs for j, q in ys if len(p) >= 3 and len(q) >= 3 and len({*p} & {*q}) / len({*p} | {*q}) >= t}
            assert {(r.left_id, r.right_id): r.similarity for r in Sim.similar_pairs(x, y, t, few=few).collect()} == want
    with pytest.raises(ValueError):
        Sim.similar_pairs(left, right, 0)


def greedy(sizes, shares):
    total = sum(size * n for size, n in sizes)
    lacking, out = [Fraction(round(x * splits.UNIT), splits.UNIT) * total for _, x in shares], []
    for size, n in sizes:
        for _ in range(n):
            k = max(range(len(lacking)), key=lambda k: (lacking[k], -k))
            out.append(k)
            lacking[k] -= size
    return out


def test_plans_are_the_greedy_deal():
    rng = random.Random(3)
    for _ in range(3000):
        sizes = [(s, rng.randint(1, 40)) for s in sorted({rng.choice([1, 2, 3, 5, 8, 20, 100, 1000]) for _ in range(rng.randint(1, 6))}, reverse=True)]
        shares = tuple((str(i), x) for i, x in enumerate(rng.choice([(0.8, 0.1, 0.1), (0.7, 0.15, 0.15), (0.5, 0.5), (1.0,), (0.4, 0.3, 0.2, 0.1)])))
        dealt = []
        for (_, n), phases in zip(sizes, splits.run_plan(sizes, shares), strict=True):
            assert len(phases) <= len(shares) + 1
            for r in range(n):
                first, turn = [p for p in phases if p[0] <= r][-1]
                dealt.append(turn[(r - first) % len(turn)])
        assert dealt == greedy(sizes, shares)


def test_one_deal_of_many_groups_and_a_hot_one(spark):
    """300,000 groups of which one holds a third of all rows: shares are right, and no group is in two splits."""
    groups = spark.range(300_000).selectExpr("'x' label", "concat('g', id) `group`", "if(id = 7, 150000L, 1L) rows")
    got = splits.assigned(groups)
    sums = {r.split: r.n for r in got.groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    total = sum(sums.values())
    assert total == 449_999 and all(abs(sums[name] / total - share) < 1e-4 for name, share in splits.SHARES)
    assert got.groupBy("group").count().where("count > 1").isEmpty()


def test_a_group_under_two_labels_stays_whole(spark):
    rows = spark.createDataFrame([(f"g{i % 30}", i % 7 % 2) for i in range(300)], "g string, label int")
    a = splits.split_by_group(rows, "g", "label")
    assert a.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n <> 1").isEmpty() and a.where("split IS NULL").isEmpty()
    key = lambda df: sorted(map(tuple, df.distinct().collect()))
    assert key(a) == key(splits.split_by_group(rows.repartition(3), "g", "label"))


RULES = ["// c", "", "com", "kr", "co.kr", "*.ck", "!www.ck", "*.kawasaki.jp", "jp", "!city.kawasaki.jp", "k12.ma.us", "US", "ma.us"]


@pytest.mark.parametrize(
    ("host", "suffix", "domain"),
    [
        ("a.b.com", "com", "b.com"), ("B.CO.KR.", "co.kr", "b.co.kr"), ("x.y.co.kr", "co.kr", "y.co.kr"), ("a.foo.ck", "foo.ck", "a.foo.ck"), ("foo.ck", "foo.ck", "foo.ck"), ("www.ck", "ck", "www.ck"),
        ("x.www.ck", "ck", "www.ck"), ("a.b.c.kawasaki.jp", "c.kawasaki.jp", "b.c.kawasaki.jp"), ("x.city.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp"), ("s.k12.ma.us", "k12.ma.us", "s.k12.ma.us"),
        ("k12.ma.us", "k12.ma.us", "ma.us"), ("a.zzz", "zzz", "a.zzz"), ("localhost", "localhost", "localhost"), ("", "", ""), (None, "", ""), ("kawasaki.jp", "jp", "kawasaki.jp"), ("a.b.ma.us", "ma.us", "b.ma.us"),
    ],
)
def test_suffix_rules(spark, host, suffix, domain, _cache={}):  # noqa: B006
    if not _cache:
        known = suffixes.rules(spark.createDataFrame([(r,) for r in RULES], "value string"))
        hosts = [p[0] for p in test_suffix_rules.pytestmark[0].args[1]]
        _cache.update({r.host: (r.suffix, r.domain) for r in suffixes.registered(spark.createDataFrame([(h,) for h in hosts] * 2, "host string"), known).collect()})
    assert _cache[host] == (suffix, domain)


def test_suffix_rules_serve_the_graph(spark):
    """Under *.ck two shops of one town are apart, as their town is a suffix."""
    rows = spark.createDataFrame([(1, None, ["a.town.ck"], [], None), (2, None, ["b.town.ck"], [], None), (3, None, ["x.b.town.ck", "a.co.kr"], [], None), (4, None, [], [], None)], REPORT)
    known = suffixes.rules(spark.createDataFrame([(r,) for r in RULES], "value string"))
    ready = G.prepared(suffixes.with_registered(rows, known, "id", "domains"), CHAT)
    members = G.clusters(ready)
    assert {r.id: r.root for r in members.collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    edges = {(r.source, r.target) for r in G.edges(ready, members, G.nodes(ready, members, CHAT)).collect()}
    assert edges == {("url:b.town.ck", "url:x.b.town.ck"), ("url:a.co.kr", "url:x.b.town.ck")}


def test_stored_tables_are_dropped(spark):
    first = components.stored(spark.range(3), "t")
    path = first.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and components.drop_stored(spark) >= 1 and not os.path.exists(path) and components.drop_stored(spark) == 0


def test_the_generators_view_of_texts(spark):
    """Against the same rules in Python's own expressions."""
    import re

    from tidewatch.functions import text as T
    from tidewatch.lexicons import KOREAN

    texts = ["택배 http://track.hanjin.com/x 문의 1588-0011", "go bit.ly/a and evil.example.xyz/p?q 010-1234-5678", "+1 202 5550 1234 또는 +82 10-1234-5678", "02-123-4567 plain", "www.kbstar.com 1234-5678\n끝", "", None, "a.b 1.2.3"]

    def url(m):
        host = re.sub("(?i)^https?://", "", m.group()).split("/")[0].lower().replace("www.", "")
        under = lambda ds: any(host == d or host.endswith("." + d) for d in ds)
        return " [URL_OFFICIAL] " if under(KOREAN.official_domains) else " [URL_SHORTENER] " if under(KOREAN.url_shorteners) else " [URL_SUSPICIOUS] "

    def phone(m):
        d = re.sub(r"\D", "", m.group())
        if m.group().strip().startswith("+") and not d.startswith("82"):
            return " [PHONE_FOREIGN] "
        return " [PHONE_OFFICIAL] " if d in KOREAN.official_numbers or (not d.startswith("010") and re.match("1[0-9]{3}|15|16|18", d)) else " [PHONE_MOBILE] "

    def plain(t):
        t = re.sub(r"(?i)\b(?:https?://|www\.)[^\s]+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s]*)?", url, t or "")
        return " ".join(re.sub(r"(?<!\d)(?:\+\d{1,3}[-\s]?)?0?\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4}(?!\d)", phone, t.replace("\n", " ")).split())

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.model_text for r in T.for_generated(df).orderBy("i").collect()] == [plain(t) for t in texts]


def test_an_empty_text_is_an_error(spark):
    from tidewatch.operators import pipelines

    rows = spark.createDataFrame([("a", 0.9), ("b", 0.6), ("c", 0.1)], "text string, probability double")
    assert [(r.score, r.risk_level, r.verdict) for r in pipelines.message_results(rows).orderBy("text").collect()] == [(0.9, "high", "phishing"), (0.6, "medium", "suspicious"), (0.1, "low", "normal")]
    for bad in (" ", None):
        with pytest.raises(ValueError, match="empty"):
            pipelines.message_results(rows.unionByName(spark.createDataFrame([(bad, 0.5)], "text string, probability double")))


def test_matches_meet_distinct_sets_not_reports(spark):
    """Time grows no faster than inputs and reports where most clusters have a common token; the results by hand."""
    import time

    from tidewatch.operators import graph as G
    from tidewatch.plans.tables import CHAT

    def made(n):
        """n clusters of one report with one of two tokens, cluster n of two reports with both, and n inputs with both."""
        i = F.col("id")
        words = F.when(i >= n, F.array(F.lit("ein"), F.lit("para"))).when(i % 2 == 0, F.array(F.lit("ein"))).otherwise(F.array(F.lit("para")))
        none = F.array().cast("array<string>")
        rows = spark.range(n + 2).select("id", F.lit(None).cast("string").alias("sender"), none.alias("regs"), words.alias("strong"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
        inputs = spark.range(n).select("id", F.lit(None).cast("string").alias("sender"), none.alias("domains"), F.array(F.lit("para"), F.lit("ein")).alias("tokens"))
        return inputs, rows, rows.select("id", F.least("id", F.lit(n)).alias("cluster"))

    for found in (lambda n: G.match(*made(n), CHAT), lambda n: G.campaigns(*made(n), "2024-01-02", CHAT)):
        took = {}
        for n in (4_000, 16_000):
            began = time.time()
            out = found(n)
            kept = [c for c in ("cluster", "match_type", "shared", "similar", "similar_case_count", "similar_phrase_count") if c in out.columns]
            got = [tuple(r) for r in out.groupBy(*kept).count().collect()]
            took[n] = time.time() - began
            assert got == [(n, "strong_phrase", 2, 2, n)]
        assert took[16_000] < 4 * took[4_000] + 4, took


def test_clusters_link_keys_not_reports(spark, monkeypatch):
    """The edges that components get follow the keys that reports join, and nodes and edges stay those of all reports."""
    from tidewatch.operators import graph as G
    from tidewatch.plans.tables import CHAT

    seen, plain = [], G.connected_components

    def counted(edges, *args):
        seen.append(edges.count())
        return plain(edges, *args)

    monkeypatch.setattr(G, "connected_components", counted)
    i, none = F.col("id"), F.array().cast("array<string>")
    known = [
        (5000, "x", ["h.d1.com"], []), (5001, "x", None, []), (5002, "", ["h.d2.com"], ["ein", "para", "con"]), (5003, None, [], ["para", "con"]),
        (5004, "y", [], ["con", "ein", "ein"]), (5005, None, [], ["ein"]), (5006, "y", ["d3.com", "d4.com"], []), (5007, None, None, []),
    ]
    many = spark.range(3000).select("id", F.lit(None).cast("string").alias("sender"), F.array(F.concat(F.lit("h.d"), (i % 3).cast("string"), F.lit(".com"))).alias("domains"), none.alias("tokens"))
    reports = many.union(spark.createDataFrame(known, "id long, sender string, domains array<string>, tokens array<string>")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    rows = G.prepared(reports, CHAT)
    members = G.clusters(rows)
    got = {r.id: r.root for r in members.collect()}
    want = {n: n % 3 for n in range(3000)} | {5000: 1, 5001: 1, 5002: 2, 5003: 2, 5004: 2, 5005: 5005, 5006: 2, 5007: 5007}
    assert got == want
    assert seen and seen[0] < 10
    found = G.nodes(rows, members, CHAT)
    edges = {tuple(r) for r in G.edges(rows, members, found).collect()}
    assert ("num:x", "url:h.d1.com") in edges and ("url:d3.com", "url:d4.com") in edges and ("num:y", "url:d3.com") in edges and len(edges) == len(G.edges(rows, members, found).collect())


@pytest.mark.parametrize("few", [0, 500_000])
def test_no_root_gathers_its_reports(spark, some, monkeypatch, few):
    """Reports look their cluster up by a key and are never sorted by root; those without phrases need no cluster for their edges."""
    plans, plain = {}, G.stored

    def written(df, name, *args):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name, *args)

    monkeypatch.setattr(G, "stored", written)
    monkeypatch.setattr(R, "FEW", few, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = prepared(spark, some)
        members = G.clusters(rows)
        want = roots(some)
        assert {r.id: r.root for r in members.collect()} == want
        assert {r.root: r.cluster for r in members.collect()} == {r: n for n, r in enumerate(sorted(set(want.values())))}
        assert "SortMergeJoin" not in plans["clusters"] and "HashJoin" in plans["clusters"]
        firsts, cluster = {}, {r.id: r.cluster for r in members.collect()}
        for i, sender, domains, *_ in some:
            for name in [*(("url", d) for d in domains), *([("number", sender)] if sender else [])]:
                firsts[name] = min(i, firsts.get(name, i))
        found = G.nodes(rows, members, CHAT)
        assert {(r.type, r.label): r.cluster for r in found.collect() if r.type != "phrase"} == {name: cluster[i] for name, i in firsts.items()}
        silent = rows.where("size(strong) = 0")
        edges = lambda m: sorted(map(tuple, G.edges(silent, m, found).collect()))
        assert edges(members) == edges(members.where("id < 0")) and any(a.startswith("num:") for a, _ in edges(members))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cluster_gathers_its_inputs(spark, some):
    """Inputs of one cluster are not sorted by it where they get its counts, and strong tokens need no function for each token."""
    import re

    from tidewatch.functions import text as T
    from tidewatch.lexicons import ENGLISH, KOREAN

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = prepared(spark, some)
        found = G.campaigns(spark.createDataFrame(some, REPORT), rows, G.clusters(rows), "2024-01-10 00:00:00", CHAT)
        # Sets of a cluster may be sorted by it, rows of inputs may not.
        assert not re.findall(r"SortMergeJoin \[cluster#\d+L?(?:, (?:o|_s)#\d+L?)?\]", found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lists = [["zu", "zu", None, "x", "ein", "other"], [], None, [*KOREAN.strong_tokens, "a"], [*ENGLISH.strong_tokens, *ENGLISH.stopwords, "zu"]]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>")
    for profile in (CHAT, ENGLISH, KOREAN):
        for r in df.select(T.meaning_tokens(F.col("t"), profile).alias("m"), T.strong_tokens(F.col("t"), profile).alias("s")).collect():
            assert r.s == (r.m if r.m is None else [t for t in r.m if t in profile.strong_tokens])
    assert "lambda" not in df.select(T.strong_tokens(F.col("t"), CHAT))._jdf.queryExecution().optimizedPlan().toString()


def test_every_event_links_its_sender(spark, tmp_path):
    """Two domains with one sender are one cluster, whatever the numbers of the events, and no sender is left out."""
    day = lambda n: datetime(2024, 1, n, 12)
    rows = [(1, day(1), 7, "click"), (2, day(2), 7, "click"), (3, day(3), 8, "click"), (4, day(3), 9, "view"), (5, day(4), None, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.label: r.cluster for r in registry.QUERIES["sender_graph_nodes"](spark, str(tmp_path)).collect()}
    hosts = {"h1.click-2024-01-01.test": 0, "h2.click-2024-01-02.test": 0, "h0.click-2024-01-03.test": 1, "h1.view-2024-01-03.test": 2, "h2.view-2024-01-04.test": 3}
    assert got == hosts | {"7": 0, "8": 1, "9": 2}
