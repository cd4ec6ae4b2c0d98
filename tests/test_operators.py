import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation as E
from tidewatch.operators import feed, generators, splits
from tidewatch.operators import graph as G
from tidewatch.operators import model as M
from tidewatch.operators import pipelines as Pipe
from tidewatch.operators import relational as R
from tidewatch.operators import reports as P
from tidewatch.operators.components import connected_components
from tidewatch.operators.similarity import sharing_pairs, similar_pairs
from tidewatch.plans import text_queries


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 9)] + [(20, k) for k in range(21, 26)] + [(8, 25), (50, 50), (None, 3)]
    edges += [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(50)]
    rng.shuffle(edges)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {v: v for e in edges if None not in e for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(2)
    sets = [(i, rng.sample("abcdefghijklm", rng.randint(0, 8))) for i in range(60)]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    for t in (0.3, 0.6, 1.0):
        got = {(r.left_id, r.right_id): r.similarity for r in similar_pairs(df, df, t).collect()}
        want = {}
        for (i, a), (j, b) in itertools.product(sets, sets):
            if len(a) >= 3 and len(b) >= 3 and len({*a} & {*b}) / len({*a} | {*b}) >= t:
                want[i, j] = len({*a} & {*b}) / len({*a} | {*b})
        assert got == want


def test_sharing_pairs_connect_what_all_pairs_would(spark):
    rng = random.Random(3)
    sets = [(i, rng.sample("abcdefgh", rng.randint(0, 3))) for i in range(40)]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    every = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if len({*a} & {*b}) >= 2]
    label = lambda edges: {r.vertex: r.component for r in connected_components(edges, "a", "b").collect()}
    assert label(sharing_pairs(df)) == label(spark.createDataFrame(every, "a long, b long"))


def test_relational(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 0), (2, "b", 1), (4, "b", 1), (5, None, 1)], "id int, t string, l int")
    assert sorted(r.id for r in R.first_of(df, ["t"], ["id"]).collect()) == [1, 2, 5]
    assert sorted(r.id for r in R.without_conflicts(df, "t", "l").collect()) == [2, 4, 5]
    other = spark.createDataFrame([(" b ",)], "t string")
    assert sorted(r.id for r in R.not_in(df, other, ["t"], trim=True).collect()) == [1, 3, 5]
    assert [r.n for r in R.numbered(df, ["id"], "n").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert R.concat(df, other).columns == ["id", "t", "l"] and R.converted(other, ["x", "t"]).columns == ["x", "t"]
    assert R.text_column(df.withColumnRenamed("t", "message")) == "message"
    with pytest.raises(ValueError):
        R.labelled(df.withColumn("l", F.lit(7)), "t", "l")
    assert R.labelled(df, "t", "l", {1: 0}).count() == 3


MESSAGES = [
    (1, "계좌 정지 확인 http://a1.evil.top/x", "010", "2024-01-01 00:00:00"), (2, "계좌 정지 확인 http://a2.evil.top/y", None, "2024-01-01 12:00:00"), (3, "택배 배송 주소불일치", "010", "2024-01-02 00:00:00"),
    (4, "택배 배송 주소불일치 조회", None, "2024-01-02 01:00:00"), (5, "안녕 좋은 아침", None, "2024-01-02 02:00:00"),
]


@pytest.fixture(scope="module")
def reports(spark):
    df = spark.createDataFrame(MESSAGES, "id long, text string, sender string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return P.new_reports(df, "user").cache()


def test_status(spark, reports):
    rows = [("a",) for _ in range(5)] + [("b",)] * 2 + [("c",)] + [("d",)]
    df = spark.createDataFrame(rows, "case_key string").withColumns({"source": F.when(F.col("case_key") == "d", "seed").otherwise("user"), "created_at": F.lit("2024-01-01").cast("timestamp"), "text": F.lit("t"), "sender": F.lit(None).cast("string")})
    status = {r.case_key: r.status for r in P.cases(df).collect()}
    assert status == {"a": "confirmed", "b": "suspected", "c": "pending", "d": "confirmed"}
    none = spark.createDataFrame([], "case_key string, label int, approved_at timestamp")
    ok = P.approve(df, none, "a", 0, "2024-02-01")
    assert {r.case_key: r.status for r in P.cases(df, ok).collect()}["a"] == "false_positive"
    assert [r.case_key for r in P.training_candidates(df).collect()] == ["a"] and P.training_candidates(df, ok).count() == 0
    with pytest.raises(ValueError):
        P.approve(df, none, "c", 1, "2024-02-01")
    with pytest.raises(ValueError):
        P.by_status(df, "unknown")
    samples = P.approved_samples(df, ok)
    assert samples.count() == 1 and not P.retraining_ready(samples).first().ready
    assert P.training_set(spark.createDataFrame([("t", 0)], "text string, label int"), samples).count() == 1


def test_graph(spark, reports):
    rows = G.prepared(reports)
    members = G.clusters(rows)
    by = {r.id: r.cluster for r in members.collect()}
    assert by[1] == by[2] == by[3] == by[4] != by[5]
    found = G.nodes(rows, members)
    names = {r.id for r in found.collect()}
    assert {"url:a1.evil.top", "url:a2.evil.top", "num:010", "phrase:0:택배"} <= names
    edges = {(r.source, r.target) for r in G.edges(rows, members, found).collect()}
    assert ("url:a1.evil.top", "url:a2.evil.top") in edges and all(a < b for a, b in edges)
    table = {r.cluster: r for r in G.cluster_table(rows, members, found).collect()}
    assert table[0].report_count == 4 and table[0].risk == pytest.approx(0.40 + 0.24 + 0.03)
    assert G.degrees(G.edges(rows, members, found), 1).count() == 1
    hosts = spark.createDataFrame([("x.a1.evil.top",)], "host string")
    assert [r.label for r in G.highlighted(found, hosts).collect()] == ["a1.evil.top"]


def test_scoring_end_to_end(spark, reports):
    df = spark.createDataFrame([(10, "계좌 정지 http://a1.evil.top", None, 0.9), (11, "택배 배송 주소불일치 재확인", None, 0.2), (12, "이용금액 정상 승인", None, 0.99)], "id long, text string, sender string, probability double")
    out = {r.id: r for r in Pipe.score(df, P.with_status(reports), as_of="2024-01-02 03:00:00").collect()}
    assert out[10].match_type == "domain" and out[10].level == "danger" and out[10].signals.reputation == 0.35 and out[10].campaign_status == "active"
    assert out[11].match_type == "strong_phrase" and out[11].signals.reputation == 0.30
    assert out[12].risk_score == 0.25 and out[12].level == "safe" and out[12].cluster_id is None
    trend = {(r.kind, r.label): r["count"] for r in Pipe.trends(reports).collect()}
    assert trend["category", "계좌 정지"] == 2 and trend["domain", "evil.top"] == 2
    assert Pipe.meta_dataset(df, reports).count() == 3
    leaks = P.seed_leakage(P.new_reports(spark.createDataFrame([(1, MESSAGES[0][1], None, None)], "id long, text string, sender string, created_at timestamp"), "user").withColumn("norm", F.col("text")), reports.withColumn("norm", F.col("text")))
    assert leaks.first().same_text and leaks.first().shared_domain


def test_clean_dataset(spark):
    raw = spark.createDataFrame([("택배 왔어요 hanjin.com", 1), ("택배 왔어요 hanjin.com", 1), ("x y", 2), ("x y", 1), ("  ", 2), ("한진택배 12", 3), ("z", 9)], "content string, class int")
    out = {r.content: r for r in Pipe.clean_dataset(raw).collect()}
    assert set(out) == {"택배 왔어요 hanjin.com", "한진택배 12"} and out["한진택배 12"].structured_family == "hanjin_pickup" and out["택배 왔어요 hanjin.com"].has_official_url == 1


def test_published_counts_give_the_published_ratios(spark):
    row = E.with_ratios(spark.createDataFrame([(4426, 74, 1070, 3430)], "tn long, fp long, fn long, tp long")).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == pytest.approx((0.872889, 0.978881, 0.762222, 0.857071), abs=1e-6)


def test_curves_against_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 1), round(rng.random(), 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert E.auc(df).first().roc_auc == pytest.approx(want, abs=1e-6)
    assert E.auc(df.where("label = 1")).first().roc_auc is None
    for r in E.threshold_sweep(df).collect():
        assert r.tp == sum(y and s >= r.threshold for _, y, s in rows) and r.fp == sum((not y) and s >= r.threshold for _, y, s in rows)
    assert E.best_threshold(E.threshold_sweep(df)).count() == 1
    zero = E.confusion(df.withColumn("predicted", F.lit(0))).first()
    assert zero.precision == 0 and zero.f1 == 0


def test_gate(spark):
    a = spark.createDataFrame([(0.9, 0.9, 5)], "f1 double, precision double, fp long")
    assert E.promotion_gate(a, a).first().decision == "PROMOTE"
    assert E.promotion_gate(a, a.withColumn("fp", F.lit(6))).first().decision == "REJECT"


def test_splits(spark):
    rng = random.Random(6)
    rows = [(i, f"g{int(rng.paretovariate(1.1)) % 90}", i % 2) for i in range(2000)]
    df = spark.createDataFrame([(i, f"{y}-{g}", y) for i, g, y in rows], "id int, g string, y int")
    out = splits.split_by_group(df, "g", "y").cache()
    splits.check_no_leakage(out, [["g"]])
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "validation", "test"}
    fixed = spark.createDataFrame([("0-g1", "test")], "group string, split string")
    again = splits.split_by_group(df, "g", "y", fixed=fixed)
    assert {r.split for r in again.where("g = '0-g1'").select("split").distinct().collect()} == {"test"}
    assert sorted(map(str, out.collect())) == sorted(map(str, splits.split_by_group(df.repartition(7), "g", "y").collect()))
    with pytest.raises(ValueError):
        splits.check_no_leakage(out.withColumn("split", F.col("id").cast("string")), [["g"]])


def test_generators(spark):
    specs = [("a", "b", "n{n} {x}", "p{n} {x}")]
    rows = generators.pairs(spark, specs, {"x": ["1", "2", "3"]}, 30)
    generators.check_pairs(rows)
    assert rows.count() == 60 and sorted(map(str, rows.collect())) == sorted(map(str, generators.pairs(spark, specs, {"x": ["1", "2", "3"]}, 30).collect()))
    made = generators.from_templates(spark, [("k", "{x}!")], {"x": ["a", "b"]}, 10, 1).collect()
    assert {r.text for r in made} == {"a!", "b!"} and all(r.is_synthetic for r in made)
    assert generators.mined(spark.createDataFrame([("a1 b2 a1",)], "t string"), "t", "[a-z][0-9]").first().value == "a1"


def test_model(spark):
    rows = [(f"win money now {i}", 1) for i in range(20)] + [(f"meeting at noon {i}", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "text string, label int")
    model = M.fit(df, features=500, iterations=10)
    got = M.predict(model, df).groupBy("label").agg(F.avg("probability").alias("p")).collect()
    assert {r.label: r.p > 0.5 for r in got} == {1: True, 0: False}
    out = M.predict_with(df, lambda: lambda t: t.str.len().astype(float))
    assert out.first().probability == len(rows[0][0])


def test_model_weights_and_probabilities_by_hand(spark, tmp_path):
    """Features, coefficients and probabilities against scikit-free arithmetic: TF-IDF by dictionaries, the optimum by its gradient."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc" if i % 3 else "abcxyz") for _ in range(rng.randint(1, 14))) for i in range(60)] + ["", "ababab"]
    rows = [(t, int("x" in t or len(t) > 9)) for t in texts]
    df = spark.createDataFrame(rows, "text string, label int")
    model = M.fit(df, iterations=400, high=3)
    grams = [Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)) for t in texts]
    held = Counter(g for c in grams for g in c)
    terms = model.terms.vocabulary
    assert set(terms) == {g for g, n in held.items() if n >= 2}
    idf = {g: math.log((len(texts) + 1) / (held[g] + 1)) for g in terms}
    x = np.array([[(1 + math.log(c[g])) * idf[g] if c[g] else 0.0 for g in terms] for c in grams])
    y = np.array([r[1] for r in rows], float)
    coefficients = np.array([w / idf[g] if idf[g] else 0.0 for w, g in zip(model.weights, terms, strict=True)])
    p = 1 / (1 + np.exp(-(x @ coefficients + model.intercept)))
    got = {r.text: r.probability for r in M.predict(model, df).collect()}
    assert all(got[t] == pytest.approx(v, abs=6e-5) for t, v in zip(texts, p, strict=True))
    # Balanced weights; the penalty is on coefficients of standardised features. At the optimum no gradient is left.
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    mean = (share[:, None] * x).sum(0) / share.sum()
    spread = (share[:, None] * (x - mean) ** 2).sum(0) / (share.sum() * (1 - (share**2).sum() / share.sum() ** 2))
    gradient = (share * (p - y)) @ x / share.sum() + 0.01 * coefficients * spread
    assert abs(((p - y) * share).sum() / share.sum()) < 1e-4 and np.abs(gradient).max() < 2e-3
    model.save(str(tmp_path / "m"))
    again = M.TextModel.load(str(tmp_path / "m"))
    assert {r.text: r.probability for r in M.predict(again, df).collect()} == got
    plan = M.predict(model, df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scores_use_the_defaults_of_the_model(spark, sf, monkeypatch):
    """n-grams of two to four letters and the operator's own number of terms and iterations."""
    asked = []
    fit = M.fit
    monkeypatch.setattr(M, "fit", lambda df, **given: asked.append((given, fit(df, features=5000, iterations=1))) or asked[-1][1])
    text_queries.lr_model_scores(spark, sf)
    given, model = asked[0]
    assert given == {} and {len(g) for g in model.terms.vocabulary} == {2, 3, 4}


def test_feed(spark):
    items = [("1", "KISA", "스미싱 주의", "2024-01-02", "u1"), ("1", "KISA", "스미싱 주의", "2024-01-01", "u2"), ("2", "KISA", "피싱", "2024-01-03", "u1"), ("3", "KISA", "날씨", "2024-01-04", None), ("4", "경찰청", "해킹", "", None)]
    df = spark.createDataFrame(items, "id string, source string, title string, published_at string, url string")
    rows = feed.classified(df)
    assert {r.id for r in rows.collect()} == {"1", "2", "4"}
    assert [r.id for r in feed.top_items(feed.distinct_items(rows)).collect()] == ["2", "4"]
    found, errors = feed.gathered({"a": lambda: df, "b": lambda: spark.read.parquet("/nowhere")})
    assert found.count() == 5 and set(errors) == {"b"}


def test_model_versions_go_forth_and_back(spark, tmp_path):
    from tidewatch.operators import promotion as V

    events = V.no_versions(spark)
    with pytest.raises(ValueError):
        V.rollback(events)
    events = V.promote(V.promote(events, "a"), "b")
    assert V.live(events).first()[1:] == ("b", "a")
    events = V.rollback(events)
    assert V.live(events).first()[1:] == ("a", None)
    with pytest.raises(ValueError):
        V.rollback(events)
    spark.range(2).write.parquet(str(tmp_path / "m/terms"))
    V.check_model(spark, str(tmp_path / "m"), ("terms",))
    with pytest.raises(ValueError):
        V.check_model(spark, str(tmp_path / "m"), ("terms", "weights"))


def test_a_retraining_round_uses_samples_once(spark):
    from tidewatch.operators import pipelines

    reports = spark.createDataFrame([(i, f"text {i}", None, f"c{i}", "user", "2024-01-01") for i in range(25)], "id long, text string, sender string, case_key string, source string, created_at string")
    approvals = spark.createDataFrame([(f"c{i}", i % 2, "2024-01-02") for i in range(25)], "case_key string, label int, approved_at string")
    base = spark.createDataFrame([("text 1", 1), ("other", 0)], "text string, label int")
    used = spark.createDataFrame([], "case_key string, run string")
    sizes = []
    decision, after = pipelines.retraining_round(reports, approvals, used, base, "r1", lambda rows: sizes.append(rows.count()), lambda model: "REJECT")
    assert decision == "REJECT" and after.count() == 25 and sizes == [26]  # one sample is in the base
    assert pipelines.retraining_round(reports, approvals, after, base, "r2", lambda rows: 1 / 0, lambda model: "PROMOTE")[0] == "WAIT"
    with pytest.raises(ZeroDivisionError):
        pipelines.retraining_round(reports, approvals, used, base, "r3", lambda rows: 1 / 0, lambda model: "PROMOTE")


def test_rounding_of_halves_is_that_of_the_sql(spark):
    """Shares that end in a half, whose double lies below or above it, against DuckDB; 57 of 800 is such a one."""
    import duckdb

    from tidewatch.functions.columns import rounded

    pairs = [(a, b) for b in (32, 800, 1600, 2080, 3200) for a in range(b)]
    df = spark.createDataFrame(pairs, "a int, b int").coalesce(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS a, unnest($2) AS b", [[a for a, _ in pairs], [b for _, b in pairs]])
    for places in (4, 6):
        got = [r.x for r in df.select(rounded(F.col("a") / F.col("b"), places).alias("x")).collect()]
        assert got == [r[0] for r in con.execute(f"SELECT round(a / b, {places}) FROM t").fetchall()]


def test_ngrams_are_made_without_walking_an_array_of_characters(spark):
    """Runs of two to four code points, by length and in order, with line ends and characters beyond the basic plane."""
    texts = [None, "", "a", "ab", "a\nb\r\nc", "\U0001f600x\U0001f601\U0001f600é한", "aaaaa", "\u2028\u0085 z"]
    df = M.with_ngrams(spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1), "t")
    got = {r.i: r.grams for r in df.collect()}
    assert got == {i: [(t or "")[k : k + n] for n in (2, 3, 4) for k in range(len(t or "") - n + 1)] for i, t in enumerate(texts)}
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_write_no_table_and_vectors_are_written_in_small_groups(spark, tmp_path, monkeypatch):
    """What a task holds is bounded: a row's own n-grams in predict, a small row group of vectors in fit."""
    import pyarrow.parquet as pq

    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(2000)), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string, label int").coalesce(1)
    asked, write = [], M.stored
    monkeypatch.setattr(M, "stored", lambda made, name, **more: asked.append((name, write(made, name, **more))) or asked[-1][1])
    monkeypatch.setattr(M, "GROUP_BYTES", 1 << 18)
    model = M.fit(df, features=3000, iterations=2)
    assert [name for name, _ in asked] == ["counts", "features"]
    for _, made in asked:
        for path in made.inputFiles():
            groups = pq.ParquetFile(path.removeprefix("file://")).metadata
            assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 200
    assert M.predict(model, df).count() == 600 and len(asked) == 2
