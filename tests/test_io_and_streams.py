import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import promotion
from tidewatch.sources import readers, sinks
from tidewatch.sources.versions import Versions
from tidewatch.streaming import streams


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8-sig"), ("b", "cp949")):
        (tmp_path / f"{name}.csv").write_bytes("text,label\n한글 문자,1\n,0\n".encode(encoding))
        rows = readers.csv(spark, str(tmp_path / f"{name}.csv"))
        assert rows.columns == ["text", "label"] and rows.first().text == "한글 문자"
        assert readers.dataset(spark, str(tmp_path / f"{name}.csv")).count() == 1


def test_lists_and_seeds(spark, tmp_path):
    (tmp_path / "l").write_text("# c\n\nA.com\n a.com \nb.net\n")
    assert sorted(r.domain for r in readers.block_list(spark, str(tmp_path / "l")).collect()) == ["a.com", "b.net"]
    (tmp_path / "s.json").write_text('[{"text": "x"}, {"text": " "}, {"text": "y", "sender": "1"}]')
    assert readers.seed_messages(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "f.json").write_text('{"items": [{"id": "1", "title": "t", "keywords": ["k"]}]}')
    assert readers.feed_items(spark, str(tmp_path / "f.json")).first().keywords == ["k"]
    (tmp_path / "bad.json").write_text("{broken")
    assert readers.feed_items(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "r.csv").write_text("1,a.com\n2,b.com\n")
    assert readers.ranked_domains(spark, str(tmp_path / "r.csv")).first().raw_domain == "a.com"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b.com", [1]), ("a.com", [2]), ("x@y", [3])], "domain string, n array<int>")
    sinks.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    sinks.block_list(df, str(tmp_path / "b"), heading="h")
    assert [r.domain for r in readers.block_list(spark, str(tmp_path / "b")).orderBy("domain").collect()] == ["a.com", "b.com"]
    assert sinks.feed(df, str(tmp_path / "feed")) and not sinks.feed(df.limit(0), str(tmp_path / "feed")) and Versions(spark, str(tmp_path / "feed"), "json").read().count() == 3
    sinks.run_result(spark, str(tmp_path / "runs"), "v1", "PROMOTE", f1=0.9)
    assert spark.read.parquet(str(tmp_path / "runs")).first().numbers["f1"] == 0.9
    a, b = sinks.content_fingerprint(df).first(), sinks.content_fingerprint(df.repartition(3)).first()
    assert a == b and a.rows == 3 and a.sha256 != sinks.content_fingerprint(df.limit(2)).first().sha256


def _write(spark, rows, path):
    spark.createDataFrame(rows, "case_key string, source string, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_running_status_and_promotions(spark, tmp_path):
    at = datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    _write(spark, [("a", "user", at)] * 2 + [("b", "seed", at)], path)
    stream = lambda: spark.readStream.schema("case_key string, source string, ts timestamp").parquet(path)
    q = streams.running_status(stream()).writeStream.outputMode("complete").format("memory").queryName("status").start()
    p = streams.promotions(stream()).writeStream.outputMode("update").format("memory").queryName("moves").start()
    for x in (q, p):
        x.processAllAvailable()
    time.sleep(0.1)
    _write(spark, [("a", "user", at)] * 3, path)
    for x in (q, p):
        x.processAllAvailable()
        x.stop()
    assert {r.case_key: r.status for r in spark.table("status").collect()} == {"a": "confirmed", "b": "confirmed"}
    assert sorted((r.case_key, r.status) for r in spark.table("moves").collect()) == [("a", "confirmed"), ("a", "suspected"), ("b", "confirmed")]


def test_windows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    _write(spark, [("a", "user", at + timedelta(minutes=m)) for m in (0, 10, 100)], path)
    stream = lambda: spark.readStream.schema("case_key string, source string, ts timestamp").parquet(path)
    for name, df in (("days", streams.last_day(stream(), "case_key")), ("sessions", streams.sessions(stream(), "case_key"))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("days").agg(F.max("n")).first()[0] == 3
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_feed_cycle(spark, tmp_path):
    schema = "id string, source string, title string, published_at string, url string"
    spark.createDataFrame([("1", "KISA", "스미싱 주의", "2024-01-02", "u1"), ("2", "KISA", "날씨", "2024-01-03", "u2")], schema).write.json(str(tmp_path / "in"))
    for _ in range(2):
        q = streams.feed_cycle(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "ck"), every=None)
        q.awaitTermination()
        rows = readers.feed_items(spark, str(tmp_path / "cache")).collect()
        assert [r.id for r in rows] == ["1"] and rows[0].category == "스미싱"
    spark.createDataFrame([("3", "경찰청", "피싱", "2024-01-05", "u3")], schema).write.mode("append").json(str(tmp_path / "in"))
    streams.feed_cycle(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "ck"), every=None).awaitTermination()
    assert sorted(r.id for r in readers.feed_items(spark, str(tmp_path / "cache")).collect()) == ["1", "3"]


def test_versions(spark, tmp_path, monkeypatch):
    """A failure before the commit, and a writer that lost a race, leave the current version as it was."""
    store = Versions(spark, str(tmp_path / "t"))
    assert store.read() is None and store.numbers() == [] and store.expire() == 0
    ids = lambda: sorted(r.id for r in store.read("id long").collect())
    assert store.publish(spark.range(3)) == 1
    lost = store.prepare(spark.range(9))
    assert ids() == [0, 1, 2]
    with pytest.raises(Exception, match="(?i)divi"):
        store.publish(spark.range(5).selectExpr("id div (id - 4) as id"))
    assert ids() == [0, 1, 2] and store.numbers() == [1]
    store.publish(store.read("id long").where("id > 0"))  # reads what it replaces
    assert ids() == [1, 2]
    monkeypatch.setattr(Versions, "numbers", lambda self: [1])  # a writer that has not seen version 2
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(lost)
    monkeypatch.undo()
    assert ids() == [1, 2] and store.rollback() == 3 and ids() == [0, 1, 2]
    store.publish(spark.range(1))
    assert store.expire(keep=1) >= 2 and ids() == [0] and store.numbers() == [4]
    with pytest.raises(ValueError):
        store.read(number=1)
    with pytest.raises(ValueError):
        store.rollback()


def test_feed_cycle_keeps_a_cache_that_cannot_be_read(spark, tmp_path, monkeypatch):
    schema = "id string, source string, title string, published_at string, url string"
    run = lambda k: streams.feed_cycle(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / k), every=None).awaitTermination()
    spark.createDataFrame([("1", "KISA", "스미싱 주의", "2024-01-02", "u1")], schema).write.json(str(tmp_path / "in"))
    run("ck")
    spark.createDataFrame([("2", "KISA", "피싱", "2024-01-03", "u2")], schema).write.mode("append").json(str(tmp_path / "in"))

    def broken(self, *a, **k):
        raise PermissionError("storage")

    monkeypatch.setattr(Versions, "read", broken)
    with pytest.raises(Exception, match="storage"):
        run("ck")
    monkeypatch.undo()
    assert [r.id for r in readers.feed_items(spark, str(tmp_path / "cache")).collect()] == ["1"]
    run("ck")
    assert sorted(r.id for r in readers.feed_items(spark, str(tmp_path / "cache")).collect()) == ["1", "2"]


def test_promotion_is_stored(spark, tmp_path, monkeypatch):
    for v in ("a", "b"):
        spark.range(2).write.parquet(str(tmp_path / v / "terms"))
    models = promotion.ModelVersions(spark, str(tmp_path / "live"), ("terms",))
    assert models.live() is None
    models.promote(str(tmp_path / "a"))
    with pytest.raises(ValueError):
        models.promote(str(tmp_path / "missing"))

    def crash(self, name):
        raise RuntimeError("crash between write and commit")

    monkeypatch.setattr(Versions, "commit", crash)
    with pytest.raises(RuntimeError):
        models.promote(str(tmp_path / "b"))
    monkeypatch.undo()
    again = promotion.ModelVersions(spark, str(tmp_path / "live"), ("terms",))
    assert again.live() == str(tmp_path / "a")
    again.promote(str(tmp_path / "b"))
    assert models.live() == str(tmp_path / "b")
    models.rollback()
    assert again.live() == str(tmp_path / "a")
    with pytest.raises(ValueError):
        again.rollback()
