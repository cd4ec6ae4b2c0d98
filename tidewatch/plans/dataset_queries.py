"""Queries over datasets, stores of reports, files and what a page shows of them, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import presentation as V
from tidewatch.functions import text as T
from tidewatch.functions import urls as U
from tidewatch.lexicons import ENGLISH
from tidewatch.operators import evaluation as E
from tidewatch.operators import graph as G
from tidewatch.operators import relational as R
from tidewatch.operators import reports as P
from tidewatch.operators.components import shared_folder
from tidewatch.plans.evaluation_queries import _P
from tidewatch.plans.report_queries import _REPORTS, _approvals
from tidewatch.plans.tables import event_reports, predictions, table
from tidewatch.plans.url_queries import _FLAG, BINARY, _flagged
from tidewatch.sources import readers, sinks

NOW = "2024-02-01 00:00:00"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def suffix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered domains of hosts under suffixes of one and of two labels."""
    n = F.col("c_custkey")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".co.kr", ".com", ".go.kr", ".co.uk", ".kr")]), (n % 5 + 1).cast("int"))
    host = F.concat(F.when(n % 3 == 0, "www.m.").when(n % 3 == 1, "m.").otherwise(""), F.lit("shop"), (n % 40).cast("string"), ending)
    return table(spark, sf_dir, "customer").select("c_custkey", host.alias("host"), U.registered_domain(host).alias("domain"))


def common_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of both a supplier in debt and a customer in debt."""
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return R.common(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")), poor, ["nation"])


def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_examples(predictions(spark, sf_dir), key="doc_id").select("doc_id", "type", "score")


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_summary(table(spark, sf_dir, "documents").select("lang", "source", F.md5("text").alias("h")), ["lang", "source"], "h")


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt by number, with sources as groups and languages as templates."""
    from tidewatch.operators.splits import split_summary as summary

    rows = predictions(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))
    return summary(rows, "label", "source", "lang")


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in several splits, where splits go by number and not by text."""
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("content"), (F.col("doc_id") % 3).alias("split"))
    return R.overlaps(docs, ["content"])


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flag_summary(_flagged(spark, sf_dir), list(BINARY), "flag")


def numbered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of texts, with a column that one lacks, under one numbering."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    a = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.md5(F.col(R.text_column(docs))).alias("h"), "lang")
    b = turns.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.md5(F.col(R.text_column(turns))).alias("h"), "role")
    both = R.concat(R.converted(a, ["kind", "id", "h", "lang"]), b)
    return R.numbered(both, ["kind", "id", "h"])


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a text, and a second label mapped from classes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    return R.labelled(R.labelled(rows, "text", "quality"), "text", "toxic", {0: 1, 1: 0}).select("doc_id", "quality", "toxic", F.length("text").cast("long").alias("n"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.approved_samples(event_reports(spark, sf_dir), _approvals(spark, sf_dir))


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of events of user 5 as the base, and the approved samples that it lacks."""
    base = table(spark, sf_dir, "events").where("user_id = 5").select(F.col("props").alias("text"), F.lit(0).alias("label"))
    return P.training_set(base, _samples(spark, sf_dir))


def unused_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved samples after a run that used those of one event type."""
    used = P.mark_used(spark.createDataFrame([], "case_key string, run string"), _samples(spark, sf_dir).where("case_key LIKE '%click%' OR case_key LIKE '%view%'"), "run-1")
    return P.approved_samples(event_reports(spark, sf_dir), _approvals(spark, sf_dir), used).select("case_key", "label", "report_count")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents written as CSV, with a byte-order mark, and read as a labelled dataset."""
    path = _folder(spark, "csv")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sinks.csv(rows.select("doc_id", F.md5("text").alias("text"), F.col("quality").alias("label")), path)
    return readers.dataset(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")


def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cached alerts, written and read again."""
    path = _folder(spark, "feed")
    pages = table(spark, sf_dir, "pages").select(F.sha1(F.col("url").cast("binary")).alias("id"), "url", F.lit("a title").alias("title"), F.array(F.lit("k")).alias("keywords"))
    sinks.feed(pages, path)
    return readers.feed_items(spark, path).select("id", "url", "title", F.array_join("keywords", ",").alias("keywords"))


def block_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages written as a block list and read again."""
    path = _folder(spark, "block")
    sinks.block_list(table(spark, sf_dir, "pages").select(U.host_of(F.col("url")).alias("domain")), path)
    return readers.block_list(spark, path)


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the table of runs."""
    path = _folder(spark, "runs")
    n = table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("ones"), F.count("*").alias("rows")).first()
    sinks.run_result(spark, path, "v1", "REJECT", rows=n.rows)
    sinks.run_result(spark, path, "v2", "PROMOTE", rows=n.rows, ones=n.ones)
    return spark.read.parquet(path).select("version", "decision", F.col("numbers")["rows"].alias("rows"), F.col("numbers")["ones"].alias("ones"))


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored as reports; those of seeds read again, with the columns that the file lacks null."""
    path = _folder(spark, "reports")
    event_reports(spark, sf_dir).write.parquet(path)
    return readers.reports(spark, path, "seed").select("id", "case_key", "source", "status", "created_at")


def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and read again."""
    path = _folder(spark, "metrics")
    E.confusion(predictions(spark, sf_dir)).write.json(path)
    return readers.metrics(spark, path).select("tn", "fp", "fn", "tp")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of one domain for each user: what is known of the case of each as an input."""
    events = table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("sender"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".com"))).alias("domains"), none.alias("tokens"), F.lit("user").alias("source"), F.col("ts").alias("created_at"))
    known = G.prepared(rows, ENGLISH)
    inputs = rows.groupBy("sender").agg(F.min("id").alias("id"), F.first("domains").alias("domains"), F.first("tokens").alias("tokens")).select("id", "sender", "domains", "tokens")
    found = G.campaigns(inputs, known, G.clusters(known), "2024-01-20 00:00:00", ENGLISH)
    return found.select("id", "match_type", "similar_case_count", "shared_domain_count", "shared_sender_count", "first_seen", "last_seen")


def cluster_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports, sent by their market segment and naming a domain of their nation."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("-", "c_mktsegment", (F.col("c_nationkey") % 5).cast("string")).alias("sender"),
        F.array(F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".com"))).alias("domains"), none.alias("tokens"), F.lit("user").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    known = G.prepared(rows, ENGLISH)
    out = G.cluster_sets(known, G.clusters(known))
    return out.select(F.col("cluster").cast("long").alias("cluster"), "reports", F.array_join("domains", ",").alias("domains"), F.array_join("senders", ",").alias("senders"))


def language_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("count"))
    return R.bar_percent(counts)


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest events of each user and how long ago they were."""
    rows = R.newest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")
    return rows.select("user_id", "event_id", V.relative_time(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("told"))


def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by the first of their candidate names that is there and has a value."""
    rows = table(spark, sf_dir, "documents").withColumn("origin", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return R.first_present(rows, {"id": ["document", "doc_id"], "place": ["origin", "lang"], "size": ["n_chars"]})


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows of a document: a heading, a level and the first three of its reasons."""
    reasons = F.array(F.lit("first"), F.col("lang"), F.col("source"), F.lit("left out"))
    text = V.report_text(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.when(F.col("n_chars") > 500, "long").otherwise("short"), F.col("n_chars") % 100, reasons)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _tokens(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's likeness to the next one of its conversation; 0 where either has fewer than three tokens."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.similarity_tokens(_tokens(), ENGLISH).alias("a"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("a"), F.col("b")).cast("double"), 6).alias("similarity"))


def seed_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that benchmark items give away: by text, by language as the domain, by tokens."""
    rows = lambda df, key, domains: df.select(F.col(key).alias("id"), F.lower("text").alias("norm"), domains.alias("domains"), _tokens().alias("tokens"))
    docs = rows(table(spark, sf_dir, "documents"), "doc_id", F.array("lang"))
    seed = rows(table(spark, sf_dir, "benchmark"), "item_id", F.when(F.col("item_id") % 2 == 0, F.array(F.lit("de"))).otherwise(F.array(F.lit("fr"))))
    return P.seed_leakage(docs, seed, profile=ENGLISH).select("id", "same_text", "shared_domain", F.round(F.col("similarity").cast("double"), 6).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        suffix_domains, common_nations, error_examples, group_summary, split_summary, split_overlaps, flag_summary, numbered_union, labelled_rows, training_set, unused_samples, csv_round_trip, feed_round_trip,
        block_list_round_trip, run_results, stored_reports, metrics_file, campaigns, cluster_sets, language_bars, newest_events, present_columns, report_texts, turn_similarity, seed_leakage,
    )
}

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda x: x NOT IN ({})))".format(", ".join(f"'{w}'" for w in ENGLISH.generic_tokens))
_SAMPLES = f"WITH {_REPORTS}, s AS (SELECT e.case_key, label, min(text) AS text, count(*) AS report_count FROM e JOIN ap ON e.case_key = ap.case_key GROUP BY 1, 2)"
ORACLES = {
    "suffix_domains": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'www.m.' WHEN 1 THEN 'm.' ELSE '' END || d AS host, d AS domain
      FROM (SELECT c_custkey, 'shop' || (c_custkey % 40) || ['.co.kr', '.com', '.go.kr', '.co.uk', '.kr'][c_custkey % 5 + 1] AS d FROM customer)""",
    "common_nations": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "error_examples": f"""WITH {_P}, w AS (SELECT doc_id, score, CASE WHEN predicted = 1 THEN 'FP' ELSE 'FN' END AS type FROM q WHERE label <> predicted),
      n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN type = 'FP' THEN -score ELSE score END, doc_id) AS n FROM w) SELECT doc_id, type, score FROM n WHERE n <= 20""",
    "group_summary": "SELECT lang, source, count(*) AS rows, min(md5(text)) AS first FROM documents GROUP BY lang, source",
    "split_summary": f"WITH {_P} SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, label, count(*) AS rows, count(DISTINCT source) AS groups, count(DISTINCT lang) AS templates FROM q GROUP BY 1, 2",
    "split_overlaps": "SELECT md5(text) AS content, count(DISTINCT doc_id % 3) AS splits, count(*) AS rows FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1",
    "flag_summary": f"{_FLAG} SELECT flag, count(*) AS rows, " + ", ".join(f"sum({c}) AS {c}_sum, round(avg({c}), 4) AS {c}_mean" for c in BINARY) + " FROM g GROUP BY flag",
    "numbered_union": """WITH u AS (SELECT 'document' AS kind, doc_id AS id, md5(text) AS h, lang, NULL AS role FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, md5(text), NULL, role FROM conversations)
      SELECT *, row_number() OVER (ORDER BY kind, id, h) - 1 AS row_id FROM u""",
    "labelled_rows": "SELECT d.doc_id, quality, 1 - toxic AS toxic, length(trim(text)) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE trim(text) <> ''",
    "training_set": f"{_SAMPLES} SELECT props AS text, 0 AS label FROM events WHERE user_id = 5 UNION ALL (SELECT DISTINCT text, label FROM s WHERE text NOT IN (SELECT props FROM events WHERE user_id = 5))",
    "unused_samples": f"{_SAMPLES} SELECT case_key, label, report_count FROM s WHERE NOT (case_key LIKE '%click%' OR case_key LIKE '%view%')",
    "csv_round_trip": "SELECT d.doc_id, md5(text) AS text, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "feed_round_trip": "SELECT sha1(url) AS id, url, 'a title' AS title, 'k' AS keywords FROM pages",
    "block_list_round_trip": "SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)), '^www\\.', '') AS domain FROM pages",
    "run_results": "SELECT 'v1' AS version, 'REJECT' AS decision, count(*)::DOUBLE AS rows, NULL::DOUBLE AS ones FROM labels UNION ALL SELECT 'v2', 'PROMOTE', count(*)::DOUBLE, (count(*) FILTER (quality = 1))::DOUBLE FROM labels",
    "stored_reports": f"WITH {_REPORTS} SELECT id, case_key, source, NULL::VARCHAR AS status, created_at FROM e WHERE source = 'seed'",
    "metrics_file": f"WITH {_P} SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM q",
    "campaigns": "SELECT min(event_id) AS id, 'domain' AS match_type, count(*) AS similar_case_count, count(*) AS shared_domain_count, count(*) AS shared_sender_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id",
    "cluster_sets": """WITH r AS (SELECT c_nationkey % 5 AS k, count(*) AS reports, min(c_custkey) AS low, string_agg(DISTINCT c_mktsegment || '-' || (c_nationkey % 5), ',' ORDER BY c_mktsegment || '-' || (c_nationkey % 5)) AS senders FROM customer GROUP BY 1)
      SELECT row_number() OVER (ORDER BY low) - 1 AS cluster, reports, 'n' || k || '.com' AS domains, senders FROM r""",
    "language_bars": "SELECT lang, n AS count, floor(n * 100 / max(n) OVER () + 0.5)::INT AS percent FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)",
    "newest_events": f"""WITH n AS (SELECT user_id, event_id, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 60)::BIGINT AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
      SELECT user_id, event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || ' h ago' WHEN m < 2880 THEN 'yesterday' ELSE (m // 1440) || ' days ago' END AS told FROM n WHERE n <= 5""",
    "present_columns": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND source IS NOT NULL THEN source ELSE lang END AS place, n_chars AS size FROM documents",
    "report_texts": "SELECT doc_id, concat_ws(chr(10), 'Document ' || doc_id, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END || ' (' || (n_chars % 100) || '%)', '- first', '- ' || lang, '- ' || source) AS text FROM documents",
    "turn_similarity": f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) < 3 OR len(b.t) < 3 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS similarity
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1""",
    "seed_leakage": f"""WITH a AS (SELECT doc_id, lower(text) AS norm, lang, {_TOKENS} AS t FROM documents), b AS (SELECT item_id, lower(text) AS norm, {_TOKENS} AS t FROM benchmark),
      i AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(t) AS x FROM a) x JOIN (SELECT item_id, unnest(t) AS x FROM b) y ON x.x = y.x GROUP BY 1, 2),
      j AS (SELECT i.doc_id, max(n / (len(a.t) + len(b.t) - n)) AS s FROM i JOIN a ON i.doc_id = a.doc_id JOIN b ON i.item_id = b.item_id WHERE len(a.t) >= 3 AND len(b.t) >= 3 GROUP BY 1),
      r AS (SELECT a.doc_id AS id, a.norm IN (SELECT norm FROM b) AS same_text, lang IN ('de', 'fr') AS shared_domain, round(CASE WHEN s >= 0.30 THEN s ELSE 0 END, 6) AS similarity FROM a LEFT JOIN j ON a.doc_id = j.doc_id)
      SELECT id, same_text, shared_domain, coalesce(similarity, 0) AS similarity FROM r WHERE same_text OR shared_domain OR similarity > 0""",
}
