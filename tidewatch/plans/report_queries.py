"""Queries over reports, cases, the entity graph and the feed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import feed as A
from tidewatch.lexicons import ENGLISH
from tidewatch.operators import feed as Feed
from tidewatch.operators import graph as G
from tidewatch.operators import reports as P
from tidewatch.operators.components import connected_components, stored
from tidewatch.plans.tables import day_reports, event_reports, page_reports, table
from tidewatch.plans.url_queries import _REG, HOSTS, PAGES
from tidewatch.sources.readers import alerts_from_pages

AS_OF = "2024-01-20 00:00:00"


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of user 3 is verified normal."""
    rows = event_reports(spark, sf_dir).where("sender = '3'").groupBy("case_key").agg(F.max("created_at").alias("approved_at"))
    return rows.select("case_key", F.lit(0).alias("label"), "approved_at")


def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cases(event_reports(spark, sf_dir), _approvals(spark, sf_dir)).select("case_key", "report_count", "has_seed", "first_seen", "last_seen", "status")


def training_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.training_candidates(event_reports(spark, sf_dir), _approvals(spark, sf_dir))
    return rows.select("case_key", "text", "sender", "report_count", "first_seen", "last_seen")


def approved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.approved_samples(event_reports(spark, sf_dir), _approvals(spark, sf_dir)).select("case_key", "label", "approved_at", "text", "sender", "report_count")


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.case_summary(P.with_status(event_reports(spark, sf_dir))).select("case_key", "status", "report_count", "first_seen", "last_seen")


def retraining_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.retraining_ready(P.approved_samples(event_reports(spark, sf_dir), _approvals(spark, sf_dir)))


def campaign_activity_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sender's reports until the time of asking, and of those of the last day the status."""
    now = F.lit(AS_OF).cast("timestamp")
    rows = event_reports(spark, sf_dir).where(F.col("created_at") <= now).groupBy("sender")
    out = rows.agg(F.count("*").alias("reports"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("last_day"))
    return out.withColumn("status", G.campaign_status(F.col("last_day")))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a part are linked; a component's label is its smallest supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    low = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("src"))
    return connected_components(lines.join(low, "l_partkey").select("src", F.col("l_suppkey").alias("dst")))


def _graph(spark: SparkSession, sf_dir: str):
    rows = stored(G.prepared(page_reports(spark, sf_dir), ENGLISH).drop("words"), "pages")
    return rows, G.clusters(rows)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes(*_graph(spark, sf_dir), ENGLISH).select("id", "label", "type", F.col("cluster").cast("long").alias("cluster"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = _graph(spark, sf_dir)
    return G.edges(rows, members, stored(G.nodes(rows, members, ENGLISH), "nodes"))


def cluster_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = _graph(spark, sf_dir)
    return G.cluster_table(rows, members, G.nodes(rows, members, ENGLISH)).select(F.col("cluster").cast("long").alias("cluster"), "report_count", "domain_count", "size", "risk")


def top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(graph_edges(spark, sf_dir))


def cluster_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = _graph(spark, sf_dir)
    found = G.match(page_reports(spark, sf_dir).select("id", "sender", "domains", "tokens"), rows, members, ENGLISH)
    return found.select(F.col("id").alias("page_id"), F.col("cluster").cast("long").alias("cluster"), "match_type")


def _senders(spark: SparkSession, sf_dir: str, every: int = 1):
    rows = stored(G.prepared(day_reports(spark, sf_dir, every), ENGLISH).drop("words"), "days")
    return rows, G.clusters(rows)


def sender_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and senders of reports that domains and senders link."""
    return G.nodes(*_senders(spark, sf_dir), ENGLISH).select("id", "label", "type", F.col("cluster").cast("long").alias("cluster"))


def sender_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between hosts of a domain, and from a report's host to its sender, which every 199th event names, as the SQL has it."""
    rows, members = _senders(spark, sf_dir, 199)
    return G.edges(rows, members, stored(G.nodes(rows, members, ENGLISH), "nodes"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Feed.classified(alerts_from_pages(table(spark, sf_dir, "pages")), ENGLISH)
    return rows.select("id", "url", "title", "category", F.array_join("keywords", ",").alias("keywords"))


def feed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as a feed, dated by their page: newest twenty."""
    date = F.concat(F.lit("2024."), (F.col("page_id") % 12 + 1).cast("string"), F.lit("."), (F.col("page_id") % 28 + 1).cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", A.iso_date(date).alias("published_at"))
    rows = pages.select(F.sha1(F.col("url").cast("binary")).alias("id"), "url", "published_at", "page_id")
    return Feed.top_items(Feed.distinct_items(rows)).select("id", "url", "published_at")


def feed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts_from_pages(table(spark, sf_dir, "pages"), source="feed")
    return rows.select("id", A.summary(F.col("source"), F.col("title")).alias("summary"))


QUERIES = {
    "case_status": case_status, "training_candidates": training_candidates, "approved_samples": approved_samples, "case_summary": case_summary, "retraining_gate": retraining_gate,
    "campaign_activity_24h": campaign_activity_24h, "components": components, "graph_nodes": graph_nodes, "graph_edges": graph_edges, "cluster_risk": cluster_risk, "top_degree": top_degree,
    "cluster_match": cluster_match, "sender_graph_nodes": sender_graph_nodes, "sender_graph_edges": sender_graph_edges, "feed_items": feed_items, "feed_topk": feed_topk, "feed_summaries": feed_summaries,
}

_REPORTS = """e AS (SELECT event_id AS id, props AS text, CAST(user_id AS VARCHAR) AS sender, user_id || '-' || event_type || '-' || CAST(ts AS DATE) AS case_key,
  CASE WHEN event_id % 97 = 0 THEN 'seed' ELSE 'user' END AS source, ts AS created_at FROM events),
ap AS (SELECT case_key, 0 AS label, max(created_at) AS approved_at FROM e WHERE sender = '3' GROUP BY case_key),
c AS (SELECT case_key, count(*) AS report_count, bool_or(source = 'seed') AS has_seed, min(created_at) AS first_seen, max(created_at) AS last_seen FROM e GROUP BY case_key)"""
_STATUS = "CASE WHEN has_seed OR report_count >= 5 THEN 'confirmed' WHEN report_count >= 2 THEN 'suspected' ELSE 'pending' END"
_GRAPH = f"""WITH {PAGES}, {HOSTS}, p AS (SELECT DISTINCT page_id, i.h AS host, {_REG.replace("h,", "i.h,").replace("ELSE h", "ELSE i.h")} AS reg FROM pages JOIN (SELECT DISTINCT url, h FROM h) i ON pages.url = i.url),
  root AS (SELECT reg, min(page_id) AS root FROM p GROUP BY reg), num AS (SELECT reg, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster FROM root),
  edges AS (SELECT DISTINCT least('url:' || a, 'url:' || host) AS source, greatest('url:' || a, 'url:' || host) AS target FROM (SELECT host, min(host) OVER (PARTITION BY reg) AS a FROM (SELECT DISTINCT host, reg FROM p)) WHERE a <> host)"""
_TITLE = r"replace(regexp_replace(CASE WHEN regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) <> '' THEN regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END, '<[^>]*>', ' ', 'g'), '&amp;', '&')"
_TITLE = rf"regexp_replace(regexp_replace({_TITLE}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_and = lambda ws: " AND ".join(f"contains(title, '{w}')" for w in ws)
_CATEGORY = "CASE " + " ".join(f"WHEN {_and(ws)} THEN '{n}'" for ws, n in ENGLISH.title_categories) + f" ELSE '{ENGLISH.title_category_default}' END"
_KEYWORDS = "list_filter([" + ", ".join(f"'{k}'" for k in ENGLISH.title_keywords) + "], lambda k: contains(lower(title), lower(k)))"


def _days(sender: str) -> str:
    """Events as reports, their keys, which reach each other, and the clusters of keys."""
    return f"""WITH RECURSIVE d AS (SELECT event_id AS id, {sender} AS sender, event_type || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS reg FROM events),
  e AS (SELECT id, sender, reg, 'h' || (id % 3) || '.' || reg || '.test' AS host FROM d),
  k AS (SELECT id, 'd' || reg AS k FROM e UNION SELECT id, 's' || sender FROM e WHERE sender IS NOT NULL),
  l AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b ON a.id = b.id WHERE a.id IN (SELECT id FROM e WHERE sender IS NOT NULL) AND b.id IN (SELECT id FROM e WHERE sender IS NOT NULL)),
  r AS (SELECT k AS a, k AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  low AS (SELECT k, min(id) AS id FROM k GROUP BY k), top AS (SELECT a AS k, min(id) AS root FROM r JOIN low ON r.b = low.k GROUP BY a),
  num AS (SELECT k, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster FROM top)"""


ORACLES = {
    "sender_graph_nodes": f"""{_days("CAST(user_id AS VARCHAR)")} SELECT DISTINCT 'url:' || host AS id, host AS label, 'url' AS type, cluster FROM e JOIN num ON num.k = 'd' || reg
      UNION SELECT 'num:' || sender, sender, 'number', cluster FROM e JOIN num ON num.k = 's' || sender""",
    "sender_graph_edges": f"""{_days("CASE WHEN event_id % 199 = 0 THEN CAST(user_id AS VARCHAR) END")}, h AS (SELECT DISTINCT host, min(host) OVER (PARTITION BY reg) AS m FROM e), u AS (SELECT 'url:' || m AS a, 'url:' || host AS b FROM h WHERE m <> host
      UNION SELECT 'url:' || host, 'num:' || sender FROM e WHERE sender IS NOT NULL) SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target FROM u""",
    "case_status": f"WITH {_REPORTS} SELECT c.*, CASE WHEN ap.label = 0 THEN 'false_positive' ELSE {_STATUS} END AS status FROM c LEFT JOIN ap ON c.case_key = ap.case_key",
    "training_candidates": f"""WITH {_REPORTS} SELECT e.case_key, min(text) AS text, min(sender) AS sender, count(*) AS report_count, min(created_at) AS first_seen, max(created_at) AS last_seen
      FROM e JOIN c ON e.case_key = c.case_key WHERE source = 'user' AND {_STATUS.replace("report_count", "c.report_count")} = 'confirmed' AND e.case_key NOT IN (SELECT case_key FROM ap) GROUP BY e.case_key""",
    "approved_samples": f"WITH {_REPORTS} SELECT e.case_key, label, approved_at, min(text) AS text, min(sender) AS sender, count(*) AS report_count FROM e JOIN ap ON e.case_key = ap.case_key GROUP BY 1, 2, 3",
    "case_summary": f"WITH {_REPORTS} SELECT case_key, {_STATUS} AS status, report_count, first_seen, last_seen FROM c",
    "retraining_gate": f"WITH {_REPORTS} SELECT count(*) AS samples, count(*) >= 20 AS ready FROM ap",
    "campaign_activity_24h": f"""WITH {_REPORTS}, s AS (SELECT sender, count(*) AS reports, min(created_at) AS first_seen, max(created_at) AS last_seen,
      count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) AS last_day FROM e WHERE created_at <= TIMESTAMP '{AS_OF}' GROUP BY sender)
      SELECT *, CASE WHEN last_day >= 5 THEN 'rapidly_spreading' WHEN last_day >= 1 THEN 'active' ELSE 'historical' END AS status FROM s""",
    "components": """WITH RECURSIVE l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
      n AS (SELECT DISTINCT a.s AS a, b.s AS b FROM (SELECT p, min(s) AS s FROM l GROUP BY p) a JOIN l b ON a.p = b.p), e AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
      r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS vertex, min(least(a, b)) AS component FROM r GROUP BY a""",
    "graph_nodes": f"{_GRAPH} SELECT DISTINCT 'url:' || host AS id, host AS label, 'url' AS type, cluster FROM p JOIN num ON p.reg = num.reg",
    "graph_edges": f"{_GRAPH} SELECT source, target FROM edges",
    "cluster_risk": f"""{_GRAPH} SELECT cluster, count(*) AS report_count, count(DISTINCT p.reg) AS domain_count, count(DISTINCT host) AS size,
      round(least(0.95, CAST(0.40 + 0.06 * count(*) + 0.03 * count(DISTINCT p.reg) AS DOUBLE)), 4) AS risk FROM p JOIN num ON p.reg = num.reg GROUP BY cluster""",
    "top_degree": f"{_GRAPH} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 4",
    "cluster_match": f"{_GRAPH} SELECT page_id, cluster, 'domain' AS match_type FROM p JOIN num ON p.reg = num.reg",
    "feed_items": f"""WITH t AS (SELECT url, {_TITLE} AS title FROM pages) SELECT sha1(url) AS id, url, title, {_CATEGORY} AS category,
      CASE WHEN len({_KEYWORDS}) > 0 THEN array_to_string({_KEYWORDS}[1:5], ',') ELSE '{ENGLISH.title_default}' END AS keywords FROM t WHERE title <> '' AND ({" OR ".join(f"contains(title, '{k}')" for k in ENGLISH.alert_keywords)})""",
    "feed_topk": """WITH t AS (SELECT sha1(url) AS id, url, '2024-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS published_at FROM pages)
      SELECT id, url, max(published_at) AS published_at FROM t GROUP BY id, url ORDER BY published_at DESC, id LIMIT 20""",
    "feed_summaries": rf"""WITH t AS (SELECT url, {_TITLE} AS title FROM pages) SELECT sha1(url) AS id, 'feed에서 ''' || trim(regexp_replace(title, '^\s*\[.*?\]\s*', '')) || ''' 관련 안전 정보를 안내하고 있습니다. 의심스러운 연락은 공식 기관의 채널을 통해 직접 확인하세요.' AS summary FROM t WHERE title <> ''""",
}
