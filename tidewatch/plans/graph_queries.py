"""Queries over reports with senders, hosts and tokens: the whole graph, its matches, campaigns and clusters batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import graph as G
from tidewatch.operators import incremental as I
from tidewatch.operators import suffixes
from tidewatch.operators.components import shared_folder, stored
from tidewatch.plans.tables import CHAT, table, turn_reports

AS_OF = "2024-01-15 00:00:00"
#: Some public suffix rules, with wildcards and exceptions.
RULES = ("com", "net", "org", "kr", "co.kr", "go.kr", "seoul.kr", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "us", "ma.us", "k12.ma.us", "pvt.k12.ma.us")
#: Endings of the hosts that customers get, whatever rule they fall under.
ENDINGS = ("com", "co.kr", "ck", "town.ck", "www.ck", "kawasaki.jp", "ward.kawasaki.jp", "city.kawasaki.jp", "k12.ma.us", "pvt.k12.ma.us", "unknown", "go.kr", "uk")


def _known(spark: SparkSession, sf_dir: str):
    rows = stored(G.prepared(turn_reports(spark, sf_dir), CHAT).drop("words"), "chat")
    return rows, G.clusters(rows)


def chat_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, senders and, in each cluster, the strong tokens of all turns."""
    rows, members = _known(spark, sf_dir)
    return G.nodes(rows, members, CHAT).select("id", "label", "type", F.col("cluster").cast("long").alias("cluster"))


def chat_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each turn's first entity to its others, and between hosts of a domain."""
    rows, members = _known(spark, sf_dir)
    return G.edges(rows, members, stored(G.nodes(rows, members, CHAT), "nodes"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_reports(spark, sf_dir).select("id", "sender", "domains", "tokens")


def chat_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every turn as an input: by its domain, else its sender, else its strong tokens."""
    rows, members = _known(spark, sf_dir)
    found = G.match(_inputs(spark, sf_dir), rows, members, CHAT)
    return found.select("id", F.col("cluster").cast("long").alias("cluster"), "match_type", "shared", "similar")


def chat_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the cluster that every turn matches: counts, the last day's reports and the status."""
    rows, members = _known(spark, sf_dir)
    found = G.campaigns(_inputs(spark, sf_dir), rows, members, AS_OF, CHAT)
    return found.withColumn("cluster", F.col("cluster").cast("long"))


def incremental_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all turns, added in four batches by the time they were reported."""
    rows = G.prepared(turn_reports(spark, sf_dir), CHAT)
    state = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    day = F.floor(F.datediff("created_at", F.lit("2024-01-01")) / 6)
    dealt = stored(rows.withColumn("batch", F.least(day, F.lit(3))), "dealt")
    for number in range(4):
        I.add(state, dealt.where(F.col("batch") == number).drop("batch"), number)
    return I.clusters(spark, state).select("id", "root", F.col("cluster").cast("long").alias("cluster"))


def suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffix and registered domain of a host for each customer, by rules with wildcards and exceptions."""
    n = F.col("c_custkey")
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (n % len(ENDINGS) + 1).cast("int"))
    host = F.concat(F.when(n % 4 == 0, "www.M.").when(n % 4 == 1, "m.").when(n % 4 == 2, "").otherwise("a.b.c."), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("shop"), (n % 40).cast("string"), F.lit("."))), ending)
    rows = table(spark, sf_dir, "customer").select("c_custkey", host.alias("host"))
    known = suffixes.rules(spark.createDataFrame([("// rules",), ("",), *[(r,) for r in RULES]], "value string"))
    return rows.join(suffixes.registered(rows, known), "host").select("c_custkey", "host", "suffix", "domain")


QUERIES = {f.__name__: f for f in (chat_graph_nodes, chat_graph_edges, chat_match, chat_campaigns, incremental_clusters, suffix_rules)}

_STRONG = ", ".join(f"'{w}'" for w in CHAT.strong_tokens)
#: Reports, their link keys and, over the keys, which reach each other: there are far fewer keys than reports.
_CHAT = f"""WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 'n' || conv_id END AS sender, CASE WHEN turn = 0 THEN 's' || (conv_id // 12) || '.com' END AS reg,
    CASE WHEN turn = 0 THEN 'h' || (conv_id % 3) || '.s' || (conv_id // 12) || '.com' END AS host,
    list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda w: w IN ({_STRONG}))) AS strong,
    TIMESTAMP '2024-01-01' + to_hours(conv_id * 37 % 480) + to_minutes(turn) AS ts FROM conversations),
  t AS (SELECT id, unnest(strong) AS w FROM e),
  k AS (SELECT id, 'd:' || reg AS k FROM e WHERE reg IS NOT NULL UNION SELECT id, 's:' || sender FROM e WHERE sender IS NOT NULL UNION SELECT a.id, 'p:' || a.w || ':' || b.w FROM t a JOIN t b ON a.id = b.id AND a.w < b.w),
  l AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b ON a.id = b.id), r AS (SELECT k AS a, k AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  low AS (SELECT k, min(id) AS id FROM k GROUP BY k), top AS (SELECT a AS k, min(low.id) AS root FROM r JOIN low ON r.b = low.k GROUP BY a),
  roots AS (SELECT e.id, coalesce(min(top.root), e.id) AS root FROM e LEFT JOIN k ON k.id = e.id LEFT JOIN top ON top.k = k.k GROUP BY e.id),
  m AS (SELECT id, root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster FROM roots),
  c AS (SELECT e.*, m.cluster FROM e JOIN m USING (id)),
  common AS (SELECT w FROM t GROUP BY w HAVING count(DISTINCT id) >= 2),
  nodes AS (SELECT 'url:' || host AS id, host AS label, 'url' AS type, min_by(cluster, id) AS cluster FROM c WHERE host IS NOT NULL GROUP BY host
    UNION ALL SELECT 'num:' || sender, sender, 'number', min_by(cluster, id) FROM c WHERE sender IS NOT NULL GROUP BY sender
    UNION ALL SELECT DISTINCT 'phrase:' || cluster || ':' || w, w, 'phrase', cluster FROM t JOIN m USING (id) SEMI JOIN common USING (w))"""
_MATCH = """, ct AS (SELECT DISTINCT cluster, w FROM t JOIN m USING (id)),
  most AS (SELECT t.id, cluster, count(*) AS n FROM t JOIN ct USING (w) GROUP BY ALL),
  best AS (SELECT id, max(n) AS shared, arg_max(cluster, n * 1000000 - cluster) AS cluster FROM most GROUP BY id HAVING max(n) >= 2),
  near AS (SELECT a.id, m.cluster, b.id AS other, count(*) AS n FROM t a JOIN t b ON a.w = b.w JOIN m ON m.id = b.id GROUP BY ALL HAVING count(*) >= 2),
  alike AS (SELECT id, cluster, count(*) AS "similar" FROM near GROUP BY ALL),
  match AS (SELECT c.id, CASE WHEN reg IS NOT NULL THEN dc.cluster WHEN sender IS NOT NULL THEN sc.cluster ELSE best.cluster END AS cluster,
      CASE WHEN reg IS NOT NULL THEN 'domain' WHEN sender IS NOT NULL THEN 'sender' ELSE 'strong_phrase' END AS match_type,
      CASE WHEN reg IS NULL AND sender IS NULL THEN best.shared ELSE 0 END AS shared, CASE WHEN reg IS NULL AND sender IS NULL THEN alike."similar" ELSE 0 END AS "similar"
    FROM c LEFT JOIN (SELECT reg, min(cluster) AS cluster FROM c GROUP BY reg) dc USING (reg) LEFT JOIN (SELECT sender, min(cluster) AS cluster FROM c GROUP BY sender) sc USING (sender)
    LEFT JOIN best ON best.id = c.id LEFT JOIN alike ON alike.id = c.id AND alike.cluster = best.cluster WHERE reg IS NOT NULL OR sender IS NOT NULL OR alike."similar" >= 2)"""
_RULES = ", ".join(f"'{r}'" for r in RULES)
ORACLES = {
    "chat_graph_nodes": f"{_CHAT} SELECT id, label, type, cluster FROM nodes",
    "chat_graph_edges": f"""{_CHAT}, ents AS (SELECT id, 0 AS o, 'url:' || host AS n FROM c WHERE host IS NOT NULL UNION SELECT id, 1, 'num:' || sender FROM c WHERE sender IS NOT NULL
        UNION SELECT t.id, 2, 'phrase:' || cluster || ':' || w FROM t JOIN m USING (id) SEMI JOIN common USING (w)),
      a AS (SELECT id, arg_min(n, (o, n)) AS anchor FROM ents GROUP BY id), h AS (SELECT DISTINCT host, min(host) OVER (PARTITION BY reg) AS low FROM e WHERE host IS NOT NULL),
      u AS (SELECT anchor AS x, n AS y FROM ents JOIN a USING (id) WHERE n <> anchor UNION SELECT 'url:' || low, 'url:' || host FROM h WHERE low <> host)
      SELECT DISTINCT least(x, y) AS source, greatest(x, y) AS target FROM u""",
    "chat_match": f'{_CHAT} {_MATCH} SELECT id, cluster, match_type, shared, "similar" FROM match',
    "chat_campaigns": f"""{_CHAT} {_MATCH}, s AS (SELECT cluster, count(*) AS similar_case_count, min(ts) AS first_seen, max(ts) AS last_seen,
        count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) AS reports_last_24h FROM c GROUP BY cluster)
      SELECT x.id, x.cluster, x.match_type, similar_case_count, (SELECT count(*) FROM c b WHERE b.cluster = x.cluster AND b.reg = i.reg) AS shared_domain_count,
        (SELECT count(*) FROM c b WHERE b.cluster = x.cluster AND b.sender = i.sender) AS shared_sender_count, coalesce(al."similar", 0) AS similar_phrase_count, first_seen, last_seen, reports_last_24h,
        CASE WHEN reports_last_24h >= 5 THEN 'rapidly_spreading' WHEN reports_last_24h >= 1 THEN 'active' ELSE 'historical' END AS status
      FROM match x JOIN e i USING (id) JOIN s ON s.cluster = x.cluster LEFT JOIN alike al ON al.id = x.id AND al.cluster = x.cluster""",
    "incremental_clusters": f"{_CHAT} SELECT id, root, cluster FROM m",
    "suffix_rules": f"""WITH h AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'www.M.' WHEN 1 THEN 'm.' WHEN 2 THEN '' ELSE 'a.b.c.' END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'shop' || (c_custkey % 40) || '.' END
        || [{", ".join(f"'{x}'" for x in ENDINGS)}][c_custkey % {len(ENDINGS)} + 1] AS host FROM customer),
      s AS (SELECT *, string_split(lower(host), '.') AS a FROM h), rule AS (SELECT unnest([{_RULES}]) AS r),
      p AS (SELECT a, r, len(string_split(ltrim(r, '!'), '.')) AS n FROM (SELECT DISTINCT a FROM s) JOIN rule
        ON len(a) >= len(string_split(ltrim(r, '!'), '.')) AND (array_to_string(a[-len(string_split(ltrim(r, '!'), '.')):], '.') = ltrim(r, '!')
          OR (starts_with(r, '*.') AND array_to_string(a[-len(string_split(r, '.')) + 1:], '.') = r[3:]))),
      k AS (SELECT a, coalesce(max(n - 1) FILTER (starts_with(r, '!')), max(n), 1) AS n FROM p GROUP BY a)
      SELECT c_custkey, host, array_to_string(s.a[-coalesce(k.n, 1):], '.') AS suffix, CASE WHEN len(s.a) > coalesce(k.n, 1) THEN array_to_string(s.a[-coalesce(k.n, 1) - 1:], '.') ELSE array_to_string(s.a[-2:], '.') END AS domain
      FROM s LEFT JOIN k ON k.a = s.a""",
}
