"""Queries that prepare datasets and evaluate classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import urls as U
from tidewatch.functions.columns import rounded
from tidewatch.lexicons import ENGLISH
from tidewatch.operators import evaluation as E
from tidewatch.operators import generators
from tidewatch.operators import relational as R
from tidewatch.operators import splits as Split
from tidewatch.plans.tables import predictions, table, urls
from tidewatch.plans.url_queries import _IP, _REG, HOSTS, URLS

FIXED = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def exact_dedupe_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang", "source")
    return R.first_of(docs, ["h"], ["doc_id"]).select("doc_id", "lang", "source")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as labels of texts: texts that several sources have."""
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("content"), "source")
    return R.conflicts(rows, "content", "source")


def conflict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.without_conflicts(_labelled(spark, sf_dir), "content", "label")
    return rows.groupBy("label").agg(F.count("*").alias("rows"), F.count_distinct("content").alias("contents"))


def anti_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd number whose trimmed text no document of even number has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.not_in(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), ["text"], trim=True).select("doc_id")


def anti_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations and segments that no supplier's nation with a negative balance has."""
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return R.not_in(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), poor, ["c_nationkey", "c_mktsegment"])


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(predictions(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_sweep(predictions(spark, sf_dir))


def fixed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_sweep(predictions(spark, sf_dir), thresholds=FIXED)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_threshold(E.threshold_sweep(predictions(spark, sf_dir)))


def recall_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_for_recall(E.threshold_sweep(predictions(spark, sf_dir)), 0.95)


def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.curve(predictions(spark, sf_dir))
    return rows.select("score", "tp", "fp", *[rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.auc(predictions(spark, sf_dir))


def group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_errors(predictions(spark, sf_dir), ["lang"])


def weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weaknesses(predictions(spark, sf_dir), ["lang", "source"])


def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return R.value_counts(rows, E.error_type(F.col("label"), F.col("predicted")))


def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as pairs: all rows of one right."""
    return E.pair_accuracy(predictions(spark, sf_dir).withColumn("pair_id", F.concat_ws("-", "source", "lang")), "pair_id")


def family_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.family_errors(predictions(spark, sf_dir), "source")


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crosstab(predictions(spark, sf_dir), "lang", "label", [0, 1])


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold of 0.6 against one of 0.5 as the candidate."""
    return E.promotion_gate(E.confusion(predictions(spark, sf_dir)), E.confusion(predictions(spark, sf_dir, 0.5)))


def robustness_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rules on documents and on their variants, as predictions of the toxic label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").select("doc_id", "text", "label")
    made = F.array(F.struct(F.lit("original").alias("type"), F.col("text")), *[F.struct(F.lit(n).alias("type"), _rewritten(n, p).alias("text")) for n, p in ENGLISH.rewrites])
    rows = docs.select(F.col("doc_id").alias("id"), "label", F.explode(made).alias("v")).select("id", "label", F.col("v.type").alias("condition"), "v.text")
    none = F.array().cast("array<string>")
    score = U.total_weight(T.text_evidence(none, F.col("text"), profile=ENGLISH))
    return E.robustness(rows.withColumn("predicted", (score >= 0.3).cast("int")))


def _rewritten(name: str, pairs):
    out = F.regexp_replace("text", "(?i)https?://", "hxxp://") if name == "url_obfuscation" else F.col("text")
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents split by text, how many went to each split, and the texts found in more than one split, of which there are none."""
    rows = Split.split_by_group(_labelled(spark, sf_dir), "content")
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("split").isNull()).alias("unassigned"), *[F.count_if(F.col("split") == n).alias(n) for n, _ in Split.SHARES]).join(R.overlaps(rows, ["content"]).agg(F.count("*").alias("leaks")))  # one row each


def domain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls(spark, sf_dir).withColumn("domain", U.registered_domain(U.host_of(F.col("url"))))
    return Split.split_by_group(rows, "domain", shares=Split.DOMAIN_SHARES)


def balanced_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents against page domains ranked by page: a hundred of each."""
    rows = urls(spark, sf_dir).withColumn("domain", U.host_of(F.col("url")))
    ip = U.is_ip(F.col("domain"))
    normal = rows.where(~ip).withColumn("rank", F.length("url"))
    return Split.balanced(rows.where(ip), normal, 100).select("url", "domain", "label")


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources.sinks import content_fingerprint as fingerprint

    return fingerprint(table(spark, sf_dir, "benchmark"))


_SPECS = [("delivery", "parcel", "Parcel {n} arrives at {time}.", "Parcel {n} is held, pay at {site}."), ("bank", "card", "Card payment {n} of {time} is done.", "Card {n} is blocked, log in at {site}.")]
_SLOTS = {"time": ["9:00", "12:30", "18:15"], "site": ["a.example.com", "b.example.net"]}


def synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.pairs(spark, _SPECS, _SLOTS, 50)


QUERIES = {
    "exact_dedupe_docs": exact_dedupe_docs, "label_conflicts": label_conflicts, "conflict_free": conflict_free, "anti_benchmark": anti_benchmark, "anti_composite": anti_composite,
    "confusion_metrics": confusion_metrics, "threshold_sweep": threshold_sweep, "fixed_thresholds": fixed_thresholds, "best_threshold": best_threshold, "recall_threshold": recall_threshold,
    "pr_points": pr_points, "roc_auc": roc_auc, "group_errors": group_errors, "weaknesses": weaknesses, "error_types": error_types, "pair_accuracy": pair_accuracy, "family_errors": family_errors,
    "crosstab": crosstab, "promotion_gate": promotion_gate, "robustness_retention": robustness_retention, "split_leakage": split_leakage, "domain_split": domain_split, "balanced_urls": balanced_urls,
    "content_fingerprint": content_fingerprint, "synthetic_pairs": synthetic_pairs,
}

_P = r"""p AS (SELECT d.doc_id, lang, source, quality AS label, toxic, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 4) ELSE 0 END AS score
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents) d JOIN labels l ON d.doc_id = l.doc_id),
q AS (SELECT *, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS predicted FROM p)"""
_CELLS = "count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp"
_RATIOS = """round(CASE WHEN tn + fp + fn + tp = 0 THEN 0 ELSE (tp + tn) / (tn + fp + fn + tp) END, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


def _sweep(grid: str) -> str:
    return f"""WITH {_P}, t AS ({grid}), c AS (SELECT threshold, count(*) FILTER (label = 0 AND score < threshold) AS tn, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
      count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 1 AND score >= threshold) AS tp FROM q CROSS JOIN t GROUP BY threshold), s AS (SELECT *, {_RATIOS} FROM c)"""


_SWEEP = _sweep("SELECT round((5 + i) / 100, 2) AS threshold FROM range(91) r(i)")
_CURVE = f"""WITH {_P}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM q GROUP BY score),
  c AS (SELECT score, p, n, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g WINDOW w AS (ORDER BY score DESC)),
  v AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS recall FROM c)"""


def _errors(by: str) -> str:
    return f"""SELECT {by}, count(*) AS total, count(*) FILTER (label = predicted) AS correct, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn,
      count(*) FILTER (label <> predicted) AS errors, round(count(*) FILTER (label = predicted) / count(*), 6) AS accuracy,
      round(CASE WHEN count(*) FILTER (label = 0) = 0 THEN 0 ELSE count(*) FILTER (label = 0 AND predicted = 1) / count(*) FILTER (label = 0) END, 6) AS fp_rate,
      round(CASE WHEN count(*) FILTER (label = 1) = 0 THEN 0 ELSE count(*) FILTER (label = 1 AND predicted = 0) / count(*) FILTER (label = 1) END, 6) AS fn_rate FROM q GROUP BY {by.split(" AS ")[0]}"""


def _variant_sql() -> str:
    parts = ["SELECT doc_id, 'original' AS condition, text FROM documents"]
    for n, pairs in ENGLISH.rewrites:
        out = "regexp_replace(text, '(?i)https?://', 'hxxp://', 'g')" if n == "url_obfuscation" else "text"
        for a, b in pairs:
            out = f"replace({out}, '{a}', '{b}')"
        parts.append(f"SELECT doc_id, '{n}', {out} FROM documents")
    return " UNION ALL ".join(parts)


_RULE = "round(least(1.0, CAST(" + " + ".join(f"CASE WHEN contains(text, '{k}') THEN {w} ELSE 0 END" for k, w in ENGLISH.keywords) + " AS DOUBLE)), 4)"
_CONF = lambda t: f"(SELECT *, {_RATIOS} FROM (SELECT {_CELLS} FROM (SELECT label, CASE WHEN score >= {t} THEN 1 ELSE 0 END AS predicted FROM p)))"
_picked = lambda name, values: f"[{', '.join(repr(v) for v in values)}][('0x' || substr(md5('42:' || id || ':{name}'), 1, 8))::BIGINT % {len(values)} + 1]"
_FILLED = "replace(t, '{n}', id::VARCHAR)"
for _name, _values in _SLOTS.items():
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', {_picked(_name, _values)})"
_TEMPLATES = " UNION ALL ".join(f"SELECT {i} AS at, {label} AS label, '{a}' AS scenario, '{b}' AS subtype, '{t}' AS t" for i, (a, b, *ts) in enumerate(_SPECS) for label, t in enumerate(ts))
ORACLES = {
    "content_fingerprint": """WITH r AS (SELECT sha256(json_object('item_id', item_id, 'text', text)::VARCHAR) AS h FROM benchmark),
      g AS (SELECT substr(h, 1, 3) AS g, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, sha256(coalesce(string_agg(h, '' ORDER BY g), '')) AS sha256 FROM g""",
    "synthetic_pairs": f"""WITH t AS ({_TEMPLATES}), n AS (SELECT range AS id FROM range({len(_SPECS) * 50}))
      SELECT id * 2 + label AS id, id AS pair_id, {_FILLED} AS text, label, scenario, subtype FROM n JOIN t ON n.id % {len(_SPECS)} = t.at""",
    "exact_dedupe_docs": "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "label_conflicts": "SELECT md5(text) AS content, count(DISTINCT source) AS labels, count(*) AS rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "conflict_free": """WITH r AS (SELECT md5(text) AS content, toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT content FROM r GROUP BY content HAVING count(DISTINCT label) = 1)
      SELECT label, count(*) AS rows, count(DISTINCT content) AS contents FROM r WHERE content IN (SELECT content FROM k) GROUP BY label""",
    "anti_benchmark": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND trim(text) NOT IN (SELECT trim(text) FROM documents WHERE doc_id % 2 = 0)",
    "anti_composite": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0))",
    "confusion_metrics": f"WITH {_P} SELECT *, {_RATIOS} FROM (SELECT {_CELLS} FROM q)",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM s",
    "fixed_thresholds": _sweep("SELECT unnest([" + ", ".join(map(str, FIXED)) + "])::DOUBLE AS threshold") + " SELECT * FROM s",
    "best_threshold": f"{_SWEEP} SELECT * FROM s ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1",
    "recall_threshold": f"{_SWEEP} SELECT * FROM s WHERE recall >= 0.95 ORDER BY precision DESC, f1 DESC, threshold DESC LIMIT 1",
    "pr_points": f"{_CURVE} SELECT score, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-12), 6) AS f1 FROM v",
    "roc_auc": f"""{_CURVE} SELECT CASE WHEN max(np) > 0 AND max(nn) > 0 THEN round(CAST(sum((tp - p) * n + 0.5 * p * n) AS DOUBLE) / CAST(max(np) * max(nn) AS DOUBLE), 6) END AS roc_auc, round(sum(precision * p) / CAST(max(np) AS DOUBLE), 6) AS average_precision FROM v""",
    "group_errors": f"WITH {_P} {_errors('lang')}",
    "weaknesses": f"WITH {_P} SELECT *, 'lang' AS level FROM ({_errors('lang AS name')}) UNION ALL SELECT *, 'source' FROM ({_errors('source AS name')})",
    "error_types": f"WITH {_P} SELECT CASE WHEN label = predicted THEN 'CORRECT' WHEN predicted = 1 THEN 'FP' ELSE 'FN' END AS value, count(*) AS n FROM q GROUP BY 1",
    "pair_accuracy": f"WITH {_P} SELECT count(*) AS pairs, round(avg(ok), 6) AS accuracy FROM (SELECT CASE WHEN bool_and(label = predicted) THEN 1 ELSE 0 END AS ok FROM q GROUP BY source || '-' || lang)",
    "family_errors": f"WITH {_P} SELECT source, count(*) AS rows, round(avg(predicted), 6) AS fp_rate, round(avg(score), 6) AS mean_score FROM q WHERE label = 0 GROUP BY source",
    "crosstab": f"WITH {_P} SELECT lang, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM q GROUP BY lang",
    "promotion_gate": f"""WITH {_P}, d AS (SELECT round(b.f1 - a.f1, 6) AS delta_f1, round(b.precision - a.precision, 6) AS delta_precision, b.fp - a.fp AS delta_fp FROM {_CONF(0.6)} a CROSS JOIN {_CONF(0.5)} b)
      SELECT *, CASE WHEN delta_f1 >= 0 AND delta_precision >= 0 AND delta_fp <= 0 THEN 'PROMOTE' ELSE 'REJECT' END AS decision FROM d""",
    "robustness_retention": f"""WITH v AS ({_variant_sql()}), q AS (SELECT v.doc_id, condition, toxic AS label, CASE WHEN {_RULE} >= 0.3 THEN 1 ELSE 0 END AS predicted FROM v JOIN labels l ON v.doc_id = l.doc_id),
      o AS (SELECT doc_id, predicted AS was FROM q WHERE condition = 'original'), c AS (SELECT condition, {_CELLS}, count(*) FILTER (label = 1 AND was = 1 AND predicted = 1) AS retained,
        count(*) FILTER (label = 1 AND was = 1 AND predicted = 0) AS evaded FROM q JOIN o ON q.doc_id = o.doc_id GROUP BY condition),
      r AS (SELECT *, {_RATIOS}, round(CASE WHEN retained + evaded = 0 THEN 0 ELSE retained / (retained + evaded) END, 6) AS retention FROM c), b AS (SELECT accuracy AS a0, recall AS r0, f1 AS f0 FROM r WHERE condition = 'original')
      SELECT r.*, round(a0 - accuracy, 6) AS accuracy_drop, round(r0 - recall, 6) AS recall_drop, round(f0 - f1, 6) AS f1_drop FROM r CROSS JOIN b""",
    "domain_split": f"""WITH RECURSIVE {URLS}, {HOSTS}, r AS (SELECT url, {_REG} AS domain FROM h), g AS (SELECT domain, count(*) AS n FROM r GROUP BY domain),
      o AS (SELECT domain, n, row_number() OVER (ORDER BY n DESC, md5('42:' || domain), domain) AS i, CAST(sum(n) OVER () AS DOUBLE) AS t FROM g),
      d AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS domain, ''::VARCHAR AS split, 0.7 * max(t) AS a, 0.15 * max(t) AS b, 0.15 * max(t) AS c FROM o
        UNION ALL SELECT o.i, o.domain, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END, CASE WHEN a >= b AND a >= c THEN a - n ELSE a END,
          CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN b - n ELSE b END, CASE WHEN NOT (a >= b AND a >= c) AND b < c THEN c - n ELSE c END FROM d JOIN o ON o.i = d.i + 1)
      SELECT url, r.domain, split FROM r JOIN d ON r.domain = d.domain""",
    "balanced_urls": f"""WITH {URLS}, {HOSTS}, r AS (SELECT url, h AS domain, {_IP} AS ip FROM h), p AS (SELECT url, domain, 1 AS label FROM r WHERE ip ORDER BY md5('42:' || url), url LIMIT 100),
      n AS (SELECT url, domain, 0 AS label FROM r WHERE NOT ip AND domain NOT IN (SELECT domain FROM r WHERE ip) ORDER BY length(url), domain, url LIMIT 100) SELECT * FROM p UNION ALL SELECT * FROM n""",
    "split_leakage": """WITH RECURSIVE r AS (SELECT md5(text) AS content FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT content, count(*) AS n FROM r GROUP BY content),
      o AS (SELECT content, n, row_number() OVER (ORDER BY n DESC, md5('42:' || content), content) AS i, CAST(sum(n) OVER () AS DOUBLE) AS t FROM g),
      d AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS content, ''::VARCHAR AS split, 0.8 * max(t) AS a, 0.1 * max(t) AS b, 0.1 * max(t) AS c FROM o
        UNION ALL SELECT o.i, o.content, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END, CASE WHEN a >= b AND a >= c THEN a - n ELSE a END,
          CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN b - n ELSE b END, CASE WHEN NOT (a >= b AND a >= c) AND b < c THEN c - n ELSE c END FROM d JOIN o ON o.i = d.i + 1),
      s AS (SELECT r.content, d.split FROM r LEFT JOIN d ON r.content = d.content)
      SELECT count(*) AS rows, count(*) FILTER (split IS NULL) AS unassigned, (SELECT count(*) FROM (SELECT content FROM s GROUP BY content HAVING count(DISTINCT split) > 1)) AS leaks,
        count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM s""",
}
