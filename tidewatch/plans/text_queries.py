"""Queries over texts, with their SQL where the patterns are those of both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.functions import urls as U
from tidewatch.lexicons import ENGLISH
from tidewatch.operators import model as M
from tidewatch.operators.similarity import best_similarity
from tidewatch.plans.tables import table


def nfkc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("norm_sha256"))


def preprocess_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(None).cast("string").alias("sender"))
    return T.preprocess(rows).select("conv_id", "turn", "urls", "domains", F.size("tokens").alias("n_tokens"), F.length("masked").alias("masked_length"))


def document_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and domains in documents, with their structure score."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.found_urls(T.repaired_for_urls(F.col("text"))).alias("urls"))
    each = rows.select("doc_id", F.explode("urls").alias("url"))
    return U.url_rules(each, profile=ENGLISH).select("doc_id", "url", "rule_score")


def keyword_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").withColumn("e", T.text_evidence(none, F.col("text"), profile=ENGLISH))
    return rows.select("doc_id", U.total_weight(F.col("e")).alias("rule_score"), F.size("e").cast("long").alias("n_evidence"))


def category_trends_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(T.categories(F.col("text"), ENGLISH)).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(5)


def message_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    rows = rows.withColumns({"template": T.template(F.col("text")), "family": T.family(F.col("text"), F.col("label"), ENGLISH)})
    return rows.select("doc_id", "family", F.length("template").cast("long").alias("template_length"), T.group_id(F.col("label"), F.col("family"), F.col("template")).alias("group_id"))


def token_presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_flags(T.for_model(table(spark, sf_dir, "documents").select("doc_id", "text"), name="model_text"), "model_text")
    return rows.select("doc_id", *[name for _, name in T.FLAGS])


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token statistics after particles, stop words and short tokens are gone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0)).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size(T.meaning_tokens(F.col("t"), ENGLISH)).cast("long").alias("n_meaning"))


def benchmark_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's Jaccard similarity to the most similar benchmark item, from 0.10."""
    tokens = lambda df, key: df.select(F.col(key).alias("id"), T.similarity_tokens(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0)), ENGLISH).alias("tokens"))
    found = best_similarity(tokens(table(spark, sf_dir, "documents"), "doc_id"), tokens(table(spark, sf_dir, "benchmark"), "item_id"), 0.10)
    return found.select(F.col("left_id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


def adversarial_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.variants(F.col("text"), ENGLISH)).alias("v"))
    return rows.select("conv_id", "turn", "v.type", "v.text")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stand-in for the model's probability, the keyword rules and, by doc_id, a reputation and a cluster."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", ((F.col("n_chars") % 997) / 997.0).alias("model"), ((F.col("doc_id") % 7) / 10.0).alias("reputation"))
    rows = rows.withColumn("rule", U.total_weight(T.text_evidence(none, F.col("text"), profile=ENGLISH)))
    return rows.withColumns({"reports": F.col("doc_id") % 5, "risk": S.cluster_risk(F.col("doc_id") % 5, F.col("doc_id") % 3)})


def fused_score_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.fuse(F.col("model"), F.col("rule"), F.col("reputation"))
    return _signals(spark, sf_dir).select("doc_id", score.alias("score"), S.level(score).alias("level"))


def display_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    strong = F.col("reports") > 0
    rows = rows.withColumn("score", S.with_cluster(S.fuse(F.col("model"), F.col("rule"), F.col("reputation")), strong, F.col("risk"))).withColumn("support", S.supports(strong, F.col("risk"), F.col("reports")))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("score", S.benign_adjusted(F.col("text"), F.col("score"), F.col("rule"), F.col("reputation"), none, F.col("support"), ENGLISH))
    rows = rows.withColumns(S.uncertainty(F.col("model"), F.col("rule"), F.col("reputation"), F.col("score"), F.col("support")))
    rows = rows.withColumns({"risk_score": S.displayed(F.col("score"), F.col("rule"), F.col("reputation"), F.col("support")), "level": S.level(F.col("score"))})
    return rows.select("doc_id", "risk_score", "level", "confidence", "review_required", "signal_agreement", "signal_disagreement")


def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence and the number of sentences that explain it."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").withColumn("e", T.text_evidence(none, F.col("text"), profile=ENGLISH))
    rows = rows.withColumn("d", S.distinct_evidence(F.concat("e", "e"))).withColumn("s", U.total_weight(F.col("d")))
    told = S.reasons(F.col("d"), S.level(F.col("s")), F.col("s"), F.lit(None).cast("string"), F.lit(0))
    return rows.select("doc_id", F.size("d").cast("long").alias("n_distinct"), F.size(told).cast("long").alias("n_reasons"))


def message_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    return rows.withColumns(S.message_risk(F.col("model"))).select("doc_id", "risk_level", "verdict")


def lr_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the n-gram model, trained on the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = M.fit(rows)
    return M.predict(model, docs).select("doc_id", "probability")


QUERIES = {
    "nfkc_normalize": nfkc_normalize, "preprocess_messages": preprocess_messages, "document_urls": document_urls, "keyword_rule_score": keyword_rule_score, "category_trends_topk": category_trends_topk,
    "message_templates": message_templates, "token_presence_flags": token_presence_flags, "document_tokens": document_tokens, "benchmark_similarity": benchmark_similarity,
    "adversarial_variants": adversarial_variants, "fused_score_level": fused_score_level, "display_confidence": display_confidence, "evidence_reasons": evidence_reasons,
    "message_risk": message_risk, "lr_model_scores": lr_model_scores,
}

_any = lambda x, parts: "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
_RULE = "round(least(1.0, CAST(" + " + ".join(f"CASE WHEN contains(text, '{k}') THEN {w} ELSE 0 END" for k, w in ENGLISH.keywords) + " AS DOUBLE)), 4)"
_N_EVIDENCE = " + ".join(f"CASE WHEN contains(text, '{k}') THEN 1 ELSE 0 END" for k, _ in ENGLISH.keywords)
_SQUEEZED = r"regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ | $', '', 'g')"
_SIGNALS = f"""s AS (SELECT doc_id, text, (n_chars % 997) / 997.0::DOUBLE AS m, (doc_id % 7) / 10.0::DOUBLE AS p, {_RULE} AS r, doc_id % 5 AS reports,
  round(least(0.95, CAST(0.40 + 0.06 * (doc_id % 5) + 0.03 * (doc_id % 3) AS DOUBLE)), 4) AS risk FROM documents)"""
_FUSED = "round((m + (1.0 - m) * r) + (1.0 - (m + (1.0 - m) * r)) * p, 4)"
_LEVEL = "CASE WHEN {x} >= 0.70 THEN 'danger' WHEN {x} >= 0.40 THEN 'suspicious' ELSE 'safe' END"
_TEMPLATE = "lower(text)"
for _name in T.PROTECTED:
    _TEMPLATE = f"replace({_TEMPLATE}, '[{_name}]', ' {_name}_token ')"
for _pattern, _to in T.SLOTS[1:6]:
    _TEMPLATE = rf"regexp_replace({_TEMPLATE}, '{_pattern}', '{_to}', 'g')"
_TEMPLATE = rf"regexp_replace({_TEMPLATE}, '\d{{6,}}', ' long_number_token ', 'g')"  # runs of digits are whole, so no look-around is needed
_TEMPLATE = rf"regexp_replace({_TEMPLATE}, '\d+', ' number_token ', 'g')"
_TEMPLATE = rf"regexp_replace(regexp_replace(regexp_replace({_TEMPLATE}, '[^0-9a-z가-힣_\[\]\s]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
for _name in T.PROTECTED:
    _TEMPLATE = f"replace({_TEMPLATE}, '{_name}_token', '[{_name.upper()}]')"
_STEM = "x"
for _p in reversed(ENGLISH.particles):
    _STEM = f"CASE WHEN ends_with(x, '{_p}') AND length(x) - {len(_p)} >= 2 THEN substr(x, 1, length(x) - {len(_p)}) ELSE {_STEM} END"
_STOP = ", ".join(f"'{w}'" for w in ENGLISH.stopwords)
_GENERIC = ", ".join(f"'{w}'" for w in ENGLISH.generic_tokens)


def _rewritten(name: str, pairs) -> str:
    out = "regexp_replace(text, '(?i)https?://', 'hxxp://', 'g')" if name == "url_obfuscation" else "text"
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return f"SELECT conv_id, turn, '{name}' AS type, text AS original, {out} AS text FROM conversations"


ORACLES = {
    "keyword_rule_score": f"SELECT doc_id, {_RULE} AS rule_score, CAST({_N_EVIDENCE} AS BIGINT) AS n_evidence FROM documents",
    "category_trends_topk": "SELECT label, count(*) AS count FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS label FROM documents WHERE {_any(_SQUEEZED, [p.lower() for p in parts])}" for c, parts in ENGLISH.categories) + ") GROUP BY label ORDER BY count DESC, label LIMIT 5",
    "message_templates": f"""WITH t AS (SELECT d.doc_id, toxic AS label, {_TEMPLATE} AS template, CASE WHEN toxic = 1 THEN 'phishing' WHEN {_any('lower(text)', [p for _, ps in ENGLISH.families for p in ps])} THEN '?' ELSE 'other' END AS family
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, family, length(template) AS template_length, substr(sha1('label=' || label || '|family=' || family || '|template=' || template), 1, 16) AS group_id FROM t""",
    "document_tokens": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct,
      len(list_distinct(list_filter(list_transform(t, lambda x: {_STEM}), lambda y: length(y) >= 2 AND y NOT IN ({_STOP})))) AS n_meaning FROM t""",
    "benchmark_similarity": f"""WITH a AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda x: x NOT IN ({_GENERIC}))) AS t FROM documents),
      b AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda x: x NOT IN ({_GENERIC}))) AS t FROM benchmark),
      i AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(t) AS x FROM a) x JOIN (SELECT item_id, unnest(t) AS x FROM b) y ON x.x = y.x GROUP BY 1, 2),
      j AS (SELECT i.doc_id, n / (len(a.t) + len(b.t) - n) AS s FROM i JOIN a ON i.doc_id = a.doc_id JOIN b ON i.item_id = b.item_id WHERE len(a.t) >= 3 AND len(b.t) >= 3)
      SELECT doc_id, round(max(s), 6) AS similarity FROM j WHERE s >= 0.10 GROUP BY doc_id""",
    "adversarial_variants": "SELECT conv_id, turn, type, text FROM (" + " UNION ALL ".join(_rewritten(n, p) for n, p in ENGLISH.rewrites) + ") WHERE text <> original",
    "fused_score_level": f"WITH {_SIGNALS}, f AS (SELECT doc_id, {_FUSED} AS score FROM s) SELECT doc_id, score, {_LEVEL.format(x='score')} AS level FROM f",
    "display_confidence": f"""WITH {_SIGNALS}, f AS (SELECT *, {_FUSED} AS f0, reports > 0 AS strong FROM s),
      g AS (SELECT *, CASE WHEN strong THEN round(f0 + (1.0 - f0) * 0.10 * risk, 4) ELSE f0 END AS f1, strong AND risk >= 0.50 AND reports >= 2 AS support FROM f),
      h AS (SELECT *, round(CASE WHEN {_any('lower(trim(text))', ENGLISH.benign)} AND NOT {_any('lower(trim(text))', ENGLISH.actions)} AND NOT (r >= 0.10 OR p >= 0.10 OR support) THEN least(f1, 0.25) ELSE f1 END, 4) AS score,
        (m >= 0.70)::INT + (r >= 0.30)::INT + (p >= 0.30)::INT + support::INT AS risky, (m <= 0.30)::INT + (r < 0.10)::INT + (p < 0.10)::INT + (NOT support)::INT AS safe FROM g),
      v AS (SELECT *, (score >= 0.40 AND score < 0.70) OR (m >= 0.70 AND risky = 1) OR (m <= 0.30 AND risky >= 2) AS review FROM h)
      SELECT doc_id, round(least(score, [0.70, 0.93, 0.96, 0.98][(r >= 0.30)::INT + (p >= 0.30)::INT + support::INT + 1]::DOUBLE), 4) AS risk_score, {_LEVEL.format(x='score')} AS level,
        CASE WHEN review THEN 'low' WHEN risky >= 3 OR safe >= 3 THEN 'high' WHEN risky >= 2 OR safe >= 2 THEN 'medium' ELSE 'low' END AS confidence, review AS review_required,
        round(greatest(risky, safe) / 4, 4) AS signal_agreement, round(1.0 - round(greatest(risky, safe) / 4, 4), 4) AS signal_disagreement FROM v""",
    "evidence_reasons": f"SELECT doc_id, CAST({_N_EVIDENCE} AS BIGINT) AS n_distinct, CAST(1 + CASE WHEN {_N_EVIDENCE} > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_reasons FROM documents",
    "message_risk": f"""WITH {_SIGNALS} SELECT doc_id, CASE WHEN m >= 0.8 THEN 'high' WHEN m >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level,
      CASE WHEN m >= 0.8 THEN 'phishing' WHEN m >= 0.5 THEN 'suspicious' ELSE 'normal' END AS verdict FROM s""",
}
