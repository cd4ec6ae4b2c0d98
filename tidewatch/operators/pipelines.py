"""Whole dataflows: scoring messages, cleaning a dataset, and a retraining round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.functions import urls as U
from tidewatch.functions.columns import require_texts
from tidewatch.lexicons import KOREAN, Profile
from tidewatch.operators import graph as G
from tidewatch.operators import relational as R
from tidewatch.operators import reports as P

NONE = "array<struct<type:string,detail:string,weight:double>>"


def score(messages: DataFrame, reports: DataFrame, probability: str = "probability", as_of: str | None = None, blocked: DataFrame | None = None, profile: Profile = KOREAN) -> DataFrame:
    """Messages (id, text, sender, probability) against reports: risk, level, evidence, reasons and confidence.

    blocked is a table of domains (domain). The level is that of the whole score, while the score
    that is shown is capped by how many signals agree. With as_of, campaign columns are added.
    """
    pre = T.preprocess(messages)
    if blocked is None:
        pre = pre.withColumn("_blocked", F.array().cast("array<string>"))
    else:
        hits = pre.select("id", F.explode("domains").alias("domain")).join(blocked.select("domain").distinct(), "domain", "left_semi")
        pre = pre.join(hits.groupBy("id").agg(F.array_sort(F.collect_set("domain")).alias("_blocked")), "id", "left").withColumn("_blocked", F.coalesce("_blocked", F.array().cast("array<string>")))
    pre = pre.withColumn("text_evidence", T.text_evidence(F.col("domains"), F.col("norm"), F.col("_blocked"), profile))
    rows = pre.join(U.url_rules_of_messages(pre, "id", "urls", profile), "id", "left").join(P.reputation(pre, reports, "id", profile), "id", "left")
    known = G.prepared(reports, profile)
    members = G.clusters(known)
    table = G.cluster_table(known, members, G.nodes(known, members, profile))
    rows = rows.join(G.match(pre, known, members, profile), "id", "left").join(table, "cluster", "left")

    rule = F.greatest(U.total_weight(F.col("text_evidence")), F.coalesce("url_score", F.lit(0.0)))
    rows = rows.withColumns({"rule": rule, "reputation": F.coalesce("rep_score", F.lit(0.0)), "model": F.round(probability, 4), "_strong": S.is_strong_cluster(F.col("match_type"), F.col("shared"), F.col("similar"))})
    rows = rows.withColumn("_support", S.supports(F.col("_strong"), F.col("risk"), F.col("report_count")))
    fused = S.with_cluster(S.fuse(F.col(probability), F.col("rule"), F.col("reputation")), F.col("_strong"), F.col("risk"))
    rows = rows.withColumn("_fused", fused)
    rows = rows.withColumn("_score", S.benign_adjusted(F.col("text"), F.col("_fused"), F.col("rule"), F.col("reputation"), F.col("urls"), F.col("_support"), profile))
    rows = rows.withColumns({"level": S.level(F.col("_score")), "risk_score": S.displayed(F.col("_score"), F.col("rule"), F.col("reputation"), F.col("_support"))})
    rows = rows.withColumns(S.uncertainty(F.col(probability), F.col("rule"), F.col("reputation"), F.col("_score"), F.col("_support")))
    none = F.array().cast(NONE)
    evidence = S.distinct_evidence(F.concat("text_evidence", F.coalesce("url_evidence", none), F.coalesce("rep_evidence", none)))
    rows = rows.withColumns({"evidence": evidence, "cluster_id": F.when(F.col("cluster").isNotNull(), F.concat(F.lit("조직-"), F.col("cluster").cast("string")))})
    rows = rows.withColumn("reasons", S.reasons(F.col("evidence"), F.col("level"), F.col("risk_score"), F.col("cluster_id"), F.col("report_count")))
    out = rows.select(
        "id", "risk_score", "level", "reasons", "evidence", F.struct("model", "rule", "reputation").alias("signals"), "cluster_id", F.col("size").alias("cluster_size"), F.col("report_count").alias("cluster_reports"),
        F.col("risk").alias("cluster_risk"), "match_type", "urls", "confidence", "review_required", "review_reason", "signal_agreement", "signal_disagreement",
    )
    if as_of is None:
        return out
    found = G.campaigns(pre, known, members, as_of, profile).drop("cluster", "match_type").withColumnRenamed("status", "campaign_status")
    return out.join(found, "id", "left")


def message_results(messages: DataFrame, probability: str = "probability", text: str = "text") -> DataFrame:
    """The older results by probability alone: score, risk_level and verdict of each message; an error if a text is empty."""
    rows = require_texts(messages, text)
    return rows.withColumns({"score": F.round(probability, 4), **S.message_risk(F.col(probability))})


def meta_dataset(messages: DataFrame, reports: DataFrame, probability: str = "probability", profile: Profile = KOREAN) -> DataFrame:
    """Every message's signals as features: model_p, rule_s, rep_s, has_url and url_count."""
    scored = score(messages, reports, probability, profile=profile)
    return scored.select("id", F.col("signals.model").alias("model_p"), F.col("signals.rule").alias("rule_s"), F.col("signals.reputation").alias("rep_s"), (F.size("urls") > 0).cast("int").alias("has_url"), F.size("urls").alias("url_count"))


def graph(reports: DataFrame, profile: Profile = KOREAN) -> tuple[DataFrame, DataFrame]:
    known = G.prepared(reports, profile)
    members = G.clusters(known)
    found = G.nodes(known, members, profile)
    return found, G.edges(known, members, found)


def retraining_round(reports: DataFrame, approvals: DataFrame, used: DataFrame, base: DataFrame, run: str, train: Callable[[DataFrame], object], judge: Callable[[object], str]) -> tuple[str, DataFrame]:
    """One round: samples that no run used, the training set of base and samples, training and the gate.

    train gets the set (text, label) and returns a model, judge says PROMOTE or REJECT of it. Returns
    the decision and the uses, with this run's unless it had too few samples. An error leaves no use.
    """
    samples = P.approved_samples(reports, approvals, used)
    if not P.retraining_ready(samples).first().ready:
        return "WAIT", used
    return judge(train(P.training_set(base, samples))), P.mark_used(used, samples, run)


def trends(reports: DataFrame, n: int = 5, profile: Profile = KOREAN) -> DataFrame:
    """(kind, label, count): the n most frequent categories and registered domains of user reports, each report once."""
    user = reports.where(F.col("source") == "user")
    named = user.select(F.explode(T.categories(F.col("text"), profile)).alias("label")).withColumn("kind", F.lit("category"))
    domains = user.select(F.explode(F.array_distinct(F.transform("domains", U.registered_domain))).alias("label")).where("label <> ''").withColumn("kind", F.lit("domain"))
    tops = [d.groupBy("kind", "label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(n) for d in (named, domains)]
    return tops[0].unionByName(tops[1])


def clean_dataset(raw: DataFrame, content: str = "content", class_: str = "class", classes: dict[int, int] | None = None, profile: Profile = KOREAN) -> DataFrame:
    """Raw messages to model rows: labels mapped, blanks, conflicts and repeats dropped, texts and flags added.

    Rows are numbered by their content before texts that come out empty are dropped, so numbers can have gaps.
    """
    rows = raw.withColumn("label", F.col(class_))
    rows = R.labelled(rows, content, "label", classes or {1: 0, 2: 1, 3: 0})
    rows = R.without_conflicts(rows, content, "label")
    rows = R.first_of(rows, [content], [c for c in rows.columns if c != content])
    rows = T.for_model(R.numbered(rows, [content]), content, "text", profile).where("text <> ''")
    rows = T.with_flags(rows)
    rows = rows.withColumn("structured_family", T.family(F.col(content), F.col("label"), profile)).withColumn("template_text", T.template(F.col("text")))
    return rows.withColumn("group_id", T.group_id(F.col("label"), F.col("structured_family"), F.col("template_text")))
