"""Reports as events, and what follows from them: cases, status, approvals and reputation.

Reports are only appended. A case's status is a view over its reports and approvals, so nothing is
rewritten: a verified normal case is a false positive; one with a seed report, or five reports, is
confirmed; two make it suspected; one is pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.columns import require_columns
from tidewatch.lexicons import KOREAN, Profile
from tidewatch.operators.similarity import best_similarity

STATUSES = ("pending", "suspected", "confirmed", "false_positive")
SUSPECTED, CONFIRMED = 2, 5
W_DOMAIN, W_MORE, MOST_DOMAIN, W_PHRASE, SIMILAR = 0.35, 0.05, 0.60, 0.30, 0.30
READY = 20


def status_of(count: Column, has_seed: Column, verified_normal: Column | None = None) -> Column:
    status = F.when(has_seed | (count >= CONFIRMED), "confirmed").when(count >= SUSPECTED, "suspected").otherwise("pending")
    return status if verified_normal is None else F.when(F.coalesce(verified_normal, F.lit(False)), "false_positive").otherwise(status)


def new_reports(messages: DataFrame, source: str, created_at: str = "created_at") -> DataFrame:
    """Messages (id, text, sender, created_at) as report rows with their case key."""
    rows = T.preprocess(messages)
    key = T.case_key(F.col("sender"), F.col("domains"), F.col("urls"), F.col("norm"))
    return rows.select("id", "text", "sender", "urls", "domains", "tokens", F.lit(source).alias("source"), key.alias("case_key"), F.col(created_at).alias("created_at"))


def cases(reports: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """One row per case key: report_count, has_seed, first and last seen, approval and status.

    approvals has (case_key, label, approved_at); the latest counts.
    """
    out = reports.where(F.col("case_key").isNotNull()).groupBy("case_key").agg(
        F.count("*").alias("report_count"), F.max(F.col("source") == "seed").alias("has_seed"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )
    if approvals is None:
        out = out.withColumns({"label": F.lit(None).cast("int"), "approved_at": F.lit(None).cast("timestamp")})
    else:
        last = approvals.groupBy("case_key").agg(F.max_by("label", "approved_at").alias("label"), F.max("approved_at").alias("approved_at"))
        out = out.join(last, "case_key", "left")
    return out.withColumn("status", status_of(F.col("report_count"), F.col("has_seed"), F.col("label") == 0))


def with_status(reports: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    return reports.drop("status").join(cases(reports, approvals).select("case_key", "status"), "case_key", "left")


def by_status(reports: DataFrame, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    return reports.where(F.col("status") == status)


def training_candidates(reports: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """Confirmed cases of user reports that nobody has approved yet, most reported and latest first."""
    rows = by_status(with_status(reports, approvals), "confirmed").where(F.col("source") == "user")
    if approvals is not None:
        rows = rows.join(approvals.select("case_key").distinct(), "case_key", "left_anti")
    out = rows.groupBy("case_key").agg(
        F.min("text").alias("text"), F.min("sender").alias("sender"), F.count("*").alias("report_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )
    return out.orderBy(F.desc("report_count"), F.desc("last_seen"), "case_key")


def approve(reports: DataFrame, approvals: DataFrame, case_key: str, label: int, approved_at: str) -> DataFrame:
    """The approvals with one more, of a confirmed case; 0 makes it a false positive."""
    if label not in (0, 1):
        raise ValueError("label must be 0 or 1")
    status = cases(reports, approvals).where(F.col("case_key") == case_key).select("status").first()
    if status is None or status[0] != "confirmed":
        raise ValueError("only a confirmed case can be approved")
    spark = reports.sparkSession
    row = spark.createDataFrame([(case_key, label, approved_at)], "case_key string, label int, approved_at string").withColumn("approved_at", F.col("approved_at").cast("timestamp"))
    return approvals.unionByName(row)


def approved_samples(reports: DataFrame, approvals: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """One sample for each approved case that no training used, in the order of approval."""
    last = approvals.where(F.col("label").isin(0, 1)).groupBy("case_key").agg(F.max("label").alias("label"), F.min("approved_at").alias("approved_at"))
    if used is not None:
        last = last.join(used.select("case_key").distinct(), "case_key", "left_anti")
    rows = reports.join(last, "case_key").groupBy("case_key", "label", "approved_at")
    return rows.agg(F.min("text").alias("text"), F.min("sender").alias("sender"), F.count("*").alias("report_count")).orderBy("approved_at", "case_key")


def mark_used(used: DataFrame, samples: DataFrame, run: str) -> DataFrame:
    """The uses (case_key, run) with those of a run, of every sample whether or not the run's model is promoted."""
    return used.select("case_key", "run").unionByName(samples.select("case_key").distinct().withColumn("run", F.lit(run)))


def retraining_ready(samples: DataFrame, least: int = READY) -> DataFrame:
    return samples.agg(F.count("*").alias("samples"), (F.count("*") >= least).alias("ready"))


def training_set(base: DataFrame, samples: DataFrame) -> DataFrame:
    """Base rows (text, label) and, after them, samples whose text and label the base lacks, each once."""
    new = samples.select("text", "label").dropDuplicates().join(base.select("text", "label").distinct(), ["text", "label"], "left_anti")
    return base.select("text", "label").unionByName(new)


def case_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("case_key", "status").agg(F.count("*").alias("report_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def reputation(inputs: DataFrame, reports: DataFrame, key: str = "id", profile: Profile = KOREAN) -> DataFrame:
    """(key, rep_score, rep_evidence) from reports that are no false positives.

    inputs has domains and tokens. A domain reported n times weighs 0.35 and 0.05 for each further
    report, 0.60 at most; a report of similar wording weighs 0.30.
    """
    require_columns(inputs, [key, "domains", "tokens"])
    live = reports.where(~(F.col("status") == "false_positive")) if "status" in reports.columns else reports
    known = live.select(F.explode(F.array_distinct("domains")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    hits = inputs.select(F.col(key).alias("_id"), F.explode(F.array_distinct("domains")).alias("domain")).join(known, "domain")
    weight = F.round(F.least(W_DOMAIN + W_MORE * (F.col("n") - 1), F.lit(MOST_DOMAIN)), 4)
    item = lambda kind, detail, w: F.struct(F.lit(kind).alias("type"), detail.alias("detail"), w.alias("weight"))
    told = item("신고 이력 도메인", F.concat("domain", F.lit(" (신고 "), F.col("n").cast("string"), F.lit("건)")), weight)
    domains = hits.groupBy("_id").agg(F.sum(weight).alias("s"), F.array_sort(F.collect_list(told)).alias("e"))
    clean = lambda df, name: df.select(F.col(name).alias("id"), T.similarity_tokens(F.col("tokens"), profile).alias("tokens"))
    phrases = best_similarity(clean(inputs, key), clean(live, "id"), SIMILAR)
    phrases = phrases.select(F.col("left_id").alias("_p"), item("유사 신고 문구", F.concat(F.lit("기존 신고와 "), F.bround(F.col("similarity") * 100).cast("int").cast("string"), F.lit("% 유사")), F.lit(W_PHRASE)).alias("p"))
    rows = inputs.select(key).join(domains, F.col(key) == F.col("_id"), "left").join(phrases, F.col(key) == F.col("_p"), "left")
    total = F.coalesce("s", F.lit(0.0)) + F.when(F.col("p").isNotNull(), W_PHRASE).otherwise(0.0)
    none = F.array().cast("array<struct<type:string,detail:string,weight:double>>")
    return rows.select(key, F.round(F.least(total, F.lit(1.0)), 4).alias("rep_score"), F.concat(F.coalesce("e", none), F.when(F.col("p").isNotNull(), F.array("p")).otherwise(none)).alias("rep_evidence"))


def seed_leakage(evaluated: DataFrame, seed: DataFrame, key: str = "id", threshold: float = SIMILAR, profile: Profile = KOREAN) -> DataFrame:
    """Evaluation rows that seed reports give away: same_text, shared_domain, similarity."""
    texts = seed.select("norm").distinct().withColumn("same_text", F.lit(True))
    domains = seed.select(F.explode("domains").alias("domain")).distinct()
    shared = evaluated.select(F.col(key).alias("_d"), F.explode("domains").alias("domain")).join(domains, "domain", "left_semi").select("_d").distinct().withColumn("shared_domain", F.lit(True))
    clean = lambda df, name: df.select(F.col(name).alias("id"), T.similarity_tokens(F.col("tokens"), profile).alias("tokens"))
    best = best_similarity(clean(evaluated, key), clean(seed, "id"), threshold).withColumnRenamed("left_id", "_s")
    out = evaluated.select(key, "norm").join(texts, "norm", "left").join(shared, F.col(key) == F.col("_d"), "left").join(best, F.col(key) == F.col("_s"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select(key, flag("same_text"), flag("shared_domain"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")).where("same_text OR shared_domain OR similarity > 0")
