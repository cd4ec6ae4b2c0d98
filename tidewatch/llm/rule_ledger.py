"""Quality rules kept as a ledger: one bit for each rule that a document fails, with the measurements.

Every rule is evaluated once. A policy is a named version with a set of rules; applying one, or
asking what a policy would keep without one of its rules, only reads the bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table, with_arrow_columns
from tidewatch.llm.text_stats import NAMES, measure
from tidewatch.operators.components import stored

#: Bit, name and the SQL condition, over the measurements, under which a document fails.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    (3, "symbols", "10 * n_symbols > n_words"),
    (4, "repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    (5, "few_alphabetic_words", "10 * n_alpha_words < 8 * n_words"),
    (6, "capitals", "2 * n_upper > n_letters AND n_letters > 0"),
    (7, "many_words", "n_words > 100000"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the policy and the rules that each applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "word_length", "symbols", "repeated_lines", "few_alphabetic_words"),
    "v3": (*BASE, "word_length", "symbols", "repeated_lines", "few_alphabetic_words", "capitals"),
}
CURRENT = "v3"


def mask(rules: tuple[str, ...] | list[str]) -> int:
    bits = {name: 1 << bit for bit, name, _ in RULES}
    return reduce(lambda a, b: a | b, (bits[r] for r in rules), 0)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the counts of text_stats as longs; columns of their names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]

    def compute(batch: pa.RecordBatch) -> list:
        rows = np.array([measure(x.as_py()) for x in batch.column(0)], np.int64).reshape(-1, len(NAMES))
        return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(NAMES))]

    fields = [T.StructField(n, T.LongType()) for n in NAMES]
    return with_arrow_columns(docs, {"text": F.col(f"`{text}`").cast("binary")}, fields, compute, keep)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, the measurements and fail_bits.

    A null or empty text has no words and zero counts, so it fails few_words and nothing that needs
    a word. Repeated rows stay; columns besides the key and the text are not read.
    """
    bits: Column = F.lit(0).cast("long")
    rows = measured(docs.select(key, text), text, [key])
    for bit, _, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Append kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and are kept without it.

    The ledger is first counted by its bits, so at most one row for each pattern is looked at again.
    """
    all_bits = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(all_bits).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.rule", "r.bit")
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measurements of every document, the base verdict, and the current policy's."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits"
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every policy and each of its rules, over all documents: what fails it, fails it alone, is kept, and would be kept without it.

    The ledger is written once; all policies read its bits.
    """
    rows = stored(ledger(table(spark, sf_dir, "documents")), "ledger")
    parts = []
    for policy in POLICIES:
        kept = apply_policy(rows, policy).agg(F.count_if("kept").alias("kept"))
        parts.append(ablations(rows, policy).crossJoin(F.broadcast(kept)).select(F.lit(policy).alias("policy"), "rule", "failed", "failed_alone", "kept", "kept_without"))  # one row
    return reduce(DataFrame.unionByName, parts)


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ln
  FROM t
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m)
), c AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r
), s AS (
  SELECT m.r, doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[ \t-\r]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words
  FROM m LEFT JOIN c ON m.r = c.r
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_alpha_words < 8 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters AND n_letters > 0 THEN 64 ELSE 0 END)
    + (CASE WHEN n_words > 100000 THEN 128 ELSE 0 END) AS fail_bits
  FROM s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept, fail_bits::BIGINT AS fail_bits
FROM b
"""

_BITS = {name: 1 << bit for bit, name, _ in RULES}
_RULES_OF = ", ".join(f"('{p}', '{r}', {_BITS[r]}, {mask(rs)})" for p, rs in POLICIES.items() for r in rs)
ABLATIONS_ORACLE = f"""
SELECT policy, rule, sum((fail_bits & bit <> 0)::BIGINT)::BIGINT AS failed, sum((fail_bits & of = bit)::BIGINT)::BIGINT AS failed_alone,
  sum((fail_bits & of = 0)::BIGINT)::BIGINT AS kept, sum((fail_bits & (of - bit) = 0)::BIGINT)::BIGINT AS kept_without
FROM ({ORACLE}) x, (VALUES {_RULES_OF}) r(policy, rule, bit, of) GROUP BY policy, rule
"""
