"""Document quality by histogram gradient-boosted trees over document statistics.

Training reads a bounded sample of labelled rows: at most ``max_rows``, those whose doc_id hashes
lowest, so the same rows on every run. Their statistics are binned once at quantiles; each tree grows
level by level from histograms of gradients. The trees are complete to their depth and flattened
into arrays (feature, threshold and value by tree and node), which a batch of documents walks
together: one gather per level for all documents and trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import id_hash, table, with_arrow_columns
from tidewatch.llm.text_stats import NAMES, measure

MAX_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 48
RATE = 0.15
L2 = 1.0
MIN_HESSIAN = 1.0
CUT = 0.3

FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "alpha_word_share",
    "digit_share", "stops_per_word", "distinct_share", "top_word_share", "words_per_line", "exclaim_per_word",
)


def features(rows: np.ndarray) -> np.ndarray:
    """Statistics of documents from their counts, a row each; shares of nothing are 0."""
    c = {n: rows[:, i].astype(float) for i, n in enumerate(NAMES)}
    per = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]), per(c["word_chars"], c["n_words"]), per(c["n_symbols"], c["n_words"]), per(c["n_dup_lines"], c["n_lines"]),
            per(c["n_repeat_words"], c["n_words"]), per(c["n_upper"], c["n_letters"]), per(c["n_alpha_words"], c["n_words"]),
            per(c["n_digits"], c["n_bytes"]), per(c["n_stops"], c["n_words"]), per(c["n_distinct_words"], c["n_words"]),
            per(c["n_top_word"], c["n_words"]), per(c["n_words"], c["n_lines"]), per(c["n_exclaim"], c["n_words"]),
        ]
    )


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node 0 is a root, node i has children 2i+1 (at most the threshold) and 2i+2."""

    prior: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        margin = np.full(n, self.prior)
        if trees and n:
            node, tree, row = np.zeros((n, trees), np.int64), np.arange(trees), np.arange(n)[:, None]
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            margin = margin + self.value[tree, node - ((1 << self.depth) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for the logistic loss. Without both labels the smoothed prior alone is the model."""
    n, m = x.shape if x.ndim == 2 else (0, len(FEATURES))
    ones = float(y.sum()) if n else 0.0
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not 0 < ones < n:
        return Trees(prior, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)])
    offset = np.arange(m) * bins
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, prior)
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            width = 1 << level
            cell = (node[:, None] * (m * bins) + offset + binned).ravel()
            hist = [np.bincount(cell, np.repeat(v, m), width * m * bins).reshape(width, m, bins) for v in (g, h)]
            gl, hl = (a.cumsum(axis=2)[:, :, :-1] for a in hist)
            gt, ht = (a[:, :1].sum(axis=2, keepdims=True) for a in hist)
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain = np.where((hl >= MIN_HESSIAN) & (ht - hl >= MIN_HESSIAN), gain, 0)
            best = gain.reshape(width, -1).argmax(axis=1)
            split_f, split_b = np.divmod(best, bins - 1)
            won = np.take_along_axis(gain.reshape(width, -1), best[:, None], 1)[:, 0] > 1e-9
            for i in np.nonzero(won)[0]:
                f, b = split_f[i], split_b[i]
                if b < len(edges[f]):
                    feature[k, width - 1 + i], threshold[k, width - 1 + i] = f, edges[f][b]
            node = 2 * node + (x[np.arange(n), feature[k, width - 1 + node]] > threshold[k, width - 1 + node])
        value[k] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + L2)
        margin = margin + value[k, node]
    return Trees(prior, depth, feature, threshold, value)


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([measure(x.as_py()) for x in batch.column(0)], np.int64).reshape(-1, len(NAMES))


def held_out(key: str = "doc_id", folds: int = 5):
    return F.pmod(id_hash(F.col(key)), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Trees:
    """Fit on at most max_rows labelled documents outside the held-out fold.

    Null keys and labels other than 0 and 1 are passed over; a key with several labels takes their
    larger half (ties: 1); of several texts of a key the one with the smallest statistics is taken.
    So at most max_rows rows come to the driver. No usable row gives the prior one half.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_key"))
    known = known.groupBy("_key").agg(F.avg("_label").alias("_label")).orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(known), "_key")  # at most max_rows rows

    def compute(batch: pa.RecordBatch) -> list:
        return [features(_counts(batch)).tolist()]

    rows = with_arrow_columns(chosen, {"text": F.col("_text").cast("binary")}, [T.StructField("x", T.ArrayType(T.DoubleType()))], compute, ["_key", "_label"])
    found = sorted((r._key, tuple(r.x), r._label) for r in rows.groupBy("_key", "_label").agg(F.min("x").alias("x")).collect())
    x = np.array([r[1] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r[2] >= 0.5) for r in found]))


def score(docs: DataFrame, model: Trees, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Append the probability of label 1 for every whole text; null and empty texts count as no words."""

    def compute(batch: pa.RecordBatch) -> list:
        return [pa.array(model.probability(features(_counts(batch))))]

    return with_arrow_columns(docs, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(name, T.DoubleType())], compute, keep)


def op4_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = score(docs, model, keep=["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose score reaches the cut, with their own columns only."""
    scored = score(docs, train(docs, labels), name="quality score of this stage")
    return scored.where(F.col("quality score of this stage") >= cut).select(*[f"`{c}`" for c in docs.columns])
