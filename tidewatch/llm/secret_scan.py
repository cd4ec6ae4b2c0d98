"""Secrets in texts: three base patterns, and character Markov models for what they miss.

Everything is DataFrame expressions. A pattern's matches and the text between them alternate, so
splitting a text at the pattern and extracting the pattern gives every position as a running sum of
lengths, taken in chunks so that a text with very many matches costs no more for each. Strings of key-like letters outside the base matches are scored by two first-order Markov
models, one of random strings and one of ordinary identifiers: the sum over letter pairs of the log
ratio of their probabilities. The models are counts over labelled samples, smoothed, and fit in one
array with a cell for each pair of letters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import let, table, words

#: Kind, pattern, the group whose length counts, and its least length.
BASE: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the same matches as runs of any length of which those under 16 are dropped
)
MARKOV = "markov"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(LETTERS) + 1
SMOOTH = 0.5
#: Nats by which the random model must win over a whole string, and a letter.
MARGIN = 12.0
RATE = 1.2
#: Elements, or letters of a text, that are handled together.
CHUNK = 256
#: Beyond any position.
FAR = 2**31 - 1
#: Documents whose words make the sample of ordinary identifiers.
SAMPLE_DOCS = 300
#: Random strings of each alphabet in the sample.
SAMPLE_RANDOM = 1500


def running(x: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes of the elements of an array up to and with each, in time in proportion to the array.

    A fold that appends copies what it has at each step, so it runs over chunks, and once over what
    the chunks make of themselves. join must be associative with zero as its neutral element.
    """
    none = F.array().cast("array<int>")

    def fold(values: Column) -> Column:
        def add(acc: Column, v: Column) -> Column:
            return F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], v))).alias("out"))

        return F.aggregate(values, F.struct(F.lit(zero).alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        totals = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = lambda before: F.transform(parts, lambda p, i: F.transform(p, lambda v: join(F.coalesce(F.get(before, i - 1), F.lit(zero)), v)))
        return let(totals, lambda before: F.flatten(moved(before)))

    def chunks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: fold(F.slice(v, c * CHUNK + 1, CHUNK)))

    return let(x, lambda v: F.when(F.size(v) > 0, let(chunks(v), joined)).otherwise(none))


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """The matches of a pattern in order: the length of the text before each, the match, and the length of its group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.zip_with(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), measured, lambda x, m: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(m).alias("part")))
    found = F.filter(found, lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,hit:string,part:int>>"))


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """(start, kind, end, hit) of a pattern's leftmost non-overlapping matches, in code points.

    Matches whose group is shorter than least are dropped.
    """

    def span(x: Column, e: Column) -> Column:
        return F.struct((e - F.length(x["hit"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["hit"].alias("hit"), x["part"].alias("part"))

    def spans(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda x: x["gap"] + F.length(x["hit"])), 0, lambda a, b: a + b)
        return F.filter(F.zip_with(pieces, ends, span), lambda x: x["part"] >= least)

    return let(_pieces(text, pattern, group), spans)


def ordinary_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Identifiers (column sample) made of the words of at most max_docs documents, those whose keys hash lowest."""
    ids = docs.select(F.col(key).alias("_id")).where(F.col("_id").isNotNull()).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    found = docs.select(F.col(key).alias("_id"), words(F.col(text)).alias("w")).join(F.broadcast(ids), "_id")  # at most max_docs keys
    plain = found.select(F.filter("w", lambda x: x.rlike("^[A-Za-z]{2,24}$")).alias("w"))
    pairs = plain.select(F.explode(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))).alias("p"))
    pairs = pairs.select("p.a", "p.b").distinct()
    number = lambda n: F.pmod(F.xxhash64("a", "b"), F.lit(n)).cast("string")
    made = F.array(
        F.concat("a", "b"), F.concat(F.lower("a"), F.lit("_"), F.lower("b")), F.concat("a", F.lit("-"), "b"), F.concat(F.lower("a"), F.initcap("b")),
        F.concat(F.upper("a"), F.lit("_"), F.upper("b")), F.concat("a", F.lit("/"), "b", F.lit("_"), number(100)), F.concat("a", number(3000)),
        F.concat(F.lpad(number(2100), 4, "0"), F.lit("-"), F.lpad(number(12), 2, "0"), F.lit("-"), F.lpad(number(28), 2, "0")), number(10**9),
    )
    return pairs.select(F.explode(made).alias("sample"))


def random_samples(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """Random strings (column sample) over the alphabets of keys: base 64 and 62, upper case with digits, hexadecimal."""
    raw = spark.range(n).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    made = F.array(b64, F.translate(b64, "+/=", "xY7"), F.upper(F.translate(b64, "+/=", "Q3K")), F.translate(b64, "+/=", "_-"), F.substring("h", 1, 40))
    return raw.select(F.explode(made).alias("sample"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(a, b, n): how often letter b follows letter a, by their places in LETTERS, 0 before the first."""
    chars = F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(LETTERS), c))
    codes = samples.where(F.length("sample") > 0).select(F.filter(chars, lambda c: c > 0).alias("c"))
    pairs = codes.select(F.explode(F.zip_with(F.concat(F.array(F.lit(0)), "c"), "c", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return pairs.select("p.a", "p.b").where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """The log-likelihood ratios of all letter pairs, SIDE by SIDE, from the two samples.

    Only counts of letter pairs, SIDE * SIDE of each model, come to the driver. Samples without
    rows make a uniform model.
    """
    counts = pair_counts(random).withColumn("m", F.lit(1)).unionByName(pair_counts(ordinary).withColumn("m", F.lit(0)))
    seen = {(r.m, r.a, r.b): r.n for r in counts.collect()}
    out = []
    for a in range(SIDE):
        total = [sum(seen.get((m, a, b), 0) for b in range(1, SIDE)) + SMOOTH * (SIDE - 1) for m in (0, 1)]
        for b in range(SIDE):
            p = [(seen.get((m, a, b), 0) + SMOOTH) / total[m] for m in (0, 1)]
            out.append(round(math.log(p[1] / p[0]), 6))
    return out


def ratio_table(ratios: list[float]) -> Column:
    """The ratios as one constant array."""
    return F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<double>")


def likelihood_ratio(token: Column, ratios: Column) -> Column:
    """Sum over the letters of a token of the log ratio of the random to the ordinary model."""
    steps = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(LETTERS), c))

    def add(acc: Column, code: Column) -> Column:
        return F.struct((acc["sum"] + F.element_at(ratios, acc["last"] * SIDE + code + 1)).alias("sum"), code.alias("last"))

    return F.aggregate(F.filter(steps, lambda c: c > 0), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), add, lambda acc: acc["sum"])


def scan(docs: DataFrame, ratios: list[float], text: str = "text", margin: float = MARGIN, name: str = "spans") -> DataFrame:
    """Append an array of (start, kind, end): kind numbers BASE's kinds, and after them MARKOV.

    Sorted by start, then kind. A candidate of the Markov models counts if it holds a digit, wins
    by the margin, over the whole and a letter, and overlaps no base match. A null or empty text has
    no spans. The time is in proportion to the text and its matches, whatever their number.
    """
    table_ = ratio_table(ratios)
    base = lambda x: x["kind"] < len(BASE)

    def wins(x: Column) -> Column:
        return x["hit"].rlike("[0-9]") & (likelihood_ratio(x["hit"], table_) > F.greatest(F.lit(margin), RATE * (x["end"] - x["start"])))

    def free(found: Column) -> Column:
        """The found spans but for candidates that a base match before them reaches into or that one begins in."""
        reach = running(F.transform(found, lambda x: F.when(base(x), x["end"]).otherwise(0)), 0, F.greatest)
        begins = F.reverse(running(F.reverse(F.transform(found, lambda x: F.when(base(x), x["start"]).otherwise(FAR))), FAR, F.least))
        near = lambda n: F.filter(found, lambda x, i: base(x) | ((F.get(n, i)["r"] <= x["start"]) & (F.get(n, i)["b"] >= x["end"])))
        return let(F.arrays_zip(reach.alias("r"), begins.alias("b")), near)

    def spans(whole: Column) -> Column:
        sure = F.concat(*[matches(whole, p, i, g, n) for i, (_, p, g, n) in enumerate(BASE)])
        more = F.filter(matches(whole, CANDIDATE, len(BASE), 0, 20), wins)
        both = let(F.array_sort(F.concat(sure, more)), lambda found: F.when(F.exists(found, base) & F.exists(found, lambda x: ~base(x)), free(found)).otherwise(found))
        return F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    found = let(F.coalesce(F.col(f"`{text}`"), F.lit("")), spans)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], found.alias(name))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def models(spark: SparkSession, docs: DataFrame) -> list[float]:
    return train(random_samples(spark), ordinary_samples(docs))


def op7_secret_markov_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, models(spark, docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))

    def number(kind: int) -> Column:  # a lambda's second parameter would be the place in the array
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    numbers = [number(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return rows.select("doc_id", *numbers, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end out of its chunks; only chunks that the cut touches are read."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.substring(some, start - first * CHUNK + 1, end - start)


def redacted(docs: DataFrame, ratios: list[float], text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their text replaced by the mark; spans that overlap become one.

    n_chars, where there is such a column, is counted again for texts that changed.
    """
    name = "_text of this scan"
    text_ = F.col(f"`{text}`")

    def clean(spans: Column, ends: Column, chunks: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        # A span that begins before an earlier one ends lies in the same mark.
        parts = F.transform(spans, lambda x, i: F.when(x["start"] >= before(i), F.concat(_cut(chunks, before(i), x["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), _cut(chunks, F.element_at(ends, -1), F.length(text_)))

    def replaced(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["end"]), 0, F.greatest)
        chunks = F.regexp_extract_all(text_, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.when(F.size(spans) > 0, let(ends, lambda e: let(chunks, lambda c: clean(spans, e, c))))

    rows = scan(docs, ratios, text, name=name)
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], let(F.col(f"`{name}`"), replaced).alias(name))
    made = F.col(f"`{name}`")
    values = {text: F.coalesce(made, text_), "n_chars": F.when(made.isNotNull(), F.length(made).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns])
