"""Secret scans: fixed patterns, plus two character Markov models compared by log-likelihood ratio, in DataFrame functions only.

Fixed patterns (`assign`, `access`, `hex`) give the base spans. Besides, every long token of the secret alphabet is scored by two
first-order Markov models over characters, one of random strings and one of ordinary identifiers, trained by counting pairs in
labelled samples. The threshold is fitted on labelled samples of their own: the least ratio that at most `most_false` of the ordinary
ones reach. Tokens at or above it become `markov` spans unless they touch a base span.

All positions are code points, end exclusive, found by cutting the text at the matches and adding up lengths.

Defined results: null text counts as empty and has no spans; texts of any length are scanned whole; equal texts get equal spans, so
repeated rows do; rows with a null doc_id are scanned and trained on like others; a character outside the alphabet never is part of a
markov token; without documents to train on the ordinary model knows no pair and every pair counts alike in it; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import constant_array, durable, let

# The base patterns, in the order of their kinds, with the least length of the group that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
#: The same matches found sooner: of runs that end only where the class ends, those long enough are the long matches.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
DISTINCT = 8  # rules and runs of few characters are no random strings, which pairs alone do not tell
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has at least `least` characters."""
    none = F.array().cast(SPAN)

    def place(found):
        got = F.split(text, pattern, -1)
        sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

        def step(acc, z):
            start = acc["at"] + F.length(z["gap"])
            end = start + F.length(z["hit"])
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
            return F.struct(end.alias("at"), F.when(F.length(z["size"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        zipped = F.arrays_zip(F.slice(got, 1, F.size(found)).alias("gap"), found.alias("hit"), sizes.alias("size"))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def random_samples(n: int = 4000, seed: int = 17) -> list[str]:
    """Labelled random strings: keys as generators make them (base 64, base 62, upper case and digits, hex)."""
    rng = np.random.default_rng(seed)
    sets = (ALPHABET[:64], ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
    return ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(20, 48)))) for i in range(n)]


def ordinary_samples(docs: DataFrame, documents: int = 200, pairs: int = 20_000) -> DataFrame:
    """Labelled identifiers from the pairs of words of about `documents` distinct documents, `pairs` pairs at most (both picked by a
    hash): words alone and together, as snake_case, camelCase, kebab-case, paths and capitals, or with a number."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("text").alias("mark"))
    n = docs.count()
    picked = text.where(F.pmod("mark", F.lit(1 << 30)) < F.lit(float(1 << 30) * min(1.0, documents / max(n, 1))))
    pair = picked.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z])[A-Za-z]{2,}+[^A-Za-z]++[A-Za-z]{2,}"), F.lit(0))).alias("pair"))
    pair = pair.select(F.regexp_extract("pair", r"^[A-Za-z]+", 0).alias("a"), F.regexp_extract("pair", r"[A-Za-z]+$", 0).alias("b")).distinct()
    pair = pair.orderBy(F.xxhash64("a", "b"), "a", "b").limit(pairs)
    a, b = F.col("a"), F.col("b")
    forms = [a, F.concat_ws("_", a, b), F.concat(a, F.initcap(b)), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.upper(F.concat_ws("_", a, b)), F.concat(a, b, F.length(a).cast("string")), F.concat(a, b)]
    return pair.select(F.explode(F.array(*forms)).alias("sample"))


def pair_counts(samples: DataFrame, column: str = "sample") -> np.ndarray:
    """How often each character follows each other one (ALPHABET squared), counted by Spark."""
    s = F.col(column)
    pairs = samples.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))).alias("two"))
    out = np.zeros((len(ALPHABET), len(ALPHABET)))
    for r in pairs.where(F.length("two") == 2).groupBy("two").count().collect():  # at most the alphabet squared, and some pairs with other characters
        x, y = ALPHABET.find(r["two"][0]), ALPHABET.find(r["two"][1])
        if x >= 0 and y >= 0:
            out[x, y] += r["count"]
    return out


def ratios(random_: np.ndarray, ordinary: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random over ordinary."""

    def log(c):
        return np.log((c + smooth) / (c + smooth).sum(1, keepdims=True))

    return log(random_) - log(ordinary)


def train(spark: SparkSession, docs: DataFrame, most_false: float = 0.001) -> tuple[np.ndarray, float]:
    """The table of ratios and the threshold, each fitted on its half of the labelled samples (dealt by a hash)."""
    drawn = spark.createDataFrame([(s,) for s in random_samples()], "sample string")
    plain = durable(ordinary_samples(docs))
    half = F.pmod(F.xxhash64("sample"), F.lit(2))
    table = ratios(pair_counts(drawn.where(half == 0)), pair_counts(plain.where(half == 0)))
    long_ = plain.where((half == 1) & F.col("sample").rlike(f"^{TOKEN}$"))
    reached = long_.agg(F.percentile_approx(token_score(F.col("sample"), table), 1 - most_false, 100_000)).first()[0]
    return table, max(float(reached) if reached is not None else 0.0, 0.0) + 1e-6


def token_score(token: Column, table: np.ndarray) -> Column:
    """Mean log-likelihood ratio over the pairs of characters of a token."""
    width = len(ALPHABET)
    flat = constant_array((round(float(x), 4) for x in table.ravel()), "double")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def total(k):
        each = F.transform(F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda y, i: F.get(flat, F.get(k, i) * width + y))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.greatest(F.size(k) - 1, F.lit(1))

    return let(codes, total)


def markov_spans(text: Column, table: np.ndarray, threshold: float, rank: int) -> Column:
    """Spans of tokens that the random model explains better, by `threshold` a pair on the mean."""
    found = spans(text, "markov", rank, TOKEN, 0, 20)

    def odd(s):
        token = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        return (F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT) & (token_score(token, table) >= threshold)

    return F.filter(found, odd)


def scan(docs: DataFrame, table: np.ndarray | None = None, threshold: float | None = None) -> DataFrame:
    """doc_id, text, base (spans by start, then kind) and all_spans (with the markov spans that touch no base span). What is not given is fitted on `docs`."""
    if table is None or threshold is None:
        table, threshold = train(docs.sparkSession, docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    rows = rows.withColumn("base", F.array_sort(F.concat(*[spans(t, k, i, FAST.get(k, p), g, n) for i, (k, p, g, n) in enumerate(PATTERNS)])))
    rows = rows.withColumn("extra", markov_spans(t, table, threshold, len(PATTERNS)))
    free = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.withColumn("all_spans", F.when(F.size("extra") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", free)))).drop("extra")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, all spans as a string."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k, *_ in PATTERNS]
    return scanned.select("doc_id", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
