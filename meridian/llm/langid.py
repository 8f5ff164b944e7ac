"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training runs in numpy by stochastic gradient descent on a sample bounded by three parameters (`per_language` documents of each
language, `max_rows` and `max_bytes` in all, in the order of a hash of doc_id and text); a calibration part of that sample fits
the temperature and the score under which a prediction is marked as rejected. Since the model is linear before the softmax,
embedding and output layer fold into one table (bucket x language), so prediction is a gather and a mean.

Defined results: null, empty or letterless text is `und` with score 0; texts of any length are read whole, and neither the window
in which they are read nor their neighbours change a score; rows with a null language or text never train; rows with a null id
are not held out; repeated rows get equal predictions and train once; ties between languages go to the first by code point; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import as_bytes, small

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
AHEAD = 3  # an n-gram of four bytes reaches three beyond its first
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _grams(pieces: list[bytes], buckets: int, sizes=(2, 3, 4)):
    """Hashed byte n-grams inside words (white space, digits and punctuation count as one boundary mark), a vector per size, with offsets.

    Each piece is a stretch of a padded text and ends with AHEAD bytes at which no n-gram of its own begins.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    marks = np.where(_LETTER[data], data, 32).astype(np.uint32)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    own = np.ones(len(data), bool)
    for k in range(1, AHEAD + 1):
        own[ends - k] = False
    out = []
    for n in sizes:
        h = np.full(len(marks) - AHEAD, 2166136261 + n, np.uint32)
        for j in range(n):
            h ^= marks[j : j + len(h)]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
        out.append((h & np.uint32(buckets - 1))[own[: len(h)]])
    return out, np.concatenate([[0], ends - AHEAD * np.arange(1, len(pieces) + 1)])


def padded(text: bytes) -> bytes:
    return b" " + text + b" " * AHEAD


def _features(texts: list[bytes], buckets: int):
    """Per text the distinct buckets and how often each occurs."""
    for t in texts:
        grams, _ = _grams([padded(t)], buckets)
        ids, n = np.unique(np.concatenate(grams) if t else np.zeros(0, np.uint32), return_counts=True)
        yield ids, (n / max(n.sum(), 1)).astype(np.float32)


def fit(texts: list[str], langs: list[str], buckets: int = 1 << 15, width: int = 16, epochs: int = 6, steps: int = 9000, rate: float = 4.0, precision: float = 0.995, seed: int = 7) -> Model:
    """Train on whole texts; every fifth one calibrates and is not trained on."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    rows = list(_features(as_bytes([t.lower() for t in texts]), buckets))
    order = rng.permutation(len(rows))
    held, train = (order[::5], np.setdiff1d(order, order[::5])) if len(rows) >= 50 else (order, order)
    emb = rng.normal(0, 1 / width, (buckets, width)).astype(np.float32)
    out = rng.normal(0, 0.1, (width, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    epochs = max(epochs, -(-steps // max(len(train), 1)))  # a small sample is passed more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, share = rows[i]
            if not len(ids):
                continue
            mean = share @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= 0.1 * step * np.outer(mean, p)
            bias -= 0.01 * step * p
            emb[ids] -= step * share[:, None] * back
    folded = emb @ out
    z = np.stack([rows[i][1] @ folded[rows[i][0]] + bias if len(rows[i][0]) else bias for i in held])

    def loss(t: float) -> float:
        s = z / t - (z / t).max(1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(len(held)), y[held]].mean())

    temperature = min(np.geomspace(0.2, 5, 40), key=loss)
    s = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
    s /= s.sum(1, keepdims=True)
    best, right = s.max(1), s.argmax(1) == y[held]
    ranked = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[ranked]) >= precision * np.arange(1, len(ranked) + 1))
    reject = float(best[ranked[good[-1]]]) if len(good) else 1.0
    return Model(names, folded, bias, float(temperature), min(reject, 1.0))


def logits(model: Model, texts: list[bytes], window: int = 1 << 20) -> np.ndarray:
    """Mean table row over all n-grams of each whole text; a long text is read in windows that overlap by an n-gram's reach, so it needs no more memory."""
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    pieces = []
    used = 0

    def flush():
        nonlocal pieces, used
        if pieces:
            grams, at = _grams([t for _, t in pieces], len(model.table))
            who = np.array([i for i, _ in pieces])
            for g in grams:
                for c in range(total.shape[1]):
                    np.add.at(total[:, c], who, np.add.reduceat(model.table[:, c][g].astype(np.float64), at[:-1]))
                np.add.at(count, who, np.diff(at))
        pieces, used = [], 0

    for i, t in enumerate(texts):
        t = padded(t)
        for k in range(0, len(t) - AHEAD, window):
            pieces.append((i, t[k : k + window + AHEAD]))
            used += len(pieces[-1][1])
            if used >= window:
                flush()
    flush()
    return total / np.maximum(count, 1)[:, None] + model.bias


def has_letter(text) -> bool:
    return isinstance(text, str) and (any("a" <= c <= "z" or "A" <= c <= "Z" for c in text[:64]) or any(unicodedata.category(c)[0] == "L" for c in text))


def predict(model: Model, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    z = logits(model, as_bytes([t.lower() if isinstance(t, str) else t for t in texts])) / model.temperature
    known = np.array([has_letter(t) for t in texts], bool)
    if not len(model.languages):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    p = np.exp(z - z.max(1, keepdims=True)) if len(texts) else z
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1) if len(texts) else np.zeros(0, int)
    score = np.where(known, p.max(1), 0.0) if len(texts) else np.zeros(0)
    return [model.languages[b] if k else "und" for b, k in zip(best, known)], score, known & (score >= model.reject_below)


def training_sample(docs: DataFrame, per_language: int, max_rows: int = 20_000, max_bytes: int = 64 << 20) -> list:
    """At most `per_language` distinct rows of each language outside the held-out fold, and at most `max_rows` of `max_bytes` in all, by a hash of doc_id and text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    rows = rows.select("lang", "text", F.octet_length("text").alias("size"), F.xxhash64("doc_id", "text", "lang").alias("mark"))
    seen = rows.groupBy("lang").agg(F.count("*").alias("seen"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 20) / F.col("seen"))  # twice the wish, so that a language is ranked over few rows
    wanted = seen.orderBy(F.desc("seen"), "lang").limit(max_rows).select(F.col("lang").alias("seen_lang"), (share * F.lit(float(1 << 30))).alias("under"))
    drawn = rows.join(F.broadcast(wanted), F.col("lang") == F.col("seen_lang"))  # at most max_rows rows
    drawn = drawn.where(F.pmod("mark", F.lit(1 << 30)) < F.col("under")).groupBy("lang", "mark").agg(F.first("size").alias("size"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark"))
    picked = drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("rank", "mark").limit(max_rows).select("mark", "size", "rank")
    few, used = [], 0
    for r in picked.collect():
        if used + r["size"] <= max_bytes:
            used += r["size"]
            few.append((r["mark"],))
    if not few:
        return []
    marks = F.broadcast(docs.sparkSession.createDataFrame(few, "mark long"))
    return sorted(rows.join(marks, "mark").dropDuplicates(["mark"]).collect(), key=lambda r: r["mark"])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, per_language: int = 500, max_rows: int = 20_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Predict the language of every whole text of `docs` (doc_id, text, lang); the three parameters bound the training sample."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("lang"))
    sample = training_sample(own, per_language, max_rows, max_bytes)
    model = spark.sparkContext.broadcast(fit([r["text"] for r in sample], [r["lang"] for r in sample]))

    def run(batches):
        for part in small(batches):
            lang, score, accepted = predict(model.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    fed = own.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return fed.mapInArrow(run, SCHEMA)
