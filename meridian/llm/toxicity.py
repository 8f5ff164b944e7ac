"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token that looks disguised (digits or symbols among letters, letters repeated, letters spaced out) becomes a
lattice: each character may stand for itself, for the letters it imitates, or for nothing; at a separator a word may end. A
Viterbi search over all contexts of the character language model (n-grams with back-off, trained on word types) finds the
likeliest reading of a token or spaced run of any length, whole. The reading takes the token's place, and the restored text's
distinct words and their stems feed a logistic model whose vocabulary and weights come from labelled documents.

All labelled documents outside the held-out fold are learned from, wherever they are: word types, counts of words and the
gradients of the weights are summed by Spark, and the driver holds the characters' counts and the telling words only. Sums that
steer the weights are integers, so the layout of the tables doesn't matter. A caller may ask for a sample instead, of
`max_labelled` documents and `max_bytes` of text at most, taken in the order of a hash of doc_id and text. Labels of one
document that disagree are settled by majority, ties as toxic.

Defined results: null, empty or wordless text scores as a text without any known word; texts of any length are scored whole;
rows with a null label or a null id never train; repeated rows score equally and train once; without labels of both kinds
every score is near the one kind that there is (near 0 if there is none); an empty table gives an empty result; other columns are
ignored by `assess` and kept as they are by `keep_clean`, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, durable, small
from .langid import held_out

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
# Letters that symbols and digits imitate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
BREAKS = set(".-_ ,;:/")
FILL = set(".-_*~'^`,:;/\\=#\" ")
BLANKS = set("*#_%")
EDGES = ".,;:!?\"'()[]{}<>*#$%&+-_=/|~`"
OUTER = EDGES.translate({ord(c): None for c in "!$|+"})  # what may end a token without standing for a letter
STEMS = (7,)
_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]|[0-9@$!|+])(?:[\s.\-_*]+(?:[^\W\d_]|[0-9@$!|+])(?!\w)){2,}")
_RUN = re.compile(r"(.)\1{2,}")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_MAIL = re.compile(r"\S+@\S+\.\S+|https?:|\d{1,3}(\.\d{1,3}){3}|(?<!\w)(?=[a-f]*\d)[0-9a-f]{16,}(?!\w)")  # mails, addresses and hexadecimal strings are no words


def grams(words, order: int = 5) -> Counter:
    """How often each character comes after each of its last 0..order-1 characters."""
    counts: Counter = Counter()
    for w in words:
        padded = "^" + w + "$"
        counts.update((padded[i - n : i], padded[i]) for i in range(1, len(padded)) for n in range(min(order, i + 1)))
    return counts


@dataclass
class CharModel:
    """Counts of characters after their last 1..order-1 characters, over word types."""

    order: int = 5
    seen: dict = field(default_factory=dict)
    costs: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def train(cls, words, order: int = 5) -> CharModel:
        return cls.counted([(*k, n) for k, n in grams(words, order).items()], order)

    @classmethod
    def counted(cls, rows, order: int = 5) -> CharModel:
        """From (characters before, character, count), each pair once."""
        seen: dict[str, dict] = defaultdict(dict)
        for past, ch, n in sorted(rows):
            seen[past][ch] = n
        return cls(order, {past: (sum(by.values()), by) for past, by in seen.items()})

    def cost(self, past: str, ch: str) -> float:
        """Minus log probability, by interpolation from the longest context that was seen (Witten-Bell)."""
        if (known := self.costs.get((past, ch))) is not None:
            return known
        p = 1 / 300
        for n in range(self.order):
            if n > len(past):
                break
            if (got := self.seen.get(past[len(past) - n :] if n else "")) is not None:
                total, by = got
                p = (by.get(ch, 0) + len(by) * p) / (total + len(by))
        if len(self.costs) > 150_000:
            self.costs.clear()
        self.costs[past, ch] = -math.log(p)
        return -math.log(p)


def decode(token: str, model: CharModel, fill_cost: float = 0.3, swap_cost: float = 0.7, repeat_cost: float = 0.3, blank_cost: float = 1.0, break_cost: float = 1.0, single_cost: float = 3.0, drop_cost: float = 4.0) -> str:
    """The likeliest reading of a disguised token or run; at a separator a word may end and another begin.

    A state is the reading's last characters, all that later costs depend on, so the search is exact. Readings are linked
    lists that share their beginnings, so memory grows with the token, not with the token times the states.
    """
    cost_of, keep = model.cost, 1 - model.order

    def end(past):
        if past == "^":
            return 0.0
        return min(cost_of(past, "$"), single_cost) if past[0] == "^" and len(past) == 2 else cost_of(past, "$")

    states: dict[str, tuple] = {"^": (0.0, None)}  # last characters of the reading -> cost, (reading before, character)
    before = ""
    for ch in token:
        if ch.isspace():
            ch = " "
        after: dict[str, tuple] = {}
        letter = ch.isalpha()
        ways = [(ch, 0.0)] if letter else [(c, swap_cost) for c in LEET.get(ch, "")] + ([(ch, 4.0)] if ch.isdigit() else [])
        idle = fill_cost if ch in FILL else fill_cost + drop_cost if ch in LEET else None
        if ch == before:
            idle = repeat_cost if idle is None else min(idle, repeat_cost)
        for past, (cost, read) in states.items():
            for c, extra in ways:
                new, total = (past + c)[keep:], cost + extra + cost_of(past, c)
                if new not in after or total < after[new][0]:
                    after[new] = (total, (read, c))
            if ch in BLANKS and len(past) > 2 and (got := model.seen.get(past[-3:])) is not None:
                for c in got[1]:
                    if c != "$":
                        new, total = (past + c)[keep:], cost + blank_cost + cost_of(past, c)
                        if new not in after or total < after[new][0]:
                            after[new] = (total, (read, c))
            if idle is not None and (past not in after or cost + idle < after[past][0]):
                after[past] = (cost + idle, read)
            if ch in BREAKS and past != "^":
                total = cost + fill_cost + break_cost + end(past)
                if "^" not in after or total < after["^"][0]:
                    after["^"] = (total, (read, " "))
        states = after or {p: (c + 8.0, r) for p, (c, r) in states.items()}
        before = ch
    best = min(states, key=lambda p: (states[p][0] + end(p), p))
    out, at = [], states[best][1]
    while at is not None:
        at, c = at
        out.append(c)
    return "".join(reversed(out)).strip()


def _disguised(token: str) -> list[str]:
    """The token's cores, with and without its trailing symbols, that look like a disguised word."""
    if token.isalpha():
        return []
    whole = token.strip(OUTER)
    if whole.isalpha():
        return []
    cores = [core for core in dict.fromkeys((whole, whole.rstrip("!|+$"))) if _looks_disguised(core)]
    return [] if not cores or _MAIL.search(token) else cores


def _looks_disguised(core: str) -> bool:
    if len(core) < 3 or core.isalpha():
        return False
    once = _RUN.sub(r"\1", core)  # a run says no more than its character
    if sum(map(str.isalpha, once)) * 4 < len(once):
        return False
    inner = re.sub(r"^[^\W\d_]+(['.,;:-][^\W\d_]+)*$", "", core)
    return bool(inner) or max(map(len, re.split(r"['.,;:-]", core))) <= 3


def words_of(text, model: CharModel | None, cache: dict) -> set[bytes]:
    """Distinct lower-case words of the restored text: plain tokens as written, disguised ones as read (as written without a model)."""
    if not isinstance(text, str) or not text:
        return set()
    low = text.lower()
    if model is None:
        return set(low.encode("utf-8", "surrogatepass").translate(_PLAIN).split())
    found: set[bytes] = set()

    def restored(run: str) -> None:
        if run not in cache:
            if len(cache) > 60_000:
                cache.clear()
            cache[run] = decode(run, model).encode("utf-8", "surrogatepass").translate(_PLAIN).split()
        found.update(cache[run])

    tokens = set(low.split())
    plain = cache.setdefault(None, set())  # tokens already found to be undisguised
    if len(plain) > 100_000:
        plain.clear()
    read, repeats = [], _REPEAT.search(low)
    for token in tokens - plain:
        if cores := _disguised(token):
            for core in cores:
                restored(core)
            read.append(token)
        elif repeats and _REPEAT.search(token):
            restored(token.strip(EDGES))
            read.append(token)
        else:
            plain.add(token)
    tokens.difference_update(read)
    found.update(" ".join(tokens).encode("utf-8", "surrogatepass").translate(_PLAIN).split())
    for m in _SPACED.finditer(low):
        restored(m.group())
    return found


@dataclass
class Model:
    chars: CharModel
    weights: dict[bytes, float]
    bias: float


def type_of(word: bytes) -> str | None:
    """The word if the character model may learn from it: letters only, 24 at most."""
    if 2 <= len(word) <= 48 and (s := word.decode("utf-8", "ignore")).isalpha() and len(s) <= 24:
        return s
    return None


def clear(one: np.ndarray, zero: np.ndarray, n1: int, n0: int, least: int = 3) -> np.ndarray:
    """Which words occur in clearly more of the n1 label-1 documents (in `one` of them) than of the n0 others (in `zero`)."""
    p, q, both = one / n1, zero / n0, (one + zero) / (n1 + n0)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    return (one >= least) & (z > 4) & ((p + 0.5 / n1) / (q + 0.5 / n0) > 3)


_UNIT = 1 << 28  # losses and errors are summed as whole numbers of 1 / _UNIT, so their order is of no account


def slope(features: np.ndarray, lengths: np.ndarray, label: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Loss, then its gradient, in units, over n[i] documents with label[i] and the next lengths[i] of `features`; `at` is weights, then bias."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    z = np.clip(np.bincount(row, at[:-1][features], len(lengths)) + at[-1], -30, 30)
    err = np.rint((1 / (1 + np.exp(-z)) - label) * _UNIT).astype(np.int64) * n
    out = np.zeros(len(at) + 1, np.int64)
    out[0] = (np.rint((np.logaddexp(0, z) - label * z) * _UNIT).astype(np.int64) * n).sum()
    np.add.at(out[1:-1], features, err[row])
    out[-1] = err.sum()
    return out


def climb(summed, counts: np.ndarray, n1: int, n0: int, ridge: float = 0.02, steps: int = 300, near: float = 1e-3, memory: int = 12) -> np.ndarray:
    """Weights, then bias, of the ridge logistic model by L-BFGS; `summed` gives the slope at a point, `counts` in how many documents each feature is."""
    scale = 1 / np.sqrt(0.25 * np.append(counts, n1 + n0) + ridge)
    shrink = np.append(np.full(len(counts), ridge), 0.0)

    def value(x):
        at = x * scale
        got = summed(at) / _UNIT
        return got[0] + 0.5 * float(np.sum(shrink * at * at)), (got[1:] + shrink * at) * scale

    x = np.append(np.zeros(len(counts)), math.log(n1 / n0)) / scale
    loss, grad = value(x)
    past: list[tuple] = []
    for _ in range(steps):
        if np.abs(grad).max() <= near:
            break
        step, kept = -grad, []
        for ds, dg, r in reversed(past):
            kept.append(r * (ds @ step))
            step = step - kept[-1] * dg
        if past:
            step = step * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (ds, dg, r), k in zip(past, reversed(kept)):
            step = step + (k - r * (dg @ step)) * ds
        down, size = float(grad @ step), 1.0
        while True:
            new = x + size * step
            there, slant = value(new)
            if there <= loss + 1e-4 * size * down or size < 1e-6:
                break
            size /= 2
        if there >= loss:
            break
        ds, dg = new - x, slant - grad
        if ds @ dg > 0:
            past = [*past, (ds, dg, 1 / (ds @ dg))][-memory:]
        x, loss, grad = new, there, slant
    return x * scale


def fit(texts: list[str], labels: list[int]) -> Model:
    """Choose words that occur in clearly more of the label-1 documents and fit a ridge logistic model on their presence. `train` does the same over tables."""
    types: Counter = Counter()
    for t in texts:
        types.update({s for w in words_of(t, None, {}) if (s := type_of(w))})
    chars = CharModel.train(w for w in types if types[w] > 1)
    del types
    n1 = sum(map(bool, labels))
    n0 = len(labels) - n1
    if not n1 or not n0:
        return Model(chars, {}, 20.0 if n1 else -20.0)
    cache: dict = {}
    number: dict[bytes, int] = {}  # documents are kept as arrays of feature numbers
    bags = [np.array([number.setdefault(w, len(number)) for w in stems(words_of(t, chars, cache))], np.int32) for t in texts]
    one, zero = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for bag, label in zip(bags, labels):
        (one if label else zero)[bag] += 1
    telling = clear(one, zero, n1, n0)
    vocab = sorted(w for w, i in number.items() if telling[i])
    column = np.full(len(number), -1)
    column[[number[w] for w in vocab]] = np.arange(len(vocab))
    rows = [np.sort((c := column[bag])[c >= 0]) for bag in bags]
    packed = np.concatenate(rows), np.array([len(r) for r in rows]), np.array(labels, np.int64), np.ones(len(rows), np.int64)
    at = climb(lambda x: slope(*packed, x), np.array([(one + zero)[number[w]] for w in vocab]), n1, n0)
    return Model(chars, dict(zip(vocab, at[:-1].tolist())), float(at[-1]))


def stems(words: set[bytes], sizes=STEMS) -> set[bytes]:
    """The words and their beginnings (marked by a trailing ~): related forms share a stem."""
    return words.union(*[{w[:n] + b"~" for w in words if len(w) > n} for n in sizes])


def score_text(text, model: Model, cache: dict) -> float:
    known = model.weights.keys() & stems(words_of(text, model.chars, cache))
    z = model.bias + math.fsum(model.weights[w] for w in known)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def settled(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one label for each labelled document outside the held-out fold, by majority, ties as 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("doc_id")).agg((F.avg(F.col("toxic").cast("int")) >= 0.5).cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, max_bytes: int = 64 << 20) -> Model:
    """Fit on all labelled documents outside the held-out fold; if `max_labelled` is given, on at most that many of at most `max_bytes` together."""
    known = settled(labels)
    if max_labelled is None:
        return fit_whole(labelled(docs, known).select("mark", "label", "text"))
    marked = labelled(docs, known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)).withColumn("size", F.octet_length("text"))
    rows = bounded(marked, max_labelled, max_bytes)
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def labelled(docs: DataFrame, known: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(doc_id, label, mark, text) of all documents in `known`. Texts stay where they are: labels go out in broadcasts of about `most`, each with a scan of its own."""
    parts = max(1, -(-known.count() // most))
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(~held_out(F.col("doc_id")))
    pieces = [own.join(F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k) if parts > 1 else known), "doc_id") for k in range(parts)]
    return reduce(DataFrame.union, pieces).select("doc_id", "label", F.xxhash64("doc_id", "text").alias("mark"), "text")


def _summed(batches, each, schema: pa.Schema, rows=lambda held: [(*k, *v) for k, v in held.items()], most: int = 200_000):
    """Batches of the rows of the dictionary that `each(dictionary, batch)` fills, sent on whenever it has many keys."""

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows(held)), schema)], schema.names)

    held: dict = {}
    for b in small(batches):
        each(held, b)
        if len(held) > most:
            yield sent()
            held.clear()
    if held:
        yield sent()


def fit_whole(marked: DataFrame) -> Model:
    """`fit` over all rows of `marked` (mark, label, text); rows of one mark are one. Neither texts nor counts of all words reach the driver."""
    share = marked.sparkSession.sparkContext.broadcast
    type_rows = pa.schema({"word": pa.string(), "mark": pa.int64()})
    gram_rows = pa.schema({"past": pa.string(), "ch": pa.string(), "n": pa.int64()})
    word_rows = pa.schema({"word": pa.binary(), "one": pa.int64(), "zero": pa.int64()})
    like_rows = pa.schema({"features": pa.list_(pa.int32()), "label": pa.int32(), "n": pa.int64()})

    def types(held, b):
        for mark, text in zip(b.column("mark").to_pylist(), b.column("text")):
            for w in words_of(text.as_py(), None, {}):
                if w not in held:
                    if type_of(w):
                        held[w] = mark
                elif held[w] != mark:
                    held[w] = None  # in two documents

    def typed(held):
        return [(type_of(w), mark) for w, mark in held.items()]

    def grams_of(held, b):
        for k, n in grams(b.column("word").to_pylist()).items():
            held[k] = (held.get(k, (0,))[0] + n,)

    words = marked.select("mark", "text").mapInArrow(lambda bs: _summed(bs, types, type_rows, typed), "word string, mark long")
    words = words.groupBy("word").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.max(F.col("mark").isNull()).alias("two"))
    words = words.where("two or low < high").select("word")
    counted = words.mapInArrow(lambda bs: _summed(bs, grams_of, gram_rows), "past string, ch string, n long")
    chars = CharModel.counted(map(tuple, counted.groupBy("past", "ch").agg(F.sum("n")).collect()))
    model = share(chars)

    def restored(batches):
        cache: dict = {}
        for b in small(batches):
            read = [zlib.compress(b" ".join(sorted(words_of(t.as_py(), model.value, cache))), 1) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("mark"), b.column("label"), pa.array(read, pa.binary())], ["mark", "label", "words"])

    bags = durable(marked.mapInArrow(restored, "mark long, label int, words binary").dropDuplicates(["mark"]))
    sizes = dict(map(tuple, bags.groupBy("label").count().collect()))
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(chars, {}, 20.0 if n1 else -20.0)

    def read_again(b):
        return zip(b.column("label").to_pylist(), (stems(set(zlib.decompress(w).split())) for w in b.column("words").to_pylist()))

    def tallied(held, b):
        for label, found in read_again(b):
            for w in found:
                one, zero = held.get((w,), (0, 0))
                held[(w,)] = (one + label, zero + 1 - label)

    def chosen(batches):
        for b in batches:
            one, zero = (b.column(c).to_numpy(zero_copy_only=False) for c in ("one", "zero"))
            yield b.filter(pa.array(clear(one, zero, n1, n0)))

    tally = bags.mapInArrow(lambda bs: _summed(bs, tallied, word_rows), "word binary, one long, zero long")
    tally = tally.groupBy("word").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    vocab = sorted((bytes(w), one + zero) for w, one, zero in tally.mapInArrow(chosen, "word binary, one long, zero long").collect())
    number = share({w: i for i, (w, _) in enumerate(vocab)})

    def patterned(held, b):
        at = number.value
        for label, found in read_again(b):
            k = (tuple(sorted(at[w] for w in at.keys() & found)), label)
            held[k] = (held.get(k, (0,))[0] + 1,)

    # Documents with the same telling words and label count together.
    alike = bags.mapInArrow(lambda bs: _summed(bs, patterned, like_rows), "features array<int>, label int, n long")
    alike = durable(alike.groupBy("features", "label").agg(F.sum("n").alias("n")))
    alike = alike.coalesce(max(1, min(marked.sparkSession.sparkContext.defaultParallelism, alike.count() // 20_000)))

    def summed(at):
        def run(batches):
            total = np.zeros(len(at) + 1, np.int64)
            for b in batches:
                f = b.column("features")
                label, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "n"))
                total += slope(f.flatten().to_numpy(zero_copy_only=False), np.diff(f.offsets.to_numpy()), label, n, at)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return np.sum([np.frombuffer(r["total"], np.int64) for r in alike.mapInArrow(run, "total binary").collect()], axis=0)

    at = climb(summed, np.array([n for _, n in vocab]), n1, n0)
    return Model(chars, dict(zip((w for w, _ in vocab), at[:-1].tolist())), float(at[-1]))


def assess(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, threshold: float = 0.3, model: Model | None = None) -> DataFrame:
    """Score every whole text of `docs`: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, max_labelled))

    def run(batches):
        cache: dict = {}
        for b in small(batches):
            got = [score_text(t.as_py(), model.value, cache) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    fed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return fed.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, threshold: float = 0.3) -> DataFrame:
    """`docs` without the documents whose score reaches the threshold, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))

    def run(batches):
        cache: dict = {}
        for b in small(batches):
            keep = [score_text(t.as_py(), model.value, cache) < threshold for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
