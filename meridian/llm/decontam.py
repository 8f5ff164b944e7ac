"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage of the corpus.

Items are documents of the index, grouped in blocks; postings keep BM25 impacts (as shares of the item's own best
score) and, per term, the largest impact of the list and of each block. A passage (a window of `2 * stride` words, every `stride`
words, with stride at least the longest item) is a query. First its bound for each block is summed from block maxima of the
essential postings (those without which no item can reach the threshold) plus the most the others can add, for a batch of
passages at once; passages without a block at the threshold leave there. Every other passage is searched by block-max WAND: its
terms' cursors are kept in the order of their items, the pivot is the first item at which the list maxima add up to the threshold,
block maxima at the pivot decide whether to skip to the next block or to score, and all items at or above the threshold are
retrieved. Each retrieved pair is verified against the words of the passage: the five-word shingles of the item must occur
there to `least_overlap`, and those of its question part and of its answer part (the last sentence) each to `least_part`; a part
of fewer than five words is one shingle of all its words.

BM25's counts are those of the whole benchmark. Items are searched in blocks of at most `items_at_once`; a block's index is
broadcast alone and its result written before the next one, so a larger benchmark means more passes, not more memory.

Words are compared in lower case and without ASCII punctuation, so a passage set into a sentence still matches.

Defined results: null or empty texts and items, and those without words, match nothing; texts of any length are searched whole; an
item of fewer than five words must occur as a whole; each (doc_id, item_id) is reported once, with the numbers of its best
passage (by score, then overlap), so repeated rows and items come once and rows with a null doc_id are reported together; ties
between items are all retrieved; empty tables give an empty result; other columns are ignored by `find` and kept as they are by
`keep_clean`, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, durable, mix64, slabs, small, word_hashes

SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# ASCII punctuation separates words
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() or b in (9, 10, 11, 12, 13) else 32 for b in range(256))


@dataclass
class Index:
    """terms: sorted word hashes. post_*: postings by term, in item order. width: items of a block."""

    ids: np.ndarray
    terms: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    width: int
    stride: int
    parts: list  # per item: the shingles of the whole, of its question and of its answer
    kept: dict = field(default_factory=dict)

    def lists(self, k: int) -> tuple:
        """Of a term: its items, their impacts, the largest one, and the largest of each block of items that it meets (kept once made)."""
        if ("list", k) not in self.kept:
            a, z = self.post_at[k], self.post_at[k + 1]
            items, impacts = self.post_item[a:z].tolist(), self.post_impact[a:z].tolist()
            most: dict[int, float] = {}
            for i, x in zip(items, impacts):
                most[i // self.width] = max(most.get(i // self.width, 0.0), x)
            self.kept["list", k] = items, impacts, max(impacts), most
        return self.kept["list", k]

    def essential(self, threshold: float):
        """Block maxima (offsets by term, blocks, largest impacts) of the essential postings, and per block the most that the others can add.

        An item's least impacts, up to half the threshold together, are its non-essential ones.
        """
        if threshold not in self.kept:
            n, items = len(self.post_item), len(self.ids)
            term = np.repeat(np.arange(len(self.terms)), np.diff(self.post_at))
            order = np.lexsort((term, self.post_impact, self.post_item))
            first = np.searchsorted(self.post_item[order], np.arange(items))
            run = np.cumsum(self.post_impact[order])
            run -= np.append(0.0, run)[first][self.post_item[order]]
            small = np.zeros(n, bool)
            small[order] = run <= threshold / 2
            n_blocks = (items - 1) // self.width + 1
            spare = np.bincount(self.post_item[small], self.post_impact[small], items)
            rest = np.zeros(n_blocks)
            np.maximum.at(rest, np.arange(items) // self.width, spare)
            key = term[~small] * n_blocks + self.post_item[~small] // self.width
            keys, inverse = np.unique(key, return_inverse=True)
            most = np.zeros(len(keys))
            np.maximum.at(most, inverse, self.post_impact[~small])
            self.kept[threshold] = np.searchsorted(keys // n_blocks, np.arange(len(self.terms) + 1)), keys % n_blocks, most, rest
        return self.kept[threshold]


def plain(texts) -> list[bytes]:
    """UTF-8 of each text in lower case, ASCII punctuation blanked; null is empty."""
    return [t.translate(_PLAIN) for t in as_bytes([t.lower() if t else t for t in texts])]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(out)]
    return mix64(out)


def _part(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The distinct shingles of a part: of five words, or one of all its words; with their length."""
    n = min(5, len(h))
    return n, np.unique(_grams(h, n)) if n else h


@dataclass
class Counts:
    """What BM25 takes from a whole benchmark: items, words, the longest item, and how many items hold each term."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


def _words(items):
    items = [(i, t) for i, t in items if isinstance(t, str) and plain([t])[0].split()]
    h, at = word_hashes(plain([t for _, t in items]))
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(items)), sizes)
    pairs, tf = np.unique(np.stack([h, owner.astype(np.uint64)]), axis=1, return_counts=True) if len(h) else (np.zeros((2, 0), np.uint64), np.zeros(0))
    return items, h, at, sizes, pairs, tf


def count(blocks) -> Counts:
    """Counts over all blocks of items."""
    out = Counts(0, 0, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for block in blocks:
        items, _, _, sizes, pairs, _ = _words(block)
        terms, df = np.unique(pairs[0], return_counts=True)
        both, inverse = np.unique(np.concatenate([out.terms, terms]), return_inverse=True)
        merged = np.zeros(len(both), np.int64)
        np.add.at(merged, inverse, np.concatenate([out.df, df]))
        out = Counts(out.items + len(items), out.words + int(sizes.sum()), max(out.longest, int(sizes.max(initial=1))), both, merged)
    return out


def build(items: list[tuple[int, str]], width: int = 8, stride: int = 64, k1: float = 1.2, b: float = 0.75, counts: Counts | None = None) -> Index:
    """Index the items' words (lower case, without punctuation). Impacts are divided by the item's best possible score.

    `counts` are those of the whole benchmark, of which the items may be a block.
    """
    counts = counts or count([items])
    items, h, at, sizes, pairs, tf = _words(items)
    terms, df = np.unique(pairs[0], return_counts=True)
    item = pairs[1].astype(np.int64)
    mean = counts.words / max(counts.items, 1)
    held = counts.df[np.searchsorted(counts.terms, terms)]
    idf = np.log1p((counts.items - held + 0.5) / (held + 0.5))
    impact = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[item] / max(mean, 1)))
    best = np.bincount(item, impact, len(items))
    impact = impact / np.maximum(best[item], 1e-12)
    post_at = np.concatenate([[0], np.cumsum(df)])
    cut = []
    for k, (_, t) in enumerate(items):
        words = h[at[k] : at[k + 1]]
        parts = [n for x in plain(_SENTENCE.split(t.strip())) if (n := len(x.split()))]
        tail = parts[-1] if len(parts) > 1 else max(1, len(words) // 4)
        cut.append((_part(words), _part(words[: len(words) - tail]), _part(words[len(words) - tail :])))
    return Index(np.array([i for i, _ in items], np.int64), terms, post_at, item, impact, width, max(stride, counts.longest), cut)


def _spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the lists `which` and, for each, the index in `which` it belongs to."""
    n = at[which + 1] - at[which]
    who = np.repeat(np.arange(len(which)), n)
    return at[which][who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n), who


def search(index: Index, texts: list[bytes], threshold: float):
    """Pairs (text, item, score, first word, past last word) of all passages that reach the threshold, and the word hashes with offsets."""
    h, at = word_hashes(texts)
    none = np.zeros(0, np.int64)
    empty = (none, none, np.zeros(0), none, none, h, at)
    if not len(h) or not len(index.terms):
        return empty
    cells = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(at) // index.stride)))])
    # bounds by block, from the essential postings: without one of them no item can reach the threshold
    block_at, block_id, block_max, rest = index.essential(threshold)
    wanted = index.terms[np.diff(block_at) > 0]
    sieve = np.zeros(1 << 16, bool)
    sieve[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
    passage, word = _queries(index, h, at, cells, maybe)
    entry, who = _spread(block_at, word)
    n_blocks = len(rest)
    keys, inverse = np.unique(passage[who] * n_blocks + block_id[entry], return_inverse=True)
    alive = keys[np.bincount(inverse, block_max[entry], len(keys)) + rest[keys % n_blocks] >= threshold - 1e-9]
    if not len(alive):
        return empty
    # the cursors of every passage that is left
    live = np.unique(alive // n_blocks)
    start = at[doc := np.searchsorted(cells, live, "right") - 1] + (live - cells[doc]) * index.stride
    end = np.minimum(start + 2 * index.stride, at[doc + 1])
    size = end - start
    spots = np.unique(np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    passage, word = _queries(index, h, at, cells, spots)
    ends = np.searchsorted(passage, live, "right")
    got = [wand(index, word[a:z].tolist(), threshold) for a, z in zip(np.searchsorted(passage, live), ends)]
    n = np.array([len(g) for g in got])
    item = np.array([i for g in got for i, _ in g], np.int64)
    score = np.array([x for g in got for _, x in g], float)
    return np.repeat(doc, n), item, score, np.repeat(start, n), np.repeat(end, n), h, at


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose impacts over these terms reach the threshold, by block-max WAND."""
    cursors = [[items[0], 0, items, impacts, top, most] for items, impacts, top, most in map(index.lists, terms)]
    cursors.sort(key=lambda c: c[0])
    threshold -= 1e-9
    out, width = [], index.width

    def settle(moved: int, target: int) -> None:
        """Move the first cursors to the target or beyond, drop those that end, and restore the order."""
        for c in cursors[:moved]:
            if c[0] < target:
                c[1] = bisect_left(c[2], target, c[1])
                c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]
        cursors.sort(key=lambda c: c[0])

    while cursors:
        bound, p = 0.0, -1
        for p, c in enumerate(cursors):
            bound += c[4]
            if bound >= threshold:
                break
        if bound < threshold:
            break
        pivot = cursors[p][0]
        while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
            p += 1
        block = pivot // width
        if sum(c[5].get(block, 0.0) for c in cursors[: p + 1]) < threshold:  # nothing before the next block, or the next list, can reach it
            far = (block + 1) * width
            settle(p + 1, min(far, cursors[p + 1][0]) if p + 1 < len(cursors) else far)
        elif cursors[0][0] == pivot:
            score = math.fsum(c[3][c[1]] for c in cursors[: p + 1])
            if score >= threshold:
                out.append((pivot, score))
            settle(p + 1, pivot + 1)
        else:
            settle(p + 1, pivot)
    return out


def _queries(index: Index, h, at, cells, spots) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (passage, term) of the words at `spots`. Passage c joins stretch c of a text and the next one."""
    term = np.searchsorted(index.terms, h[spots])
    known = index.terms[np.minimum(term, len(index.terms) - 1)] == h[spots]
    spots, term = spots[known], term[known]
    doc = np.searchsorted(at, spots, "right") - 1
    cell = (spots - at[doc]) // index.stride
    here, before = cells[doc] + cell, cell > 0
    pairs = np.unique(np.concatenate([here, here[before] - 1]) * np.int64(len(index.terms)) + np.concatenate([term, term[before]]))
    return pairs // len(index.terms), pairs % len(index.terms)


def matches(index: Index, texts: list[bytes], threshold: float, least_overlap: float, least_part: float):
    """Verified hits: (text, item id, score, overlap, question overlap, answer overlap), the best passage of each pair."""
    doc, item, score, start, end, h, _ = search(index, texts, threshold)
    best: dict[tuple[int, int], tuple] = {}
    for d, i, s, a, e in zip(doc.tolist(), item.tolist(), score.tolist(), start.tolist(), end.tolist()):
        known: dict[int, np.ndarray] = {}

        def share(n, want, a=a, e=e, known=known):
            if not n:
                return 1.0
            if n not in known:
                known[n] = _grams(h[a:e], n)
            return float(np.isin(want, known[n]).mean())

        overlap, q, w = (share(*part) for part in index.parts[i])
        if overlap >= least_overlap and min(q, w) >= least_part:
            got = (s, overlap, q, w)
            best[d, i] = max(best.get((d, i), got), got)
    return [(d, int(index.ids[i]), *got) for (d, i), got in best.items()]


def item_blocks(benchmark: DataFrame, items_at_once: int):
    """The benchmark's rows on the driver, `items_at_once` at a time (a stated query set, in blocks)."""
    block = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == items_at_once:
            yield block
            block = []
    if block:
        yield block


def _in_turn(spark, benchmark, items_at_once, one):
    """one(index) for each block of items, written before the next index is made if there are several; the last or only result stays lazy."""
    counts = count(item_blocks(benchmark, items_at_once))
    left = -(-counts.items // items_at_once)
    for block in item_blocks(benchmark, items_at_once):
        index = spark.sparkContext.broadcast(build(block, counts=counts))
        got = one(index)
        left -= 1
        if left > 0:
            got = durable(got)
            index.unpersist()
        yield got


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least_overlap: float = 0.8, least_part: float = 0.6, items_at_once: int = 20_000) -> DataFrame:
    """One row per document and item whose passage it holds."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(index):
        def run(batches):
            for b in small(batches):
                ids = b.column("doc_id")
                texts = plain(b.column("text").to_pylist())
                rows = []
                for lo, hi in slabs(texts):
                    rows += [(ids[lo + d].as_py(), *rest) for d, *rest in matches(index.value, texts[lo:hi], threshold, least_overlap, least_part)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        return own.mapInArrow(run, SCHEMA)

    out = spark.createDataFrame([], SCHEMA)
    for part in _in_turn(spark, benchmark, items_at_once, one):
        out = out.unionByName(part)
    best = F.max(F.struct("score", "overlap", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least_overlap: float = 0.8, least_part: float = 0.6, items_at_once: int = 20_000) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage, all columns as they are."""
    state = [docs]

    def one(index):
        def run(batches):
            for b in small(batches):
                texts = plain(b.column("text").to_pylist())
                bad = set()
                for lo, hi in slabs(texts):
                    bad |= {lo + m[0] for m in matches(index.value, texts[lo:hi], threshold, least_overlap, least_part)}
                yield b.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        state[0] = state[0].mapInArrow(run, docs.schema)
        return state[0]

    for state[0] in _in_turn(docs.sparkSession, benchmark, items_at_once, one):
        pass
    return state[0]
