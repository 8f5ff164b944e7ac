"""Helpers that the text operators share: durable cuts of lineage, column checks, vectorised hashing of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is named (tests), one beside the tables of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so lost executors cost no recomputation of what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(marked: DataFrame, rows: int, size: int) -> list:
    """At most `rows` distinct rows of at most `size` bytes together, in the order of their `mark` (a hash of all that tells rows apart).

    `marked` has mark, size (bytes of its text) and other columns. Choice is made on marks and sizes; only chosen texts reach the driver.
    """
    few = marked.select("mark", "size").distinct().orderBy("mark", "size").limit(rows).collect()
    chosen, used = [], 0
    for r in few:
        if used + r["size"] > size:
            continue
        used += r["size"]
        chosen.append((r["mark"],))
    if not chosen:
        return []
    picked = F.broadcast(marked.sparkSession.createDataFrame(chosen, "mark long"))
    return sorted(marked.join(picked, "mark").dropDuplicates(["mark"]).collect(), key=lambda r: r["mark"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def constant_array(values, kind: str) -> Column:
    """A literal array of many numbers, as one string that the optimizer folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, grown when a longer buffer comes."""
    if not len(_POWERS) or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["codes"] = _byte_codes()
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII white space) and, per text, where its words begin (n + 1 offsets)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    up, down = _powers(len(data))
    blank = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    total = np.cumsum(_POWERS["codes"][data] * up[: len(data)], dtype=np.uint64)
    hashes = mix64((total[ends - 1] - total[starts - 1]) * down[starts])
    return hashes, np.searchsorted(starts, begins)


def shingle_hashes(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of `words` words, with n + 1 offsets. A shorter text has one shingle of all its words; one without words has none."""
    h, at = word_hashes(texts)
    counts = np.diff(at)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(counts)), made)
    first = at[:-1][doc] + (np.arange(len(doc)) - offsets[:-1][doc])
    out = np.zeros(len(doc), np.uint64)
    last = at[1:][doc]
    for j in range(words):
        inside = first + j < last
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += np.where(inside, h[np.minimum(first + j, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(j + 1))
    return mix64(out), offsets


def small(batches, rows: int = 512):
    """All rows of the Arrow batches in order, at most `rows` at a time, so that a worker's copies of texts stay few. Freed memory goes back at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def slabs(texts: list[bytes], size: int = 512 << 10):
    """Ranges of texts of about `size` bytes together; a longer text comes alone, whole."""
    start = used = 0
    for i, t in enumerate(texts):
        if used and used + len(t) > size:
            yield start, i
            start, used = i, 0
        used += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of each value of a pandas column; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]
