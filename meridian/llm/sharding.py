"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of a prime number of slots and the shards take turns claiming the
next free slot, so each gets an equal share and few slots change hands when a shard joins or leaves.
The table (a prime number of slots, fixed by a parameter and hence bounded) is broadcast; placing a row
hashes its key to a slot and reads the owner.

Defined results: a null key hashes as its own value, so such rows share one slot only if their texts are
equal too (the text is the fallback key); texts of any length are kept whole; repeated rows land on one shard; an empty table gives
an empty result; other columns are kept as they are, and slot and shard take as many underscores as they need to be new names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
MAX_SLOTS = 1 << 24


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation; any skip below a prime visits every slot."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard index that owns each slot."""
    if not is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}: {slots}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, at most as many as slots")
    owner = np.full(slots, -1, np.int32)
    at = [preference(s, slots) for s in shards]
    following = [a for a, _ in at]
    left = slots
    while left:
        for k, (_, skip) in enumerate(at):
            slot = following[k]
            while owner[slot] >= 0:
                slot = (slot + skip) % slots
            owner[slot] = k
            following[k] = (slot + skip) % slots
            left -= 1
            if not left:
                break
    return owner


def slot_of(key, fallback, slots: int):
    """The slot of a row: its key's hash modulo the table; rows without a key use the fallback."""
    return F.pmod(F.when(key.isNull(), F.xxhash64(F.lit("no key"), fallback)).otherwise(F.xxhash64(key)), F.lit(slots)).cast("int")


def free_names(taken: list[str]) -> dict[str, str]:
    """slot and shard, with underscores until no column has that name (in any case)."""
    low, out = {c.lower() for c in taken}, {}
    for n in ("slot", "shard"):
        out[n] = n
        while out[n].lower() in low:
            out[n] += "_"
        low.add(out[n].lower())
    return out


def place(docs: DataFrame, n_shards: int = 64, slots: int = SLOTS) -> DataFrame:
    """`docs` with its columns as they are, plus slot and shard (with underscores where the names are taken)."""
    spark = docs.sparkSession
    owner = fill([f"shard-{k:05d}" for k in range(n_shards)], slots)
    names = free_names(docs.columns)
    lookup = spark.createDataFrame([(int(s), int(k)) for s, k in enumerate(owner)], f"`{names['slot']}` int, `{names['shard']}` int")
    placed = docs.withColumn(names["slot"], slot_of(F.col("doc_id"), F.col("text"), slots))
    joined = placed.join(F.broadcast(lookup), names["slot"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], names["slot"], names["shard"])


def write_shards(docs: DataFrame, path: str, n_shards: int = 64, slots: int = SLOTS, file_bytes: int = 256 << 20) -> None:
    """Write one folder per shard, in files of about `file_bytes` of text; as many tasks as files, so no task holds a whole shard.

    Files of a shard are dealt by a hash of the row; rows alike in doc_id and text share a file.
    """
    out = place(docs, n_shards, slots)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    files = max(1, -(-size // (n_shards * file_bytes)))
    shard = out.columns[-1]
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    out.repartition(n_shards * files, F.col(shard), deal).write.partitionBy(shard).mode("overwrite").parquet(path)
