"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same real number of copies, target / size of the source. The
whole part is sure; the fraction is rounded by pairing documents and moving words between the two at
random, in proportions that keep each one's expected copies, until one of them is a whole number. Pairing
runs inside buckets of about `bucket` documents of a source (dealt by a hash of the row), each of which
leaves one fractional document at most; those residuals are paired again in a tree of the same fan-in, until a
source has one left, which goes to the nearer whole number. So a source misses its target by half a
document at most. Draws come from hashes of the rows, so reruns agree whatever the cluster's layout.

Rows alike in doc_id, text and source are counted before they are dealt, and paired as one document with their copies together,
so any number of them is one small row; their copies are then shared out as evenly as whole numbers allow.

Defined results: null text has size 0 and takes nothing; texts of any length are counted whole; null source is a source of its own,
last in order; rows with a null doc_id are rows like others; repeated rows are separate rows; an empty table gives an empty result;
other columns are ignored by `mix` and kept as they are by `repeat`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
STATE = "doc_id string, mark long, source string, size long, rows long, target double, source_size long, whole long, share double"
MOST_SOURCES = 20_000  # beyond that many, targets are found by a distributed search
CHUNK = 10_000  # a row is repeated so often at most in one step


def targets(sizes: dict[str | None, int], weights=WEIGHTS, total_share: float = 1.5, limit: float = 2.0) -> dict[str | None, float]:
    """Words each source should give. A source stops at `limit` times its size; what it cannot give goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left = total_share * sum(sizes.values())
    out: dict[str | None, float] = {}
    open_ = list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > limit * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def plan(sources: DataFrame, weights=WEIGHTS, total_share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(plan_source, target, source_size, n) of sources (source, words, n) of any number: `targets` as a distributed search.

    Sources are ranked by code point inside ranges; the amount of a unit of weight then rises, one aggregate a step, until no further source is full.
    """
    dealt = durable(sources.where("source is not null").repartitionByRange("source").select("source", "words", "n", F.spark_partition_id().alias("part")))
    parts = dealt.groupBy("part").agg(F.count("*").alias("held"))
    before = parts.select(F.col("part").alias("of"), (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("before"))  # one row a range
    rank = F.row_number().over(W.partitionBy("part").orderBy("source")) - 1
    ranked = dealt.withColumn("rank", rank).join(before, F.col("part") == F.col("of")).select("source", "words", "n", (F.col("rank") + F.col("before")).alias("rank"))
    last = sources.where("source is null").select("source", "words", "n", F.lit(dealt.count()).cast("long").alias("rank"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    all_ = durable(ranked.unionByName(last).withColumn("weight", weight))
    room = F.lit(float(limit)) * F.col("words")
    unit = float("inf")
    while True:
        full = F.col("weight") * F.lit(unit) > room if unit < float("inf") else F.lit(False)
        r = all_.agg(F.sum("words").alias("all"), F.sum(F.when(full, room).otherwise(F.lit(0.0))).alias("given"), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = (total_share * r["all"] - r["given"]) / r["open"]
        if new == unit:
            break
        unit = new
    target = F.least(F.col("weight") * F.lit(unit), room) if unit < float("inf") else room
    return all_.select(F.col("source").alias("plan_source"), target.alias("target"), F.col("words").alias("source_size"), "n")


def pivot(size: np.ndarray, share: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round `share` (expected extra copies, each in [0, 1)) so that the sum of size * share stays; returns 0/1 values and the index of the one still fractional, or -1."""
    rng = np.random.default_rng(seed)
    value = share.astype(float).copy()
    value[value > 1 - 1e-12] = 1.0
    value[value < 1e-12] = 0.0
    draws = rng.random(len(value))
    keep = -1
    for i in range(len(value)):
        p = value[i]
        if p <= 0 or p >= 1 or size[i] == 0:
            continue
        if keep < 0:
            keep = i
            continue
        q, a, b = value[keep], float(size[keep]), float(size[i])
        up, down = min((1 - q) * a, p * b), min(q * a, (1 - p) * b)
        if draws[i] * (up + down) < down:
            q, p = q + up / a, p - up / b
        else:
            q, p = q - down / a, p + down / b
        q, p = (round(x) if min(x, 1 - x) < 1e-9 else x for x in (q, p))
        value[keep], value[i] = q, p
        if 0 < p < 1:
            keep = i
        elif not 0 < q < 1:
            keep = -1
    return value, keep


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: settle all but one of its rows; the open one keeps a share strictly between 0 and 1."""
    pdf = pdf.sort_values(["mark", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
    seed = int(np.bitwise_xor.reduce(pdf["mark"].to_numpy(np.int64)) & 0x7FFFFFFF) + len(pdf)
    value, keep = pivot(pdf["size"].to_numpy(), pdf["share"].to_numpy(), seed)
    settled = np.arange(len(pdf)) != keep
    pdf["whole"] = pdf["whole"] + np.where(settled & (pdf["size"] > 0), np.rint(np.where(settled, value, 0)), 0).astype("int64")
    pdf["share"] = np.where(settled, 0.0, value)
    return pdf[["doc_id", "mark", "source", "size", "rows", "target", "source_size", "whole", "share"]]


def _mark() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.col("source").cast("string"))


def _times(df: DataFrame, times: str, most: int) -> DataFrame:
    """Each row `times` times over, numbered from 1 in `__nth`; what is repeated very often is dealt out in between."""
    if most <= CHUNK:
        return df.where(F.col(times) > 0).withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK)))
    dealt = df.where(F.col(times) > 0).withColumn("__part", part).repartition("__part")
    upper = F.least(F.col(times).cast("long"), (F.col("__part") + 1) * CHUNK)
    return dealt.withColumn("__nth", F.explode(F.sequence(F.col("__part") * CHUNK + 1, upper))).drop("__part")


def _settled(docs: DataFrame, weights, total_share: float, limit: float, bucket: int, most_sources: int) -> DataFrame:
    """STATE of every distinct (doc_id, mark): `whole` copies of its `rows` rows together."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _mark().alias("mark"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    counted = durable(own.groupBy("doc_id", "mark", "source", "size").agg(F.count("*").alias("rows")))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("n"))
    found = sources.limit(most_sources + 1).collect()
    if len(found) <= most_sources:
        wanted = targets({r["source"]: int(r["words"]) for r in found}, weights, total_share, limit)
        planned = F.broadcast(spark.createDataFrame([(r["source"], float(wanted[r["source"]]), int(r["words"]), r["n"]) for r in found], "plan_source string, target double, source_size long, n long"))
        most = max((r["n"] for r in found), default=0)
    else:
        planned = durable(plan(sources, weights, total_share, limit))
        most = planned.agg(F.max("n")).first()[0] or 0
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("rows")
    buckets = F.ceil(F.col("n") / bucket)
    state = counted.join(planned, F.col("source").eqNullSafe(F.col("plan_source"))).select("doc_id", "mark", "source", "size", "rows", "target", "source_size", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("share"), F.pmod(F.xxhash64("doc_id", "mark"), buckets).alias("slot"))
    state = durable(state.groupBy("source", "slot").applyInPandas(lambda p: _round(p), STATE))
    done, left = [state.where("share = 0")], state.where("share > 0")
    most = math.ceil(most / bucket)
    while most > 1:  # a level of the tree: at most one open row of each bucket comes up
        most = math.ceil(most / bucket)
        level = left.groupBy("source", F.pmod(F.xxhash64("mark", F.lit(most)), F.lit(most)).alias("slot")).applyInPandas(lambda p: _round(p), STATE)
        level = durable(level)
        done.append(level.where("share = 0"))
        left = level.where("share > 0")
    done.append(left.withColumn("whole", F.col("whole") + F.when(F.col("share") > 0.5, 1).otherwise(0)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = 1.5, limit: float = 2.0, bucket: int = 512, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Every row of `docs` (doc_id, text, source) with size, source_size, target, copies and taken; mark is a hash of the row."""
    state = _settled(docs, weights, total_share, limit, bucket, most_sources)
    each = _times(state, "rows", state.agg(F.max("rows")).first()[0] or 0)
    copies = F.floor(F.col("whole") / F.col("rows")) + F.when(F.col("__nth") <= F.col("whole") % F.col("rows"), 1).otherwise(0)
    return each.select(F.col("doc_id").cast("long").alias("doc_id"), "mark", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights=WEIGHTS, total_share: float = 1.5, limit: float = 2.0, bucket: int = 512, most_sources: int = MOST_SOURCES) -> DataFrame:
    """`docs`, each row as often as the mix takes it, all columns as they are.

    Rows alike in doc_id, text and source share their copies as evenly as whole numbers allow, the least hash over all columns first.
    """
    state = _settled(docs, weights, total_share, limit, bucket, most_sources)
    names = [F.col(f"`{c}`") for c in docs.columns]
    id_ = F.col("doc_id").cast("string")
    keys = {"__mark": _mark(), "__key": F.coalesce(id_, F.lit("")), "__none": id_.isNull()}
    state = state.select(F.col("mark").alias("__mark"), keys["__key"].alias("__key"), keys["__none"].alias("__none"), F.col("rows").alias("__rows"), F.col("whole").alias("__whole"))
    marked = docs.withColumns(keys)
    most = state.where("__rows > 1").agg(F.max("__whole")).first()[0]
    if most is None:  # no row comes twice, so there is nothing to share
        return _times(marked.join(state.select(*keys, "__whole"), [*keys]), "__whole", 0).select(*names)
    # kinds of row (alike in all columns) of each mark, in order of their hash: a kind is one row with a number
    row = F.xxhash64(*names)
    kinds = marked.withColumn("__row", row).groupBy(*keys, "__row").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__row")) - F.col("__n")
    shared = kinds.join(state, [*keys]).withColumn("__before", before)
    extra = F.least(F.col("__n"), F.greatest(F.lit(0), F.col("__whole") % F.col("__rows") - F.col("__before")))
    shared = shared.select(*keys, "__row", (F.floor(F.col("__whole") / F.col("__rows")) * F.col("__n") + extra).alias("__times"))
    alone = marked.withColumn("__row", row).dropDuplicates([*keys, "__row"])
    return _times(alone.join(shared, [*keys, "__row"]), "__times", most).select(*names)
