"""Cadence operators: ticks, prefetch, at-or-before lookup, brackets, record slices, months of a span, time shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import epoch_seconds, from_micros, instant, micros, snap_down, url_at
from .order import BLOCK, carried, following, numbered


def ticks(spark: SparkSession, start: str, step_seconds: int, lower: str | None = None, upper: str | None = None, end: str | None = None) -> DataFrame:
    """(tick_index, anchor, epoch_s) of all aligned instants in [max(lower, start), min(upper, end)); empty if nothing bounds it above."""
    bounds = [b for b in (upper, end) if b is not None]
    one = spark.range(1)
    if not bounds:
        return one.where("false").select(F.col("id").alias("tick_index"), instant(start).alias("anchor"), F.lit(0.0).alias("epoch_s"))
    step = step_seconds * 10**6
    first = micros(instant(start))
    low = F.greatest(first, micros(instant(lower)) if lower else first)
    begin = -F.floor(-(low - first) / F.lit(step)).cast("long")
    top = F.least(*[micros(instant(b)) for b in bounds], F.lit(2**62).cast("long"))
    stop = -F.floor(-(top - first) / F.lit(step)).cast("long")  # first tick not before the end
    index = F.when(stop > begin, F.sequence(begin, stop - 1)).otherwise(F.array().cast("array<bigint>"))
    at = from_micros(first + F.col("tick_index") * F.lit(step))
    return one.select(F.explode(index).alias("tick_index")).select("tick_index", at.alias("anchor"), epoch_seconds(at).alias("epoch_s"))


def prefetch(ticked: DataFrame, start: str, file_seconds: int, template: str) -> DataFrame:
    """Distinct (file_anchor, url) of the files that the ticks need."""
    anchor = snap_down(F.col("anchor"), instant(start), file_seconds)
    return ticked.select(anchor.alias("file_anchor")).distinct().select("file_anchor", url_at(F.col("file_anchor"), template).alias("url"))


def at_or_before(asked: DataFrame, records: DataFrame, on: str, at: str, value: str, clamp: bool = False, block: int = BLOCK) -> DataFrame:
    """`asked` with <at> and <value> of the latest record not after its <on>; ties take the least value.

    Both sides are numbered in one order of time and filled forward inside blocks of rows; a block starts with the last record of all
    earlier ones, found over one row per block. With `clamp`, instants before all records get the earliest one.
    """
    names = asked.columns
    best = records.groupBy(F.col(at).alias("__at")).agg(F.min(value).alias("__value")).where("__at is not null")
    left = asked.select(*[F.col(c) for c in names], F.col(on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(best.schema["__at"].dataType).alias("__at"), F.lit(None).cast(best.schema["__value"].dataType).alias("__value"))
    right = best.select(*[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in names], F.col("__at").alias("__t"), F.lit(0).alias("__side"), "__at", "__value")
    both = numbered(left.unionByName(right), "__t", "__side", block=block)
    last, before = carried(both, F.when(F.col("__side") == 0, F.struct("__at", "__value")))
    filled = both.withColumn("__last", last).where("__side = 1").join(before, "__block", "left")
    got = F.when(F.col("__t").isNotNull(), F.coalesce("__last", "__carry"))
    if clamp:
        first = best.agg(F.min(F.struct("__at", "__value")).alias("__first"))
        filled = filled.join(F.broadcast(first))  # a single row
        got = F.coalesce(got, F.when(F.col("__t").isNotNull(), F.col("__first")))
    return filled.select(*names, got["__at"].alias(at), got["__value"].alias(value))


def brackets(records: DataFrame, at: str, value: str, within: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Each record with its successor's time and value; the last one is its own. `within` splits the sequence where the successor must not be sought."""
    names = records.columns
    rows = records.withColumn("__within", within if within is not None else F.lit(0))
    led = following(numbered(rows, "__within", at, value, block=block), F.struct("__within", at, value))
    same = F.col("__next").isNotNull() & F.col("__next")["__within"].eqNullSafe(F.col("__within"))
    got = F.when(same, F.struct(F.col("__next")[at].alias(at), F.col("__next")[value].alias(value))).otherwise(F.struct(at, value))
    return led.withColumn("__got", got).select(*names, F.col("__got")[at].alias("next_" + at), F.col("__got")[value].alias("next_" + value))


def seam_brackets(records: DataFrame, at: str, value: str, file: Column, block: int = BLOCK) -> DataFrame:
    """Brackets over files in their order: the last record's successor is the first of the next file."""
    names = records.columns
    led = following(numbered(records.withColumn("__file", file), "__file", at, value, block=block), F.struct(at, value))
    got = F.coalesce("__next", F.struct(at, value))
    return led.withColumn("__got", got).select(*names, F.col("__got")[at].alias("next_" + at), F.col("__got")[value].alias("next_" + value))


def record_index(asked: DataFrame, records: DataFrame, on: str, file: str, at: str, start: Column, step_seconds: int, block: int = BLOCK) -> DataFrame:
    """record_index of each asked instant in its file: at or before on the file's own times (the first of equal ones) if they span it, else by offset from `start`.

    Files and instants are numbered in one order, so a file of any length needs no array and no task of its own.
    """
    names = asked.columns
    kind = records.schema[at].dataType
    held = records.where(F.col(at).isNotNull()).groupBy(F.col(file).alias("__file"), F.col(at).alias("__t")).agg(F.count("*").alias("__n"))
    files = held.groupBy("__file").agg(F.min("__t").alias("__low"), F.max("__t").alias("__high"), F.sum("__n").alias("__all"))
    left = asked.select(*names, F.col(file).alias("__file"), F.col(on).cast(kind).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__n"))
    right = held.select(*[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in names], "__file", "__t", F.lit(0).alias("__side"), "__n")
    both = numbered(left.unionByName(right), "__file", "__t", "__side", block=block)
    run = W.partitionBy("__block").orderBy("__index").rowsBetween(W.unboundedPreceding, 0)
    last, before = carried(both, F.col("__n"))
    sums = both.groupBy("__block").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__sum"))
    sums = sums.select("__block", (F.sum("__sum").over(W.orderBy("__block")) - F.col("__sum")).alias("__earlier"))  # one row a block
    bases = files.select(F.col("__file").alias("__of"), "__low", "__high", (F.sum("__all").over(W.orderBy("__file")) - F.col("__all")).alias("__base"))  # one row a file
    filled = both.withColumn("__last", last).withColumn("__seen", F.coalesce(F.sum("__n").over(run), F.lit(0))).where("__side = 1")
    filled = filled.join(before, "__block", "left").join(sums, "__block", "left").join(bases, F.col("__file") == F.col("__of"), "left")
    asof = F.col("__seen") + F.col("__earlier") - F.coalesce("__last", "__carry") - F.col("__base")
    offset = F.floor((micros(F.col(on)) - micros(start)) / F.lit(step_seconds * 10**6)).cast("long")
    inside = F.coalesce(F.col("__t").between(F.col("__low"), F.col("__high")), F.lit(False))
    return filled.select(*names, F.when(inside, asof).otherwise(offset).cast("long").alias("record_index"))


def record_slice(records: DataFrame, file: str, at: str, tie: str, index: int) -> DataFrame:
    """The record of position `index` of each file; the time axis is dropped."""
    n = F.row_number().over(W.partitionBy(file).orderBy(at, tie)) - 1
    return records.withColumn("__n", n).where(F.col("__n") == index).drop("__n", at)


def months_in_span(spark: SparkSession, start: str, end: str, buffer_hours: int = 3) -> DataFrame:
    """(year, month, days) that cover the span with a buffer on both sides."""
    low, high = instant(start) - F.expr(f"INTERVAL {buffer_hours} HOUR"), instant(end) + F.expr(f"INTERVAL {buffer_hours} HOUR")
    days = spark.range(1).select(F.explode(F.sequence(low.cast("date"), high.cast("date"), F.expr("INTERVAL 1 DAY"))).alias("d"))
    return days.groupBy(F.year("d").alias("year"), F.month("d").alias("month")).agg(F.sort_array(F.collect_list(F.dayofmonth("d"))).alias("days"))


def time_shards(records: DataFrame, at: str, tie: str, per_shard: int) -> DataFrame:
    """(shard, t_start, t_end, n_records) of records dealt in time order, `per_shard` each."""
    ranked = numbered(records.select(at, tie), at, tie).withColumn("shard", F.floor(F.col("__index") / per_shard).cast("long"))
    return ranked.groupBy("shard").agg(F.min(at).alias("t_start"), F.max(at).alias("t_end"), F.count("*").alias("n_records"))


def resume_after(records: DataFrame, at: str, last: str | None) -> DataFrame:
    """What is new after the last record written; everything if nothing was."""
    return records if last is None else records.where(F.col(at) > instant(last))
