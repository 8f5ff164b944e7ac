"""Positions in a total order without a global window: rows are dealt by range, so no key, however frequent, fills a task alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16  # rows of a block; what crosses blocks is one row each


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints; where none is named (tests), one beside the tables of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so what was numbered once is not numbered anew."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """`df` with __index, each row's position from 0 in the order of the keys, and __block, the block of rows that it falls into."""
    dealt = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = sorted(map(tuple, dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()))  # one row a partition
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    index = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__index", index)
    return out.withColumn("__block", F.floor(F.col("__index") / block)).drop("__part", "__start", "__id")


def carried(rows: DataFrame, value: Column) -> tuple[Column, DataFrame]:
    """(the last non-null `value` so far inside the block, (__block, __carry) of the last one in all earlier blocks)."""
    run = W.partitionBy("__block").orderBy("__index").rowsBetween(W.unboundedPreceding, 0)
    own = rows.groupBy("__block").agg(F.max_by(value, F.when(value.isNotNull(), F.col("__index"))).alias("__own"))
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    return F.last(value, ignorenulls=True).over(run), own.select("__block", F.last("__own", ignorenulls=True).over(before).alias("__carry"))


def following(rows: DataFrame, value: Column) -> DataFrame:
    """Numbered `rows` with __next: `value` of the next row, null at the end."""
    w = W.partitionBy("__block").orderBy("__index")
    first = rows.groupBy("__block").agg(F.min_by(value, "__index").alias("__first"))
    first = first.select((F.col("__block") - 1).alias("__block"), "__first")
    led = rows.withColumn("__lead", F.lead(value).over(w)).join(first, "__block", "left")
    return led.withColumn("__next", F.coalesce("__lead", "__first")).drop("__lead", "__first")
