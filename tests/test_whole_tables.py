"""Queries without id subsets: every vector and every record takes part."""

from pyspark.sql import functions as F

from meridian.plans import catalog

SF = "/root/testdata/sf0.001"


def test_array_queries_take_every_vector(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    n = vectors.count()
    index = catalog.Q["linear_index"](spark, SF)
    assert index.select("vec").distinct().count() == n
    assert sorted(r["f_order"] for r in index.collect()) == list(range(64 * n))
    assert catalog.Q["edge_clip"](spark, SF).agg(F.sum("inside")).first()[0] == n
    assert catalog.Q["needed_chunks"](spark, SF).agg(F.sum("n")).first()[0] == 64 * n


def test_lookups_take_every_record(spark):
    first = spark.read.parquet(f"{SF}/events.parquet").agg(F.min("ts")).first()[0]
    found = catalog.Q["asof_record"](spark, SF)
    assert found.agg(F.min("ts")).first()[0] < first.replace(year=2024, month=1, day=3, hour=0, minute=0, second=0, microsecond=0)
    assert found.where("ts is null").count() > 0
    clamped = catalog.Q["asof_clamped"](spark, SF)
    assert clamped.where("ts is null").count() == 0 and clamped.agg(F.min("ts")).first()[0] == first
    assert catalog.Q["record_index"](spark, SF).where("record_index is null").count() == 0
