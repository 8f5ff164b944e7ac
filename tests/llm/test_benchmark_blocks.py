"""Scores do not depend on how many items are indexed at once."""

from meridian.llm import decontam

SF = "/root/testdata/sf0.001"


def test_scores_are_those_of_the_whole_benchmark(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [(r["item_id"], r["text"]) for r in items.limit(40).collect()]
    lengthy = " ".join(f"long{i}" for i in range(300))
    bench = spark.createDataFrame([*texts, (9000, lengthy)], "item_id long, text string")
    df = spark.createDataFrame([(k, "some words first " + t.split(" ", 1)[1] + " and some after") for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    whole, parts = (sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontam.find(df, bench, items_at_once=n).collect()) for n in (20_000, 7))
    assert whole == parts and len(whole) > 5
