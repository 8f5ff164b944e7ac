"""The cache at many keys: fetches are dealt to many tasks, and objects are held against their manifests by key, without a listing."""

from pyspark.sql import functions as F

from meridian.functions import keys
from meridian.sources import cache, objects


def test_fetches_and_checks_are_dealt_out_and_nothing_is_listed(spark, tmp_path, monkeypatch):
    root, n = str(tmp_path / "cache"), 200
    for k in range(n):
        objects.put(str(tmp_path / "pages"), f"{k}.html", b"x" * k)
    urls = spark.range(n).select(F.format_string(f"file://{tmp_path}/pages/%d.html", "id").alias("url"))
    got = cache.fetch(urls, root)
    assert got.where("status = 'downloaded'").count() == n
    assert got.groupBy(F.spark_partition_id()).count().count() > 1  # as many tasks as fetched
    listed, first = cache.verify(spark, root), got.orderBy("url").collect()
    want = sorted(map(tuple, listed.collect()))
    monkeypatch.setattr(cache, "manifests", None)
    held = cache.verify(spark, root, got)
    assert sorted(map(tuple, held.collect())) == want and all(ok for _, ok, _ in want) and sorted(b for _, _, b in want) == list(range(n))
    assert cache.verify(spark, root, got.limit(3)).count() == 3
    assert cache.verify(spark, root, spark.createDataFrame([("0" * 64, "blobs/00/none")], "key string, path string")).first()[1:] == (False, None)
    objects.put(root, first[3]["path"], b"other")
    objects.delete(root, first[4]["path"])
    objects.put(root, f"meta/{first[5]['key']}.json", b"{")
    objects.put(root, f"meta/{first[6]['key']}.json", objects.get(root, f"meta/{first[7]['key']}.json"))
    bad = {r["key"] for r in cache.verify(spark, root, got).where("not ok").collect()}
    assert bad == {first[k]["key"] for k in (3, 4, 5, 6)}
    monkeypatch.undo()
    assert {r["key"] for r in cache.verify(spark, root).where("not ok").collect()} >= {first[k]["key"] for k in (3, 4)}
    assert spark.createDataFrame([(first[0]["url"],)], "url string").select(keys.cache_key(F.col("url"))).first()[0] == first[0]["key"]
