"""Toxicity learns from every labelled document, word type and telling word."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridian.llm import langid, toxicity

ROWS = 6000


def spelled(n):
    return "".join("bcdfghjklm"[int(c)] + "ae"[int(c) % 2] for c in f"{n:05d}")


@pytest.fixture(scope="module")
def planted(spark):
    """Documents and labels: two words shared with a neighbour each, telling words in three toxic documents each, and one in ten documents whose ids hash last."""
    ids = [r[0] for r in spark.range(ROWS).where(~langid.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()]
    late, toxic = set(ids[-10:]), ids[::9]
    place = {d: i for i, d in enumerate(toxic)}
    rows, labels = [], []
    for d in range(ROWS):
        words = [f"w{spelled(k * 6_000 + (d + s) % ROWS)}" for k in range(6) for s in (0, 1)]
        if d in place:
            words += [f"bad{spelled((place[d] + s) % len(toxic) * 4 + k)}" for k in range(4) for s in range(3)]
        if d in late:
            words.append("numpty")
        rows.append((d, " ".join(words)))
        labels.append((d, int(d in place or d in late)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), late


def test_model_comes_from_all_labelled_rows(spark, planted):
    docs, labels, _ = planted
    again = docs.union(docs.where("doc_id % 7 = 0"))  # repeated rows train once
    model = toxicity.train(again, labels)
    other = toxicity.train(docs.repartition(5), labels.repartition(2))
    known = docs.join(labels, "doc_id").where(~langid.held_out(F.col("doc_id"))).collect()
    assert len(known) > 4000
    types = Counter(w for r in known for w in r["text"].split())
    assert len(types) > 20_000 and len(model.weights) > 2000 and b"numpty" in model.weights
    assert model.chars.seen["^"][0] == sum(n > 1 for n in types.values())
    whole = toxicity.fit([r["text"] for r in known], [r["toxic"] for r in known])
    for got in (model, other):
        assert got.chars.seen == whole.chars.seen
        assert got.weights.keys() == whole.weights.keys()
        assert all(got.weights[w] == pytest.approx(x, abs=1e-9) for w, x in whole.weights.items()) and got.bias == pytest.approx(whole.bias, abs=1e-9)


def test_labels_of_one_kind_or_none(spark, planted):
    docs, labels, _ = planted
    few = docs.limit(50)
    for known, near in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        assert {round(r["score"], 6) for r in toxicity.assess(few, known).collect()} == {near}


def test_pipeline_drops_what_late_labels_tell(spark, planted, tmp_path):
    import corpus_pipeline

    docs, labels, late = planted
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    new = spark.createDataFrame([(ROWS + 1, "what a numpty"), (ROWS + 2, "what a day")], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs.union(new), str(tmp_path)).collect()}
    assert ROWS + 2 in kept and ROWS + 1 not in kept and not late & kept
