"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage; bounded samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import chat, decontam, fingerprint, jaccard, langid, mixing, pii, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rows int, whole int, nth int, key string, root int, mark long, score double, TEXT_ string, slot_ int"


@pytest.fixture(scope="module")
def odd(spark):
    long_ = " ".join(f"word{i % 997}" for i in range(40_000))
    rest = (7, 1, 2, 3, "k", 4, 5, 0.5, "t", 6)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "no id here at all you see", "en", "a", 3), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", None, 4), (4, long_, "en", "b", 5), (5, "x" * 300_000, "de", "b", 5), (6, "same row twice over and over again", "de", "b", 5), (6, "same row twice over and over again", "de", "b", 5), (6, "same id other text of some words", "de", "b", 5), (7, "12 34 !!", "fr", "c", 8)]
    return spark.createDataFrame([(*r, *rest) for r in rows], SCHEMA)


LABELS = [(6, 0), (6, 1), (4, None), (None, 1), (7, 0)]


def labels_of(spark):
    return spark.createDataFrame([(d, 1, t) for d, t in LABELS], "doc_id long, quality int, toxic int")


def bench_of(spark):
    return spark.createDataFrame([(1, "where does the long road end it ends here"), (1, "where does the long road end it ends here"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


def test_every_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    empty = odd.limit(0)
    for run in (langid.identify, mixing.mix, sharding.place, fingerprint.compare_edits, jaccard.join, lambda d: secrets.digest(secrets.scan(d)), lambda d: toxicity.assess(d, labels_of(spark)), lambda d: pii.anonymise(d, b"k")):
        assert run(odd).count() == n and run(empty).count() == 0
    assert decontam.find(odd, bench_of(spark)).count() == 0 and decontam.find(empty, bench_of(spark)).count() == 0
    for run in (jaccard.keep_one, mixing.repeat, lambda d: toxicity.keep_clean(d, labels_of(spark)), lambda d: decontam.keep_clean(d, bench_of(spark))):
        out = run(odd)
        assert out.columns == odd.columns and out.count() <= 2 * n and run(empty).count() == 0


def test_every_stage_takes_odd_rows(spark, odd, tmp_path):
    labels_of(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert set(odd.columns) <= set(docs.columns)
            docs = docs.persist()
            docs.count()


def test_chats_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, turns int"
    rows = [(None, None, None, None, "f", 1), (1, 2, "user", "tie", "f", 1), (1, 2, "user", "tie", "f", 1), (1, 2, "assistant", "é" * 200_000, "f", 1), (2, 1, "", "", "f", 1), (3, 1, "a: b", "#### </turn> \\ ###", "f", 1)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} " + "#" * (i % 7), "f", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, schema)
    made = chat.format_chats(df)
    for r in made.collect():
        inside = r["formatted"].removeprefix("### ").removesuffix(" </turn>\n").replace(" </turn>\n### ", "")
        assert "###" not in inside and "</turn>" not in inside
        assert [chat_text(r["formatted"], s) for s in r["loss_spans"]] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    assert got[1]["n_turns"] == 3 and got[9]["n_turns"] == 3000 and got[1]["loss_chars"] == 200_000
    assert chat.format_chats(df.limit(0)).count() == 0


def chat_text(formatted, span):
    parts = formatted[span["start"] : span["end"]].split("\\\\")
    return "\\".join(p.replace("\\h", "#").replace("\\l", "<") for p in parts)


def test_conflicting_text_is_always_escaped(spark):
    text = "he wrote </turn> and\n### Assistant: sure </turn> ok"
    made = chat.format_chats(spark.createDataFrame([(1, 1, "user", text)], "conv_id long, turn long, role string, text string")).first()
    assert made["escaped"] and made["formatted"].count("###") == 1 and made["formatted"].count("</turn>") == 1


def test_language_scores_do_not_depend_on_windows_or_neighbours():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh éü") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    model = langid.fit(texts, ["x" if i % 2 else "y" for i in range(60)], steps=200)
    raw = [t.encode() for t in texts]
    whole = langid.logits(model, raw)
    for window in (1, 7, 100):
        assert np.allclose(langid.logits(model, raw, window), whole, atol=1e-9)
    assert np.allclose(np.concatenate([langid.logits(model, [t]) for t in raw]), whole, atol=1e-9)


def test_samples_are_bounded(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text of row "), F.when(F.col("id") % 3 == 1, F.lit(0)).otherwise(F.col("id")).cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("lang"))
    assert len(langid.training_sample(rows, 50)) <= 100
    assert len(langid.training_sample(rows, 50, max_rows=30)) <= 30
    assert sum(len(r["text"]) for r in langid.training_sample(rows, 50, max_bytes=200)) <= 200
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    again = rows.union(rows.withColumn("text", F.lit("other")))
    seen = []
    keep = toxicity.fit
    toxicity.fit = lambda texts, labels, **_: seen.append((texts, labels)) or keep([], [])
    try:
        toxicity.train(again, labels, max_labelled=100)
        toxicity.train(again, labels, max_labelled=100, max_bytes=300)
        toxicity.train(again.repartition(5), labels.repartition(3), max_labelled=100)
    finally:
        toxicity.fit = keep
    assert len(seen[0][0]) <= 100 and sum(map(len, seen[1][0])) <= 300 and seen[0] == seen[2]


def test_labels_that_disagree_are_settled(spark):
    rows = [(1, 0), (1, 1), (3, 0), (3, 0), (3, 1), (4, 1), (None, 1), (4, None)]
    got = {tuple(r) for n in (1, 4) for r in toxicity.settled(spark.createDataFrame(rows, "doc_id long, toxic int").repartition(n)).collect()}
    known = {d for d, in spark.createDataFrame([(1,), (3,), (4,)], "d long").where(~langid.held_out(F.col("d"))).collect()}
    assert got == {(d, x) for d, x in ((1, 1), (3, 0), (4, 1)) if d in known}


def test_disguises_of_any_length():
    words = ["idiot", "stupid", "moron", "trash", "the", "and", "list"] * 2
    model = toxicity.CharModel.train(words)
    for text, word in (("stu" + "u" * 500 + "pid", "stupid"), ("1d10t" + "0" * 25, "idiot"), ("i   d   i   o   t", "idiot"), ("i\td\ti\no\tt", "idiot"), (" ".join("idiot" * 300), "idiot")):
        found = toxicity.words_of(text, model, {})
        assert word.encode() in found
    assert b"1d10t" not in toxicity.words_of("an 1d10t here", model, {})


def brute_decode(token, model, fill=0.3, swap=0.7, repeat=0.3, drop=4.0):
    """All readings of a short token, by enumeration (no separators, no blanks)."""
    ways = [("^", 0.0, "")]
    for i, ch in enumerate(token):
        new = []
        for past, cost, text in ways:
            for c, extra in [(ch, 0.0)] if ch.isalpha() else [(c, swap) for c in toxicity.LEET.get(ch, "")] + ([(ch, 4.0)] if ch.isdigit() else []):
                new.append(((past + c)[1 - model.order :], cost + extra + model.cost(past, c), text + c))
            if i and token[i - 1] == ch:
                new.append((past, cost + repeat, text))
            elif ch in toxicity.LEET:
                new.append((past, cost + fill + drop, text))
        ways = new
    ends = [(cost + (0.0 if past == "^" else min(model.cost(past, "$"), 3.0) if past[0] == "^" and len(past) == 2 else model.cost(past, "$")), text) for past, cost, text in ways]
    return min(ends)


def test_search_is_exact():
    rng = random.Random(5)
    model = toxicity.CharModel.train(["idiot", "stupid", "moron", "trash", "loser", "silly", "list", "toll"] * 2)
    for _ in range(150):
        token = "".join(rng.choice("idotslr10357") for _ in range(rng.randrange(3, 9)))
        assert toxicity.decode(token, model) == brute_decode(token, model)[1]


def test_targets_of_many_sources_equal_those_of_few(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice([None, "a", "b", "é", "z", "source nine", "Z"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = {tuple(r) for r in mixing.mix(df).select("doc_id", "target", "taken").collect()}
    many = {tuple(r) for r in mixing.mix(df, most_sources=0).select("doc_id", "target", "taken").collect()}
    assert {(d, round(t, 6), k) for d, t, k in few} == {(d, round(t, 6), k) for d, t, k in many}


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "one two three", "a")] * 40 + [(i, "w " * (i % 9), "b") for i in range(2, 30)] + [(None, "q r", None)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1))
    mixed = mixing.mix(df).collect()
    hot = [r for r in mixed if r["doc_id"] == 1]
    assert len(mixed) == len(rows) and len(hot) == 40 and max(r["copies"] for r in hot) - min(r["copies"] for r in hot) <= 1
    for part in ({r["source"] for r in mixed}):
        own = [r for r in mixed if r["source"] == part]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    out = mixing.repeat(df)
    assert out.count() == sum(r["copies"] for r in mixed) and out.where("doc_id = 1").count() == sum(r["copies"] for r in hot)
    shown, mixing.CHUNK = mixing.CHUNK, 3
    try:
        assert mixing.mix(df).count() == len(rows) and mixing.repeat(df).count() == out.count()
    finally:
        mixing.CHUNK = shown


def test_next_rows_of_one_hot_id(spark):
    rows = [(i, f"t{i}") for i in range(50)] + [(25, f"hot{i}") for i in range(300)] + [(None, f"none{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(df, ["text"], rows_per_stretch=8).collect()]
    assert len(got) == len(rows) and sorted(t for _, t, _ in got) == sorted(n for *_, n in got)
    step = {t: n for _, t, n in got}
    at, seen = "t49", []
    for _ in rows:
        seen.append(at)
        at = step[at]
    assert len(set(seen)) == len(rows) and at == "t49"
    ids = {t: d for d, t in rows}
    order = [ids[t] for t in seen]
    assert order == sorted(order, key=lambda d: (d is None, -(d or 0)))


def test_parts_of_an_item_are_verified_in_order_of_words(spark):
    item = "who built the bridge? Old Tom built it in the year of the flood"
    rows = [(1, item), (2, "who built the bridge? flood the of year the in it built Tom Old"), (3, "bridge the built who? Old Tom built it in the year of the flood")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), items, least_overlap=0.0, threshold=0.3)
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_every_passage_over_the_bound_is_found_by_cursors():
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(3, 12)))) for i in range(200)]
    index = decontam.build(items, width=4)
    for _ in range(60):
        terms = np.unique(rng.integers(0, len(index.terms), 14)).tolist()
        want = np.zeros(len(items))
        for t in terms:
            want[index.post_item[index.post_at[t] : index.post_at[t + 1]]] += index.post_impact[index.post_at[t] : index.post_at[t + 1]]
        got = dict(decontam.wand(index, terms, 0.5))
        assert set(got) == set(np.flatnonzero(want >= 0.5 - 1e-9).tolist()) and all(abs(want[i] - x) < 1e-9 for i, x in got.items())
