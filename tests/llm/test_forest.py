"""The forest's parts: prefixes by length of text, sorted runs, stars of links, recall at the threshold, ties between rows."""

import random

import numpy as np
import pyarrow as pa

from meridian.llm import jaccard
from meridian.llm._common import mix64

DOC = "doc_id long, text string, lang string, source string"


def test_prefixes_shorten_for_short_texts():
    own, least = jaccard.depths(0.8, 0.999)
    assert own[5] < own[1000] == jaccard.prefix_length(0.8, 0.999) and (np.diff(own) >= 0).all()
    for n in range(5, 2000):
        assert least[n] <= own[int(np.ceil(n * 0.8))] and least[n] <= own[n]


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    own, least = jaccard.depths(0.8, 0.999)
    for union in (5, 10, 30, 100, 400):
        found = pairs = 0
        for _ in range(8):
            common, tail = round(0.8 * union), union - round(0.8 * union)
            sets = []
            for _ in range(100):
                both = mix64(rng.integers(1, 2**63, common + tail, dtype=np.uint64))
                cut = common + tail // 2
                sets += [both[:cut], np.concatenate([both[:common], both[cut:]])]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            n = np.diff(at)
            nodes = jaccard.prefixes(jaccard.signatures(np.concatenate(sets), at), own[n], least[n])
            found += sum(bool(set(a) & set(b)) for a, b in zip(nodes[::2], nodes[1::2]))
            pairs += 100
        assert found >= pairs * 0.996, (union, found)


def test_sorted_runs_keep_what_may_have_a_neighbour():
    rng = random.Random(1)
    nodes = sorted(rng.choice([bytes([k, j]) for k in range(40) for j in range(20)]) for _ in range(500))
    for size in (1, 3, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(nodes[i : i + size], pa.binary()), pa.array([b"k"] * len(nodes[i : i + size]), pa.binary())], ["node", "key"]) for i in range(0, 500, size)]
        got = [x for b in jaccard._met(iter(batches)) for x in b.column("node").to_pylist()]
        assert got == [x for i, x in enumerate(nodes) if i in (0, 499) or nodes.count(x) > 1]


def test_components_of_long_chains_and_rings(spark):
    links = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(150)] + [(b"x%d" % i, b"x%d" % ((i + 1) % 9)) for i in range(9)]
    got = {bytes(r["key"]): bytes(r["root"]) for r in jaccard.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {b"%03d" % i: b"000" for i in range(151)} | {b"x%d" % i: b"x0" for i in range(9)}


def test_rows_equal_in_id_and_text_are_chosen_alike_in_any_order(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", "a"), (1, words, "de", "b"), (2, words + " x", "fr", "c"), (None, None, None, None), (None, None, "en", None), (3, "other text of a few words", "en", "a"), (3, "other text of a few words", "en", "a")]
    kept = [sorted(map(str, jaccard.keep_one(spark.createDataFrame(r, DOC).repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and len(kept[0]) == 3
