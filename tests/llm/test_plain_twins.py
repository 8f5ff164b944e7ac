"""Plain Python versions of the fingerprints, the Markov scores and the whole pipeline."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import fingerprint, mixing, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*longs):
    h = 42
    for v in longs:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
        v = h
    return struct.unpack("<q", struct.pack("<Q", h))[0]


def one_permutation(text):
    w = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(x.encode(), seed=42).intdigest()))[0] for x in WORD.findall(text)]
    if not w:
        return []
    if len(w) >= 5:
        hashes = [spark_hash(w[i + 4], *w[i : i + 4]) for i in range(len(w) - 4)]  # the last word comes first
    else:
        joined = " ".join(map(str, w)).encode()
        hashes = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(joined, seed=42).intdigest()))[0]]
    bins = {}
    for h in hashes:
        b = (h >> 56) + fingerprint.BINS // 2
        bins[b] = min(bins.get(b, h), h)
    return [bins[b] & 255 if b in bins else None for b in range(fingerprint.BINS)]


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "é", "x\ty", "gamma\n"]) + str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 40, 300, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint.fingerprints(df).collect():
        want = one_permutation(texts[r["doc_id"]])
        assert len(r["bins"]) == len(want)
        for i, x in enumerate(want):
            if x is not None:
                assert r["bins"][i] == x
            else:
                donor = next((p for p in (int(fingerprint._PROBE[k][i]) for k in range(fingerprint.PROBES)) if want[p] is not None), None)
                assert r["bins"][i] == want[donor] if donor is not None else r["bins"][i] in want


def test_markov_scores_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    n = len(secrets.ALPHABET)
    random_, ordinary = rng.integers(0, 50, (n, n)).astype(float), rng.integers(0, 50, (n, n)).astype(float)
    table = secrets.ratios(random_, ordinary)
    tokens = ["".join(rng.choice(list(secrets.ALPHABET), k)) for k in (20, 21, 40)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.token_score(F.col("t"), table).alias("s")).collect()
    for t, s in got:
        pairs = [(secrets.ALPHABET.index(a), secrets.ALPHABET.index(b)) for a, b in zip(t, t[1:])]
        want = sum(math.log((random_[a, b] + 0.5) / (random_[a] + 0.5).sum()) - math.log((ordinary[a, b] + 0.5) / (ordinary[a] + 0.5).sum()) for a, b in pairs) / len(pairs)
        assert abs(s - want) < 1e-3


def test_added_spans_find_random_strings_and_spare_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table, threshold = secrets.train(spark, docs)
    keys = secrets.random_samples(300, seed=99)
    rng = random.Random(1)
    words = [w for r in docs.limit(50).collect() for w in re.findall("[A-Za-z]{5,}", r["text"])]
    plain = ["_".join(rng.choices(words, k=4)) for _ in range(150)] + ["".join(w.capitalize() for w in rng.choices(words, k=4)) for _ in range(150)]
    plain += ["=" * 40, "-" * 40, "/" * 30, "0" * 15 + "_" * 15, "ab" * 20]
    df = spark.createDataFrame(list(enumerate([f"x {t} y" for t in keys + plain])), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(df, table, threshold)).collect()}
    found = sum(bool(spans[i]) for i in range(len(keys))) / len(keys)
    false = sum("markov" in spans[len(keys) + i] for i in range(len(plain))) / len(plain)
    assert found > 0.95 and false < 0.03, (found, false)


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    rng = random.Random(12)
    calm = [f"word{i}" for i in range(400)]
    docs, labels, toxic = [], [], set()
    for i in range(400):
        w = rng.choices(calm, k=rng.randint(20, 60))
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "loser"]) if i % 8 else rng.choice(["1d10t", "m0r0n", "l.o.s.e.r"]))
            toxic.add(i)
        docs.append([i, " ".join(w)])
        labels.append((i, 0, int(i % 4 == 0)))
    items = [(k, " ".join(f"item{k}x{j}" for j in range(14)) + ". " + " ".join(f"answer{k}x{j}" for j in range(6)) + ".") for k in range(8)]
    leaked, near = set(), set()
    clean = [i for i in range(400) if i % 4]
    for n, i in enumerate(clean[:60]):
        if n % 3 == 0:
            docs[i][1] += " " + items[n % 8][1]
            leaked.add(i)
        elif n % 3 == 1:
            j = 1000 + i
            w = docs[i][1].split()
            docs.append([j, " ".join([*w, "tail"]) if n % 2 else docs[i][1]])
            near.add(j)
    rows = [(d, t, "en", "abc"[d % 3], len(t)) for d, t in docs] + [(5000, None, None, None, None), (5001, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the plain version
    kept = [r for r in rows if r[0] not in toxic]
    parent = {r[0]: r[0] for r in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {r[0]: shingles(r[1]) for r in kept}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and ((not sets[a] and not sets[b]) or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = [r for r in kept if root(r[0]) == r[0] and r[0] not in leaked]
    sizes = Counter()
    for r in kept:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    wanted = mixing.targets(dict(sizes))
    times = Counter(r["doc_id"] for r in out)
    known = {r[0]: r for r in kept}
    assert set(times) <= set(known) and max(times.values()) <= 2
    assert all(times[d] >= math.floor(wanted[r[3]] / sizes[r[3]]) for d, r in known.items() if sizes[r[3]] and WORD.findall(r[1] or ""))
    for s, target in wanted.items():
        took = sum(len(WORD.findall(r[1] or "")) * times[d] for d, r in known.items() if r[3] == s)
        assert abs(took - target) <= max([len(WORD.findall(r[1] or "")) for r in kept if r[3] == s]) / 2 + 1
    owner = sharding.fill([f"shard-{k:05d}" for k in range(64)])
    assert all(r["shard"] == owner[r["slot"]] and r["text"] == known[r["doc_id"]][1] for r in out)
