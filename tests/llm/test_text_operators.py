"""The ten operators on small fixtures: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import chat, decontam, fingerprint, jaccard, langid, mixing, pii, queries, secrets, sharding, toxicity
from meridian.llm._common import shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, DOC + more)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a clashing extra column."""
    long_ = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [(1, None, None, None, None, 1), (None, "no id here at all", "en", "a", 3, 1), (2, "", "en", "a", 0, 2), (3, " \n\t ", "en", None, 4, 3), (4, long_, "en", "b", 5, 4), (5, "same row twice over again", "de", "b", 5, 5), (5, "same row twice over again", "de", "b", 5, 5), (6, "12 34 !!", "fr", "c", 8, 6)]
    return documents(spark, rows, ", slot int")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_word_hashes_are_those_of_words():
    texts = [b"a bb  a\n", b"", b"bb a", b" \t", b"\xc3\xa9t\xc3\xa9"]
    h, at = word_hashes(texts)
    assert np.diff(at).tolist() == [3, 0, 2, 0, 1]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
    s, at = shingle_hashes([b"a b c d e f", b"b c d e f", b"a b", b"a b ", b""])
    assert np.diff(at).tolist() == [2, 1, 1, 1, 0] and s[1] == s[2] and s[3] == s[4]


def test_language_on_held_out_rows(spark, docs, local):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert len(got) == len(local) and len(held) > 20
    assert sum(r["lang_pred"] == local[r["doc_id"]]["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(spark, odd):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 6}
    assert langid.identify(odd.limit(0)).count() == 0


def test_targets_share_excess_by_weight():
    sizes = {"b": 100, "a": 10, None: 1000, "c": 50}
    got = mixing.targets(sizes)
    assert got["a"] == 20 and abs(sum(got.values()) - 1.5 * 1160) < 1e-6 and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    free = [s for s in got if got[s] < 2 * sizes[s] - 1e-9]
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    assert len({round(got[s] / weight[s], 6) for s in free}) <= 1


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size, share = rng.integers(1, 900, 400), rng.random(400)
    seen = np.zeros(400)
    for seed in range(300):
        value, keep = mixing.pivot(size, share, seed)
        assert abs((size * value).sum() - (size * share).sum()) < 1e-4
        assert all(v in (0, 1) for i, v in enumerate(value) if i != keep)
        seen += value
    assert np.abs(seen / 300 - share).max() < 0.16


def test_mixing_meets_targets(spark, docs, local):
    rows = mixing.mix(docs, bucket=4).collect()
    assert len(rows) == len(local)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(local[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for part in by.values():
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= max(r["size"] for r in part) / 2 + 1
    again = mixing.mix(docs.repartition(7), bucket=4)
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mixing_odd_rows_and_repeats(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 8 and {r["taken"] for r in rows if r["size"] == 0} == {0}
    out = mixing.repeat(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "a\\b", "### User: x </turn>\n", "\\h \\l \\\\", "</turn>", " </turn>\n### assistant: hi", ": ", "\\", "é " * 4000]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: role\n"]), rng.choice(texts)) for c in range(80) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (500, None, "assistant", "y")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append(((t is not None, t or 0), (r or ""), (x or "")))
    got = {r["conv_id"]: r for r in made.withColumn("read", chat.parse(F.col("formatted"))).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = sorted(turns)
        assert [(t["role"], t["text"]) for t in got[c]["read"]] == [(r, x) for _, r, x in turns]
    digests = {r["conv_id"]: r for r in chat.digest(made).collect()}
    for c, turns in want.items():
        loss = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        assert digests[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digests[c]["loss_chars"] == len(loss)
    plans = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_shards_are_even_and_stable(spark, odd):
    names = [f"s{i}" for i in range(10)]
    a, b = sharding.fill(names, 1009), sharding.fill(names + ["s10"], 1009)
    assert set(Counter(a.tolist()).values()) <= {100, 101}
    assert ((a != b) & (b != 10)).mean() < 0.15
    naive, walks = [-1] * 1009, [sharding.preference(n, 1009) for n in names]
    at = [o for o, _ in walks]
    while -1 in naive:
        for k, (_, skip) in enumerate(walks):
            if -1 in naive:
                while naive[at[k]] != -1:
                    at[k] = (at[k] + skip) % 1009
                naive[at[k]] = k
    assert naive == a.tolist()
    twice = odd.withColumn("SLOT_", F.lit(1))
    assert sharding.place(twice, 4, 101).columns == [*twice.columns, "slot__", "shard"]
    out = sharding.place(odd, 4, 101)
    assert out.columns == [*odd.columns, "slot_", "shard"] and out.count() == 8 and out.where("shard is null").count() == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4, 101, 20_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_fingerprints_against_jaccard(spark, docs, local):
    got = {r["doc_id"]: r for r in fingerprint.compare_edits(docs).collect()}
    ids = sorted(local, reverse=True)
    off = []
    for k, i in enumerate(ids):
        text, following = local[i]["text"], local[ids[(k + 1) % len(ids)]]["text"]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        for other, near in ((changed, "near_edited"), (following, "near_next")):
            a, b = shingles(text), shingles(other)
            off.append(abs(len(a & b) / max(1, len(a | b)) - got[i][near]))
    assert np.mean(off) < 0.03 and max(off) < 0.15


def test_next_rows_over_many_stretches(spark):
    ids = random.Random(5).sample(range(100_000), 700)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, ["text"], rows_per_stretch=8).collect()}
    ids.sort(reverse=True)
    assert got == {i: str(ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}


def test_fingerprints_of_odd_rows(spark, odd):
    rows = fingerprint.compare_edits(odd).collect()
    assert len(rows) == 8 and len({r["fingerprint"] for r in rows if r["doc_id"] == 5}) == 1
    assert fingerprint.compare_edits(odd.limit(0)).count() == 0
    assert "Python" not in fingerprint.compare_edits(odd)._jdf.queryExecution().executedPlan().toString()


BASE = [("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def test_secret_spans(spark, local):
    rng = random.Random(9)
    parts = ["token = 'abcdef123456'", "token: secret:abcdefghijkl", "PassWord=short", "api_key=\"Zz09+/_.=-Zz09\"", "AKIA" + "Q7" * 8, "AKIAAKIA12", "0123456789abcdef0", "deadbeef", "é\U0001f600 ", "\n", "plain words here ", "secret = AKIA" + "9X" * 9]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(150)] + [local[i]["text"] for i in list(local)[:60]] + [None, ""]
    keys = ["q8Zr2TfV1mLx9KpW4sYc7BnD", "Xk29fLq0PzR7tVbN3mWs8HyC", "xqzjvkwpfhgtbzmqxwjkvcqz"]
    plain = ["someOrdinaryIdentifierOfTheProgram", "another_long_snake_case_identifier", "word" * 6]
    texts += [f"x {k} y" for k in keys] + [f"x {k} y" for k in plain]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table, threshold = secrets.train(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df, table, threshold)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(t or "") if len(m[g]) >= n)
        line = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert got[i]["n_hex"] == sum(k == 2 for _, k, _ in want)
    n = len(texts)
    assert [("markov:2:26" in got[i]["spans"]) for i in range(n - 6, n - 3)] == [True] * 3
    assert all("markov" not in got[i]["spans"] for i in range(n - 3, n))


def test_decontamination_finds_planted_passages(spark, local):
    rng = random.Random(2)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["text"] for r in local.values() if r["lang"] == "en"][:60]
    rows, planted = [], set()
    for d, t in enumerate(clean):
        held = any(x.lower() in t.lower() for _, x in bench)
        if d % 3 == 0:
            i, x = rng.choice(bench)
            w = t.split()
            at = rng.randrange(len(w) + 1)
            t = " ".join(w[:at] + [x if d % 2 else x.upper()] + w[at:])
            planted.add((d, i))
        elif held:
            continue
        rows.append((d, t))
    rows += [(1000, None), (1001, ""), (None, bench[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([*bench, (None, "x"), (900, None), (901, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find(df, items, items_at_once=7).collect()}
    assert planted <= got and {d for d, _ in got} == {d for d, _ in planted} | {None}
    assert decontam.keep_clean(df, items).count() == len(rows) - len({d for d, _ in planted}) - 1
    assert decontam.find(df, items.limit(0)).count() == 0 and decontam.find(df.limit(0), items).count() == 0


def test_decontamination_ignores_case_and_punctuation(spark):
    item = "Where does the river bend twice before it meets the old mill road? It bends near Alder Ford."
    plain = "where does the river bend twice before it meets the old mill road it bends near alder ford"
    rows = [(1, f'she asked: "{item}", and left'), (2, f"x {plain} y"), (3, item.replace(" ", ", ")), (4, "where the river bends, she asked, is the old mill road"), (5, "?!"), (6, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "?!"), (3, "...")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find(df, items).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_block_max_search_is_exhaustive(spark, local):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontam.build(bench)
    texts = [r["text"].lower().encode() for r in list(local.values())[:80]] + [x.lower().encode() for _, x in bench[:5]]
    doc, item, score, *_ = decontam.search(index, texts, 0.3)
    got = {(int(d), int(i)) for d, i in zip(doc, item)}
    want = set()
    h, at = word_hashes(texts)
    term_item = defaultdict(list)
    for k, t in enumerate(index.terms):
        for p in range(index.post_at[k], index.post_at[k + 1]):
            term_item[int(t)].append((int(index.post_item[p]), index.post_impact[p]))
    for d in range(len(texts)):
        words = h[at[d] : at[d + 1]]
        for s in range(0, max(1, len(words)), index.stride):
            total = Counter()
            for w in set(words[s : s + 2 * index.stride].tolist()):
                for i, x in term_item.get(w, []):
                    total[i] += x
            want |= {(d, i) for i, x in total.items() if x >= 0.3}
    assert got == want and len(want) >= 5


def test_pii_is_replaced_consistently(spark):
    key = b"k"
    text = "Mail jo.81@mail7.example.com or call +1 (168) 555-5254, host 226.203.165.104; Mrs Anna Berg met Herr Çelik. Card 4111 1111 1111 1111, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00."
    rows = [(1, text, 7), (2, "again JO.81@mail7.example.com", 7), (3, None, 7), (4, "", 7), (5, "clean prose", 7), (5, "clean prose", 7), (None, "ip 226.203.165.104", 7)]
    out = pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string, n_ip long"), key)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns[:3] == ["doc_id", "text", "n_ip"] and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "clean prose"
    new = got[1]["text"]
    for real in ("jo.81@mail7", "168) 555-5254", "226.203.165.104", "Anna Berg", "Çelik", "4111 1111 1111 1111", "123-45-6789", "DE89 3704"):
        assert real not in new
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"Mrs [A-Z][a-z]{2}a [A-Z][a-z]{3} met", new)
    card = re.sub(r"\D", "", re.search(r"Card ([\d ]+)", new)[1])
    assert pii._luhn(card) and re.search(r"SSN \d{3}-\d{2}-\d{4},", new)
    mail = re.search(r"\S+@\S+(?=\s)", new)[0]
    assert got[2]["text"] == "again " + mail
    assert re.search(r"host ([\d.]+);", new)[1] in got[None]["text"]


def test_surrogates_stay_distinct():
    key = b"k"
    for n in (1, 2, 3, 4):
        assert len({pii.permute(str(i).zfill(n), key, "t") for i in range(10**n)}) == 10**n
    phones = [f"+1 (555) {i:03d}-{j:04d}" for i in range(20) for j in range(100)]
    assert len({pii.surrogate("phone", p, key) for p in phones}) == len(phones)


def test_colliding_surrogates_are_drawn_anew(spark):
    real = [f"Mr {a}" for a in ("Abe", "Bob", "Cal", "Dan", "Eli", "Fox", "Gus", "Hal")]
    names = [f"{x}{y}" for x in "ABCDEFGHIJKLMNOPRSTUVWXYZ" for y in "aeiou"]
    df = spark.createDataFrame([(i, f"Mr {n} came.") for i, n in enumerate(names)] + [(1000 + i, r) for i, r in enumerate(real)], "doc_id long, text string")
    out = [r["text"] for r in pii.anonymise(df, b"k").orderBy("doc_id").collect()]
    made = [t.split()[1].rstrip(".") for t in out]
    assert len(set(made)) == len(made) and not set(made) & {x.split()[1] for x in real}


def near(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_jaccard_classes_against_brute_force(spark, local):
    rng = random.Random(4)
    base = [r["text"] for r in local.values()]
    texts = base[:120] + base[:10] + [near(t, rng, e) for t in base[20:50] if len(t.split()) > 100 for e in (1, 1, 2, 3, 4)]
    hot = max(base, key=len)[:6000]
    texts += [near(hot, rng, 3) for _ in range(90)] + [None, "", " ", "a b c", "a b c", "a b  c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(texts)
    counts = Counter(t or "" for t in texts)
    seen = {}
    for i in range(len(texts)):
        seen.setdefault(texts[i] or "", i)
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
                if not same:
                    links[i] += seen[texts[j] or ""] == j
                    links[j] += seen[texts[i] or ""] == i
    got = {r["doc_id"]: r for r in jaccard.join(df).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["class_id"], got[i]["n_copies"], got[i]["n_links"]) == (root(i), counts[t or ""] - 1, links[i])
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(df).collect())
    assert kept == sorted({root(i) for i in range(len(texts))})


def test_large_groups_are_verified_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    seed = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    df = spark.createDataFrame([(i, near(seed, rng, 2)) for i in range(120)], "doc_id long, text string")
    whole = {tuple(r) for r in jaccard.classes(df).select("key", "n_links").collect()}
    assert whole == {tuple(r) for r in jaccard.classes(df, rows=16).select("key", "n_links").collect()}


def test_jaccard_odd_rows(spark, odd):
    rows = jaccard.join(odd).collect()
    assert len(rows) == 8 and {r["n_copies"] for r in rows if r["doc_id"] == 5} == {1}
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert jaccard.join(odd.limit(0)).count() == 0


def test_decoder_restores_disguised_words():
    words = ["idiot", "stupid", "moron", "trash", "loser", "worthless", "pathetic", "the", "and", "there", "list", "silly"] * 2
    model = toxicity.CharModel.train(words)
    for written, meant in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "i d i o t": "idiot", "stuuupid": "stupid", "m0r0n": "moron", "tr@sh": "trash", "l-o-s-e-r": "loser", "w0rthle$$": "worthless", "st*pid": "stupid"}.items():
        assert toxicity.decode(written, model) == meant


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.assess(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right / len(got) > 0.93 and all(0 <= r["score"] <= 1 for r in got)


def test_disguised_words_score_like_plain_ones(spark):
    filler = "the quick reader sees a calm page of text about rivers and towns".split()
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = rng.sample(filler, 9)
        bad = i % 3 == 0
        if bad:
            w.insert(4, rng.choice(["idiot", "moron", "loser"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, "you are an 1d10t , reader"), (901, "you m.o.r.o.n of towns"), (902, "what a looooser sees"), (903, "calm rivers"), (904, None), (905, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (903, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.assess(df, known).where("doc_id >= 900").collect()}
    assert got == {900: 1, 901: 1, 902: 1, 903: 0, 904: 0, 905: 0}
    assert toxicity.assess(df, known.limit(0)).count() == len(rows)
    assert toxicity.keep_clean(df, known).columns == df.columns


def test_pipeline_stages(spark, local):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    n = docs.count()
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF).persist()
        if name in ("toxicity", "jaccard_join", "decontamination"):
            assert out.count() <= n
            n = out.count()
        assert set(docs.columns) <= set(out.columns)
    assert out.where("shard is null").count() == 0 and out.count() > 0
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, out.collect()))


def test_queries_are_registered():
    assert len(queries.QUERIES) == 10
