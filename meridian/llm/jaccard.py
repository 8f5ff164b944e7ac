"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Stages, all on distinct texts (copies are classed by the digest of their text first):
1. Sign: five-word shingles are hashed once into `TREES * DEPTH + SPARE` bins (one-permutation MinHash, empty bins
   filled by random probing). Each of the TREES tries holds DEPTH bins of every text, in order.
2. Shorten: a text's matched prefix starts at DEPTH and is shortened, text by text, until the trees that agree on it reach the
   target recall at the threshold; texts with few shingles share bins between trees and so end nearer to the roots.
   A text also enters the nodes of the prefixes that texts of down to `threshold` times its shingles use, since only such are partners.
3. Match: all prefixes are dealt by range and sorted, so each task holds a run of the tries in order. Prefixes without an equal
   neighbour leave there; only for the others the signatures are fetched. Texts in one node are compared by signature
   (large nodes are dealt out as pairs of blocks) and only a spanning set of likely pairs is kept.
4. Components of these links gather texts that may be similar; every true pair above the threshold lies inside one.
5. Verify: inside each component (in pairs of blocks) all pairs are compared exactly by shingle sets, as block
   matrix products. Only counts per text and a spanning set of true links leave a task; pairs are never listed.
6. Components of the true links are the classes; every document gets its class by its text's digest.

Defined results: null text counts as empty; texts without words form one class of copies without links; a text of fewer
than five words links only with its copies; texts of any length are taken whole; n_copies counts other rows with the same text
and n_links other texts with Jaccard >= threshold, so repeated rows are copies; class_id is the least doc_id of the class (null
if all are null); of rows equal in doc_id and text `keep_one` keeps the one whose hash over all columns is least; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, durable, mix64, shingle_hashes, slabs, small

TREES, DEPTH, SPARE = 20, 6, 8
BINS = TREES * DEPTH + SPARE
ROWS, BYTES = 1024, 4 << 20  # a block of texts in a node or a component
BROADCAST_KEYS = 100_000
_DONORS = np.stack([np.random.default_rng([11, i]).permutation(BINS) for i in range(BINS)])


def prefix_length(threshold: float, recall: float, shingles: int = 1 << 30) -> int:
    """The longest prefix whose trees together reach the recall at the threshold, for a text of so many shingles.

    Bins of a text with few shingles repeat the same minima; n / (n + 5) of the trees count as independent (simulated pairs find more).
    """
    trees = TREES * shingles / (shingles + 5)
    for depth in range(DEPTH, 3, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 3  # shorter ones would hold unrelated texts


def depths(threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """For a text of n shingles: its own prefix length and the shortest one that a possible partner uses (n from 0; the last entry is for all longer ones)."""
    own = [prefix_length(threshold, recall, n) for n in range(1, 4096)]
    own = np.array([own[0], *own])
    least = own[np.ceil(np.arange(len(own)) * threshold - 1e-9).astype(int)]
    return own, np.minimum(own, least)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One-permutation MinHash, n x BINS; rows of texts without shingles are all ones."""
    n = len(offsets) - 1
    top = np.uint64(2**64 - 1)
    sig = np.full(n * BINS, top, np.uint64)
    if len(hashes):
        doc = np.repeat(np.arange(n), np.diff(offsets))
        spot = doc * BINS + (hashes % np.uint64(BINS)).astype(np.int64)
        order = np.lexsort((hashes, spot)) if len(hashes) < 4096 else np.argsort(spot, kind="stable")
        spot = spot[order]
        first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
        sig[spot[first]] = np.minimum.reduceat(hashes[order], first)
    sig = sig.reshape(n, BINS)
    filled = sig != top
    some = filled.any(1)
    row, col = np.nonzero(~filled & some[:, None])
    for step in range(BINS):
        if not len(row):
            break
        donor = _DONORS[col, step]
        ok = filled[row, donor]
        sig[row[ok], col[ok]] = mix64(sig[row[ok], donor[ok]])
        row, col = row[~ok], col[~ok]
    return sig


def prefixes(sig: np.ndarray, own: np.ndarray, least: np.ndarray) -> list[list[bytes]]:
    """Per text its nodes in all trees: a byte for the tree, then 16 bits of each bin, at its own depth and at its partners'."""
    low = (sig[:, : TREES * DEPTH] & np.uint64(0xFFFF)).astype(">u2").reshape(-1, TREES, DEPTH)
    raw = np.concatenate([np.broadcast_to(np.arange(TREES, dtype=np.uint8)[None, :, None], (len(sig), TREES, 1)), np.ascontiguousarray(low).view(np.uint8)], axis=2)
    out = []
    for row, most, few in zip(np.ascontiguousarray(raw), own.tolist(), least.tolist()):
        flat, size = row.tobytes(), 1 + 2 * DEPTH
        out.append([flat[t * size : t * size + 1 + 2 * d] for d in range(few, most + 1) for t in range(TREES)])
    return out


def least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the components of n points under links (a, b): the least point of each."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        cross = label[a] != label[b]
        a, b = a[cross], b[cross]
    return label


def _sign(threshold: float, recall: float):
    own, least = depths(threshold, recall)

    def run(batches):
        for batch in small(batches):
            texts = as_bytes(batch.column("text").to_pylist())
            keys = batch.column("key").cast(pa.binary())
            for lo, hi in slabs(texts):
                hashes, at = shingle_hashes(texts[lo:hi])
                count = np.diff(at)
                some = np.flatnonzero(count)
                sig = signatures(hashes, at)[some]
                n = np.minimum(count[some], len(own) - 1)
                nodes = prefixes(sig, own[n], least[n])
                low = (sig & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo).take(pa.array(some)), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(nodes, pa.list_(pa.binary())), pa.array(count[some], pa.int64())], ["key", "sig", "nodes", "shingles"]
                )

    return run


def _met(batches):
    """Of a sorted run of prefixes those with an equal neighbour, and the run's ends (their neighbour may be in another run)."""
    held = None  # the last row seen, and whether the row before it is equal or there is none
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([b])])
        node = t.column("node").to_numpy(zero_copy_only=False)
        same = node[1:] == node[:-1]
        keep = np.zeros(len(node), bool)
        keep[:-1] |= same
        keep[1:] |= same
        keep[0] |= True if held is None else held[1]
        held = t.slice(len(node) - 1), bool(keep[-1])
        keep[-1] = False
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()
    if held is not None:
        yield from held[0].combine_chunks().to_batches()


def _groups(batches, names):
    """Whole groups of equal leading columns from sorted Arrow batches; consecutive whole groups come together."""
    held = []
    rows = size = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        size += b.nbytes
        if rows < 20_000 and size < 16 << 20:
            continue
        t = pa.concat_tables(held)
        ids = [t.column(c).combine_chunks() for c in names]
        last = t.num_rows - 1
        cut = last
        tail = [c[last].as_py() for c in ids]
        while cut > 0 and all(c[cut - 1].as_py() == v for c, v in zip(ids, tail)):
            cut -= 1
        if cut:
            yield t.slice(0, cut)
        held = [t.slice(cut)]
        if cut:
            rows = size = 0
    if held:
        t = pa.concat_tables(held)
        if t.num_rows:
            yield t


def _bounds(table, names) -> np.ndarray:
    """Where each group of a sorted table begins, and its end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in names:
        v = table.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


NODE = ["node", "left", "right"]


def _likely(least: float):
    """Within each trie node (or pair of its blocks), a spanning set of the pairs whose signatures agree enough."""

    def run(batches):
        for t in _groups(batches, NODE):
            at = _bounds(t, NODE)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, BINS)
            size = np.diff(at)
            group = np.repeat(np.arange(len(size)), size)
            place = np.arange(t.num_rows) - at[:-1][group]
            one, two = [], []
            for off in range(1, int(size.max())):
                a = np.flatnonzero(place + off < size[group])
                for k in range(0, len(a), 1 << 15):
                    x = a[k : k + (1 << 15)]
                    x = x[(sig[x] == sig[x + off]).sum(1) >= least * BINS]
                    one.append(x)
                    two.append(x + off)
            a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (one, two))
            label = least_label(t.num_rows, a, b)
            moved = np.flatnonzero(label != np.arange(t.num_rows))
            key = t.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([key.take(pa.array(moved)), key.take(pa.array(label[moved]))], ["a", "b"])

    return run


def _in_blocks(df: DataFrame, blocks, key: str) -> DataFrame:
    """Deal each group out as pairs (left, right) of its `blocks` blocks: every two rows meet in one pair at least."""
    n = blocks.cast("int")
    own = F.pmod(F.xxhash64(key, F.lit(5)), n).cast("int")
    partner = F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1)))
    return df.withColumn("own", own).withColumn("partner", partner).withColumn("left", F.least("own", "partner")).withColumn("right", F.greatest("own", "partner")).drop("partner")


def _contract(batches, at_once: int = 100_000):
    """The links of a task as stars: the components of `at_once` links at a time, every member linked to the least one. What is connected stays so."""
    held, n = [], 0

    def stars():
        a, z = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("a", "b"))
        keys, at = np.unique(np.concatenate([a, z]), return_inverse=True)
        label = least_label(len(keys), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(label != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(keys[moved].tolist(), pa.binary()), pa.array(keys[label[moved]].tolist(), pa.binary())], ["a", "b"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= at_once:
            yield stars()
            held, n = [], 0
    if held:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(key, root): the least key of each connected component of links (a, b). Labels fall along links and then jump to their label's label until nothing changes."""
    stars = links.where("a <> b").mapInArrow(_contract, "a binary, b binary")  # links that meet in a task become stars, so few rounds are left
    links = stars.repartition("a").mapInArrow(_contract, "a binary, b binary")  # and so do those that share a member
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = durable(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("root")))
    while True:
        near = both.join(label, both["b"] == label["key"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, label["key"] == near["a"], "left").select("key", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        far = label.select(F.col("key").alias("far_key"), F.col("root").alias("far"))
        jumped = hooked.join(far, F.col("mid") == F.col("far_key"), "left").select("key", "old", F.least("mid", F.coalesce("far", "mid")).alias("root"))
        jumped = durable(jumped)
        label = jumped.select("key", "root")
        if jumped.where("old <> root").isEmpty():
            return label


def _sets(batches):
    for batch in small(batches):
        texts = as_bytes(batch.column("text").to_pylist())
        for lo, hi in slabs(texts):
            hashes, at = shingle_hashes(texts[lo:hi])
            got = [np.unique(hashes[at[i] : at[i + 1]]).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("key", "root", "blocks")), pa.array(got, pa.binary())], ["key", "root", "blocks", "grams"])


def similar(sets: list[np.ndarray], threshold: float, left: np.ndarray, right: np.ndarray, room: int = 4 << 20):
    """Index pairs (i of left, j of right) with exact Jaccard >= threshold, by matrix products over the shingles that occur twice."""
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets)), sizes.astype(int))
    ids, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n > 1
    number = np.cumsum(common) - 1
    keep = common[inverse]
    who, col = who[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    met = np.zeros((len(left), len(right)), np.float32)
    total = int(common.sum())
    chunk = max(1, min(total, 8192, room // max(len(left), len(right), 1)))
    for lo in range(0, total, chunk):
        a, b = np.searchsorted(col, [lo, lo + chunk])
        w, c = who[a:b], col[a:b] - lo
        x, y = (np.zeros((len(s), chunk), np.float32) for s in (left, right))
        k = row_l[w] >= 0
        x[row_l[w[k]], c[k]] = 1
        k = row_r[w] >= 0
        y[row_r[w[k]], c[k]] = 1
        met += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - met
    i, j = np.nonzero((met > 0) & (met >= threshold * union - 1e-9))
    return left[i], right[j]


def _verify(threshold: float):
    """Per (component, pair of blocks): how many true links each text has there, and a spanning set of them."""
    names = ["root", "left", "right"]

    def run(batches):
        for t in _groups(batches, names):
            at = _bounds(t, names)
            own, left, right = (t.column(c).to_numpy() for c in ("own", "left", "right"))
            key, grams = t.column("key").combine_chunks(), t.column("grams")
            count = np.zeros(t.num_rows, np.int64)
            one, two = [], []
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in grams.slice(lo, hi - lo).to_pylist()]
                o = own[lo:hi]
                same = left[lo] == right[lo]
                a, b = similar(sets, threshold, np.flatnonzero(o == left[lo]), np.flatnonzero(o == right[lo]))
                if same:
                    a, b = a[a < b], b[a < b]
                np.add.at(count, lo + a, 1)
                np.add.at(count, lo + b, 1)
                one.append(lo + a)
                two.append(lo + b)
            a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (one, two))
            label = least_label(t.num_rows, a, b)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(some)), key.take(pa.array(label[some])), pa.array(count[some], pa.int64())], ["a", "b", "n"])

    return run


def classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """One row per distinct text that has similar other texts: key (md5 of the text), root (a key, the same for a class), n_links.

    `rows` and `size` (bytes of shingle sets) bound a block of texts in a task; a group of any size is dealt out in blocks.
    """
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), "text")
    signed = durable(texts.mapInArrow(_sign(threshold, recall), "key binary, sig binary, nodes array<binary>, shingles long").dropDuplicates(["key"]))
    spots = signed.select(F.explode("nodes").alias("node"), "key")
    met = spots.repartitionByRange("node", "key").sortWithinPartitions("node", "key").mapInArrow(_met, "node binary, key binary")
    met = durable(met)
    large = met.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > rows).select(F.col("node").alias("large"), "n")
    met = met.join(large, F.col("node") == F.col("large"), "left").select("node", "key", F.coalesce(F.ceil(F.col("n") / rows), F.lit(1)).alias("blocks"))
    met = _in_blocks(met, F.col("blocks"), "key").join(signed.select("key", "sig"), "key").select(*NODE, "key", "sig")
    likely = max(0.3, threshold - 4.2 * (threshold * (1 - threshold) / BINS) ** 0.5)
    links = met.repartition(*NODE).sortWithinPartitions(*NODE, "key").mapInArrow(_likely(likely), "a binary, b binary")
    maybe = components(links).join(signed.select("key", "shingles"), "key")
    total = maybe.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("shingles") * 8 / size)).alias("blocks"))
    sized = durable(maybe.select("key", "root").join(total, "root"))
    few = sized.count() <= BROADCAST_KEYS
    members = texts.join(F.broadcast(sized) if few else sized, "key").dropDuplicates(["key"]).select("key", "root", "blocks", "text")
    sets = members.mapInArrow(_sets, "key binary, root binary, blocks long, grams binary")
    by = ["root", "left", "right"]
    dealt = _in_blocks(sets, F.col("blocks"), "key").select(*by, "own", "key", "grams")
    found = durable(dealt.repartition(*by).sortWithinPartitions(*by, "key").mapInArrow(_verify(threshold), "a binary, b binary, n long"))
    roots = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    return counts.join(roots, "key").select("key", "root", "n_links")


def _digest():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Per row of `docs`: doc_id, class_id, n_copies, n_links."""
    found = classes(docs, threshold, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("key"))
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    known = copies.join(found, "key", "left").select("key", "first_id", "rows", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = durable(known)
    heads = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    known = known.join(heads, "root").select("key", "class_id", (F.col("rows") - 1).alias("n_copies"), F.col("n_links").cast("long").alias("n_links"))
    return rows.join(known, "key").select("doc_id", "class_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """`docs` with one document of each class: the one with the least doc_id, then the least digest of the text, then the least hash of the row.

    The choice is made on ids and hashes; the texts are shuffled once, dealt by the whole choice, so copies of one text are spread.
    """
    found = classes(docs, threshold, recall)
    mark = {"__key": _digest(), "__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType)), "__row": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    marked = docs.withColumns(mark)
    copies = marked.groupBy("__key").agg(F.min(F.struct("__none", "__id", "__row")).alias("first"))
    known = copies.join(found.withColumnRenamed("key", "__key"), "__key", "left").select("first", "__key", F.coalesce("root", "__key").alias("root"))
    heads = known.groupBy("root").agg(F.min(F.struct("first.__none", "first.__id", "__key", "first.__row")).alias("head")).select("head.*")
    return marked.join(heads, [*mark], "left_semi").dropDuplicates([*mark]).drop(*mark)
