"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The five-word shingles of a text are hashed once; a shingle's bin is its hash's high bits and its rank the rest. Each bin keeps
its least rank. An empty bin borrows from another by optimal densification: it probes bins in an order of its own, the same in
every text, until it meets a filled one. Of each rank only the low BITS bits are kept, two hex digits a bin. The likeness of
two fingerprints is the share of equal bins, corrected for the chance that unequal ranks share their low bits.

Defined results: null text counts as empty; an empty or wordless text has an empty fingerprint, alike (1) to another such and
unlike (0) to all others; a text of fewer than five words is one shingle of all its words; texts of any length are read whole; equal texts have equal
fingerprints; rows with a null doc_id come last in the order, and rows of one doc_id follow each other by a hash of their text, so
repeated rows are each other's next; an empty table gives an empty result; other columns are ignored, whatever their names. Words are
runs of characters other than ASCII white space.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import constant_array, let

BINS, BITS, WORDS = 256, 8, 5
PROBES = 8
_PROBE = np.random.default_rng(5).integers(0, BINS, (PROBES, BINS))


def words(text: Column) -> Column:
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def shingle_hashes(text: Column) -> Column:
    """Sorted array of the shingles' hashes."""

    def made(h):
        n = F.size(h)
        long_ = F.transform(F.slice(h, WORDS, F.greatest(n - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + F.lit(j)) for j in range(WORDS - 1)]))
        return F.sort_array(F.when(n >= WORDS, long_).when(n > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>")))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), made)


def _bin(x: Column) -> Column:
    """0..BINS-1: the high bits of a hash, in the order in which hashes sort."""
    return F.shiftright(x, 56).cast("int") + F.lit(BINS // 2)


def bins(text: Column) -> Column:
    """array<smallint> of BINS low bits after densification; empty for a text without words."""
    low = F.lit((1 << BITS) - 1).cast("bigint")
    nothing = F.lit(None).cast("smallint")
    probes = [constant_array(row, "int") for row in _PROBE]

    def least(s):  # the first hash of each bin, in order of bins
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    def spread(f):  # BINS values or nulls
        def with_gap(x, i):
            gap = _bin(x) - F.when(i == 0, F.lit(0)).otherwise(_bin(F.get(f, i - 1)) + 1)
            value = F.array(x.bitwiseAND(low).cast("smallint"))
            return F.when(gap == 0, value).otherwise(F.concat(F.array_repeat(nothing, gap), value))

        tail = F.array_repeat(nothing, F.lit(BINS - 1) - _bin(F.element_at(f, -1)))
        return F.concat(F.flatten(F.transform(f, with_gap)), tail)

    def probed(v):
        def borrow(x, i):
            return F.coalesce(x, *[F.get(v, F.get(p, i)) for p in probes])

        return let(F.transform(v, borrow), lambda o: F.when(F.exists(o, lambda x: x.isNull()), rest(v, o)).otherwise(o))

    def rest(v, o):  # bins that found nothing so far take the filled bin that comes first in an order of their own
        filled = F.filter(F.transform(v, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

        def nearest(f):
            return F.transform(o, lambda x, i: F.coalesce(x, F.get(v, F.array_min(F.transform(f, lambda b: F.struct(F.hash(b, i).alias("h"), b.alias("b"))))["b"])))

        return let(filled, nearest)

    def dense(f):
        full = let(spread(f), lambda v: F.when(F.size(f) == BINS, v).otherwise(probed(v)))
        return F.when(F.size(f) == 0, F.array().cast("array<smallint>")).otherwise(full)

    return let(let(shingle_hashes(text), least), dense)


def packed(b: Column) -> Column:
    """The fingerprint as a string, two hex digits a bin."""
    digits = F.array(*[F.lit(f"{k:02x}") for k in range(1 << BITS)])
    return F.array_join(F.transform(b, lambda x: F.get(digits, x.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts of two arrays of bins, corrected for chance agreement of BITS bits and held in 0..1."""
    chance = 2.0**-BITS
    equal = F.size(F.filter(a, lambda x, i: x == F.get(b, i))) / F.lit(float(BINS))
    both = (F.size(a) == 0) & (F.size(b) == 0)
    one = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(both, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def with_next(docs: DataFrame, columns: list[str], rows_per_stretch: int = 256, most_stretches: int = 1 << 16) -> DataFrame:
    """`docs` (doc_id and `columns`) with next_<column>: the values of the next row by descending doc_id (after the last: the first).

    The ids are cut into stretches at approximate quantiles, two levels of at most 256 bounds; an id that fills several of them, and
    the rows without one, are cut further by a hash of the first column. Inside a stretch `lead` finds the next row; a stretch's last
    row gets the first row of the next stretch, read by its id and hash. Rows of one id go by that hash, then by the columns.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    width = min(256, max(1, math.ceil(math.sqrt(min(most_stretches, max(1, n / rows_per_stretch))))))
    parts = width * width
    asked = [i / parts for i in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", asked, 4 * parts + 100)).first()[0] or [] if asked else []
    bounds = sorted(set(cuts))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    id_ = F.col("doc_id")
    if groups:
        heads = F.array(*[F.lit(g[0]) for g in groups])
        inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
        head = F.size(F.filter(heads, lambda x: x <= id_))
        stretch = F.when(id_.isNull(), F.lit(-1)).when(head == 0, F.lit(0)).otherwise((head - 1) * width + 1 + F.size(F.filter(F.get(inner, head - 1), lambda x: x <= id_)))
    else:
        stretch = F.when(id_.isNull(), F.lit(-1)).otherwise(F.lit(0))
    rank = F.xxhash64(columns[0])
    times = {x: k for x, k in Counter(cuts).items() if k > 1}
    often = F.when(id_.isNull(), F.lit(max(1, min(parts, math.ceil(nulls / rows_per_stretch)))))
    if times:
        often = often.when(id_.isin(list(times)), F.element_at(F.create_map(*[F.lit(v) for kv in times.items() for v in kv]), id_))
    share = F.shiftright(rank, 40) + F.lit(1 << 23)  # 24 bits, in the order of the hash
    sub = F.floor(share * often.otherwise(F.lit(1)) / F.lit(1 << 24)).cast("int")
    cut = docs.select("doc_id", *columns, stretch.alias("stretch"), sub.alias("sub"), rank.alias("rank"))
    first = F.max(F.struct("doc_id", F.bitwise_not("rank").alias("unrank"))).alias("first")
    firsts = cut.groupBy("stretch", "sub").agg(first).orderBy(F.desc("stretch"), "sub").collect()  # one row a stretch
    after = [(r["stretch"], r["sub"], *(lambda x: (x["stretch"], x["sub"], ~x["first"]["unrank"]))(firsts[(k + 1) % len(firsts)])) for k, r in enumerate(firsts)]
    after = docs.sparkSession.createDataFrame(after, "stretch int, sub int, next_stretch int, next_sub int, next_rank long")
    known = [r["first"]["doc_id"] for r in firsts if r["first"]["doc_id"] is not None]
    at_head = cut.where((id_.isin(known) | id_.isNull()) & F.col("rank").isin([~r["first"]["unrank"] for r in firsts])) if firsts else cut
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("back"), *columns)
    head = at_head.groupBy(*[F.col(c).alias(f"next_{c}") for c in ("stretch", "sub", "rank")]).agg(F.min_by(F.struct(*columns), order).alias("__head"))
    head = after.join(head, ["next_stretch", "next_sub", "next_rank"]).select("stretch", "sub", "__head")
    w = W.partitionBy("stretch", "sub").orderBy(id_.desc_nulls_last(), "rank", *[F.col(c).asc() for c in columns])
    led = cut.withColumn("__next", F.lead(F.struct(*columns)).over(w)).withColumn("__last", F.row_number().over(w) == F.count("*").over(W.partitionBy("stretch", "sub")))
    head = head.select(F.col("stretch").alias("of_stretch"), F.col("sub").alias("of_sub"), "__head")
    joined = led.join(head, (F.col("stretch") == F.col("of_stretch")) & (F.col("sub") == F.col("of_sub")) & F.col("__last"), "left")
    following = F.when(F.col("__last"), F.col("__head")).otherwise(F.col("__next"))
    return joined.withColumn("__following", following).select("doc_id", *columns, *[F.col(f"__following.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, bins (array<smallint>) of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("bins", bins(F.col("text")))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next document's are."""
    rows = with_next(fingerprints(docs), ["text", "bins"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_bins", bins(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
