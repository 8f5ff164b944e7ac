"""Orthogonal selection and chunk arithmetic on dense arrays, as index tables and column expressions."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_BROADCAST = 100_000  # indices; a longer selection is joined as Spark sees fit


def parse_axis(axis) -> tuple:
    """("all",), ("indices", [...]) or ("slice", start, stop, step) from "all", a list, {"indices": [...]} or {"slice": [a, b, s]}."""
    if axis is None or axis == "all":
        return ("all",)
    if isinstance(axis, dict) and set(axis) == {"indices"}:
        axis = axis["indices"]
    if isinstance(axis, (list, tuple)):
        out = [int(i) for i in axis]
        if any(i < 0 for i in out):
            raise IndexError(f"negative index in {out}")
        return ("indices", out)
    if isinstance(axis, dict) and set(axis) == {"slice"}:
        start, stop, step = ([*axis["slice"], 1] if len(axis["slice"]) == 2 else axis["slice"])[:3]
        if step < 1 or start < 0:
            raise ValueError(f"slice must have start >= 0 and step >= 1: {axis}")
        return ("slice", int(start), int(stop), int(step))
    raise ValueError(f"unknown axis selection: {axis!r}")


def axis_indices(axis, n: int) -> list[int]:
    """The indices an axis selects of n, in the caller's order, repeats kept."""
    kind, *rest = parse_axis(axis)
    if kind == "all":
        return list(range(n))
    if kind == "slice":
        return list(range(rest[0], min(rest[1], n), rest[2]))
    if bad := [i for i in rest[0] if i >= n]:
        raise IndexError(f"index {bad[0]} out of range for an axis of {n}")
    return rest[0]


def parse_select(text: str | dict | None) -> list | None:
    """The list of axes of a selection given as JSON, a mapping with "axes", or nothing."""
    if text in (None, ""):
        return None
    got = json.loads(text) if isinstance(text, str) else text
    return got["axes"] if isinstance(got, dict) else got


def resolve(select, shape: tuple[int, ...]) -> list[list[int]]:
    """Index lists per axis; a selection applies only to arrays with as many axes."""
    axes = parse_select(select)
    if axes is None or len(axes) != len(shape):
        return [list(range(n)) for n in shape]
    return [axis_indices(a, n) for a, n in zip(axes, shape)]


def lazy_indices(select, shape: tuple[int, ...]) -> list:
    """Per axis a range (all, slices) or a list (chosen indices): what `resolve` lists, without listing it."""
    axes = parse_select(select)
    if axes is None or len(axes) != len(shape):
        return [range(n) for n in shape]
    out = []
    for a, n in zip(axes, shape):
        kind, *rest = parse_axis(a)
        out.append(range(n) if kind == "all" else range(rest[0], min(rest[1], n), rest[2]) if kind == "slice" else axis_indices(a, n))
    return out


def met_chunks(axis, length: int):
    """Ids of the chunks of one axis that hold its selected indices, in order: a range where the selection leaves none out."""
    if isinstance(axis, range):
        if not len(axis):
            return range(0)
        if axis.step <= length:
            return range(axis[0] // length, axis[-1] // length + 1)
    return sorted({i // length for i in axis})


def met_indices(axis, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, indices) of an axis' selection in lo..hi."""
    if isinstance(axis, range):
        first = max(0, -(-(lo - axis.start) // axis.step))
        last = min(len(axis), -(-(hi - axis.start) // axis.step))
        pos = np.arange(first, max(first, last))
        return pos, axis.start + pos * axis.step
    want = np.asarray(axis, np.int64)
    pos = np.flatnonzero((want >= lo) & (want < hi))
    return pos, want[pos]


def boxes(axes: list, most: int):
    """The product of the axes cut into boxes, at most about `most` of them: per box a stretch of each axis."""
    per = -(-math.prod(map(len, axes)) // most)
    cuts = []
    for axis in reversed(axes):
        size = max(1, min(len(axis), per))
        cuts.append([axis[k : k + size] for k in range(0, len(axis), size)])
        per = -(-per // max(1, len(axis)))
    return itertools.product(*reversed(cuts))


def needed_chunks(indices: list[list[int]], chunk: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Ids of the chunks that hold selected cells: the product over axes of the chunk ids met."""
    return list(itertools.product(*[sorted({i // c for i in axis}) for axis, c in zip(indices, chunk)]))


def chunk_table(spark: SparkSession, axes: list[tuple], names: list[str]) -> DataFrame:
    """The needed chunks as a table, one column an axis: (length, chunk length, selection, all if there is none) of each axis. Built by Spark, so no list of all ids is made."""
    out = spark.range(1)
    for (total, chunk, *axis), name in zip(axes, names):
        kind, *rest = parse_axis(axis[0] if axis else "all")
        if kind == "indices":
            ids = F.array(*[F.lit(k) for k in sorted({i // chunk for i in axis_indices(axis[0], total)})])
        else:
            start, stop, step = rest if kind == "slice" else (0, total, 1)
            stop = min(stop, total)
            each = F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step)) if step > chunk else F.sequence(F.lit(start // chunk), F.lit((stop - 1) // chunk))
            ids = F.array().cast("array<int>") if stop <= start else F.array_distinct(F.transform(each, lambda i, c=chunk: F.floor(i / c).cast("int"))) if step > chunk else each
        out = out.withColumn(name, F.explode(ids.cast("array<int>")))
    return out.select(*names)


def index_table(spark: SparkSession, indices: list[int], name: str) -> DataFrame:
    """(pos_<name>, <name>) of the selected indices of one axis."""
    return spark.createDataFrame(list(enumerate(map(int, indices))), f"pos_{name} int, {name} int")


def take(cells: DataFrame, spark: SparkSession, axes: dict[str, object], shape: dict[str, int]) -> DataFrame:
    """Cells at the selected indices of each axis, with their positions in the caller's order."""
    for name, axis in axes.items():
        picked = axis_indices(axis, shape[name])
        table = index_table(spark, picked, name)
        cells = cells.join(F.broadcast(table) if len(picked) <= MOST_BROADCAST else table, name)
    return cells


def gather(array: Column, indices: list[int]) -> Column:
    """Array elements in the order of the indices."""
    return F.transform(F.array(*[F.lit(int(i)) for i in indices]), lambda i: F.get(array, i))


def chunk_of(index: Column, length: int) -> Column:
    return F.floor(index / F.lit(length)).cast("int")


def within_chunk(index: Column, length: int) -> Column:
    return F.pmod(index, F.lit(length)).cast("int")


def chunk_key(*ids: Column, separator: str = ".") -> Column:
    return F.concat_ws(separator, *[i.cast("string") for i in ids])


def linear_index(indices: list[Column], shape: list[int], order: str = "C") -> Column:
    """Position of a cell in row-major (C) or column-major (F) order."""
    out = F.lit(0).cast("long")
    pairs = list(zip(indices, shape))
    for i, n in pairs if order == "C" else reversed(pairs):
        out = out * F.lit(n).cast("long") + i
    return out


def clip_edge(chunk: Column, length: int, total: int) -> Column:
    """How many cells of a chunk lie inside the array."""
    return F.least(F.lit(length), F.lit(total) - chunk * F.lit(length))


def or_fill(value: Column, fill=0) -> Column:
    """Cells of chunks that are not stored have the fill value."""
    return F.coalesce(value, F.lit(fill))


def pad_ring(ring: Column, size: Column) -> Column:
    """The last vertex repeated up to a size; a longer ring is an error, an empty one stays missing."""
    over = F.raise_error(F.lit("a part has more vertices than allowed")).cast("array<double>")
    return F.when(F.size(ring) > size, over).otherwise(F.concat(ring, F.array_repeat(F.element_at(ring, -1), size - F.size(ring))))
