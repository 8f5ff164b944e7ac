"""Zarr arrays (v2, and v3 with or without shards) as a Spark data source: only chunks that meet the selection are read.

Options: path, variable, select (JSON list of axes), mode ("cells", "chunks" or "shape"), cache (a cache to read chunks through). In mode cells each row is a selected cell:
pos_<dim> (position in the selection), <dim> (index), value. Floats are read as double; chunks that are not stored have the fill
value, which is not a missing value. One partition holds one chunk (or shard), so a task never holds more than that and its cells.
"""

from __future__ import annotations

import itertools
import json
import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.select import boxes, lazy_indices, met_chunks, met_indices
from . import objects
from .codecs import Unsupported, decode
from .errors import UnknownOption

ZARR_OPTIONS = ("variable", "select", "mode", "cache")
_V3_TYPES = {"float32": "<f4", "float64": "<f8", "int8": "|i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "|u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "bool": "|b1"}


@dataclass
class ArrayMeta:
    shape: tuple
    chunk: tuple
    dtype: str
    fill: float
    order: str
    separator: str
    codecs: list
    dims: list
    version: int
    inner: tuple | None = None  # the chunks inside a shard
    index_codecs: list = field(default_factory=list)
    index_first: bool = False


def read_meta(base: str, variable: str) -> ArrayMeta:
    """Metadata only, v2 first; chunks are never touched."""
    prefix = f"{variable}/" if variable else ""
    raw = objects.get(base, prefix + ".zarray")
    if raw is not None:
        m = json.loads(raw)
        if m.get("filters"):
            raise Unsupported("filters")
        attrs = json.loads(objects.get(base, prefix + ".zattrs") or b"{}")
        shape = tuple(m["shape"])
        dims = attrs.get("_ARRAY_DIMENSIONS") or [f"dim_{i}" for i in range(len(shape))]
        codec = (m.get("compressor") or {}).get("id")
        return ArrayMeta(shape, tuple(m["chunks"]), m["dtype"], _fill(m.get("fill_value")), m.get("order", "C"), m.get("dimension_separator") or ".", [codec] if codec else [], list(dims), 2)
    raw = objects.get(base, prefix + "zarr.json")
    if raw is None:
        raise FileNotFoundError(f"no array {variable!r} under {base}")
    m = json.loads(raw)
    if m.get("node_type") != "array" or m["chunk_grid"]["name"] != "regular":
        raise Unsupported("only arrays on regular grids")
    shape = tuple(m["shape"])
    dims = m.get("dimension_names") or m.get("attributes", {}).get("_ARRAY_DIMENSIONS") or [f"dim_{i}" for i in range(len(shape))]
    key = m["chunk_key_encoding"]
    if key["name"] != "default":
        raise Unsupported("chunk key encoding " + key["name"])
    out = ArrayMeta(shape, tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), _V3_TYPES[m["data_type"]], _fill(m.get("fill_value")), "C", key.get("configuration", {}).get("separator", "/"), [], list(dims), 3)
    steps = m["codecs"]
    if steps[0]["name"] == "sharding_indexed":
        c = steps[0]["configuration"]
        out.inner, out.index_first = tuple(c["chunk_shape"]), c.get("index_location", "end") == "start"
        out.index_codecs = [s["name"] for s in c["index_codecs"] if s["name"] != "bytes"]
        steps = c["codecs"]
    for s in steps:
        if s["name"] == "transpose":
            raise Unsupported("transpose")
        if s["name"] == "bytes":
            if s.get("configuration", {}).get("endian") == "big":
                out.dtype = ">" + out.dtype[1:]
        else:
            out.codecs.append(s["name"])
    return out


def _fill(x) -> float:
    return {None: 0, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(x, x) if not isinstance(x, bool) else int(x)


def read_axis(base: str, name: str):
    """(values, attributes) of a one-dimensional array of this name; (None, {}) if there is none."""
    try:
        meta = read_meta(base, name)
    except FileNotFoundError:
        return None, {}
    if len(meta.shape) != 1:
        return None, {}
    v2 = objects.get(base, f"{name}/.zattrs")
    attrs = json.loads(v2 or b"{}") if meta.version == 2 else json.loads(objects.get(base, f"{name}/zarr.json")).get("attributes", {})
    out = []
    for k in range(-(-meta.shape[0] // meta.chunk[0])):
        key = f"{name}/{chunk_name(meta, (k,))}"
        if meta.inner is None:
            out.append(decode_chunk(meta, objects.get(base, key), meta.chunk))
        else:
            out += [data for _, data in read_inner(base, key, meta, [(i,) for i in range(meta.chunk[0] // meta.inner[0])])]
    values = np.concatenate(out)[: meta.shape[0]] if out else np.zeros(0)
    return values.astype("f8"), {k: v for k, v in attrs.items() if k in ("units", "calendar")}


def array_shape(base: str, variable: str) -> tuple:
    return read_meta(base, variable).shape


def chunk_name(meta: ArrayMeta, ids: tuple) -> str:
    body = meta.separator.join(map(str, ids))
    if meta.version == 2:
        return body or "0"
    return "c" + (meta.separator + body if body else "")


def decode_chunk(meta: ArrayMeta, raw: bytes | None, shape: tuple) -> np.ndarray:
    if raw is None:
        return np.full(shape, meta.fill, np.dtype(meta.dtype).newbyteorder("="))
    for name in reversed(meta.codecs):
        raw = decode(name, raw)
    flat = np.frombuffer(raw, meta.dtype, math.prod(shape))
    return flat.reshape(shape, order=meta.order).astype(np.dtype(meta.dtype).newbyteorder("="), copy=False)


def shard_index(meta: ArrayMeta, raw: bytes) -> np.ndarray:
    """(offset, size) of each inner chunk in row-major order; all ones mark one that is not stored."""
    for name in reversed(meta.index_codecs):
        raw = decode(name, raw)
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def read_inner(base: str, name: str, meta: ArrayMeta, wanted: list[tuple], store=objects):
    """(inner chunk id, array) of the wanted inner chunks of one shard: the index first, then only their byte ranges."""
    grid = tuple(c // i for c, i in zip(meta.chunk, meta.inner))
    tail = 4 if "crc32c" in meta.index_codecs else 0
    size = 16 * math.prod(grid) + tail
    try:
        index = shard_index(meta, store.get_range(base, name, 0 if meta.index_first else -size, size))
    except FileNotFoundError:
        index = None
    for ids in wanted:
        spot = int(np.ravel_multi_index(ids, grid)) if grid else 0
        if index is None or index[spot][0] == 2**64 - 1:
            yield ids, decode_chunk(meta, None, meta.inner)
        else:
            yield ids, decode_chunk(meta, store.get_range(base, name, *map(int, index[spot])), meta.inner)


class Through:
    """Objects of a store by way of the cache: what is not held is fetched whole and committed, so a range is read there."""

    def __init__(self, root: str):
        self.root = root

    def _held(self, base: str, key: str):
        from . import cache  # the cache reads registries, which are not needed for direct access

        return cache.through(f"{base}/{key}", self.root)

    def get(self, base: str, key: str) -> bytes | None:
        path = self._held(base, key)
        return None if path is None else objects.get(self.root, path)

    def get_range(self, base: str, key: str, start: int, size: int) -> bytes:
        path = self._held(base, key)
        if path is None:
            raise FileNotFoundError(key)
        return objects.get_range(self.root, path, start, size)


MOST_PIECES = 20_000


class Piece(InputPartition):
    """A box of chunk (or shard) ids: a stretch of each axis."""

    def __init__(self, axes):
        self.axes = axes


class ZarrReader(DataSourceReader):
    def __init__(self, options, schema):
        self.base, self.variable = options["path"], options.get("variable", "")
        self.mode = options.get("mode", "cells")
        self.store = Through(options["cache"]) if options.get("cache") else objects
        self.meta = read_meta(self.base, self.variable)
        self.indices = lazy_indices(options.get("select"), self.meta.shape)

    def partitions(self):
        """One chunk or shard a partition; of a store with very many, boxes of some."""
        if self.mode == "shape":
            return [Piece(())]
        met = [met_chunks(axis, c) for axis, c in zip(self.indices, self.meta.chunk)]
        if any(not len(m) for m in met):
            return [Piece(None)]
        return [Piece(box) for box in boxes(met, MOST_PIECES)]

    def _pieces(self, box):
        """(chunk id, array) of the chunks of a box, one at a time; of shards only the inner chunks that the selection meets."""
        meta = self.meta
        prefix = f"{self.variable}/" if self.variable else ""
        for ids in itertools.product(*box):
            name = prefix + chunk_name(meta, ids)
            if meta.inner is None:
                yield ids, decode_chunk(meta, self.store.get(self.base, name), meta.chunk)
                continue
            per = tuple(c // i for c, i in zip(meta.chunk, meta.inner))
            own = [met_indices(axis, s * c, (s + 1) * c)[1] // n - s * p for axis, s, c, n, p in zip(self.indices, ids, meta.chunk, meta.inner, per)]
            wanted = list(itertools.product(*[np.unique(x).tolist() for x in own]))
            for inner, a in read_inner(self.base, name, meta, wanted, self.store):
                yield tuple(s * p + i for s, p, i in zip(ids, per, inner)), a

    def read(self, part):
        if part is None or part.axes is None:
            return
        meta, dims = self.meta, self.meta.dims
        if self.mode == "shape":
            yield pa.RecordBatch.from_arrays([pa.array([list(meta.shape)], pa.list_(pa.int64())), pa.array([list(meta.chunk)], pa.list_(pa.int64())), pa.array([list(dims)], pa.list_(pa.string()))], ["shape", "chunk", "dims"])
            return
        size = meta.inner or meta.chunk
        pieces = self._pieces(part.axes)
        for ids, data in pieces:
            if self.mode == "chunks":
                clip = tuple(slice(0, min(n, total - i * n)) for i, n, total in zip(ids, size, meta.shape))
                data = data[clip]
                yield pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(data.shape)], pa.list_(pa.int64())), pa.array([data.astype("f8").ravel()], pa.list_(pa.float64()))], ["chunk", "shape", "data"])
                continue
            picks = []
            for axis, (i, n) in enumerate(zip(ids, size)):
                picks.append(met_indices(self.indices[axis], i * n, (i + 1) * n))
            if not all(len(p) for p, _ in picks):
                continue
            values = data[np.ix_(*[w - i * n for (_, w), i, n in zip(picks, ids, size)])] if picks else data
            grid = np.meshgrid(*[np.arange(len(p)) for p, _ in picks], indexing="ij") if picks else []
            cols = [pa.array(p[g.ravel()].astype("i4")) for (p, _), g in zip(picks, grid)] + [pa.array(w[g.ravel()].astype("i4")) for (_, w), g in zip(picks, grid)]
            flat = values.ravel()
            flat = flat.astype("f8") if flat.dtype.kind == "f" else flat.astype("i4" if flat.dtype.itemsize < 4 or flat.dtype == np.int32 else "i8")
            batch = pa.RecordBatch.from_arrays([*cols, pa.array(flat)], [*[f"pos_{d}" for d in dims], *dims, "value"])
            for k in range(0, batch.num_rows, 1 << 16):
                yield batch.slice(k, 1 << 16)


class ZarrSource(DataSource):
    @classmethod
    def name(cls):
        return "zarr"

    def __init__(self, options):
        super().__init__(options)
        if unknown := set(options) - {"path", *ZARR_OPTIONS}:
            raise UnknownOption("zarr", unknown, {"path", *ZARR_OPTIONS})

    def schema(self):
        mode = self.options.get("mode", "cells")
        if mode == "shape":
            return "shape array<long>, chunk array<long>, dims array<string>"
        if mode == "chunks":
            return "chunk array<long>, shape array<long>, data array<double>"
        meta = read_meta(self.options["path"], self.options.get("variable", ""))
        kind = np.dtype(meta.dtype)
        value = "double" if kind.kind == "f" else "int" if kind.itemsize < 4 or kind == np.int32 else "long"
        return ", ".join([f"`pos_{d}` int" for d in meta.dims] + [f"`{d}` int" for d in meta.dims] + [f"value {value}"])

    def reader(self, schema):
        return ZarrReader(dict(self.options), schema)



def pack_index(entries: list[tuple[int, int]]) -> bytes:
    return struct.pack(f"<{2 * len(entries)}Q", *itertools.chain(*entries))
