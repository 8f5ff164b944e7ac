"""A sharded Zarr v3 writer: rows (t, dims..., variables...) go to one shard per stretch of records, metadata is written last.

`write` takes a batch DataFrame in cell form. Records are numbered by t; every `shard[time]` of them make a shard of time, and each
shard of time and space is written by one task, which holds that shard only. A later call appends: the open shard at the end is read back and committed anew in place, so the manifest has one entry per
shard and no gap. Shards come first, then shapes, then the manifest, so a reader never sees what is not there. `sink` does the same
for each micro-batch of a stream and skips what the manifest's last_t shows to be written.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from . import objects
from .codecs import PROFILES, Unsupported, crc32c, encode
from .zarr import pack_index, read_inner, read_meta

_TYPES = {"f4": "float32", "f8": "float64", "i4": "int32", "i8": "int64", "u4": "uint32", "u8": "uint64"}


@dataclass
class OutputVar:
    dims: list
    dtype: str = "f8"
    attrs: dict = field(default_factory=dict)


@dataclass
class OutputSchema:
    """dims: ordered name -> length (time's is ignored); chunk and shard: lengths by dim; coords: name -> (values, attrs)."""

    dims: dict
    time_dim: str
    vars: dict
    chunk: dict
    shard: dict
    coords: dict = field(default_factory=dict)
    profile: str = "diagnostic"
    attrs: dict = field(default_factory=dict)

    def check(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown codec profile {self.profile!r}; known: {sorted(PROFILES)}")
        for name, var in self.vars.items():
            if not var.dims or var.dims[0] != self.time_dim:
                raise ValueError(f"{name}: its first dimension must be {self.time_dim}")
            if var.dtype not in _TYPES:
                raise ValueError(f"{name}: type {var.dtype}; known: {sorted(_TYPES)}")
            for d in var.dims:
                if d not in self.chunk or d not in self.shard or d not in self.dims:
                    raise ValueError(f"{name}: {d} is missing from the grid")
                if self.shard[d] % self.chunk[d]:
                    raise ValueError(f"{d}: the shard is no multiple of the chunk")


def _array_json(shape, shard, chunk, dtype, dims, attrs, profile) -> bytes:
    name, level = PROFILES[profile]
    size = np.dtype(dtype).itemsize
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if name == "blosc":
        inner.append({"name": "blosc", "configuration": {"cname": "zstd", "clevel": level, "shuffle": "shuffle", "typesize": size, "blocksize": 0}})
    else:
        inner.append({"name": "zstd", "configuration": {"level": level, "checksum": False}})
    index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
    node = {
        "zarr_format": 3,
        "node_type": "array",
        "shape": list(shape),
        "data_type": _TYPES[dtype],
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shard)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0,
        "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunk), "codecs": inner, "index_codecs": index, "index_location": "end"}}],
        "dimension_names": list(dims),
        "attributes": {**attrs, "_ARRAY_DIMENSIONS": list(dims)},
    }
    return json.dumps(node, sort_keys=True).encode()


def build_shard(data: np.ndarray, chunk: tuple, profile: str) -> bytes:
    """One shard object: its chunks in row-major order, then the index and its checksum."""
    body, entries = [], []
    at = 0
    for ids in itertools.product(*[range(n // c) for n, c in zip(data.shape, chunk)]):
        part = np.ascontiguousarray(data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(ids, chunk))])
        raw = encode(profile, part.astype(part.dtype.newbyteorder("<")).tobytes(), part.dtype.itemsize)
        entries.append((at, len(raw)))
        body.append(raw)
        at += len(raw)
    index = pack_index(entries)
    return b"".join(body) + index + crc32c(index).to_bytes(4, "little")


def manifest(path: str) -> dict | None:
    raw = objects.get(path, "manifest.json")
    return json.loads(raw) if raw else None


def _write_static(path: str, s: OutputSchema) -> None:
    objects.put(path, "zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": s.attrs}, sort_keys=True).encode())
    for name, (values, attrs) in s.coords.items():
        if name == s.time_dim:
            continue
        values = np.asarray(values, "f8")
        objects.put(path, f"{name}/c/0", build_shard(values, values.shape, s.profile))
        objects.put(path, f"{name}/zarr.json", _array_json(values.shape, values.shape, values.shape, "f8", [name], attrs, s.profile))


def write(cells: DataFrame, path: str, s: OutputSchema) -> dict:
    """Append the records of `cells` (time_dim as number, other dims as index from 0, variables) and return the manifest."""
    s.check()
    t = s.time_dim
    old = manifest(path)
    if old is None:
        _write_static(path, s)
        old = {"schema": "zarr-output/v1", "time_dim": t, "total_records": 0, "last_t": None, "profile": s.profile, "dims": {d: n for d, n in s.dims.items() if d != t}, "shards": []}
    if old["last_t"] is not None:
        cells = cells.where(F.col(t) > F.lit(old["last_t"]))
    per, base = s.shard[t], old["total_records"]
    ranks = numbered(cells.select(F.col(t).cast("double").alias("__t")).where("__t is not null").distinct(), "__t")
    ranks = ranks.select("__t", (F.col("__index") + base).alias("__rank")).withColumn("__shard", F.floor(F.col("__rank") / per))
    found = ranks.groupBy("__shard").agg(F.min("__t").alias("low"), F.max("__t").alias("high"), F.count("*").alias("n")).orderBy("__shard").collect()  # one row a shard, as in the manifest
    if not found:
        return old
    total = base + sum(r["n"] for r in found)
    plan, open_ = s, base % per
    dims = [d for d in s.dims if d != t]

    def kept(name, var, shard, ids, shape):
        """What the open shard holds already."""
        return _read_back(path, name, shard, plan, var, ids, shape) if open_ and shard == base // per else np.zeros(shape, var.dtype)

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        """One shard of time and space of every variable that begins there."""
        shard = int(pdf["__shard"].iloc[0])
        rank = pdf["__rank"].to_numpy() - shard * per
        spot = {d: int(pdf[f"__{d}"].iloc[0]) for d in dims}
        for name, var in plan.vars.items():
            rest = [d for d in var.dims if d != t]
            if any(spot[d] for d in dims if d not in rest):
                continue
            ids = [spot[d] for d in rest]
            block = kept(name, var, shard, ids, [per, *[plan.shard[d] for d in rest]])
            block[tuple([rank, *[pdf[d].to_numpy() - spot[d] * plan.shard[d] for d in rest]])] = pdf[name].to_numpy()
            objects.put(path, f"{name}/c/" + "/".join(map(str, (shard, *ids))), build_shard(block, tuple(plan.chunk[d] for d in var.dims), plan.profile))
        return pd.DataFrame({"cells": [len(pdf)]})

    def save_times(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["__shard"].iloc[0])
        block = kept(t, OutputVar([t], "f8"), shard, [], [per])
        block[pdf["__rank"].to_numpy() - shard * per] = pdf["__t"].to_numpy()
        objects.put(path, f"{t}/c/{shard}", build_shard(block, (plan.chunk[t],), plan.profile))
        return pd.DataFrame({"cells": [len(pdf)]})

    joined = cells.withColumn("__t", F.col(t).cast("double")).join(ranks, "__t").select("__shard", "__rank", *dims, *s.vars, *[F.floor(F.col(d) / s.shard[d]).alias(f"__{d}") for d in dims])
    for done in (joined.groupBy("__shard", *[f"__{d}" for d in dims]).applyInPandas(save, "cells long"), ranks.groupBy("__shard").applyInPandas(save_times, "cells long")):
        done.agg(F.sum("cells")).collect()  # a single row
    for name, var in s.vars.items():
        shape = [total if d == t else s.dims[d] for d in var.dims]
        objects.put(path, f"{name}/zarr.json", _array_json(shape, [s.shard[d] for d in var.dims], [s.chunk[d] for d in var.dims], var.dtype, var.dims, var.attrs, s.profile))
    attrs = s.coords.get(t, (None, {}))[1]
    objects.put(path, f"{t}/zarr.json", _array_json([total], [per], [s.chunk[t]], "f8", [t], attrs, s.profile))
    shards = {x["shard"]: x for x in old["shards"]}
    for r in found:
        before = shards.get(r["__shard"], {"t_start": r["low"], "n_records": 0})
        shards[r["__shard"]] = {"shard": r["__shard"], "t_start": before["t_start"], "t_end": r["high"], "n_records": before["n_records"] + r["n"]}
    new = old | {"total_records": total, "last_t": found[-1]["high"], "shards": [shards[k] for k in sorted(shards)]}
    objects.put(path, "manifest.json", json.dumps(new, sort_keys=True).encode())
    return new


def _read_back(path, name, shard, s, var, ids, shape) -> np.ndarray:
    """One written shard of a variable, whole; zeros where none was written."""
    meta = read_meta(path, name)
    out = np.zeros(shape, var.dtype)
    per = [c // i for c, i in zip(meta.chunk, meta.inner)]
    for at, data in read_inner(path, f"{name}/c/" + "/".join(map(str, (shard, *ids))), meta, list(itertools.product(*map(range, per)))):
        out[tuple(slice(i * n, (i + 1) * n) for i, n in zip(at, meta.inner))] = data
    return out


def sink(stream: DataFrame, path: str, s: OutputSchema, checkpoint: str, **trigger):
    """Start a query that appends each micro-batch; what was written before a restart is skipped by its time."""
    return stream.writeStream.foreachBatch(lambda batch, _: write(batch, path, s) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Writer:
    """Records one batch at a time: `record` keeps DataFrames, `flush` writes what is kept (nothing to write is no error), `close` flushes and ends."""

    def __init__(self, path: str, schema: OutputSchema, region=None):
        if region is not None:
            raise Unsupported("writing a region: records are appended in order of time")
        schema.check()
        self.path, self.schema, self._kept, self.closed = path, schema, [], False

    def record(self, cells: DataFrame) -> None:
        if self.closed:
            raise ValueError("the writer is closed")
        want = {self.schema.time_dim, *self.schema.dims, *self.schema.vars}
        if absent := sorted(want - set(cells.columns)):
            raise ValueError(f"columns {absent} are missing")
        self._kept.append(cells.select(*sorted(want)))

    def flush(self) -> dict | None:
        if not self._kept:
            return manifest(self.path)
        cells = self._kept[0]
        for more in self._kept[1:]:
            cells = cells.unionByName(more)
        out = write(cells, self.path, self.schema)
        self._kept = []
        return out

    def close(self) -> dict | None:
        out = self.flush()
        self.closed = True
        return out

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None:
            self.close()
