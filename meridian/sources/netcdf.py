"""NetCDF classic files (CDF-1 and CDF-2): the header is read by byte ranges, and each task reads a range of a variable's records only."""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.times import cf_micros, latest
from . import objects
from .codecs import Unsupported
from .errors import NoSuchVariable

_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
PIECE = 32 << 20  # bytes of a variable that one task reads
GAP = 1 << 14  # bytes of other variables between two records that are rather read than skipped
STRETCH = 4 << 20  # bytes of records read at once
TIMES = 1 << 18  # values of a time axis searched at once


class NetCDF:
    """Header of a classic file. `fetch(offset, size)` gives bytes of the file, or fewer at its end; a whole file may be given as bytes."""

    def __init__(self, source):
        self.fetch = source if callable(source) else lambda at, n: bytes(source[at : at + n])
        size = 1 << 16
        while True:
            self.raw = self.fetch(0, size)
            try:
                self._parse()
                break
            except (struct.error, IndexError):
                if len(self.raw) < size:
                    raise ValueError("truncated NetCDF header") from None
                size *= 8
        self.raw = b""

    def _parse(self) -> None:
        raw = self.raw
        if raw[:4] == b"\x89HDF":
            raise Unsupported("NetCDF-4 (HDF5) needs a decoder that is not installed")
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.at, self.wide = 4, raw[3] == 2
        self.records = self._int()
        self.dims = [(self._name(), self._int()) for _ in range(self._list())]
        self.attrs = self._attrs()
        self.vars = {}
        for _ in range(self._list()):
            name = self._name()
            ids = [self._int() for _ in range(self._int())]
            attrs = self._attrs()
            kind, size = self._int(), self._int()
            begin = struct.unpack_from(">q" if self.wide else ">i", raw, self.at)[0]
            self.at += 8 if self.wide else 4
            self.vars[name] = (ids, attrs, _TYPES[kind], size, begin)
        growing = [v for v in self.vars.values() if v[0] and self.dims[v[0][0]][1] == 0]
        # a single growing variable is stored without padding between its records
        self.record_size = self._width(growing[0]) if len(growing) == 1 else sum(v[3] for v in growing)

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.raw, self.at - 4)[0]

    def _list(self) -> int:
        self._int()
        return self._int()

    def _take(self, n: int) -> bytes:
        data = self.raw[self.at : self.at + n]
        if len(data) < n:
            raise IndexError
        self.at += -(-n // 4) * 4
        return data

    def _name(self) -> str:
        return self._take(self._int()).decode()

    def _attrs(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), self._int(), self._int()
            data = self._take(np.dtype(_TYPES[kind]).itemsize * n)
            out[name] = data.decode() if kind == 2 else (np.frombuffer(data, _TYPES[kind]).tolist() if n != 1 else np.frombuffer(data, _TYPES[kind])[0].item())
        return out

    def _width(self, var) -> int:
        """Bytes of one step along the leading axis."""
        return math.prod(self.dims[i][1] for i in var[0][1:]) * np.dtype(var[2]).itemsize

    def dim_names(self, name: str) -> list[str]:
        return [self.dims[i][0] for i in self.vars[name][0]]

    def shape(self, name: str) -> list[int]:
        return [self.dims[i][1] or self.records for i in self.vars[name][0]]

    def data_variables(self) -> list[str]:
        """Numeric variables other than coordinates."""
        return sorted(n for n, v in self.vars.items() if v[2] != "S1" and self.dim_names(n) != [n])

    def kind(self, name: str) -> str:
        """double, long or string: how the values come out of `read`."""
        _, attrs, kind, _, _ = self.vars[name]
        if kind == "S1":
            return "string"
        packed = {"scale_factor", "add_offset", "_FillValue", "missing_value"} & set(attrs)
        return "double" if np.dtype(kind).kind == "f" or packed else "long"

    def read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Steps lo..hi of the leading axis: packed or masked values as doubles with NaN, other integers as they are."""
        var = self.vars[name]
        ids, attrs, kind, _, begin = var
        shape = self.shape(name)
        if not shape:
            data = np.frombuffer(self.fetch(begin, np.dtype(kind).itemsize), kind, 1)
        else:
            hi = shape[0] if hi is None else hi
            shape[0] = hi - lo
            width = self._width(var)
            if self.dims[ids[0]][1] == 0 and self.record_size != width:
                data = np.concatenate([self._records(begin, width, r, min(hi, r + self._together(width))).view(kind) for r in range(lo, hi, self._together(width))]) if hi > lo else np.zeros(0, kind)
            else:
                data = np.frombuffer(self.fetch(begin + lo * width, width * (hi - lo)), kind)
        out = data.reshape(shape)
        if kind == "S1":
            return out
        fill = attrs.get("_FillValue", attrs.get("missing_value"))
        if self.kind(name) == "double":
            value = out.astype("f8")
            if "scale_factor" in attrs or "add_offset" in attrs:
                value = value * float(attrs.get("scale_factor", 1)) + float(attrs.get("add_offset", 0))
            return np.where(out == fill, np.nan, value) if fill is not None else value
        return out.astype(out.dtype.newbyteorder("="))

    def _together(self, width: int) -> int:
        """How many records of an interleaved variable are read at once."""
        return max(1, STRETCH // self.record_size) if self.record_size - width <= GAP else 1

    def _records(self, begin: int, width: int, lo: int, hi: int) -> np.ndarray:
        """Bytes of the records lo..hi of an interleaved variable, read as one range of the file."""
        size = (hi - lo - 1) * self.record_size + width
        raw = np.zeros((hi - lo, self.record_size), "u1")
        got = self.fetch(begin + lo * self.record_size, size)
        if len(got) < size:
            raise ValueError("truncated NetCDF records")
        raw.reshape(-1)[:size] = np.frombuffer(got, "u1", size)
        return raw[:, :width].reshape(-1)

    def length(self, dim: str) -> int:
        """Steps of a dimension; 0 if there is none of this name."""
        return next((n or self.records for d, n in self.dims if d == dim), 0)

    def current(self, dim: str, instants) -> np.ndarray:
        """Index of the record current at each instant (microseconds) on the file's own times, -1 where they do not span it; a stretch of the axis is held at a time."""
        if dim not in self.vars:
            return np.full(len(instants), -1)
        attrs = self.vars[dim][1]
        units, calendar = str(attrs.get("units", "")), str(attrs.get("calendar", "standard"))
        if cf_micros(np.zeros(0), units, calendar) is None:
            return np.full(len(instants), -1)
        n = self.shape(dim)[0]
        return latest(((lo, cf_micros(self.read(dim, lo, min(n, lo + TIMES)), units, calendar)) for lo in range(0, n, TIMES)), instants)

    def pieces(self, name: str, size: int = PIECE) -> list[tuple[int, int]]:
        """Ranges of the leading axis of about `size` bytes each."""
        shape = self.shape(name)
        if not shape:
            return [(0, 1)]
        step = max(1, size // max(1, self._width(self.vars[name])))
        return [(lo, min(shape[0], lo + step)) for lo in range(0, shape[0], step)]


def open_file(path: str) -> NetCDF:
    return NetCDF(lambda at, n: objects.get_range(path, "", at, n))


def chosen(nc: NetCDF, variables) -> list[str]:
    """The data variables asked for; an unknown name is an error that lists what is present."""
    present = nc.data_variables()
    wanted = present if variables is None else list(variables)
    if absent := [v for v in wanted if v not in nc.vars]:
        raise NoSuchVariable(absent, present)
    return wanted


def signatures(path: str, variables=None) -> dict[tuple, list[str]]:
    """Variables by the dimensions that they share; each group can be read as one table."""
    nc, out = open_file(path), defaultdict(list)
    for v in chosen(nc, variables):
        out[tuple(nc.dim_names(v))].append(v)
    return dict(out)


def coordinates(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """(<dim>_idx, <dim>) of each coordinate variable of the first file, with its attributes as column metadata (units and calendar of times)."""
    nc = open_file(objects.files(spark, path)[0])
    out = {}
    for name in nc.vars:
        if nc.dim_names(name) == [name] and nc.vars[name][2] != "S1":
            df = spark.createDataFrame([(i, x) for i, x in enumerate(nc.read(name).astype("f8").tolist())], f"`{name}_idx` int, `{name}` double")
            out[name] = df.withMetadata(name, {k: v for k, v in nc.vars[name][1].items() if k in ("units", "calendar")})
    return out


@dataclass(frozen=True)
class Layout:
    """Variables of the same dimensions as the columns of one table."""

    names: tuple
    dims: tuple
    coords: tuple
    kinds: tuple
    alone: bool  # the single variable is called value

    @classmethod
    def of(cls, nc: NetCDF, variable: str | None = None, variables=None) -> Layout:
        names = chosen(nc, [variable] if variable is not None else variables)
        shapes = {tuple(nc.dim_names(v)) for v in names}
        if len(shapes) != 1:
            raise ValueError(f"variables of different dimensions {sorted(shapes)}: read them apart (see signatures)")
        dims = shapes.pop()
        return cls(tuple(names), dims, tuple(d for d in dims if d in nc.vars and nc.kind(d) != "string"), tuple(map(nc.kind, names)), variable is not None)

    @property
    def columns(self) -> list[tuple[str, str]]:
        values = [("value" if self.alone else v, k) for v, k in zip(self.names, self.kinds)]
        return [("path", "string"), *[(f"{d}_idx", "int") for d in self.dims], *[(d, "double") for d in self.coords], *values]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self.columns)

    def cells(self, nc: NetCDF, path: str, lo: int, hi: int):
        """The cells of steps lo..hi of the leading axis, some steps at a time."""
        dims = self.dims
        axes = {d: (nc.read(d, lo, hi) if d == dims[0] and nc.dim_names(d) == [d] else nc.read(d)).astype("f8") for d in self.coords}
        base = {d: lo if d == dims[0] and nc.dim_names(d) == [d] else 0 for d in self.coords}
        data = {v: nc.read(v, lo, hi) if dims else nc.read(v) for v in self.names}
        shape = data[self.names[0]].shape
        steps = max(1, (1 << 18) // max(1, math.prod(shape[1:])))
        for k in range(0, shape[0] if dims else 1, steps):
            part = {v: x[k : k + steps] if dims else x for v, x in data.items()}
            size = part[self.names[0]].shape
            at = np.indices(size).reshape(len(size), -1) if dims else np.zeros((0, 1), int)
            if dims:
                at[0] += lo + k
            out = {"path": [path] * at.shape[1]} | {f"{d}_idx": at[i].astype("i4") for i, d in enumerate(dims)}
            out |= {d: axes[d][at[dims.index(d)] - base[d]] for d in self.coords}
            yield pd.DataFrame(out | {("value" if self.alone else v): x.ravel().astype("f8" if kind == "double" else "i8") for (v, x), kind in zip(part.items(), self.kinds)})


def netcdf(spark: SparkSession, path, variable: str | None = None, variables=None) -> DataFrame:
    """path, <dim>_idx, <dim> coordinates and values: one `variable` as `value`, or several `variables` of the same dimensions (all, if
    none is named) as columns of their names. Raw CF times stay raw (decode with functions.times.cf_time); their units are column metadata.

    The driver reads headers only; a task reads one range of the leading axis. Files may differ in the lengths of axes, not in variables.
    """
    paths = objects.files(spark, path)
    first = open_file(paths[0])  # the schema comes from one header
    layout = Layout.of(first, variable, variables)
    plan = []
    for p in paths:
        nc = open_file(p)
        chosen(nc, layout.names)
        plan += [(p, lo, hi) for lo, hi in nc.pieces(layout.names[0])]

    def decode(batches):
        for pdf in batches:
            for path_, lo, hi in zip(pdf["file"], pdf["lo"].tolist(), pdf["hi"].tolist()):
                yield from layout.cells(open_file(path_), path_, lo, hi)

    dealt = spark.createDataFrame(plan, "file string, lo long, hi long").repartition(max(1, len(plan)), "file", "lo")
    out = objects.with_nan(dealt.mapInPandas(decode, layout.schema))
    for d in layout.coords:
        out = out.withMetadata(d, {k: v for k, v in first.vars[d][1].items() if k in ("units", "calendar")})
    return out


def time_length(spark: SparkSession, path, time_dim: str = "time") -> int:
    """How many records the files at `path` hold along the time dimension (from headers)."""
    return sum(nc.length(time_dim) for nc in map(open_file, objects.files(spark, path)))


def time_lengths(spark: SparkSession, path, time_dim: str = "time") -> DataFrame:
    """(path, n_records) of every file at `path`; the tasks read the headers."""

    def count(batches):
        for pdf in batches:
            yield pdf.assign(n_records=[open_file(p).length(time_dim) for p in pdf["path"]])

    paths = objects.files(spark, path)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(dealt_over(len(paths)), "path").mapInPandas(count, "path string, n_records long")


def dealt_over(files: int) -> int:
    """How many tasks share so many files of unknown length: one each, of very many some each."""
    return max(1, min(files, max(256, files // 32)))
