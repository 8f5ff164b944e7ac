"""Encoders of small files in the formats that the engine reads. Queries and tests write tables with them, one file a group of rows, and read them back."""

from __future__ import annotations

import io
import itertools
import math
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import objects

_NC = {"i1": 1, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6}


def _nc_name(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _nc_attrs(attrs: dict, kind: str) -> bytes:
    out = struct.pack(">ii", 12 if attrs else 0, len(attrs))
    for n, v in attrs.items():
        if isinstance(v, str):
            raw, code, count = v.encode(), 2, len(v.encode())
        else:
            own = kind if n == "_FillValue" else ">f8"
            raw, code, count = np.array([v], own).tobytes(), _NC[own], 1
        out += _nc_name(n) + struct.pack(">ii", code, count) + raw + b"\0" * (-len(raw) % 4)
    return out


def netcdf(dims: dict[str, int], variables: dict[str, tuple]) -> bytes:
    """A classic file with 64-bit offsets. dims: name -> length, 0 for the record dimension; variables: name -> (dims, big-endian array, attributes)."""
    order = list(dims)
    records = max([len(a) for d, a, _ in variables.values() if d and dims[d[0]] == 0] + [0])
    growing = [n for n, (d, _, _) in variables.items() if d and dims[d[0]] == 0]
    head = b"CDF\x02" + struct.pack(">i", records) + struct.pack(">ii", 10, len(dims)) + b"".join(_nc_name(n) + struct.pack(">i", k) for n, k in dims.items()) + struct.pack(">ii", 0, 0)

    def widths(n):
        d, a, _ = variables[n]
        return a.nbytes // max(1, len(a)) if n in growing else a.nbytes

    size = {n: widths(n) + (-widths(n) % 4) for n in variables}

    def table(offsets):
        out = struct.pack(">ii", 11, len(variables))
        for n, (d, a, attrs) in variables.items():
            out += _nc_name(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", order.index(x)) for x in d) + _nc_attrs(attrs, a.dtype.str) + struct.pack(">iiq", _NC[a.dtype.str.replace("|", "")], size[n], offsets[n])
        return out

    at = len(head) + len(table(dict.fromkeys(variables, 0)))
    offsets = {}
    for n in [n for n in variables if n not in growing] + growing:
        offsets[n] = at
        at += size[n]
    body = b"".join(a.tobytes() + b"\0" * (size[n] - a.nbytes) for n, (_, a, _) in variables.items() if n not in growing)
    if len(growing) == 1:  # its records follow each other without padding
        body += variables[growing[0]][1].tobytes()
    else:
        table_ = np.zeros((records, sum(size[n] for n in growing)), "u1")
        left = 0
        for n in growing if records else []:
            a = np.ascontiguousarray(variables[n][1]).reshape(records, -1)
            table_[:, left : left + widths(n)] = a.view("u1")
            left += size[n]
        body += table_.tobytes()
    return head + table(offsets) + body


def tiff(bands: np.ndarray, x0: float, y0: float, sx: float, sy: float, nodata: str = "", rows_per_strip: int = 64) -> bytes:
    """A little-endian GeoTIFF of doubles, bands x rows x columns, deflated strips; (x0, y0) is the outer corner of the first cell."""
    n, height, width = bands.shape
    strips = [zlib.compress(np.ascontiguousarray(np.moveaxis(bands[:, r : r + rows_per_strip], 0, 2)).astype("<f8").tobytes()) for r in range(0, height, rows_per_strip)]
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [64]), (259, "H", [8]), (277, "H", [n]), (278, "I", [rows_per_strip]), (284, "H", [1]), (339, "H", [3])]
    tags += [(273, "I", [0] * len(strips)), (279, "I", [len(s) for s in strips]), (33550, "d", [sx, sy, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x0, y0, 0.0]), (34735, "H", [1, 1, 0, 1, 1024, 0, 1, 2])]
    if nodata:
        tags.append((42113, "s", nodata.encode() + b"\0"))
    tags.sort()
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    table, room, spill = 8, 2 + 12 * len(tags) + 4, b""
    first = table + room
    sizes = {t: len(v) if k == "s" else struct.calcsize(f"<{len(v)}{k}") for t, k, v in tags}
    data_at = first + sum(s + (s & 1) for s in sizes.values() if s > 4)
    starts = list(itertools.accumulate([data_at, *map(len, strips[:-1])]))
    out = struct.pack("<H", len(tags))
    for t, k, v in tags:
        v = starts if t == 273 else v
        raw = v if k == "s" else struct.pack(f"<{len(v)}{k}", *v)
        if len(raw) > 4:
            out += struct.pack("<HHII", t, kinds[k], len(v), first + len(spill))
            spill += raw + b"\0" * (len(raw) & 1)
        else:
            out += struct.pack("<HHI", t, kinds[k], len(v)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, table) + out + b"\0" * 4 + spill + b"".join(strips)


def shapefile_zip(shapes: list[list[list[tuple]]], columns: list[tuple], rows: list[list[str]], deleted: list[bool], member: str = "layer") -> bytes:
    """A zip of polygons (parts of rings), a table with (name, kind, width) columns and its flags of deletion."""
    bodies = []
    for parts in shapes:
        points = [p for ring in parts for p in ring]
        starts = list(itertools.accumulate([0, *map(len, parts[:-1])]))
        xs, ys = zip(*points)
        bodies.append(struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points))
    shp = b"\0" * 100 + b"".join(struct.pack(">2i", k + 1, len(b) // 2) + b for k, b in enumerate(bodies))
    width = 1 + sum(w for _, _, w in columns)
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(columns), width)
    dbf += b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in columns) + b"\r"
    dbf += b"".join((b"*" if gone else b" ") + b"".join(str(v).encode().ljust(w)[:w] for v, (_, _, w) in zip(row, columns)) for row, gone in zip(rows, deleted))
    return zipped({f"{member}.shp": shp, f"{member}.dbf": dbf, f"{member}.prj": b"WKT"})


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in members.items():
            z.writestr(name, raw)
    return out.getvalue()


def write_groups(df: DataFrame, by: str, folder: str, ext: str, encode, count: bool = True) -> str:
    """One file a group of rows (of a bounded size: `by` deals them), named by the group and written by its task; the folder."""

    def save(pdf):
        group = pdf[by].iloc[0]
        objects.put(folder, f"{group}.{ext}", encode(pdf))
        return pdf[[by]].iloc[:1].astype(str)

    df.groupBy(by).applyInPandas(save, f"`{by}` string").agg(F.count("*")).collect()  # a single row
    return folder


def rows_of(pdf, column: str) -> np.ndarray:
    """A list column as a matrix."""
    return np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, 0))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null, to compare with tables."""
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit(math.nan)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
