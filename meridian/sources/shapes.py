"""Shapefiles, bare or in a zip: one row per part, with the record's counts, box and attributes. One task decodes one file."""

from __future__ import annotations

import io
import math
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import shape_type_name
from . import objects
from .codecs import Unsupported
from .errors import NoSuchVariable

RESERVED = ("index", "geometry", "n_vertices", "shape_index", "part_index", "n_parts", "xmin", "ymin", "xmax", "ymax", "shape_type", "crs_wkt")


def read_shapes(raw: bytes):
    """(type code, bounding box, parts) of each record of a .shp; a null shape has one empty part."""
    at, out = 100, []
    while at + 8 <= len(raw):
        size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", body)[0]
        if kind == 0:
            out.append((kind, [math.nan] * 4, [np.zeros((0, 2))]))
        elif kind % 10 == 1:
            x, y = struct.unpack_from("<2d", body, 4)
            out.append((kind, [x, y, x, y], [np.array([[x, y]])]))
        else:
            box = list(struct.unpack_from("<4d", body, 4))
            if kind % 10 == 8:
                n = struct.unpack_from("<i", body, 36)[0]
                out.append((kind, box, [np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2)]))
            elif kind % 10 in (3, 5):
                n_parts, n = struct.unpack_from("<2i", body, 36)
                starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
                points = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
                out.append((kind, box, [points[a:b] for a, b in zip(starts, starts[1:])]))
            else:
                raise Unsupported(f"shape type {kind}")
    return out


def read_dbf(raw: bytes, numeric_columns=(), only_head: bool = False):
    """(column kinds, live flags, rows) of a .dbf; only an asterisk marks a deleted row."""
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    cols, at, spot = [], 32, 1
    while raw[at] != 13:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        cols.append((name, chr(raw[at + 11]), spot, raw[at + 16]))
        spot += raw[at + 16]
        at += 32
    if bad := set(numeric_columns) - {c[0] for c in cols}:
        raise NoSuchVariable(bad, [c[0] for c in cols])
    kinds = {c: "double" if t in "NFOI+" or c in numeric_columns else "boolean" if t == "L" else "string" for c, t, _, _ in cols}

    if only_head:
        return kinds, [], []

    def cell(raw_, kind, name):
        if kind in "OI+":
            return float(struct.unpack({"O": "<d", "I": "<i", "+": "<i"}[kind], raw_)[0])
        text = raw_.decode("utf-8", "replace").strip(" \0")
        if kinds[name] == "double":
            try:
                return float(text)
            except ValueError:
                return math.nan
        return text.upper() in ("T", "Y") if kind == "L" else text

    live, rows = [], []
    for k in range(n):
        row = raw[head + k * size : head + (k + 1) * size]
        live.append(row[:1] != b"*")
        rows.append([cell(row[s : s + w], t, c) for c, t, s, w in cols])
    return kinds, live, rows


def _members(name: str, z: zipfile.ZipFile, member: str | None) -> dict[str, str]:
    """extension -> name of the layer's members: one .shp, chosen or alone, and what shares its stem in any case."""
    shapes = [n for n in z.namelist() if n.lower().endswith(".shp")]
    if member is None and len(shapes) != 1 or member is not None and member not in shapes:
        raise ValueError(f"{name}: choose one .shp member of {shapes}")
    stem = (member or shapes[0])[:-4].lower()
    return {n[len(stem) + 1 :].lower(): n for n in z.namelist() if n.lower().startswith(stem + ".")}


def _layer(name: str, raw: bytes, member: str | None) -> dict[str, bytes]:
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        return {"shp": raw}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return {ext: z.read(n) for ext, n in _members(name, z, member).items()}


def columns(path: str, member: str | None = None, numeric_columns=()) -> dict[str, str]:
    """Attribute columns and their types, from the head of the layer's table only."""
    with objects.open_input(path) as f:
        if f.read(4) != b"PK\x03\x04":
            return {}
        f.seek(0)
        with zipfile.ZipFile(f) as z:
            found = _members(path, z, member)
            if "dbf" not in found:
                return {}
            with z.open(found["dbf"]) as table:
                head = table.read(32)
                head += table.read(struct.unpack_from("<H", head, 8)[0] - 32)
    return read_dbf(head, numeric_columns, only_head=True)[0]


def shapefile(spark: SparkSession, path, member: str | None = None, numeric_columns=(), nvert_max: int | None = None, variables=None) -> DataFrame:
    """One row per part: geometry (rings padded by their last vertex to the layer's longest or nvert_max), counts, box, attributes.

    Attributes are placed by name; a file whose columns differ from the first one's is an error. `variables` keeps those attributes only.
    """
    kinds = columns(objects.files(spark, path)[0], member, numeric_columns)
    if clash := sorted(set(kinds) & set(RESERVED)):
        raise ValueError(f"attribute columns with reserved names: {clash}")
    if absent := set(variables or []) - {*kinds, *RESERVED}:
        raise NoSuchVariable(absent, [*kinds, *RESERVED])

    def decode(batches):
        for pdf in batches:
            for path_, raw in zip(pdf["path"], pdf["content"]):
                files = _layer(path_, bytes(raw), member)
                shapes = read_shapes(files["shp"])
                live, rows, own = [True] * len(shapes), [[]] * len(shapes), {}
                if "dbf" in files:
                    own, live, rows = read_dbf(files["dbf"], numeric_columns)
                if own != kinds:
                    raise ValueError(f"{path_}: attribute columns {own}, in the first file {kinds}")
                if len(live) != len(shapes):
                    raise ValueError(f"{path_}: {len(shapes)} shapes, {len(live)} attribute rows")
                place = [list(own).index(c) for c in kinds]
                kept = [(s, [r[k] for k in place]) for s, r, ok in zip(shapes, rows, live) if ok]
                longest = max([len(p) for (_, _, parts), _ in kept for p in parts] + [1])
                size = nvert_max or longest
                if longest > size:
                    raise ValueError(f"{path_}: a part has {longest} vertices, more than {size}")
                kind = next((k for k, _, _ in shapes if k), 0)
                crs = files.get("prj", b"").decode("utf-8", "replace")
                out = []
                for shape, ((_, box, parts), row) in enumerate(kept):
                    for k, p in enumerate(parts):
                        full = np.vstack([p, np.repeat(p[-1:], size - len(p), 0)]) if len(p) else np.full((size, 2), np.nan)
                        out.append([path_, len(out), full.tolist(), len(p), shape, k, len(parts), *box, kind, crs, *row])
                yield pd.DataFrame(out, columns=["path", "index", "geometry", "n_vertices", "shape_index", "part_index", "n_parts", "xmin", "ymin", "xmax", "ymax", "type_code", "crs_wkt", *kinds])

    schema = "path string, index long, geometry array<array<double>>, n_vertices int, shape_index int, part_index int, n_parts int, xmin double, ymin double, xmax double, ymax double, type_code int, crs_wkt string"
    df = objects.contents(spark, path).mapInPandas(decode, schema + "".join(f", `{c}` {t}" for c, t in kinds.items()))
    out = objects.with_nan(df.withColumn("shape_type", shape_type_name(F.col("type_code"))).drop("type_code"))
    return out if variables is None else out.select("path", "index", *[F.col(f"`{v}`") for v in variables if v not in ("path", "index")])
