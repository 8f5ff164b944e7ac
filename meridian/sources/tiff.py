"""GeoTIFF files (classic and big; none, deflate, LZW; strips or tiles): the tags are read by byte ranges, each task decodes some rows of blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import objects
from .codecs import Unsupported
from .errors import NoSuchVariable

_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PIECE = 32 << 20  # decoded bytes of a task's rows


def _lzw(raw: bytes) -> bytes:
    out, table, bits, width, store, prev = bytearray(), [], 0, 9, 0, None
    for byte in raw:
        store = (store << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = store >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev is not None:
            table.append(prev + entry[:1])
        prev = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


class Tiff:
    """Tags of a file's first image. `fetch(offset, size)` gives bytes; a whole file may be given as bytes."""

    def __init__(self, source):
        self.fetch = source if callable(source) else lambda at, n: bytes(source[at : at + n])
        start = self.fetch(0, 16)
        end = self.end = {b"II": "<", b"MM": ">"}.get(start[:2])
        magic = struct.unpack_from(end + "H", start, 2)[0] if end else 0
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        # BigTIFF (43) has wider offsets, counts and entries
        word, number, room = ("Q", "Q", 8) if magic == 43 else ("I", "H", 4)
        at = struct.unpack_from(end + word, start, room)[0]
        entry = 4 + 2 * room
        count = struct.unpack(end + number, self.fetch(at, struct.calcsize(number)))[0]
        table = self.fetch(at + struct.calcsize(number), entry * count)
        tags = self.tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(end + "HH" + word, table, entry * k)
            form = _SIZES[kind]
            size = struct.calcsize(end + form) * n
            data = table[entry * k + 4 + room : entry * k + 4 + room + size]
            if size > room:
                data = self.fetch(struct.unpack_from(end + word, table, entry * k + 4 + room)[0], size)
            tags[tag] = data if kind == 2 else struct.unpack(end + form * n, data)
        self.width, self.height = tags[256][0], tags[257][0]
        self.bands, bits, self.how = tags.get(277, (1,))[0], tags.get(258, (1,))[0], tags.get(259, (1,))[0]
        self.kind = np.dtype({1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(bits // 8)).newbyteorder(end)
        if 34264 in tags:  # a whole affine matrix
            m = tags[34264]
            self.affine = (m[0], m[1], m[3], m[4], m[5], m[7])
        elif 33550 in tags and 33922 in tags:
            i0, j0, _, x0, y0, _ = tags[33922][:6]
            sx, sy = tags[33550][:2]
            self.affine = (sx, 0.0, x0 - i0 * sx, 0.0, -sy, y0 + j0 * sy)
        else:
            raise ValueError("no georeference (tags 33550 and 33922, or 34264)")
        keys = tags.get(34735, ())
        self.projected = any(keys[i] == 1024 and keys[i + 3] == 1 for i in range(4, len(keys) - 3, 4))
        self.tiled = 322 in tags
        self.block = (tags[323][0], tags[322][0]) if self.tiled else (tags.get(278, (self.height,))[0], self.width)
        self.sentinel = tags.get(42113, b"").strip(b"\0 ").decode()

    def centres(self, row, col):
        """x and y of cell centres."""
        a, b, c, d, e, f = self.affine
        return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f

    def pieces(self, size: int = PIECE) -> list[tuple[int, int]]:
        """Ranges of rows, whole blocks each, of about `size` decoded bytes."""
        step = self.block[0] * max(1, size // max(1, self.block[0] * self.width * self.bands * 8))
        return [(lo, min(self.height, lo + step)) for lo in range(0, self.height, step)]

    def rows(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """bands x rows x columns of rows lo..hi (lo at the start of a block) as doubles; the file's missing value becomes NaN."""
        hi = self.height if hi is None else hi
        planar = self.tags.get(284, (1,))[0] == 2
        per = 1 if planar else self.bands
        out = np.zeros((hi - lo, self.width, self.bands), self.kind.newbyteorder("="))
        tall, wide = self.block
        offsets, sizes = (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])
        across, down = -(-self.width // wide), -(-self.height // tall)
        for plane in range(self.bands if planar else 1):
            for row in range(lo // tall, -(-hi // tall)):
                for col in range(across):
                    k = (plane * down + row) * across + col
                    rows = tall if self.tiled else min(tall, self.height - row * tall)
                    got = self._block(offsets[k], sizes[k], rows, wide, per)
                    y, x = row * tall - lo, col * wide
                    h, w = min(rows, hi - lo - y), min(wide, self.width - x)
                    out[y : y + h, x : x + w, plane if planar else slice(None)] = got[:h, :w, 0] if planar else got[:h, :w]
        data = np.moveaxis(out, 2, 0).astype("f8")
        return np.where(data == float(self.sentinel), np.nan, data) if self.sentinel else data

    def _block(self, offset, size, rows, cols, per):
        plain = {1: lambda d: d, 8: zlib.decompress, 32946: zlib.decompress, 5: _lzw}.get(self.how)
        if plain is None:
            raise Unsupported(f"TIFF compression {self.how}")
        got = np.frombuffer(plain(self.fetch(offset, size)), self.kind, rows * cols * per).reshape(rows, cols, per)
        return np.cumsum(got, axis=1, dtype=self.kind) if self.tags.get(317, (1,))[0] == 2 else got


def read_tiff(raw: bytes):
    """(bands x rows x columns, x centres, y centres, projected) of a whole file on a regular grid."""
    t = Tiff(raw)
    return t.rows(), t.centres(0, np.arange(t.width))[0], t.centres(np.arange(t.height), 0)[1], t.projected


def open_file(path: str) -> Tiff:
    return Tiff(lambda at, n: objects.get_range(path, "", at, n))


def geotiff(spark: SparkSession, path, band_names: list[str] | None = None, variables=None) -> DataFrame:
    """path, row and column index, cell-centre coordinates (lat, lon or y, x) and one column per band (those of `variables`, else all).

    The driver reads tags only; a task reads the blocks of some rows.
    """
    paths = objects.files(spark, path)
    first = open_file(paths[0])
    names = band_names or [f"Band{k + 1}" for k in range(first.bands)]
    if len(names) != first.bands:
        raise ValueError(f"{len(names)} band names for {first.bands} bands")
    wanted = list(names) if variables is None else list(variables)
    if absent := set(wanted) - set(names):
        raise NoSuchVariable(absent, names)
    picked = [names.index(n) for n in wanted]
    y, x = ("y", "x") if first.projected else ("lat", "lon")
    plan = [(p, lo, hi) for p in paths for lo, hi in open_file(p).pieces()]

    def decode(batches):
        for pdf in batches:
            for path_, lo, hi in zip(pdf["file"], pdf["lo"].tolist(), pdf["hi"].tolist()):
                t = open_file(path_)
                bands = t.rows(lo, hi)
                steps = max(1, (1 << 18) // t.width)
                for k in range(0, hi - lo, steps):  # cells of a few rows at a time
                    part = bands[:, k : k + steps]
                    r, c = np.indices(part.shape[1:]).reshape(2, -1)
                    xs, ys = t.centres(r + lo + k, c)
                    yield pd.DataFrame({"path": path_, f"{y}_idx": (r + lo + k).astype("i4"), f"{x}_idx": c.astype("i4"), y: ys, x: xs} | {n: part[b].ravel() for n, b in zip(wanted, picked)})

    dealt = spark.createDataFrame(plan, "file string, lo long, hi long").repartition(max(1, len(plan)), "file", "lo")
    return objects.with_nan(dealt.mapInPandas(decode, f"path string, {y}_idx int, {x}_idx int, {y} double, {x} double, " + ", ".join(f"`{n}` double" for n in wanted)))
