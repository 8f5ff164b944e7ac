"""Chunk codecs: the blosc container (byte and bit shuffle; lz4, zstd, zlib inside), zstd, gzip, zlib, crc32c. Pure numpy and library calls."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np

from .errors import MeridianError


class Unsupported(MeridianError, NotImplementedError):
    """A codec, type or layout this engine does not read or write."""


def _inner(kind: int, raw: bytes, size: int) -> bytes:
    if kind == 1:
        import pyarrow as pa

        return pa.Codec("lz4_raw").decompress(raw, size).to_pybytes()
    if kind == 3:
        return zlib.decompress(raw)
    if kind == 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    raise Unsupported(f"blosc inner codec {kind}")


def unshuffle(raw: bytes, width: int) -> bytes:
    n = len(raw) // width
    body = np.frombuffer(raw[: n * width], np.uint8).reshape(width, n).T.tobytes()
    return body + raw[n * width :]


def shuffle(raw: bytes, width: int) -> bytes:
    n = len(raw) // width
    return np.frombuffer(raw[: n * width], np.uint8).reshape(n, width).T.tobytes() + raw[n * width :]


def unshuffle_bits(raw: bytes, width: int) -> bytes:
    """Undo a bit shuffle. It moves whole groups of eight elements only; other blocks are stored as they are."""
    n = len(raw) // width
    if not n or n % 8:
        return raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n * width), bitorder="little").reshape(width * 8, n)
    return np.packbits(bits.T, bitorder="little").tobytes() + raw[n * width :]


def shuffle_bits(raw: bytes, width: int) -> bytes:
    n = len(raw) // width
    if not n or n % 8:
        return raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n * width), bitorder="little").reshape(n, width * 8)
    return np.packbits(bits.T, bitorder="little").tobytes() + raw[n * width :]


def blosc_decode(raw: bytes) -> bytes:
    """A blosc 1 frame: 16-byte header, block offsets, per block one stream or one per byte of the type."""
    _, _, flags, width, size, block, total = struct.unpack("<BBBBIII", raw[:16])
    if flags & 2:  # stored as it is
        return raw[16 : 16 + size]
    if not size:
        return b""
    count = -(-size // block)
    starts = struct.unpack(f"<{count}I", raw[16 : 16 + 4 * count])
    kind, out = flags >> 5, []
    for k, at in enumerate(starts):
        length = min(block, size - k * block)
        whole = length == block
        streams = width if not flags & 16 and whole and 1 < width <= 16 and block // width >= 128 else 1
        parts = []
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", raw, at)
            piece = raw[at + 4 : at + 4 + n]
            want = length // streams
            parts.append(piece if n == want else _inner(kind, piece, want))
            at += 4 + n
        data = b"".join(parts)
        if flags & 4:
            data = unshuffle_bits(data, width)
        out.append(unshuffle(data, width) if flags & 1 and width > 1 else data)
    return b"".join(out)


def blosc_encode(raw: bytes, width: int, level: int = 5) -> bytes:
    """One block, byte shuffled, zstd inside; stored as it is where that is smaller."""
    import zstandard

    data = shuffle(raw, width) if width > 1 else raw
    packed = zstandard.ZstdCompressor(level=level).compress(data)
    if len(packed) + 24 >= len(raw) + 16 or not raw:
        return struct.pack("<BBBBIII", 2, 1, 0x80 | 0x10 | 2, width, len(raw), max(len(raw), 1), len(raw) + 16) + raw
    flags = 0x80 | 0x10 | (1 if width > 1 else 0)
    body = struct.pack("<I", 20) + struct.pack("<i", len(packed)) + packed
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(raw), len(raw), len(body) + 16) + body


_CRC_POLY = 0x82F63B78


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_CRC_POLY), t >> 1)
    return t


_CRC = [int(x) for x in _crc_table()]


def crc32c(raw: bytes) -> int:
    c = 0xFFFFFFFF
    for b in raw:
        c = _CRC[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def decode(name: str | None, raw: bytes) -> bytes:
    if name in (None, "bytes"):
        return raw
    if name == "blosc":
        return blosc_decode(raw)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if name == "zlib":
        return zlib.decompress(raw)
    if name == "gzip":
        return gzip.decompress(raw)
    if name == "crc32c":
        if crc32c(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a checksum does not hold")
        return raw[:-4]
    raise Unsupported(f"codec {name}")


PROFILES = {"diagnostic": ("blosc", 5), "checkpoint": ("blosc", 7), "wasm": ("zstd", 5)}


def encode(profile: str, raw: bytes, width: int) -> bytes:
    name, level = PROFILES[profile]
    if name == "blosc":
        return blosc_encode(raw, width, level)
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)
