"""Objects by address: local paths, file:// and what pyarrow's file systems open (s3, gs, hdfs). Absence is told from failure."""

from __future__ import annotations

import hashlib
import os
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_base(base: str) -> tuple[fs.FileSystem, str]:
    if "://" not in base:
        return fs.LocalFileSystem(), os.path.abspath(base.removeprefix("file:"))
    if base.startswith("file://"):
        return fs.LocalFileSystem(), base[len("file://") :]
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", base))


def get(base: str, key: str) -> bytes | None:
    """The object's bytes; None only if it surely is not there."""
    system, root = open_base(base)
    path = f"{root}/{key}" if key else root
    try:
        with system.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def size(base: str, key: str) -> int | None:
    """The object's size in bytes; None if it is not there."""
    system, root = open_base(base)
    info = system.get_file_info(f"{root}/{key}" if key else root)
    return info.size if info.type == fs.FileType.File else None


def exists(base: str, key: str) -> bool:
    return size(base, key) is not None


def get_range(base: str, key: str, start: int, size: int) -> bytes:
    system, root = open_base(base)
    with system.open_input_file(f"{root}/{key}" if key else root) as f:
        return f.read_at(size, start if start >= 0 else f.size() + start)


def put(base: str, key: str, data: bytes) -> None:
    """Write under a temporary name, then move into place."""
    system, root = open_base(base)
    path = f"{root}/{key}"
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, path)


def put_stream(base: str, key: str, pieces, check=None) -> tuple[str, int]:
    """Write pieces of bytes under a temporary name, then move into place: (SHA-256, size). `check(sha)` may raise; then nothing is left."""
    system, root = open_base(base)
    path = f"{root}/{key}"
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    sha, size = hashlib.sha256(), 0
    try:
        with system.open_output_stream(temporary) as f:
            for piece in pieces:
                sha.update(piece)
                size += len(piece)
                f.write(piece)
        if check:
            check(sha.hexdigest())
    except BaseException:
        system.delete_file(temporary)
        raise
    system.move(temporary, path)
    return sha.hexdigest(), size


def digest(base: str, key: str) -> tuple[str, int] | None:
    """(SHA-256, size) of an object, read piece by piece; None if it is not there."""
    system, root = open_base(base)
    sha, size = hashlib.sha256(), 0
    try:
        with system.open_input_stream(f"{root}/{key}") as f:
            while piece := f.read(1 << 20):
                sha.update(piece)
                size += len(piece)
    except FileNotFoundError:
        return None
    return sha.hexdigest(), size


def delete(base: str, key: str) -> bool:
    """Remove an object; whether it was there."""
    system, root = open_base(base)
    try:
        system.delete_file(f"{root}/{key}")
        return True
    except FileNotFoundError:
        return False


def list_prefix(base: str, folder: str, prefix: str) -> list[str]:
    """Keys in a folder whose names begin with the prefix, in order."""
    system, root = open_base(base)
    found = system.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name.startswith(prefix))


def open_input(path: str):
    """A file to read and seek in."""
    system, root = open_base(path)
    return system.open_input_file(root)


def files(spark: SparkSession, path) -> list[str]:
    """The files at a path, a folder or a glob, as Spark lists them, in order; contents are not read."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def contents(spark: SparkSession, path) -> DataFrame:
    """(path, content) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def with_nan(df: DataFrame) -> DataFrame:
    """Missing numbers are NaN in these formats; the way through pandas makes them null."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
