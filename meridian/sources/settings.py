"""Settings from the environment, and named credentials, stores and writers."""

from __future__ import annotations

import os
from collections.abc import Mapping

from . import objects
from .codecs import Unsupported
from .errors import AuthError, NotRegistered, Offline
from .jobs import token_headers
from .registry import Registry

PREFIX = "MERIDIAN_"
TRUE = ("1", "true", "yes", "on")


def flag(name: str, environ: Mapping = os.environ) -> bool:
    """A switch such as OFFLINE or LIVE: 1, true, yes or on in any case."""
    return environ.get(PREFIX + name, "").strip().lower() in TRUE


def region(asked: str | None = None, environ: Mapping = os.environ) -> str:
    """The caller's region, else the engine's own variable, else the cloud's, else the default."""
    return asked or environ.get(PREFIX + "S3_REGION") or environ.get("AWS_REGION") or environ.get("AWS_DEFAULT_REGION") or "us-east-1"


def data_dir(environ: Mapping = os.environ) -> str:
    return environ.get(PREFIX + "DATADIR") or os.path.join(os.path.expanduser("~"), ".cache", "meridian")


def number(name: str, default: float, environ: Mapping = os.environ) -> float:
    """A knob such as HTTP_TRIES, HTTP_TIMEOUT_S, HTTP_BACKOFF_S or LOCK_STALE_S; what is no positive number is an error."""
    raw = environ.get(PREFIX + name, "").strip()
    try:
        value = float(raw) if raw else default
    except ValueError:
        value = -1.0
    if value <= 0:
        raise ValueError(f"{PREFIX}{name} must be a positive number: {raw!r}")
    return value


def online(environ: Mapping = os.environ) -> None:
    if flag("OFFLINE", environ):
        raise Offline(f"{PREFIX}OFFLINE is set")


def expand(url: str, environ: Mapping = os.environ) -> str:
    """`${DATADIR}` and `$DATADIR` (with the engine's prefix) in a file address replaced by the data folder."""
    for name in (PREFIX + "DATADIR", "DATADIR"):
        url = url.replace("${" + name + "}", data_dir(environ)).replace("$" + name, data_dir(environ))
    return url


class Realms:
    """Credentials by realm: a realm has a function that gives headers. An unknown realm is refused, never passed without credentials."""

    def __init__(self, **realms):
        self._realms = Registry("realm", cds=token_headers, **realms)

    def register(self, name: str, headers) -> None:
        """`headers` is a mapping (sent as it is) or a function without arguments that gives one."""
        self._realms.register(name, headers if callable(headers) else lambda fixed=dict(headers): fixed)

    def headers(self, realm: str | None) -> dict:
        if realm is None:
            return {}
        try:
            return dict(self._realms[realm]())
        except NotRegistered as e:
            raise AuthError(f"no credentials for realm {realm!r}; known: {list(self._realms)}") from e
        except OSError as e:
            raise AuthError(f"realm {realm!r}: {e}") from e

    def __iter__(self):
        return iter(self._realms)


REALMS = Realms()


class LocalStore:
    """Objects below a folder (or any base that `objects` opens): blobs by fan-out of their key."""

    def __init__(self, base: str):
        self.base = base

    def get(self, key: str) -> bytes | None:
        return objects.get(self.base, key)

    def put(self, key: str, data: bytes) -> None:
        objects.put(self.base, key, data)

    def exists(self, key: str) -> bool:
        return objects.exists(self.base, key)

    def delete(self, key: str) -> bool:
        return objects.delete(self.base, key)

    def blob(self, key: str) -> str | None:
        """Path of a key's blob whatever its extension: the first by name."""
        found = objects.list_prefix(self.base, f"blobs/{key[:2]}", key)
        return found[0] if found else None


def _writer(name):
    def make(*args, **options):
        if name == "zarr":
            from .zarr_sink import Writer

            return Writer(*args, **options)
        raise Unsupported(f"writer {name}")

    return make


STORES = Registry("store", local=LocalStore)
STORES.register("s3", status="stub", note="a cache in an object store is not written; objects reads and writes s3:// addresses")
WRITERS = Registry("writer", zarr=_writer("zarr"))
WRITERS.register("netcdf", status="stub", note="write Zarr instead")
