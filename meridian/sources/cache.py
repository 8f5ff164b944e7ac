"""A content-addressed cache of fetched objects, filled by a distributed job: one task per distinct key."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.order import durable
from . import objects, settings
from .errors import CacheMiss, FetchError, IntegrityError
from .jobs import JobError, JobService
from .registry import Registry

MANIFESTS = "schema string, url string, etag string, last_modified string, sha256_content string, bytes long, fetched_at string, source_loader string, auth_realm string"


@dataclass(frozen=True)
class Fetched:
    """status: "ok", "not_modified", "absent" (surely) or "unknown"; validators are those the server gave."""

    status: str
    data: object = None  # bytes, or an iterator of them
    etag: str | None = None
    last_modified: str | None = None


def _body(response, size: int = 1 << 20):
    """The body piece by piece; one that ends early is an error."""
    want, got = response.headers.get("Content-Length"), 0
    with response:
        while piece := response.read(size):
            got += len(piece)
            yield piece
    if want is not None and got != int(want):
        raise FetchError(f"{response.url}: {got} of {want} bytes", False)


@dataclass(frozen=True)
class Temporal:
    """How long an object stays fresh: for ever, or for a time to live. `columns` are those that `fetch` takes."""

    immutable: bool = True
    ttl_seconds: int | None = None

    @classmethod
    def static(cls) -> Temporal:
        """Never changes once fetched."""
        return cls()

    @classmethod
    def closed_period(cls) -> Temporal:
        """A period that is over: never changes either."""
        return cls()

    @classmethod
    def incomplete(cls, ttl) -> Temporal:
        """A period that still grows: fresh for `ttl` (seconds or a duration)."""
        return cls(False, int(ttl.total_seconds() if isinstance(ttl, datetime.timedelta) else ttl))

    def columns(self) -> dict:
        return {"immutable": F.lit(self.immutable), "ttl_seconds": F.lit(self.ttl_seconds).cast("long")}


def over_http(url: str, headers: dict, known: dict) -> Fetched:
    """GET; with known validators a conditional one. HTTP_TRIES, HTTP_BACKOFF_S and HTTP_TIMEOUT_S are settings; only what is neither there nor surely absent is tried again."""
    tries, wait = int(settings.number("HTTP_TRIES", 1)), settings.number("HTTP_BACKOFF_S", 1)
    for k in range(tries):
        got = _over_http(url, headers, known)
        if got.status != "unknown" or k + 1 == tries:
            return got
        time.sleep(min(10.0, wait * 2**k))
    return got


def _over_http(url: str, headers: dict, known: dict) -> Fetched:
    asks = {"If-None-Match": known.get("etag"), "If-Modified-Since": known.get("last_modified")}
    sent = headers | {k: v for k, v in asks.items() if v}
    try:
        r = urllib.request.urlopen(urllib.request.Request(url, headers=sent), timeout=settings.number("HTTP_TIMEOUT_S", 600))
        return Fetched("ok", _body(r), r.headers.get("ETag"), r.headers.get("Last-Modified"))
    except urllib.error.HTTPError as e:
        if e.code == 304 and any(asks.values()):
            return Fetched("not_modified", None, e.headers.get("ETag") or asks["If-None-Match"], e.headers.get("Last-Modified") or asks["If-Modified-Since"])
        return Fetched("absent" if e.code in (404, 410) else "unknown")
    except OSError:
        return Fetched("unknown")


def over_store(url: str, headers: dict, known: dict) -> Fetched:
    """Files (`${DATADIR}` is expanded) and object stores; these have no conditional read."""
    base, _, key = settings.expand(url).rpartition("/")
    try:
        got = objects.get(base, key)
    except OSError:
        return Fetched("unknown")
    return Fetched("absent") if got is None else Fetched("ok", got)


def over_jobs(url: str, headers: dict, known: dict) -> Fetched:
    """A job service with its default settings; register another `jobs.JobService` through `by_service`."""
    return by_service(JobService(headers=headers))(url, headers, known)


def by_service(service: JobService):
    def get(url: str, headers: dict, known: dict) -> Fetched:
        try:
            return Fetched("ok", service.retrieve(url))
        except JobError:
            return Fetched("unknown")

    return get


TRANSPORTS = Registry("transport", http=over_http, https=over_http, file=over_store, s3=over_store, gs=over_store, hdfs=over_store, cds=over_jobs)


FIELDS = {"schema": str, "url": str, "etag": (str, type(None)), "last_modified": (str, type(None)), "sha256_content": str, "bytes": int, "fetched_at": str, "source_loader": (str, type(None)), "auth_realm": (str, type(None))}


def check_manifest(record: dict) -> None:
    """A manifest has these fields only, of these types, a SHA-256 and a time; anything else is refused before it is written."""
    if set(record) - set(FIELDS) or {"schema", "url", "sha256_content", "bytes", "fetched_at"} - set(record):
        raise ValueError(f"manifest fields {sorted(record)}")
    if bad := [k for k, v in record.items() if not isinstance(v, FIELDS[k])]:
        raise ValueError(f"manifest fields of another type: {bad}")
    if record["schema"] != "manifest/v1" or not re.fullmatch("[0-9a-f]{64}", record["sha256_content"]) or record["bytes"] < 0 or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", record["fetched_at"]):
        raise ValueError(f"no manifest: {record}")


@contextlib.contextmanager
def locked(root: str, key: str, stale_seconds: float | None = None, poll_seconds: float = 0.05):
    """Hold a key of the cache: an exclusive file on local and shared disks; one left behind is taken over once it is stale. Other stores have none."""
    system, base = objects.open_base(root)
    if not isinstance(system, fs.LocalFileSystem):
        yield
        return
    stale_seconds = stale_seconds or settings.number("LOCK_STALE_S", 3600)
    path = f"{base}/locks/{key}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            with contextlib.suppress(FileNotFoundError):
                if time.time() - os.stat(path).st_mtime > stale_seconds:
                    os.unlink(path)
            time.sleep(poll_seconds)
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests, with their key."""
    try:
        got = spark.read.schema(MANIFESTS).json(f"{root}/meta/*.json")
    except Exception as e:  # Spark names a missing path only by its message
        if "PATH_NOT_FOUND" not in str(e):
            raise
        got = spark.createDataFrame([], MANIFESTS)
    return got.withColumn("key", keys.cache_key(F.col("url")))


def through(url: str, root: str, headers: dict | None = None) -> str | None:
    """Path in the cache of one object, fetched by the calling task if it is not held; None if it surely does not exist."""
    key = hashlib.sha256(url.encode()).hexdigest()
    stem = url.rpartition("/")[2]
    ext = m[1].lower() if (m := re.search(r"[^/]\.([A-Za-z0-9]{1,8})$", stem)) else ""
    path = f"blobs/{key[:2]}/{key}" + (f".{ext}" if ext else "")
    if objects.exists(root, path):
        return path
    got = TRANSPORTS.implemented().get(url.partition("://")[0].lower(), over_store)(url, headers or {}, {})
    if got.status == "absent":
        return None
    if got.status != "ok":
        raise FetchError(f"{url}: {got.status}", False)
    _commit(root, key, url, got, *objects.put_stream(root, path, [got.data] if isinstance(got.data, bytes) else got.data), None, None)
    return path


def _commit(root, key, url, got, sha, size, loader, realm) -> None:
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    record = {"schema": "manifest/v1", "url": url, "etag": got.etag, "last_modified": got.last_modified, "sha256_content": sha, "bytes": size, "fetched_at": now, "source_loader": loader, "auth_realm": realm}
    check_manifest(record)
    objects.put(root, f"meta/{key}.json", json.dumps(record, sort_keys=True).encode())


FETCHED = "key string, url string, status string, path string"
OPTIONAL = {"mirrors": "array<string>", "expected_sha": "string", "immutable": "boolean", "ttl_seconds": "long"}


def fetch(urls: DataFrame, root: str, offline: bool | None = None, headers: dict | None = None, realm: str | None = None, transports: dict | None = None, loader: str | None = None, verify_on_read: bool = False) -> DataFrame:
    """Bring every url into the cache; returns (key, url, status, path) with status hit, not_modified or downloaded.

    Beside `url`, `urls` may have the columns of OPTIONAL; an address counts as immutable unless it says otherwise. What is held
    is judged by `keys.freshness`: hits are not asked for; objects with validators are asked for conditionally; the rest is
    fetched, from the address or its mirrors in order, by exactly one task a key. A validator whose object is gone is not
    trusted: the object is fetched again. A digest other than the expected one raises IntegrityError and nothing is stored.
    A task locks a key while it fetches and looks again once it has the lock, so several jobs at once download an object once.
    With `verify_on_read`, hits are held against their manifests first; a difference raises IntegrityError.
    Credentials are those given as `headers`, else those of the `realm` (an unknown one is refused). Offline (by default as the setting says),
    what is held (with or without a manifest) is a hit and missing keys raise CacheMiss.
    """
    spark = urls.sparkSession
    offline = settings.flag("OFFLINE") if offline is None else offline
    headers = (settings.REALMS.headers(realm) if realm and headers is None else headers) or {}
    for name, kind in OPTIONAL.items():
        if name not in urls.columns:
            urls = urls.withColumn(name, F.lit(None).cast(kind))
    path = keys.blob_path(F.col("key"), keys.ext_of(F.col("url")))
    asked = urls.select("url", *OPTIONAL).withColumn("key", keys.cache_key(F.col("url"))).withColumn("path", path).dropDuplicates(["key"])
    held = manifests(spark, root).select("key", "etag", "last_modified", "sha256_content", F.try_to_timestamp("fetched_at").alias("fetched")).dropDuplicates(["key"])
    known = F.coalesce("etag", "last_modified").isNotNull()
    verdict = keys.freshness(F.coalesce("immutable", F.lit(True)), F.col("expected_sha"), F.col("sha256_content"), known, F.col("fetched"), F.col("ttl_seconds"), F.current_timestamp())
    judged = durable(asked.join(held, "key", "left").withColumn("verdict", F.when(F.col("sha256_content").isNotNull(), F.lit("hit")).otherwise(F.lit("miss")) if offline else verdict))
    hits = judged.where("verdict = 'hit'").select("key", "url", F.lit("hit").alias("status"), "path")
    missing = judged.where("verdict <> 'hit'").select("key", "url", "mirrors", "path", "expected_sha", "sha256_content", "etag", "last_modified", "verdict")
    served = TRANSPORTS.implemented() | (transports or {})

    def bring(r) -> str:
        with locked(root, r.key):
            if r.verdict == "miss" and not isinstance(r.expected_sha, str) and not isinstance(r.sha256_content, str) and objects.exists(root, f"meta/{r.key}.json") and objects.exists(root, r.path):
                return "hit"  # another job brought it in the meantime
            return load(r)

    def load(r) -> str:
        outcomes = []
        for k, candidate in enumerate([r.url, *(r.mirrors if r.mirrors is not None else [])]):
            ask = served.get(candidate.partition("://")[0].lower(), over_store)
            validators = {n: v for n in ("etag", "last_modified") if isinstance(v := getattr(r, n), str)}
            mine = validators if k == 0 and r.verdict == "revalidate" and objects.exists(root, r.path) else {}
            got = ask(candidate, headers or {}, mine)
            outcomes.append(got.status)
            if got.status in ("ok", "not_modified"):
                break
        else:
            raise FetchError(f"{r.url}: {outcomes}", all(o == "absent" for o in outcomes))
        if got.status == "ok":
            def check(sha):
                if isinstance(r.expected_sha, str) and sha != r.expected_sha.lower():
                    raise IntegrityError(f"{r.url}: digest {sha}, expected {r.expected_sha}")

            sha, size = objects.put_stream(root, r.path, [got.data] if isinstance(got.data, bytes) else got.data, check)
        else:
            sha, size = r.sha256_content, objects.size(root, r.path)
        _commit(root, r.key, r.url, got, sha, size, loader, realm)
        return "downloaded" if got.status == "ok" else got.status

    def run(batches):
        for pdf in batches:
            did = [(("hit" if objects.exists(root, r.path) else "miss") if offline else bring(r)) for r in pdf.itertuples(index=False)]
            yield pdf[["key", "url"]].assign(status=did, path=pdf["path"])

    loaded = missing.repartition(_tasks(missing.count()), "key").mapInPandas(run, "key string, url string, status string, path string")
    out = hits.unionByName(loaded)
    if verify_on_read and (bad := [r["key"] for r in verify(spark, root, hits.select("key", "path")).where("not ok").limit(5).collect()]):
        raise IntegrityError(f"objects that differ from their manifests: {bad}")
    done = durable(out)  # the job runs once, here
    if lost := [f"{r['url']} ({r['key']})" for r in done.where("status = 'miss'").limit(5).collect()]:
        raise CacheMiss(", ".join(lost))
    return done


def _tasks(objects_: int) -> int:
    """How many tasks bring so many objects: rows of addresses are small, so a shuffle left to itself would give most of them to one."""
    return max(1, min(-(-objects_ // 64), max(256, objects_ // 1024)))


def verify(spark: SparkSession, root: str, held: DataFrame | None = None) -> DataFrame:
    """(key, ok, bytes) of every cached object: size and digest against its manifest, and the size that this gives.

    With `held` (key and path, as `fetch` gives them) of those only, and manifests are not listed; one without a manifest is not ok.
    Each object is looked up by the task that holds its key.
    """
    if held is None:
        held = manifests(spark, root).select("key", keys.blob_path(F.col("key"), keys.ext_of(F.col("url"))).alias("path"))
    return held.select("key", "path").mapInPandas(lambda batches: (_inspected(root, pdf) for pdf in batches), "key string, ok boolean, bytes long")


def _inspected(root: str, pdf: pd.DataFrame) -> pd.DataFrame:
    ok, sizes = [], []
    for key, path in zip(pdf["key"], pdf["path"]):
        try:
            record = json.loads((objects.get(root, f"meta/{key}.json") if isinstance(key, str) else None) or b"{}")  # a manifest that cannot be read has no key
        except ValueError:
            record = {}
        mine = isinstance(record, dict) and isinstance(record.get("url"), str) and hashlib.sha256(record["url"].encode()).hexdigest() == key
        size = record.get("bytes") if mine else None
        sizes.append(size if isinstance(size, int) else None)
        ok.append(mine and objects.digest(root, path) == (record.get("sha256_content"), size))
    return pd.DataFrame({"key": pdf["key"], "ok": ok, "bytes": pd.array(sizes, "Int64")})


def check(spark: SparkSession, root: str) -> None:
    bad = [r["key"] for r in verify(spark, root).where("not ok").limit(5).collect()]
    if bad:
        raise IntegrityError(f"objects that differ from their manifests: {bad}")
