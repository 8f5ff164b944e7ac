"""Column builders for keys, addresses, paths and manifests of cached objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(url: Column, first=None, last=None) -> Column:
    """SHA-256 (hex) of the address as it stands; a byte range is part of the key."""
    if first is not None:
        url = F.concat(url, F.lit("#bytes="), F.lit(first).cast("string"), F.lit("-"), F.lit(last).cast("string"))
    return F.sha2(url.cast("binary"), 256)


def scheme_of(url: Column, strict: bool = False) -> Column:
    """The lower-case scheme; null if the address has none, or an error if `strict`."""
    found = F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit(""))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no scheme: "), url)).cast("string")) if strict else found


def ext_of(url: Column) -> Column:
    """The extension of the last path segment (1 to 8 letters or digits after a non-empty stem), else empty."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]{1,8})$", 1))


def blob_path(key: Column, ext: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(key, 1, 2), F.lit("/"), key, F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext)))


def manifest_path(key: Column) -> Column:
    return F.concat(F.lit("meta/"), key, F.lit(".json"))


def expand_variable(text: Column, name: str, value: str) -> Column:
    """`${NAME}` and `$NAME` replaced by a value."""
    return F.replace(F.replace(text, F.lit("${" + name + "}"), F.lit(value)), F.lit("$" + name), F.lit(value))


def s3_bucket(url: Column) -> Column:
    return F.regexp_extract(url, r"^s3://([^/]+)", 1)


def s3_object(url: Column) -> Column:
    return F.regexp_extract(url, r"^s3://[^/]+/(.*)$", 1)


def s3_https(url: Column, region: str) -> Column:
    """The regional virtual-host address of an s3:// object; other addresses stay."""
    return F.when(url.startswith("s3://"), F.concat(F.lit("https://"), s3_bucket(url), F.lit(f".s3.{region}.amazonaws.com/"), s3_object(url))).otherwise(url)


def job_url(dataset: str, request: Column) -> Column:
    """`cds://<dataset>?<JSON>`; the request struct's fields must be in order of their names."""
    return F.concat(F.lit(f"cds://{dataset}?"), F.to_json(request))


def job_dataset(url: Column) -> Column:
    return F.regexp_extract(url, r"^cds://([^?]+)\?", 1)


def job_request(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^cds://[^?]+\?(.*)$", 1)


def glob_regex(pattern: str) -> str:
    """A regular expression for a case-sensitive glob of * ? [..] [!..]; an unclosed bracket is literal."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) >= 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end + 1
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
    return "(?s)^" + out + "$"


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


MANIFEST = ("schema", "url", "etag", "last_modified", "sha256_content", "bytes", "fetched_at", "source_loader", "auth_realm")


def manifest_json(**fields: Column) -> Column:
    """A manifest record as JSON, keys sorted, missing values as null."""
    return F.to_json(F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in sorted(MANIFEST)]), {"ignoreNullFields": "false"})


def freshness(immutable: Column, expected_sha: Column, sha: Column, has_validator: Column, fetched: Column, ttl_seconds: Column, now: Column) -> Column:
    """The first rule that holds: no copy, pinned checksum, immutable, validators to ask with, time to live."""
    young = F.coalesce(F.unix_micros(now) - F.unix_micros(fetched) <= ttl_seconds.cast("long") * 1_000_000, F.lit(False))
    return (
        F.when(sha.isNull(), F.lit("miss"))
        .when(expected_sha.isNotNull(), F.when(F.lower(expected_sha) == F.lower(sha), F.lit("hit")).otherwise(F.lit("miss")))
        .when(immutable, F.lit("hit"))
        .when(has_validator, F.lit("revalidate"))
        .otherwise(F.when(young, F.lit("hit")).otherwise(F.lit("miss")))
    )


def fetch_outcome(ok: Column, not_found: Column) -> Column:
    """Aggregate over the mirrors of an object: served, surely absent, or unknown."""
    return F.when(F.bool_or(ok), F.lit("ok")).when(F.bool_and(not_found), F.lit("absent")).otherwise(F.lit("unknown"))
