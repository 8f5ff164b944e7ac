"""Data that a job service prepares on request: `cds://<dataset>?<request JSON>` is submitted, awaited and downloaded.

Credentials come from the environment or the user's rc file and travel as headers only; they never enter an address or a manifest.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

# The service's address, its header for the key, its end points and its words for jobs under way.
API = "https://cds.climate.copernicus.eu/api"
TOKEN = "PRIVATE-TOKEN"
EXECUTE, JOB, RESULTS = "{api}/retrieve/v1/processes/{dataset}/execution", "{api}/retrieve/v1/jobs/{job}", "{api}/retrieve/v1/jobs/{job}/results"
UNDER_WAY = ("accepted", "running", "successful")


class JobError(OSError):
    """The service refused, failed or did not finish a job."""


def encode(dataset: str, request: Mapping) -> str:
    """The address of a request. Equal requests have equal addresses: keys are sorted at every level, without spaces."""
    if not dataset or "?" in dataset:
        raise ValueError(f"not a dataset: {dataset!r}")
    return f"cds://{dataset}?" + json.dumps(request, sort_keys=True, separators=(",", ":"))


def decode(url: str) -> tuple[str, dict]:
    """Dataset and request of an address; ValueError if either is missing or the request is no JSON object."""
    scheme, _, rest = url.partition("://")
    dataset, _, body = rest.partition("?")
    if scheme != "cds" or not dataset or not body:
        raise ValueError(f"not a job address: {url!r}")
    request = json.loads(body)
    if not isinstance(request, dict):
        raise ValueError(f"the request is no JSON object: {url!r}")
    return dataset, request


def settings(home: Path | None = None) -> dict:
    """{"url", "key"}: each from its variable, else from the first such line of the rc file; url has a default, key may be missing."""
    rc = (home or Path.home()) / ".cdsapirc"
    lines = rc.read_text().splitlines() if rc.is_file() else []
    named = [(k.strip().lower(), v.strip()) for k, sep, v in (x.partition(":") for x in lines) if sep]
    found = {k: v for k, v in reversed(named) if k in ("url", "key") and v}
    found |= {k: v for k in ("url", "key") if (v := os.environ.get(f"CDSAPI_{k.upper()}", "").strip())}
    return {"url": API} | found | ({"url": found["url"].rstrip("/")} if "url" in found else {})


def token_headers(key: str | None = None) -> dict:
    key = key or settings().get("key")
    if not key:
        raise JobError("no key: set CDSAPI_KEY or write `key: ...` to ~/.cdsapirc")
    return {TOKEN: key}


@dataclass
class JobService:
    """Submits requests, polls until they are done and downloads the result. `headers` replace those from the settings."""

    api: str | None = None
    headers: dict = field(default_factory=dict, repr=False)
    poll_seconds: float = 5.0
    timeout_seconds: float = 600.0

    def _ask(self, url: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        sent = {"Content-Type": "application/json"} | (self.headers or token_headers())
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, sent), timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise JobError(f"{url}: {e.code} {e.read()[:500]!r}") from e
        except OSError as e:
            raise JobError(f"{url}: {e}") from e

    def _url(self, form: str, **parts) -> str:
        return form.format(api=(self.api or settings()["url"]).rstrip("/"), **parts)

    def submit(self, dataset: str, request: Mapping) -> str:
        got = self._ask(self._url(EXECUTE, dataset=dataset), {"inputs": dict(request)})
        if got.get("status") not in UNDER_WAY or not got.get("jobID"):
            raise JobError(f"{dataset}: no job was made: {got}")
        return str(got["jobID"])

    def wait(self, job: str) -> str:
        """The address of the finished job's result."""
        late = time.monotonic() + self.timeout_seconds
        while (got := self._ask(self._url(JOB, job=job))).get("status") != "successful":
            if got.get("status") not in UNDER_WAY:
                raise JobError(f"job {job} ended: {got}")
            if time.monotonic() > late:
                raise JobError(f"job {job} is not done after {self.timeout_seconds} s")
            time.sleep(self.poll_seconds)
        result = self._ask(self._url(RESULTS, job=job))
        try:
            return result["asset"]["value"]["href"]
        except (KeyError, TypeError) as e:
            raise JobError(f"job {job} has no result: {result}") from e

    def download(self, href: str) -> bytes:
        """The result is at a signed address of its own, so no headers are sent."""
        try:
            with urllib.request.urlopen(href, timeout=600) as r:
                return r.read()
        except OSError as e:
            raise JobError(f"{href}: {e}") from e

    def retrieve(self, url: str) -> bytes:
        return self.download(self.wait(self.submit(*decode(url))))
