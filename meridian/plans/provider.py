"""A façade over one declared source: constant, or discrete in time; every answer is a lazy DataFrame."""

from __future__ import annotations

import datetime
import inspect
import os
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import cf_micros, from_micros, latest, micros
from ..operators import cadence
from ..operators.order import durable
from ..sources import cache, netcdf, objects
from ..sources.codecs import Unsupported
from ..sources.errors import MeridianError, OutOfRange, UnknownOption
from ..sources.files import FORMATS
from ..sources.zarr import ZARR_OPTIONS, ZarrSource, array_shape, read_axis

EPOCH = datetime.datetime(1970, 1, 1)
ACCESS = ("cached", "direct")
BRACKET_TIME = {"units": "seconds since 1970-01-01T00:00:00Z", "calendar": "standard"}
UNREACHABLE = (MeridianError, OSError, ValueError, KeyError, PySparkException)  # no successor then


def naive(t: datetime.datetime) -> datetime.datetime:
    """Instants are UTC; those without a zone are so already."""
    return t.astimezone(datetime.timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def since(t: datetime.datetime) -> int:
    return (t - EPOCH) // datetime.timedelta(microseconds=1)


@dataclass(frozen=True)
class Cadence:
    """records_per_sample: None for whole files, 1 for the record at an instant, 2 for it and its successor."""

    start: datetime.datetime
    step: datetime.timedelta
    file_period: datetime.timedelta
    end: datetime.datetime | None = None
    time_dim: str = "time"
    records_per_sample: int | None = None

    def snap(self, t: datetime.datetime, step: datetime.timedelta) -> datetime.datetime:
        t = naive(t)
        if t < self.start:
            raise ValueError(f"{t} is before {self.start}")
        return self.start + (t - self.start) // step * step


@dataclass(frozen=True)
class Source:
    name: str
    format: str
    url: object  # text, strftime template, or a function of the anchor
    cadence: Cadence | None = None
    options: dict = field(default_factory=dict)
    variables: tuple = ()
    mirrors: tuple = ()
    auth_realm: str | None = None
    store_access: str | None = None

    def resolve(self, anchor: datetime.datetime | None) -> str:
        if callable(self.url):
            return self.url(anchor)
        return self.url if anchor is None or self.url.startswith("cds://") else anchor.strftime(self.url)


class Provider:
    """`load` reads a constant source; `refresh(t)` gives what is current at t and says whether that changed.

    With `cache_root`, files are fetched into the cache first and read there. `window` (start, end) bounds refresh_times and prefetch.
    """

    def __init__(self, spark: SparkSession, source: Source, window: tuple | None = None, cache_root: str | None = None, transports: dict | None = None, headers: dict | None = None, offline: bool | None = None, formats=FORMATS):
        self.spark, self.source, self.cache_root = spark, source, cache_root
        self._reader = None if source.format == "zarr" else formats[source.format]
        accepted = set(ZARR_OPTIONS) if self._reader is None else set(inspect.signature(self._reader).parameters) - {"spark", "path"}
        if unknown := set(source.options) - accepted:
            raise UnknownOption(source.format, unknown, accepted)
        if source.cadence and source.cadence.records_per_sample not in (None, 1, 2):
            raise ValueError("records_per_sample is None, 1 or 2")
        if source.cadence and source.cadence.records_per_sample and source.format not in ("netcdf", "zarr"):
            raise ValueError(f"{source.format} has no records to choose from")
        asked = source.store_access or os.environ.get("MERIDIAN_STORE_ACCESS") or None
        self.store_access = asked or ("cached" if cache_root else "direct")
        if self.store_access not in ACCESS:
            raise ValueError(f"store_access is one of {ACCESS}: {self.store_access!r}")
        if self.store_access == "cached" and not cache_root:
            raise ValueError("cached access needs a cache")
        if self.store_access == "direct" and cache_root and not self.supports_selection:
            raise ValueError(f"{source.format} files are read whole, so they go through the cache")
        self.window = None if window is None else tuple(map(naive, window))
        self._fetch_options = {"transports": transports, "headers": headers, "offline": offline}
        self._anchor = self._coords_url = None
        self._recent: OrderedDict[str, object] = OrderedDict()  # time axes of the two files used last

    @property
    def is_const(self) -> bool:
        return self.source.cadence is None

    @property
    def supports_selection(self) -> bool:
        """Whether `select` can be pushed into the read."""
        return self._reader is None

    @property
    def coords(self) -> dict[str, DataFrame]:
        """Coordinates of what was read last, by name; empty before that."""
        if self._coords_url is None:
            return {}
        if self.source.format == "netcdf":
            return netcdf.coordinates(self.spark, self._coords_url)
        if self.source.format == "zarr":
            axes = {d: read_axis(self._coords_url, d) for d in self._dims()}
            return {d: self.spark.createDataFrame(list(enumerate(v.tolist())), f"`{d}_idx` int, `{d}` double").withMetadata(d, attrs) for d, (v, attrs) in axes.items() if v is not None}
        return {}

    def _dims(self) -> list[str]:
        return [c.removeprefix("pos_") for c in self._read(self._coords_url).columns if c.startswith("pos_")]

    # reading

    def _located(self, url: str) -> str:
        """Where the file is read: in the cache, once fetched, or at its address."""
        if self.store_access == "direct" or self.supports_selection:
            return url
        return f"{self.cache_root}/{self._fetch([url])[0]['path']}"

    def _fetch(self, urls: list[str]) -> list:
        rows = [(u, list(self.source.mirrors) or None) for u in dict.fromkeys(urls)]
        asked = self.spark.createDataFrame(rows, "url string, mirrors array<string>")
        return cache.fetch(asked, self.cache_root, realm=self.source.auth_realm, loader=self.source.name, **self._fetch_options).collect()

    def _read(self, url: str, select=None, **more) -> DataFrame:
        s = self.source
        if self.supports_selection:
            self.spark.dataSource.register(ZarrSource)
            options = s.options | ({"select": select} if select is not None else {})
            if self.store_access == "cached":
                options |= {"cache": self.cache_root}
            return self.spark.read.format("zarr").options(**options).load(url)
        if select is not None:
            raise ValueError(f"{s.format} takes no selection")
        chosen = {"variables": list(s.variables)} if s.variables else {}
        return self._reader(self.spark, self._located(url), **(s.options | chosen | more))

    def load(self, select=None) -> DataFrame:
        """A constant source's data; of a discrete one what is current at the window's start (else its own)."""
        if not self.is_const:
            return self.refresh(self._lower(), select)[0]
        url = self.source.resolve(None)
        out = self._read(url, select)
        if select is None:
            self._coords_url = url if self.supports_selection else self._located(url)
        return out

    def refresh(self, t: datetime.datetime, select=None) -> tuple[DataFrame, bool]:
        """What is current at t, and whether it differs from the last call's. A call with `select` is a peek: it changes nothing."""
        c = self.source.cadence
        if c is None:
            return self.load(select), False
        anchor = c.snap(t, c.step)
        file_anchor = c.snap(anchor, c.file_period)
        url = self.source.resolve(file_anchor)
        if c.records_per_sample is None:
            out = self._read(url, select)
        elif c.records_per_sample == 1:
            out = self._record(url, self._index(url, anchor, file_anchor), select).drop(*self._time_columns())
        else:
            out = self._bracket(url, anchor, file_anchor, select)
        changed = anchor != self._anchor
        if select is None:
            self._anchor = anchor
            self._coords_url = url if self.supports_selection else self._located(url)
        return out, changed

    # records

    def _time_columns(self) -> list[str]:
        d = self.source.cadence.time_dim
        return [f"pos_{d}", d] if self.supports_selection else [f"{d}_idx", d]

    def _times(self, url: str) -> tuple[int, np.ndarray | None]:
        """Length of a file's time axis and its instants in microseconds (None if they cannot be decoded). Two files are remembered."""
        if url not in self._recent:
            d = self.source.cadence.time_dim
            if self.supports_selection:
                values, attrs = read_axis(url, d)
                n = len(values) if values is not None else self._length(url, d)
            else:
                nc = netcdf.open_file(objects.files(self.spark, self._located(url))[0])
                n = nc.length(d)
                values, attrs = (nc.read(d), nc.vars[d][1]) if d in nc.vars else (None, {})
            self._recent[url] = n, None if values is None else cf_micros(values, str(attrs.get("units", "")), str(attrs.get("calendar", "standard")))
            while len(self._recent) > 2:
                self._recent.popitem(last=False)
        self._recent.move_to_end(url)
        return self._recent[url]

    def _length(self, url: str, dim: str) -> int:
        dims = [c.removeprefix("pos_") for c in self._read(url).columns if c.startswith("pos_")]
        return array_shape(url, self.source.options.get("variable", ""))[dims.index(dim)] if dim in dims else 0

    def time_length(self, t: datetime.datetime) -> int:
        """How many records the file that covers t holds."""
        c = self.source.cadence
        return self._times(self.source.resolve(c.snap(c.snap(t, c.step), c.file_period)))[0]

    def _index(self, url: str, anchor, file_anchor) -> int:
        """The latest record at or before the anchor on the file's own times if they span it (the first of equal ones), else the offset."""
        _, times = self._times(url)
        found = int(latest([] if times is None else [(0, times)], [since(anchor)])[0])
        return found if found >= 0 else (anchor - file_anchor) // self.source.cadence.step

    def _record(self, url: str, index: int, select=None) -> DataFrame:
        n, _ = self._times(url)
        if n and not 0 <= index < n:
            raise OutOfRange(f"record {index} of {n} in {url}")
        first, _ = self._time_columns()
        df = self._read(url, select)
        if first not in df.columns:  # not temporal: as it is
            return df
        column = first if not self.supports_selection else self.source.cadence.time_dim
        return df.where(F.col(f"`{column}`") == index)

    def _bracket(self, url: str, anchor, file_anchor, select=None) -> DataFrame:
        """The record at the anchor and its successor, in this file or the next; at the end of the data the record itself twice."""
        c = self.source.cadence
        low = self._index(url, anchor, file_anchor)
        one = self._record(url, low, select)
        after, two = anchor + c.step, None
        if c.end is None or after < c.end:
            try:
                if low + 1 < self._times(url)[0]:
                    two = self._record(url, low + 1, select)
                else:
                    next_file = c.snap(after, c.file_period)
                    next_url = self.source.resolve(next_file)
                    index = self._index(next_url, after, next_file)
                    if 0 <= index < self._times(next_url)[0]:
                        two = self._record(next_url, index, select)
            except UNREACHABLE:
                two = None
        if two is None:
            after, two = anchor, one
        first, time = self._time_columns()
        if first not in one.columns:
            return one

        def placed(df, k, t):
            return df.withColumn(first, F.lit(k).cast("int")).withColumn(time, F.lit((t - EPOCH).total_seconds()))

        out = placed(one, 0, anchor).unionByName(placed(two, 1, after))
        return out.withMetadata(time, BRACKET_TIME)

    def refresh_all(self, asked: DataFrame, at: str) -> DataFrame:
        """What `refresh` gives at every instant of the column `at`, in one job: `at`, the tick (anchor), then the columns of `refresh`. No state changes.

        Instants are dealt out by the file that holds them; a task searches its time axis a stretch at a time and reads only the records
        that are asked for. This is for NetCDF records read at their address, one file an address; rows without an instant give none.
        """
        c, s = self.source.cadence, self.source
        if c is None or not c.records_per_sample or s.format != "netcdf" or self.store_access != "direct":
            raise Unsupported("many instants at once: only for records of NetCDF files that are read directly")

        def locate(batches):
            for pdf in batches:
                anchors = [c.snap(EPOCH + datetime.timedelta(microseconds=us), c.step) for us in pdf["at"].tolist()]
                yield pdf.assign(anchor=list(map(since, anchors)), url=[s.resolve(c.snap(a, c.file_period)) for a in anchors])

        when = asked.where(F.col(at).isNotNull()).select(micros(F.col(at)).alias("at"))
        located = durable(when.mapInPandas(locate, "at long, anchor long, url string"))
        n, first = located.agg(F.count_distinct("url"), F.min_by("url", "anchor")).first()
        if not n:
            raise ValueError("no instants")
        head = netcdf.open_file(first)
        layout = netcdf.Layout.of(head, **({"variables": list(s.variables)} if s.variables else {}) | s.options)
        temporal, pair = c.time_dim in layout.dims, c.records_per_sample == 2
        gone = [] if not temporal else [f"{c.time_dim}_idx", c.time_dim]
        columns = [(k, t) for k, t in layout.columns if k not in gone]
        if temporal and pair:
            columns += [(gone[0], "int"), (gone[1], "double")]

        def bring(batches):
            kept, size = [], 0
            for pdf in batches:
                for url, rows in pdf.groupby("url", sort=False):
                    for part in _current(c, s, layout, url, rows):
                        kept.append(part[["at", "anchor", *[k for k, _ in columns]]])
                        size += len(part)
                        if size >= 1 << 16:  # cells
                            yield pd.concat(kept, ignore_index=True)
                            kept, size = [], 0
            if kept:
                yield pd.concat(kept, ignore_index=True)

        dealt = located.repartition(netcdf.dealt_over(n), "url").sortWithinPartitions("url", "anchor")
        got = dealt.mapInPandas(bring, "at long, anchor long, " + ", ".join(f"`{k}` {t}" for k, t in columns))
        out = objects.with_nan(got).select(from_micros(F.col("at")).alias(at), from_micros(F.col("anchor")).alias("anchor"), *[f"`{k}`" for k, _ in columns])
        for d in layout.coords:
            if d not in gone:
                out = out.withMetadata(d, {k: v for k, v in head.vars[d][1].items() if k in ("units", "calendar")})
        return out.withMetadata(c.time_dim, BRACKET_TIME) if temporal and pair else out

    # schedule

    def _lower(self) -> datetime.datetime:
        start = self.source.cadence.start
        return max(self.window[0], start) if self.window else start

    def refresh_times(self, lower=None, upper=None) -> DataFrame:
        """(tick_index, anchor, epoch_s) of the instants in [lower, upper) at which the data change; none for constant or unbounded sources."""
        c = self.source.cadence
        text = lambda x: None if x is None else x.isoformat(sep=" ")
        if c is None:
            return cadence.ticks(self.spark, text(EPOCH), 1)
        low, high = (self.window or (None, None)) if lower is None and upper is None else (lower, upper)
        return cadence.ticks(self.spark, text(c.start), int(c.step.total_seconds()), text(low), text(high), text(c.end) if high is None else None)

    def prefetch(self, window: tuple | None = None) -> DataFrame:
        """Fetch every file that the window needs into the cache without reading it: (key, url, status, path). An unbounded window is an error."""
        if not self.cache_root:
            raise ValueError("prefetch needs a cache")
        c = self.source.cadence
        if c is None:
            urls = [self.source.resolve(None)]
        else:
            low, high = tuple(map(naive, window)) if window else self.window or (c.start, c.end)
            if high is None:
                raise ValueError("prefetch needs an end: give a window, or the cadence an end")
            at, urls = c.snap(max(low, c.start), c.file_period), []
            while at < high:
                urls.append(self.source.resolve(at))
                at += c.file_period
        rows = self._fetch(urls)
        return self.spark.createDataFrame(rows, cache.FETCHED)

    def shape(self, variable: str | None = None) -> tuple | None:
        """The whole shape of a stored array, from its metadata; None for files that are read whole."""
        if not self.supports_selection:
            return None
        c = self.source.cadence
        return array_shape(self.source.resolve(c.start if c else None), variable if variable is not None else self.source.options.get("variable", ""))


def _current(c: Cadence, source: Source, layout: netcdf.Layout, url: str, rows: pd.DataFrame):
    """The cells current at instants that one file holds, for `Provider.refresh_all`: for each row (at, anchor) the record, or it and its successor."""
    d, tick = c.time_dim, datetime.timedelta(microseconds=1)

    def opened(address):
        nc = netcdf.open_file(address)
        netcdf.chosen(nc, layout.names)
        return nc, nc.length(d)

    def index(nc, address_anchor, anchors):
        found = nc.current(d, list(map(since, anchors)))
        return [int(k) if k >= 0 else (a - address_anchor) // c.step for k, a in zip(found, anchors)]

    def record(nc, address, k):
        if tuple(nc.dim_names(layout.names[0])) != layout.dims:
            raise ValueError(f"{address}: dimensions {nc.dim_names(layout.names[0])}, not {list(layout.dims)}")
        lead = nc.shape(layout.names[0])[0] if layout.dims else 1
        if d not in layout.dims:
            yield from layout.cells(nc, address, 0, lead)
        elif layout.dims[0] == d:
            yield from layout.cells(nc, address, k, min(k + 1, lead))
        else:
            for part in layout.cells(nc, address, 0, lead):
                yield part[part[f"{d}_idx"] == k]

    nc, n = opened(url)
    anchors = [EPOCH + a * tick for a in rows["anchor"].tolist()]
    file_anchor = c.snap(anchors[0], c.file_period)
    ahead: dict = {}  # the successor in the next file, which all brackets at the end of this one share
    for at, anchor, low in zip(rows["at"].tolist(), anchors, index(nc, file_anchor, anchors)):
        if n and not 0 <= low < n:
            raise OutOfRange(f"record {low} of {n} in {url}")
        places = [(anchor, nc, url, low)]
        if c.records_per_sample == 2 and d in layout.dims:
            after, two = anchor + c.step, None
            if c.end is None or after < c.end:
                if low + 1 < n:
                    two = (after, nc, url, low + 1)
                else:
                    if after not in ahead:
                        ahead[after] = None
                        try:
                            next_file = c.snap(after, c.file_period)
                            next_url = source.resolve(next_file)
                            later, m = opened(next_url)
                            k = index(later, next_file, [after])[0]
                            ahead[after] = (after, later, next_url, k) if 0 <= k < m else None
                        except UNREACHABLE:
                            pass
                    two = ahead[after]
            places.append(two or places[0])
        for k, (t, holder, address, spot) in enumerate(places):
            for part in record(holder, address, spot):
                if len(places) == 2:
                    part = part.assign(**{f"{d}_idx": k, d: (t - EPOCH).total_seconds()})
                yield part.assign(at=at, anchor=since(anchor))
