"""Column builders for cadences: anchors, address templates, CF times. Instants are UTC without zone."""

from __future__ import annotations

import datetime
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "sec": 10**6, "s": 10**6, "minute": 60 * 10**6, "min": 60 * 10**6, "hour": 3600 * 10**6, "hr": 3600 * 10**6, "h": 3600 * 10**6, "day": 86400 * 10**6, "d": 86400 * 10**6}
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD"}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def snap_down(ts: Column, start: Column, step_seconds: int) -> Column:
    """The latest start + k * step not after ts; k may be negative."""
    step = F.lit(step_seconds * 10**6).cast("long")
    return from_micros(micros(ts) - F.pmod(micros(ts) - micros(start), step))


def url_at(ts: Column, template: str) -> Column:
    """A strftime template at an instant; text outside directives is literal."""
    if template.startswith("cds://"):
        return F.lit(template)
    parts = [p for p in re.split(r"(%[A-Za-z%])", template) if p]
    return F.concat(*[F.lit("%") if p == "%%" else F.date_format(ts, DIRECTIVES[p[1]]) if p[0] == "%" and len(p) == 2 else F.lit(p) for p in parts])


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)


def cf_time(raw: Column, units: str, calendar: str = "standard") -> Column:
    """Instants of raw values in `<unit> since <reference>`; null for calendars other than the real one."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(.+?)\s*", units)
    if calendar.lower() not in ("standard", "gregorian", "proleptic_gregorian") or not m or m[1].lower() not in UNIT_MICROS:
        return F.lit(None).cast("timestamp_ntz")
    base = F.lit(m[2].replace("T", " ").removesuffix("Z").removesuffix(" UTC").strip()).cast("timestamp_ntz")
    return from_micros(micros(base) + F.round(raw.cast("double") * UNIT_MICROS[m[1].lower()]).cast("long"))


def cf_micros(values: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray | None:
    """Instants (microseconds since 1970) of raw values of an axis; None where `cf_time` would be null. A value that is no number is an error."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(.+?)\s*", units)
    if calendar.lower() not in ("standard", "gregorian", "proleptic_gregorian") or not m or m[1].lower() not in UNIT_MICROS:
        return None
    try:
        base = datetime.datetime.fromisoformat(m[2].replace("T", " ").removesuffix("Z").removesuffix(" UTC").strip())
    except ValueError:
        return None
    start = (base - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    values = np.asarray(values)
    if values.dtype.kind == "f" and not np.isfinite(values).all():
        raise ValueError("a time that is no number")
    scaled = values.astype("f8" if values.dtype.kind == "f" else "i8") * UNIT_MICROS[m[1].lower()]
    return start + np.rint(scaled).astype("i8")


def latest(stretches, instants) -> np.ndarray:
    """Position of the latest time at or before each instant (the first of equal ones), -1 for instants that the times do not span.

    The times, in any order, come as (position of the first, array) a stretch at a time."""
    instants = np.asarray(instants, "i8")
    best, at = np.full(len(instants), np.iinfo("i8").min), np.full(len(instants), -1)
    low, high = np.iinfo("i8").max, np.iinfo("i8").min
    for start, times in stretches:
        if not len(times):
            continue
        values, first = np.unique(times, return_index=True)
        spot = np.searchsorted(values, instants, side="right") - 1
        newer = (spot >= 0) & (values[spot] > best)
        best[newer], at[newer] = values[spot[newer]], start + first[spot[newer]]
        low, high = min(low, values[0]), max(high, values[-1])
    return np.where((instants >= low) & (instants <= high), at, -1)


def mod1(index: Column, n: Column) -> Column:
    """1..n, so that n follows n - 1 and 1 follows n."""
    return F.pmod(index - 1, n) + 1


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """Null where the text is no time."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")
