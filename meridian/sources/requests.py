"""Requests to the reanalysis service, one a month: canonical field order and values, so equal wishes have one address and one cache key."""

from __future__ import annotations

import calendar
import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import LEVELS_HPA, SHORT_NAMES
from ..functions.keys import job_url
from . import jobs

DATASET = "reanalysis-era5-pressure-levels"  # fixed value
HOURS = [f"{h:02d}:00" for h in range(24)]


def all_variables() -> list[str]:
    return sorted(SHORT_NAMES)


def levels(indices) -> list[int]:
    """Pressures of level indices from 1; one out of range is an error."""
    out = []
    for raw in indices:
        i = round(raw)
        if not 1 <= i <= len(LEVELS_HPA):
            raise ValueError(f"level index {raw!r} out of range 1..{len(LEVELS_HPA)}")
        out.append(LEVELS_HPA[i - 1])
    return out


def area(lon_a: float, lat_a: float, lon_b: float, lat_b: float) -> list[int]:
    """[north, west, south, east] in whole degrees, outward by one."""
    return [math.ceil(max(lat_a, lat_b) + 1), math.floor(min(lon_a, lon_b) - 1), math.floor(min(lat_a, lat_b) - 1), math.ceil(max(lon_a, lon_b) + 1)]


def month_request(year: int, month: int, days, variables, pressure_levels, area, product_type: str = "reanalysis", data_format: str = "netcdf", download_format: str = "unarchived") -> dict:
    """One month's request. Sets are sorted and freed of repeats (levels from high to low); empty ones, unknown variables and other areas than [N, W, S, E] are errors."""
    chosen, pressures, dates = sorted(set(variables)), sorted({int(p) for p in pressure_levels}, reverse=True), sorted({int(d) for d in days})
    for name, got in (("variable", chosen), ("pressure level", pressures), ("day", dates)):
        if not got:
            raise ValueError(f"a request needs a {name} at least")
    if unknown := sorted(set(chosen) - set(SHORT_NAMES)):
        raise ValueError(f"unknown variables {unknown}; known: {all_variables()}")
    if len(area) != 4:
        raise ValueError(f"an area is [north, west, south, east]: {area!r}")
    if not 1 <= int(month) <= 12 or dates[0] < 1 or dates[-1] > calendar.monthrange(int(year), int(month))[1]:
        raise ValueError(f"no such days in {year}-{month}: {dates}")
    return {
        "product_type": [product_type],
        "variable": chosen,
        "pressure_level": [str(p) for p in pressures],
        "year": [str(year)],
        "month": [f"{month:02d}"],
        "day": [f"{d:02d}" for d in dates],
        "time": HOURS,
        "data_format": data_format,
        "download_format": download_format,
        "area": [int(x) for x in area],
    }


def month_url(*args, **options) -> str:
    return jobs.encode(DATASET, month_request(*args, **options))


def months_in_span(start: datetime.datetime, end: datetime.datetime, buffer: datetime.timedelta = datetime.timedelta(hours=3)) -> list[tuple[int, int, list[int]]]:
    """(year, month, days) that cover the span with a buffer on both sides; a reversed span is an error."""
    low, high = ((t.astimezone(datetime.timezone.utc).replace(tzinfo=None) if t.tzinfo else t) for t in (start, end))
    low, high = low - buffer, high + buffer
    if high < low:
        raise ValueError("the span ends before it starts")
    out: dict[tuple[int, int], list[int]] = {}
    day = low.date()
    while day <= high.date():
        out.setdefault((day.year, day.month), []).append(day.day)
        day += datetime.timedelta(days=1)
    return [(y, m, d) for (y, m), d in out.items()]


def month_urls(wishes: DataFrame, year: Column, month: Column, days: Column, variables: Column, pressure_levels: Column, area: Column) -> DataFrame:
    """`wishes` with `url`: the address of each row's month request, from columns (arrays are sets), built by Spark alone."""
    unknown = F.array_except(variables, F.array(*[F.lit(v) for v in all_variables()]))
    empty = (F.size(variables) == 0) | (F.size(pressure_levels) == 0) | (F.size(days) == 0) | (F.size(area) != 4) | (F.size(unknown) > 0)

    def two(x):
        return F.lpad(x.cast("int").cast("string"), 2, "0")

    request = F.struct(
        F.transform(area, lambda x: x.cast("int")).alias("area"),
        F.lit("netcdf").alias("data_format"),
        F.transform(F.array_sort(F.array_distinct(days)), two).alias("day"),
        F.lit("unarchived").alias("download_format"),
        F.array(two(month)).alias("month"),
        F.transform(F.sort_array(F.array_distinct(F.transform(pressure_levels, lambda p: p.cast("int"))), False), lambda p: p.cast("string")).alias("pressure_level"),
        F.array(F.lit("reanalysis")).alias("product_type"),
        F.array(*[F.lit(h) for h in HOURS]).alias("time"),
        F.array_sort(F.array_distinct(variables)).alias("variable"),
        F.array(year.cast("string")).alias("year"),
    )
    refused = F.raise_error(F.lit("a request needs known variables, levels, days and an area")).cast("string")
    return wishes.withColumn("url", F.when(empty, refused).otherwise(job_url(DATASET, request)))
