"""Many instants at once: one job, the same rows as one call an instant, and few reads of a file."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions.times import latest
from meridian.plans import catalog, encoders
from meridian.plans.provider import Cadence, Provider, Source
from meridian.sources import netcdf
from meridian.sources.errors import OutOfRange

SF = "/root/testdata/sf0.001"
T = datetime.datetime
HOUR, DAY = datetime.timedelta(hours=1), datetime.timedelta(days=1)


def daily(folder, day, hours):
    t, v = np.array(hours, ">i4"), np.array([[100 * day + h + k / 8, -h] for k, h in enumerate(hours)], ">f8")
    raw = encoders.netcdf({"time": 0, "x": 2}, {"time": (["time"], t, {"units": f"hours since 2020-01-{day:02d} 00:00:00"}), "x": (["x"], np.array([5.0, 6.0], ">f8"), {}), "v": (["time", "x"], v, {}), "still": (["x"], np.array([7.0, 8.0], ">f8"), {})})
    (folder / f"202001{day:02d}.nc").write_bytes(raw)


def source(folder, records, variables=("v",), end=None):
    return Source("s", "netcdf", f"{folder}/%Y%m%d.nc", Cadence(T(2020, 1, 1), 6 * HOUR, DAY, end, records_per_sample=records), variables=variables)


def asked(spark, instants):
    return spark.createDataFrame([(t,) for t in instants], "at timestamp_ntz")


def rows(df, names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("records", [1, 2])
@pytest.mark.parametrize("end", [None, T(2020, 1, 3, 12)])
def test_all_instants_at_once_equal_one_call_each(spark, tmp_path, records, end):
    for day, hours in ((1, [0, 6, 12, 18]), (2, [18, 0, 6, 6, 12]), (3, [6, 12])):
        daily(tmp_path, day, hours)
    (tmp_path / "20200104.nc").write_bytes(b"CDF\x07")  # unreadable, so day 3 is the end
    instants = [T(2020, 1, 1) + k * 3 * HOUR for k in range(16)] + [T(2020, 1, 3), T(2020, 1, 3, 8), T(2020, 1, 3, 12)]
    for variables in (("v",), ("still",)):
        p = Provider(spark, source(tmp_path, records, variables, end))
        got = p.refresh_all(asked(spark, [*instants, None]), "at")
        one, want = p.refresh(instants[0])[0], []
        names = [c for c in one.columns if c != "path"]
        for t in instants:
            want += [(t, *r) for r in rows(p.refresh(t)[0], names)]
        assert rows(got, ["at", *names]) == sorted(want)
        assert dict(got.drop("at", "anchor").dtypes) == dict(one.dtypes) and all(got.schema[c].metadata == one.schema[c].metadata for c in names)
    with pytest.raises(Exception, match=OutOfRange.__name__):
        Provider(spark, source(tmp_path, records)).refresh_all(asked(spark, [T(2020, 1, 3, 18)]), "at").collect()


def test_interleaved_records_are_read_in_few_ranges():
    n = 5000
    t, v, b = np.arange(n, dtype=">f8"), np.arange(2 * n, dtype=">i2").reshape(n, 2), np.arange(n, dtype="i1")
    raw = encoders.netcdf({"time": 0, "x": 2}, {"time": (["time"], t, {"units": "seconds since 2020-01-01"}), "v": (["time", "x"], v, {}), "b": (["time"], b, {})})
    reads = []
    nc = netcdf.NetCDF(lambda at, size: reads.append(size) or raw[at : at + size])
    reads.clear()
    for name, want in (("time", t), ("v", v), ("b", b)):
        assert (nc.read(name) == want).all() and (nc.read(name, 4321, 4999) == want[4321:4999]).all() and len(nc.read(name, 7, 7)) == 0
    assert len(reads) == 6
    base = (T(2020, 1, 1) - T(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    shown, netcdf.TIMES = netcdf.TIMES, 7
    try:
        assert nc.current("time", [base - 1, base, base + 12_500_000, base + 4999 * 10**6, base + 5000 * 10**6]).tolist() == [-1, 0, 12, 4999, -1]
    finally:
        netcdf.TIMES = shown
    with pytest.raises(ValueError):
        netcdf.NetCDF(raw[:-8]).read("b")


def test_latest_over_stretches_in_any_order():
    times = np.array([5, 1, 9, 5, 7, 9, 1])
    for size in (1, 2, 7):
        stretches = [(k, times[k : k + size]) for k in range(0, 7, size)]
        assert latest(stretches, [0, 1, 4, 5, 6, 8, 9, 10]).tolist() == [-1, 1, 1, 0, 0, 4, 2, -1]
    assert latest([], [3]).tolist() == [-1]


@pytest.mark.parametrize("name", ["provider_record", "provider_bracket", "time_lengths"])
def test_the_plan_does_not_grow_with_the_files(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    sizes = []
    for days in (2, 8):
        events.where(F.col("ts") < F.lit(T(2024, 1, 1) + days * DAY)).write.parquet(f"{tmp_path}/{days}/events.parquet")
        df = catalog.Q[name](spark, f"{tmp_path}/{days}")
        assert df.count() == days * (2 if name == "provider_bracket" else 1)
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("name", ["provider_record", "provider_bracket"])
def test_repeated_instants_missing_days_and_events_without_time(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet").where("dayofmonth(ts) not in (5, 6)")
    twice = events.unionByName(events.withColumn("event_id", F.col("event_id") + 1000).withColumn("value", -F.col("value")))
    twice.unionByName(events.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    found = want.fetchall()
    assert len(found) >= 28 and rows(catalog.Q[name](spark, str(tmp_path)), names) == sorted(found)
