"""The provider's records, brackets, windows, prefetch and options, on files built here."""

import datetime
import threading

import numpy as np
import pytest

from meridian.plans import encoders
from meridian.plans.provider import Cadence, Provider, Source
from meridian.sources import cache, files, netcdf, objects, requests, settings
from meridian.sources.errors import AuthError, MeridianError, NoSuchVariable, NotRegistered, Offline, OutOfRange, UnknownOption
from meridian.sources.zarr_sink import OutputSchema, OutputVar, Writer

T = datetime.datetime
HOUR, DAY = datetime.timedelta(hours=1), datetime.timedelta(days=1)


def daily(folder, day, hours, trim=False):
    """A file of records at these hours: v = 100 day + hour on two cells, and a variable without time."""
    t = np.array(hours, ">i4")
    v = np.array([[100 * day + h, -(100 * day + h)] for h in hours], ">f8")
    raw = encoders.netcdf({"time": 0, "x": 2}, {"time": (["time"], t, {"units": f"hours since 2020-01-{day:02d} 00:00:00"}), "x": (["x"], np.array([5.0, 6.0], ">f8"), {}), "v": (["time", "x"], v, {}), "still": (["x"], np.array([7.0, 8.0], ">f8"), {})})
    (folder / f"202001{day:02d}.nc").write_bytes(raw)


def source(folder, **more):
    c = Cadence(T(2020, 1, 1), 6 * HOUR, DAY, more.pop("end", None), records_per_sample=more.pop("records", 1))
    return Source("s", "netcdf", f"{folder}/%Y%m%d.nc", c, variables=more.pop("variables", ("v",)), **more)


@pytest.fixture
def folder(tmp_path):
    for day in (1, 2):
        daily(tmp_path, day, [0, 6, 12, 18])
    return tmp_path


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_record_is_sliced_and_peeks_change_nothing(spark, folder):
    p = Provider(spark, source(folder))
    df, changed = p.refresh(T(2020, 1, 1, 13))
    assert changed and values(df, "x", "v") == [(5.0, 112.0), (6.0, -112.0)] and not {"time", "time_idx"} & set(df.columns)
    assert not p.refresh(T(2020, 1, 1, 17))[1] and p.refresh(T(2020, 1, 2))[1]
    assert values(p.refresh(T(2020, 1, 2, 3))[0], "v") == [(-200.0,), (200.0,)]
    with pytest.raises(ValueError):
        p.refresh(T(2020, 1, 1, 5), select={"axes": ["all"]})
    assert not p.refresh(T(2020, 1, 2, 5))[1]
    with pytest.raises(ValueError):
        p.refresh(T(2019, 12, 31))
    assert p.time_length(T(2020, 1, 1)) == 4 and sorted(p.coords) == ["time", "x"] and p.coords["x"].count() == 2
    assert p.coords["time"].schema["time"].metadata["units"].startswith("hours since")
    still = Provider(spark, source(folder, variables=("still",)))
    assert values(still.refresh(T(2020, 1, 1))[0], "still") == [(7.0,), (8.0,)]


def test_own_times_come_before_offsets(spark, folder):
    daily(folder, 3, [6, 12])
    p = Provider(spark, source(folder))
    assert values(p.refresh(T(2020, 1, 3, 7))[0], "v") == [(-306.0,), (306.0,)]
    assert values(p.refresh(T(2020, 1, 3))[0], "v") == [(-306.0,), (306.0,)]  # before the file's span: by offset 0
    with pytest.raises(OutOfRange):
        p.refresh(T(2020, 1, 3, 18))
    daily(folder, 4, [0, 6, 6, 12])
    assert p._index(f"{folder}/20200104.nc", T(2020, 1, 4, 6), T(2020, 1, 4)) == 1


def test_brackets_cross_the_seam_and_clamp(spark, folder):
    p = Provider(spark, source(folder, records=2))

    def pair(t):
        df, _ = p.refresh(t)
        assert df.schema["time"].metadata["units"] == "seconds since 1970-01-01T00:00:00Z"
        return values(df.where("x = 5"), "time_idx", "time", "v")

    def at(*x):
        return (T(*x) - T(1970, 1, 1)).total_seconds()

    assert pair(T(2020, 1, 1, 7)) == [(0, at(2020, 1, 1, 6), 106.0), (1, at(2020, 1, 1, 12), 112.0)]
    assert pair(T(2020, 1, 1, 20)) == [(0, at(2020, 1, 1, 18), 118.0), (1, at(2020, 1, 2, 0), 200.0)]
    assert pair(T(2020, 1, 2, 20)) == [(0, at(2020, 1, 2, 18), 218.0), (1, at(2020, 1, 2, 18), 218.0)]  # no next file
    (folder / "20200103.nc").write_bytes(b"CDF\x07")
    assert pair(T(2020, 1, 2, 20))[1][1:] == (at(2020, 1, 2, 18), 218.0)  # unreadable
    ended = Provider(spark, source(folder, records=2, end=T(2020, 1, 1, 12)))
    assert values(ended.refresh(T(2020, 1, 1, 6))[0].where("x = 5"), "v") == [(106.0,), (106.0,)]


def test_window_schedule_and_prefetch(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cache"))
    window = (T(2020, 1, 1, 5), T(2020, 1, 2, 12))
    src = source(f"file://{folder}")
    p = Provider(spark, src, window, cache_root=root)
    assert [r["anchor"] for r in p.refresh_times().orderBy("anchor").collect()] == [T(2020, 1, 1, 6) + k * 6 * HOUR for k in range(5)]
    assert sorted(r["status"] for r in p.prefetch().collect()) == ["downloaded"] * 2
    assert {r["source_loader"] for r in cache.manifests(spark, root).collect()} == {"s"}
    off = Provider(spark, src, window, cache_root=root, offline=True)
    assert values(off.load(), "v") == [(-100.0,), (100.0,)] and values(off.refresh(T(2020, 1, 2))[0], "v") == [(-200.0,), (200.0,)]
    open_ = Provider(spark, src, cache_root=root)
    assert open_.refresh_times().count() == 0
    with pytest.raises(ValueError):
        open_.prefetch()
    assert open_.prefetch((T(2020, 1, 2), T(2020, 1, 3))).count() == 1


def test_construction_refuses_what_cannot_work(spark, folder, monkeypatch):
    with pytest.raises(NotRegistered):
        Provider(spark, Source("s", "grib", "x"))
    with pytest.raises(UnknownOption) as e:
        Provider(spark, Source("s", "csv", "x", options={"numeric": 1}))
    assert "numeric_columns" in e.value.accepted
    with pytest.raises(UnknownOption):
        Provider(spark, Source("s", "zarr", "x", options={"chunks": 1}))
    for bad in ({"store_access": "cached"}, {"store_access": "elsewhere"}):
        with pytest.raises(ValueError):
            Provider(spark, source(folder, **bad))
    with pytest.raises(ValueError):
        Provider(spark, source(folder, store_access="direct"), cache_root="/tmp/x")
    assert Provider(spark, Source("s", "zarr", "x", store_access="direct"), cache_root="/tmp/x").supports_selection
    monkeypatch.setenv("MERIDIAN_STORE_ACCESS", "direct")
    assert Provider(spark, Source("s", "zarr", "x"), cache_root="/tmp/x").store_access == "direct"
    assert Provider(spark, Source("s", "zarr", "x", store_access="cached"), cache_root="/tmp/x").store_access == "cached"
    with pytest.raises(ValueError):
        Provider(spark, Source("s", "csv", "x", Cadence(T(2020, 1, 1), HOUR, DAY, records_per_sample=1)))


def test_stored_arrays_by_record_and_through_the_cache(spark, tmp_path):
    base = f"{tmp_path}/store"
    s = OutputSchema({"time": 0, "x": 2}, "time", {"v": OutputVar(["time", "x"])}, {"time": 1, "x": 2}, {"time": 4, "x": 2}, {"x": ([5.0, 6.0], {}), "time": (None, {"units": "hours since 2020-01-01 00:00:00"})})
    with Writer(base, s) as w:
        w.record(spark.createDataFrame([(float(h), k, 10.0 * h + k) for h in (0, 6, 12, 18, 24) for k in (0, 1)], "time double, x int, v double"))
        assert w.flush()["total_records"] == 5 and w.flush()["total_records"] == 5
        with pytest.raises(ValueError):
            w.record(spark.range(1))
    with pytest.raises(ValueError):
        w.record(spark.range(1))
    with pytest.raises(NotImplementedError):
        Writer(base, s, region={"x": 0})
    c = Cadence(T(2020, 1, 1), 6 * HOUR, 2 * DAY, records_per_sample=1)
    for root in (None, f"{tmp_path}/cache"):
        p = Provider(spark, Source("z", "zarr", base, c, {"variable": "v"}), cache_root=root)
        assert values(p.refresh(T(2020, 1, 1, 13))[0], "x", "value") == [(0, 120.0), (1, 121.0)]
        assert values(p.refresh(T(2020, 1, 2, 1), select='{"axes": ["all", [1]]}')[0], "x", "value") == [(1, 241.0)]
        assert p.shape() == (5, 2) and p.coords["x"].count() == 2
    assert objects.list_prefix(f"{tmp_path}/cache", "meta", "")


def test_month_requests():
    url = requests.month_url(2018, 1, [8, 1, 8], ["temperature", "geopotential"], [850, 1000], requests.area(-100.5, 39.0, -80.2, 45.7))
    assert url.startswith(f"cds://{requests.DATASET}?" + '{"area":[47,-102,38,-79],"data_format":"netcdf","day":["01","08"]') and '"pressure_level":["1000","850"]' in url
    good = (2018, 2, [1], ["temperature"], [1000], [1, 0, 0, 1])
    for k, bad in ((2, []), (3, []), (4, []), (3, ["nothing"]), (5, [1, 2]), (2, [30])):
        with pytest.raises(ValueError):
            requests.month_request(*good[:k], bad, *good[k + 1 :])
    assert requests.months_in_span(T(2018, 12, 30), T(2019, 1, 2), datetime.timedelta(0)) == [(2018, 12, [30, 31]), (2019, 1, [1, 2])]
    assert requests.months_in_span(T(2018, 12, 1, 1), T(2018, 12, 1, 5))[0] == (2018, 11, [30])
    with pytest.raises(ValueError):
        requests.months_in_span(T(2019, 1, 2), T(2018, 1, 1))
    with pytest.raises(ValueError):
        requests.levels([38])
    assert requests.levels([1, 37]) == [1000, 1]


def test_settings_and_realms(monkeypatch, tmp_path):
    env = {"MERIDIAN_OFFLINE": " On ", "AWS_REGION": "b", "MERIDIAN_HTTP_TRIES": "x"}
    assert settings.flag("OFFLINE", env) and not settings.flag("LIVE", env)
    assert settings.region(None, env) == "b" and settings.region("a", env) == "a" and settings.region(None, env | {"MERIDIAN_S3_REGION": "c"}) == "c"
    with pytest.raises(Offline):
        settings.online(env)
    with pytest.raises(ValueError):
        settings.number("HTTP_TRIES", 3, env)
    assert settings.number("HTTP_TRIES", 3, {}) == 3 and settings.expand("file://${DATADIR}/x", {"MERIDIAN_DATADIR": "/d"}) == "file:///d/x"
    realms = settings.Realms(own=lambda: {"k": "v"})
    realms.register("fixed", {"a": "b"})
    assert realms.headers("own") == {"k": "v"} and realms.headers("fixed") == {"a": "b"} and realms.headers(None) == {}
    with pytest.raises(AuthError):
        realms.headers("other")
    store = settings.STORES["local"](str(tmp_path))
    store.put("blobs/ab/abc.nc", b"1")
    assert store.blob("abc") == "blobs/ab/abc.nc" and store.get("blobs/ab/abc.nc") == b"1" and store.delete("blobs/ab/abc.nc") and not store.delete("blobs/ab/abc.nc")
    for registry, name in ((settings.STORES, "s3"), (settings.WRITERS, "netcdf")):
        with pytest.raises(NotImplementedError):
            registry[name]
    assert issubclass(NotRegistered, MeridianError) and issubclass(Offline, MeridianError)


def test_csv_files_are_placed_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lat,name\n01,1.5,x\n\n02,2.5,\"q,\n\"\n")
    (tmp_path / "b.csv").write_text("name,id,lat\ny,03,20.5\n")
    (tmp_path / "c.csv").write_text("")
    got = files.csv_points(spark, str(tmp_path), ["lat"]).collect()
    assert sorted((r["id"], r["lat"], r["name"]) for r in got) == [("01", 1.5, "x"), ("02", 2.5, "q,\n"), ("03", 20.5, "y")]
    assert dict(files.csv_points(spark, str(tmp_path)).dtypes)["id"] == "double"
    assert files.csv_points(spark, str(tmp_path), [], variables=["name"]).columns == ["path", "index", "name"]
    assert files.csv_points(spark, f"{tmp_path}/c.csv").count() == 0
    for bad in ({"numeric_columns": ["none"]}, {"variables": ["none"]}):
        with pytest.raises(NoSuchVariable):
            files.csv_points(spark, str(tmp_path), **bad)
    (tmp_path / "d.csv").write_text("id,lat\n1,2\n")
    with pytest.raises(Exception, match="columns"):
        files.csv_points(spark, str(tmp_path), []).collect()


def test_netcdf_variables_and_ranges(spark, folder):
    assert netcdf.signatures(f"{folder}/20200101.nc") == {("x",): ["still"], ("time", "x"): ["v"]}
    with pytest.raises(NoSuchVariable):
        files.netcdf(spark, str(folder), variables=["w"])
    with pytest.raises(ValueError):
        files.netcdf(spark, str(folder))
    shown, netcdf.PIECE = netcdf.PIECE, 16
    try:
        assert netcdf.open_file(f"{folder}/20200101.nc").pieces("v", 16) == [(k, k + 1) for k in range(4)]
        assert files.netcdf(spark, str(folder), variables=["v"]).agg({"v": "sum"}).first()[0] == 0
    finally:
        netcdf.PIECE = shown
    assert netcdf.time_length(spark, str(folder)) == 8


def test_a_key_is_fetched_once_by_several_jobs(spark, tmp_path):
    asked, root = [], str(tmp_path / "cache")
    source_ = tmp_path / "one.bin"
    source_.write_bytes(b"x" * 1000)
    df = spark.createDataFrame([(f"file://{source_}",)], "url string")
    jobs = [threading.Thread(target=lambda: asked.extend(r["status"] for r in cache.fetch(df, root).collect())) for _ in range(4)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert sorted(asked) == ["downloaded", "hit", "hit", "hit"]
    assert [r["status"] for r in cache.fetch(df, root, verify_on_read=True).collect()] == ["hit"]
    path = objects.list_prefix(root, f"blobs/{cache.fetch(df, root).first()['key'][:2]}", "")[0]
    objects.put(root, path, b"other")
    with pytest.raises(cache.IntegrityError):
        cache.fetch(df, root, verify_on_read=True)
    with cache.locked(root, "k"), pytest.raises(TimeoutError):
        _wait(root)
    for bad in ({"schema": "manifest/v1"}, {"schema": "manifest/v1", "url": "u", "sha256_content": "0", "bytes": 1, "fetched_at": "now"}):
        with pytest.raises(ValueError):
            cache.check_manifest(bad)


def _wait(root):
    done = threading.Event()

    def take():
        with cache.locked(root, "k", stale_seconds=3600, poll_seconds=0.01):
            done.set()

    threading.Thread(target=take, daemon=True).start()
    if not done.wait(0.3):
        raise TimeoutError


def test_rotated_grids():
    raw = bytearray(encoders.tiff(np.arange(12.0).reshape(1, 3, 4), -1, 2, 0.5, 0.25))
    from meridian.sources.tiff import Tiff

    t = Tiff(bytes(raw))
    assert t.centres(0, 0) == (-0.75, 1.875) and t.projected is False
    t.affine = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    assert t.centres(1, 2) == (2.5 + 3.0 + 3.0, 10.0 + 7.5 + 6.0)


def test_dumps_are_compared(spark, folder):
    from meridian.plans import dumps

    def decode(shift=0.0):
        df = files.netcdf(spark, f"{folder}/20200101.nc", variables=["v"]).selectExpr("time_idx", "x_idx", f"v + {shift} AS v")
        return {"variables": {"v": dumps.field(df, ["time", "x"], "v")}, "coords": {"x": dumps.field(netcdf.coordinates(spark, f"{folder}/20200101.nc")["x"], ["x"], "x", units="m")}}

    cases = {"one": ("netcdf", decode), "two": ("grib", decode)}
    a = dumps.dump("native-dump/v1", "p", ["netcdf", "csv"], cases)
    b = dumps.dump("native-dump/v1", "p", ["netcdf"], {"one": ("netcdf", lambda: decode(1e-7)), "two": ("grib", decode)})
    c = dumps.dump("native-dump/v1", "p", ["netcdf"], {"one": ("netcdf", lambda: decode(1.0))})
    assert a["cases"]["one"]["variables"]["v"]["shape"] == [4, 2] and a["cases"]["two"]["status"] == "skipped" and a["cases"]["one"]["coords"]["x"]["data"] == [5.0, 6.0]
    assert dumps.differences(a, b) == [] and dumps.differences(a, c) == ["one/v[0]: 100.0 and 101.0", "two: missing"]
    assert dumps.uncovered([a, b]) == ["two"] and dumps.uncovered([a, c], everyone=True) == ["two"]
    assert dumps.same(None, None) and not dumps.same(None, 0.0)


def test_freshness_kinds_and_strict_schemes(spark):
    from meridian.functions import keys

    assert cache.Temporal.static() == cache.Temporal.closed_period() and cache.Temporal.incomplete(HOUR).ttl_seconds == 3600
    df = spark.createDataFrame([("S3://x",), ("none",)], "u string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(keys.scheme_of(F.col("u"))).collect()] == ["s3", None]
    with pytest.raises(Exception, match="no scheme"):
        df.select(keys.scheme_of(F.col("u"), strict=True)).collect()
