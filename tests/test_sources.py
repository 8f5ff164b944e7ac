"""Readers, sink, cache, provider and tick stream on fixtures built here."""

import datetime
import hashlib
import http.server
import io
import itertools
import json
import math
import struct
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.plans.provider import Cadence, Provider, Source
from meridian.sources import cache, codecs, files, jobs, objects
from meridian.sources.registry import Registry
from meridian.sources.zarr import ZarrSource
from meridian.sources.zarr_sink import OutputSchema, OutputVar, sink, write


def put_v2(root, name, data, chunks, dims, encode=None, compressor=None):
    meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "compressor": compressor, "fill_value": 0.0, "order": "C", "filters": None}
    objects.put(root, f"{name}/.zarray", json.dumps(meta).encode())
    objects.put(root, f"{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims}).encode())
    for ids in itertools.product(*[range(-(-n // c)) for n, c in zip(data.shape, chunks)]):
        part = np.zeros(chunks, data.dtype)
        view = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(ids, chunks))]
        part[tuple(slice(0, n) for n in view.shape)] = view
        objects.put(root, f"{name}/" + ".".join(map(str, ids)), (encode or (lambda b: b))(part.tobytes()))


@pytest.fixture()
def zarr(spark):
    spark.dataSource.register(ZarrSource)
    return lambda path, **options: spark.read.format("zarr").options(**options).load(str(path))


def test_selection_reads_only_needed_chunks(zarr, tmp_path):
    layer, y, x = np.indices((2, 5, 4))
    field = (100 * layer + 10 * y + x).astype("<f4")
    put_v2(str(tmp_path), "field3d", field, (1, 2, 4), ["layer", "y", "x"], lambda b: codecs.blosc_encode(b, 4), {"id": "blosc"})
    for ids in ("0.0.0", "0.1.0", "0.2.0", "1.1.0"):
        (tmp_path / "field3d" / ids).write_bytes(b"poison")
    got = zarr(tmp_path, variable="field3d", select=json.dumps([[1], {"indices": [1, 4]}, "all"])).orderBy("pos_y", "pos_x").collect()
    assert [r["value"] for r in got] == [110.0, 111.0, 112.0, 113.0, 140.0, 141.0, 142.0, 143.0]
    shape = zarr(tmp_path, variable="field3d", mode="shape").first()
    assert shape["shape"] == [2, 5, 4] and shape["dims"] == ["layer", "y", "x"]


def test_permuted_selection_keeps_its_order(zarr, tmp_path):
    a, s, r = np.indices((3, 50, 4))
    put_v2(str(tmp_path), "sr", (100000 * a + 100 * s + r).astype("<f8"), (1, 10, 4), ["layer", "source", "receptor"])
    got = zarr(tmp_path, variable="sr", select=json.dumps([[0], [24, 2, 9, 6, 2], [0]])).orderBy("pos_source").collect()
    assert [r["value"] for r in got] == [2400.0, 200.0, 900.0, 600.0, 200.0]
    with pytest.raises(Exception, match="out of range"):
        zarr(tmp_path, variable="sr", select=json.dumps([[9], [0], [0]])).collect()


def test_absent_chunks_have_the_fill_value(zarr, tmp_path):
    put_v2(str(tmp_path), "v", np.arange(6, dtype="<i4"), (2,), ["i"])
    (tmp_path / "v" / "1").unlink()
    assert [r["value"] for r in zarr(tmp_path, variable="v").orderBy("i").collect()] == [0, 1, 0, 0, 4, 5]


def test_codecs_round_trip():
    raw = np.arange(5000, dtype="<f8").tobytes()
    for profile in codecs.PROFILES:
        name = codecs.PROFILES[profile][0]
        assert codecs.decode(name, codecs.encode(profile, raw, 8)) == raw
    assert codecs.blosc_decode(codecs.blosc_encode(b"ab", 2)) == b"ab"
    assert codecs.crc32c(b"123456789") == 0xE3069283


@pytest.mark.parametrize("profile", ["diagnostic", "checkpoint", "wasm"])
def test_writer_round_trip_and_append(spark, zarr, tmp_path, profile):
    schema = OutputSchema({"time": 0, "y": 3, "x": 4}, "time", {"temp": OutputVar(["time", "y", "x"], "f8", {"units": "K"})}, {"time": 2, "y": 3, "x": 2}, {"time": 4, "y": 3, "x": 4}, {"y": ([10.0, 20.0, 30.0], {})}, profile)
    path = str(tmp_path / "out")
    cells = spark.range(60).select((F.floor(F.col("id") / 12) * 3600.0).alias("time"), (F.floor(F.col("id") / 4) % 3).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"))
    cells = cells.withColumn("temp", 100 * F.col("time") / 3600 + 10 * F.col("y") + F.col("x"))
    one = write(cells.where("time < 7200"), path, schema)
    assert one["total_records"] == 2 and len(one["shards"]) == 1
    two = write(cells, path, schema)
    assert two["total_records"] == 5 and [s["n_records"] for s in two["shards"]] == [4, 1] and two["last_t"] == 14400.0
    got = zarr(path, variable="temp").collect()
    assert len(got) == 60 and all(r["value"] == 100 * r["time"] + 10 * r["y"] + r["x"] for r in got)
    assert [r["value"] for r in zarr(path, variable="time").orderBy("time").collect()] == [0.0, 3600.0, 7200.0, 10800.0, 14400.0]
    assert write(cells, path, schema) == two
    with pytest.raises(ValueError):
        write(cells, path, OutputSchema({"time": 0, "y": 3}, "time", {"t": OutputVar(["time", "y"])}, {"time": 2, "y": 2}, {"time": 4, "y": 3}))


def test_stream_sink_resumes(spark, zarr, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    schema = OutputSchema({"time": 0, "x": 2}, "time", {"v": OutputVar(["time", "x"])}, {"time": 1, "x": 2}, {"time": 2, "x": 2})
    rows = spark.range(6).select((F.col("id") / 2).cast("int").cast("double").alias("time"), (F.col("id") % 2).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    rows.where("time < 1").write.parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(src)
    sink(stream(), out, schema, check).awaitTermination()
    rows.where("time >= 1").write.mode("append").parquet(src)
    sink(stream(), out, schema, check).awaitTermination()
    assert sorted(r["value"] for r in zarr(out, variable="v").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def netcdf_bytes():
    def name(s):
        return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    def text(n, v):
        return name(n) + struct.pack(">ii", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)

    raw = np.array([[[250, 260], [270, -32767]], [[251, 261], [271, 281]]], ">i2")
    lat, t = np.array([40.0, 39.5], ">f8"), np.array([0, 1], ">i4")
    packing = name("scale_factor") + struct.pack(">iid", 6, 1, 0.01) + name("add_offset") + struct.pack(">iid", 6, 1, 280.0) + name("_FillValue") + struct.pack(">ii", 3, 1) + struct.pack(">hxx", -32767)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 3) + b"".join(name(n) + struct.pack(">i", k) for n, k in (("time", 2), ("lat", 2), ("lon", 2))) + struct.pack(">ii", 0, 0)
    units = text("units", "hours since 2018-11-08 00:00:00")

    def build(at):
        out, offset = b"", at
        for n, dims, attrs, kind, data in (("t2m", [0, 1, 2], (3, packing), 3, raw), ("lat", [1], (0, b""), 6, lat), ("time", [0], (1, units), 4, t)):
            size = -(-data.nbytes // 4) * 4
            out += name(n) + struct.pack(">i", len(dims)) + struct.pack(f">{len(dims)}i", *dims) + struct.pack(">ii", 12 if attrs[0] else 0, attrs[0]) + attrs[1] + struct.pack(">iii", kind, size, offset)
            offset += size
        return out

    lead = head + struct.pack(">ii", 11, 3)
    return lead + build(len(lead) + len(build(0))) + raw.tobytes() + lat.tobytes() + t.tobytes()


def test_netcdf(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(netcdf_bytes())
    got = files.netcdf(spark, str(tmp_path / "a.nc"), "t2m").orderBy("time_idx", "lat_idx", "lon_idx").collect()
    assert [round(r["value"], 2) for r in got if not math.isnan(r["value"])] == [282.5, 282.6, 282.7, 282.51, 282.61, 282.71, 282.81]
    assert got[2]["lat"] == 39.5 and got[7]["time"] == 1.0
    with pytest.raises(KeyError):
        files.netcdf(spark, str(tmp_path / "a.nc"), "nothing")
    (tmp_path / "b.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(codecs.Unsupported):
        files.netcdf(spark, str(tmp_path / "b.nc"), "t2m")


def test_geotiff(spark, tmp_path):
    import zlib

    data = np.arange(12, dtype="<f4").reshape(3, 4)
    data[1, 1] = -9999
    body = zlib.compress(data.tobytes())
    extra = struct.pack("<3d", 0.5, 0.5, 0) + struct.pack("<6d", 0, 0, 0, -121.5, 40.0, 0) + struct.pack("<8H", 1, 1, 0, 1, 1024, 0, 1, 2) + b"-9999\0"
    at = 8
    spots = {33550: at + len(body), 33922: at + len(body) + 24, 34735: at + len(body) + 72, 42113: at + len(body) + 88}
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 32), (259, 3, 1, 8), (273, 4, 1, at), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 1, len(body)), (339, 3, 1, 3), (33550, 12, 3, spots[33550]), (33922, 12, 6, spots[33922]), (34735, 3, 8, spots[34735]), (42113, 2, 6, spots[42113])]
    head = b"II*\0" + struct.pack("<I", at + len(body) + len(extra))
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    (tmp_path / "a.tif").write_bytes(head + body + extra + ifd)
    got = files.geotiff(spark, str(tmp_path / "a.tif")).orderBy("lat_idx", "lon_idx").collect()
    assert got[0]["lat"] == 39.75 and got[0]["lon"] == -121.25 and got[11]["Band1"] == 11.0 and math.isnan(got[5]["Band1"])


def test_big_tiff():
    data = np.arange(6, dtype="<u2").reshape(2, 3)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1), (273, 16, 1, 16), (277, 3, 1, 1), (278, 3, 1, 2), (279, 16, 1, 12), (33550, 12, 3, 32), (33922, 12, 6, 56)]
    geo = struct.pack("<3d", 2, 1, 0) + struct.pack("<6d", 0, 0, 0, 10, 50, 0)
    ifd = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + bytes(8)
    raw = b"II" + struct.pack("<HHHQ", 43, 8, 0, 104) + data.tobytes() + bytes(4) + geo + ifd
    bands, x, y, projected = files.read_tiff(raw)
    assert bands[0].tolist() == data.tolist() and x.tolist() == [11, 13, 15] and y.tolist() == [49.5, 48.5] and not projected
    with pytest.raises(ValueError):
        files.read_tiff(b"II" + struct.pack("<H", 44) + raw[4:])


def shape_zip(member="layer/p"):
    square = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    island = [(5, 5), (6, 5), (5, 6), (5, 5)]

    def polygon(parts):
        points = [p for ring in parts for p in ring]
        starts = list(itertools.accumulate([0] + [len(r) for r in parts[:-1]]))
        xs, ys = zip(*points)
        return struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)

    bodies = [polygon([square]), polygon([square, island]), polygon([island]), struct.pack("<i", 0)]
    shp = b"\0" * 100 + b"".join(struct.pack(">2i", k + 1, len(b) // 2) + b for k, b in enumerate(bodies))
    cols = [("NAME", b"C", 8), ("EMIS", b"N", 6), ("FLAG", b"L", 1)]
    rows = [b" Alpha     1.50T", b"\0Bravo     2.25F", b"*Gone      9.00T", b" Null           "]
    rows = [r.ljust(16) for r in rows]
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(cols) + 1, 16) + b"".join(n.encode().ljust(11, b"\0") + t + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in cols) + b"\r" + b"".join(rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for ext, raw in (("shp", shp), ("dbf", dbf), ("prj", b"WKT")):
            z.writestr(f"{member}.{ext}", raw)
    return out.getvalue()


def test_shapefile(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(shape_zip())
    got = files.shapefile(spark, str(tmp_path / "a.zip")).orderBy("index").collect()
    assert [(r["NAME"], r["shape_index"], r["part_index"], r["n_parts"], r["n_vertices"]) for r in got] == [("Alpha", 0, 0, 1, 5), ("Bravo", 1, 0, 2, 5), ("Bravo", 1, 1, 2, 4), ("Null", 2, 0, 1, 0)]
    assert all(len(r["geometry"]) == 5 for r in got) and got[2]["geometry"][4] == [5.0, 5.0] and got[2]["xmax"] == 6.0
    assert got[0]["EMIS"] == 1.5 and math.isnan(got[3]["EMIS"]) and got[0]["FLAG"] is True and got[0]["shape_type"] == "Polygon" and got[0]["crs_wkt"] == "WKT"
    with pytest.raises(Exception, match="more than 3"):
        files.shapefile(spark, str(tmp_path / "a.zip"), nvert_max=3).collect()


def ff10_line(region, pol, value, name="x"):
    row = dict.fromkeys(files.FF10_POINT, "") | {"COUNTRY_CD": "US", "REGION_CD": region, "POLID": pol, "ANN_VALUE": value, "FACILITY_NAME": name}
    return ",".join(f'"{v}"' if "," in v else v for v in row.values())


def test_ff10(spark, tmp_path):
    body = "#FORMAT\n  # note\n\n" + ff10_line("01001", "NOX", "123.45", "A, B") + "\n" + ff10_line("01003", "SO2", "") + "\n"
    (tmp_path / "p.csv").write_text(body)
    got = files.ff10(spark, str(tmp_path / "p.csv")).orderBy("index").collect()
    assert [r["REGION_CD"] for r in got] == ["01001", "01003"] and got[0]["ANN_VALUE"] == 123.45 and math.isnan(got[1]["ANN_VALUE"]) and got[0]["FACILITY_NAME"] == "A, B"
    head = ",".join(files.FF10_POINT).lower()
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for n, v in (("point/egu_b.csv", "2"), ("point/egu_a.csv", "1"), ("point/other.csv", "3")):
            z.writestr(n, f"{head}\n{ff10_line('1', 'X', v)}\n")
        z.writestr("point_egu/", "")
    got = files.ff10(spark, str(tmp_path / "p.zip"), member_glob="*egu*", skip_header_row=True).orderBy("index").collect()
    assert [(r["member"], r["ANN_VALUE"]) for r in got] == [("point/egu_a.csv", 1.0), ("point/egu_b.csv", 2.0)]
    with pytest.raises(Exception, match="no header row"):
        files.ff10(spark, str(tmp_path / "p.csv"), skip_header_row=True).collect()
    assert len(files.FF10_POINT) == 77 and len(files.FF10_NUMERIC) == 42


def test_csv_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,value,note\n007,1.5,"a,b"\n\n008,2.5,\n')
    got = files.csv_points(spark, str(tmp_path / "a.csv"), ["value"]).orderBy("index").collect()
    assert [(r["id"], r["value"], r["note"]) for r in got] == [("007", 1.5, "a,b"), ("008", 2.5, "")]


def test_cache_fetches_once_and_works_offline(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text(f"body {k}")
    urls = spark.createDataFrame([(f"file://{tmp_path}/f{k % 3}.txt",) for k in range(9)], "url string")
    root = str(tmp_path / "cache")
    assert sorted(r["status"] for r in cache.fetch(urls, root).collect()) == ["downloaded"] * 3
    for k in range(3):
        (tmp_path / f"f{k}.txt").unlink()
    assert {r["status"] for r in cache.fetch(urls, root, offline=True).collect()} == {"hit"}
    cache.check(spark, root)
    with pytest.raises(cache.CacheMiss):
        cache.fetch(spark.createDataFrame([("file:///nowhere/x",)], "url string"), root, offline=True)
    blob = next((tmp_path / "cache" / "blobs").rglob("*.txt"))
    blob.write_text("changed")
    with pytest.raises(cache.IntegrityError):
        cache.check(spark, root)


def test_mirrors_are_tried_in_order(spark, tmp_path):
    (tmp_path / "m.txt").write_text("x")
    urls = spark.createDataFrame([(f"file://{tmp_path}/gone.txt", [f"file://{tmp_path}/m.txt"])], "url string, mirrors array<string>")
    assert cache.fetch(urls, str(tmp_path / "c")).first()["status"] == "downloaded"


@pytest.fixture()
def server():
    """A server with one tagged object and a job service; it notes what it is asked."""
    asked, state = [], {"body": b"one", "tag": '"1"', "polls": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def answer(self, code, body=b"", **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            asked.append((self.path, self.headers.get("If-None-Match"), self.headers.get("PRIVATE-TOKEN")))
            if self.path == "/o.bin":
                if self.headers.get("If-None-Match") == state["tag"]:
                    return self.answer(304)
                return self.answer(200, state["body"], ETag=state["tag"])
            if self.path.endswith("/jobs/7"):
                state["polls"] += 1
                return self.answer(200, json.dumps({"status": "successful" if state["polls"] > 1 else "running"}).encode())
            if self.path.endswith("/jobs/7/results"):
                return self.answer(200, json.dumps({"asset": {"value": {"href": f"http://127.0.0.1:{self.server.server_port}/made"}}}).encode())
            return self.answer(200, b"made") if self.path == "/made" else self.answer(404)

        def do_POST(self):
            asked.append((self.path, None, self.headers.get("PRIVATE-TOKEN")))
            state["inputs"] = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = self.path.endswith("/processes/era/execution")
            self.answer(201 if good else 400, json.dumps({"status": "accepted", "jobID": "7"}).encode())

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked, state
    httpd.shutdown()
    httpd.server_close()


def test_conditional_requests(spark, tmp_path, server):
    base, asked, state = server
    root = str(tmp_path / "cache")
    fixed = spark.createDataFrame([(f"{base}/o.bin",)], "url string")
    changing = fixed.withColumn("immutable", F.lit(False))
    status = lambda urls: cache.fetch(urls, root).first()["status"]
    assert status(changing) == "downloaded" and cache.manifests(spark, root).first()["etag"] == '"1"'
    assert status(fixed) == "hit" and len(asked) == 1
    assert status(changing) == "not_modified" and asked[-1][1] == '"1"'
    cache.check(spark, root)
    state.update(body=b"two!", tag='"2"')
    assert status(changing) == "downloaded"
    cache.check(spark, root)
    next((tmp_path / "cache" / "blobs").rglob("*.bin")).unlink()
    assert status(changing) == "downloaded" and asked[-1][1] is None  # validators of a lost object are not used
    sha = hashlib.sha256(b"two!").hexdigest()
    assert status(fixed.withColumn("expected_sha", F.lit(sha))) == "hit"
    with pytest.raises(Exception, match="expected 00"):
        cache.fetch(fixed.withColumn("expected_sha", F.lit("00")), root)
    with pytest.raises(Exception, match="absent"):
        cache.fetch(spark.createDataFrame([(f"{base}/none",)], "url string"), root)
    next((tmp_path / "cache" / "meta").glob("*.json")).unlink()
    assert cache.fetch(fixed, root, offline=True).first()["status"] == "hit"  # held without a manifest


def test_job_service(spark, tmp_path, server, monkeypatch):
    base, asked, state = server
    url = jobs.encode("era", {"b": [1, 2], "a": {"d": "x", "c": None}})
    assert url == 'cds://era?{"a":{"c":null,"d":"x"},"b":[1,2]}' and jobs.decode(url) == ("era", {"b": [1, 2], "a": {"d": "x", "c": None}})
    for bad in ("http://era?{}", "cds://era", "cds://?{}", "cds://era?[1]", "cds://era?{"):
        with pytest.raises(ValueError):
            jobs.decode(bad)
    service = jobs.JobService(base, {"PRIVATE-TOKEN": "k"}, poll_seconds=0.01)
    got = cache.fetch(spark.createDataFrame([(url,)], "url string"), str(tmp_path / "c"), transports={"cds": cache.by_service(service)}).first()
    assert got["status"] == "downloaded" and (tmp_path / "c" / got["path"]).read_bytes() == b"made"
    assert state["inputs"] == {"inputs": jobs.decode(url)[1]} and state["polls"] == 2
    assert [token for path, _, token in asked if path != "/made"] == ["k"] * 4 and asked[-1] == ("/made", None, None)
    assert "k" not in {v for r in cache.manifests(spark, str(tmp_path / "c")).collect() for v in r}
    with pytest.raises(jobs.JobError):
        service.submit("other", {})
    for name in ("CDSAPI_URL", "CDSAPI_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert jobs.settings(tmp_path) == {"url": jobs.API}
    (tmp_path / ".cdsapirc").write_text("url: https://h/api/\nkey: one\nkey: two\n")
    assert jobs.settings(tmp_path) == {"url": "https://h/api", "key": "one"}
    monkeypatch.setenv("CDSAPI_KEY", "three")
    assert jobs.settings(tmp_path)["key"] == "three"


def test_registry_refuses_conflicts():
    r = Registry("format", a=len)
    r.register("a", len)
    r.register("later", status="stub", note="Not yet.")
    assert list(r) == ["a", "later"] and r["a"] is len and [d["status"] for d in r.describe()] == ["implemented", "stub"] and list(r.implemented()) == ["a"]
    with pytest.raises(ValueError):
        r.register("a", max)
    with pytest.raises(ValueError):
        r.register("b", max, status="maybe")
    with pytest.raises(codecs.Unsupported, match="Not yet"):
        r["later"]
    with pytest.raises(KeyError):
        r["none"]


def test_bit_shuffle():
    assert codecs.shuffle_bits(bytes([3, 1, 0, 0, 0, 0, 0, 128]), 1) == bytes([3, 1, 0, 0, 0, 0, 0, 128])
    assert codecs.shuffle_bits(bytes([1, 2, 0, 0, 0, 0, 0, 1]), 1) == bytes([129, 2, 0, 0, 0, 0, 0, 0])
    raw = np.random.default_rng(1).integers(0, 2**40, 1000).astype("<i8").tobytes()
    for width in (1, 2, 8):
        assert codecs.unshuffle_bits(codecs.shuffle_bits(raw, width), width) == raw
    import zstandard

    body = zstandard.ZstdCompressor().compress(codecs.shuffle_bits(raw, 8))
    frame = struct.pack("<BBBBIIIIi", 2, 1, 0x80 | 0x10 | 4, 8, len(raw), len(raw), len(body) + 24, 20, len(body)) + body
    assert codecs.blosc_decode(frame) == raw


def test_provider(spark, tmp_path):
    for day in (1, 2):
        (tmp_path / f"f202401{day:02d}.csv").write_text(f"v\n{day}\n")
    d = datetime.datetime
    c = Cadence(d(2024, 1, 1), datetime.timedelta(hours=6), datetime.timedelta(days=1), d(2024, 1, 3))
    p = Provider(spark, Source("s", "csv", f"{tmp_path}/f%Y%m%d.csv", c, {"numeric_columns": ["v"]}))
    df, changed = p.refresh(d(2024, 1, 2, 7))
    assert df.first()["v"] == 2.0 and changed and not p.refresh(d(2024, 1, 2, 8))[1]
    assert p.refresh_times().count() == 8 and not p.is_const
    with pytest.raises(ValueError):
        p.refresh(d(2023, 1, 1))
    with pytest.raises(LookupError):
        Provider(spark, Source("s", "grib", "x"))


def test_tick_stream(spark, tmp_path):
    from meridian.streaming.ticks import TickSource

    spark.dataSource.register(TickSource)
    ticks = spark.readStream.format("cadence_ticks").options(start="2024-01-01", step_seconds="3600", end="2024-01-01 05:30:00").load()
    q = ticks.writeStream.format("memory").queryName("tick_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["tick_index"] for r in spark.table("tick_rows").orderBy("tick_index").collect()] == [0, 1, 2, 3, 4, 5]
