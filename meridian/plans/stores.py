"""Registered queries that write a table in a format of the sources, below the shared scratch folder, and read it back through the engine's readers.

Every row takes part. Files hold a bounded number of rows each and are written by the tasks that hold them.
"""

from __future__ import annotations

import csv
import datetime
import io
import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import decode, times
from ..operators import select
from ..operators.order import durable, scratch
from ..sources import cache, codecs, files, netcdf, objects, requests, settings, zarr, zarr_sink
from ..streaming.ticks import TickSource
from . import encoders
from .catalog import _DIMS, query
from .provider import Cadence, Provider, Source

ROWS = 4096  # rows of a file


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _vectors(embeddings):
    return embeddings.select(F.col("vec_id").cast("long").alias("vec"), "embedding", F.floor(F.col("vec_id") / ROWS).alias("file"))


@query(f"SELECT CAST(vec_id AS DOUBLE) AS vec, CAST(dim AS INTEGER) AS dim_idx, CAST(value AS DOUBLE) AS value FROM {_DIMS}", "embeddings")
def scan_netcdf(spark, embeddings):
    """Records of 64 floats with their own coordinate, growing along the first axis."""

    def encode(pdf):
        pdf = pdf.sort_values("vec")
        return encoders.netcdf({"vec": 0, "dim": 64}, {"vec": (["vec"], pdf["vec"].to_numpy(">f8"), {}), "value": (["vec", "dim"], encoders.rows_of(pdf, "embedding").astype(">f4"), {})})

    folder = encoders.write_groups(_vectors(embeddings), "file", _folder(spark, "netcdf"), "nc", encode)
    return files.netcdf(spark, folder, variables=["value"]).select("vec", "dim_idx", "value")


@query("SELECT CAST(p_partkey AS DOUBLE) AS part, CASE WHEN p_size = 7 THEN NULL ELSE p_size * CAST(0.5 AS DOUBLE) + 10 END AS size, CAST(p_partkey % 1000 AS BIGINT) AS code FROM part", "part")
def scan_netcdf_packed(spark, part):
    """Packed shorts with a fill value beside plain integers, read as two variables at once."""

    def encode(pdf):
        pdf = pdf.sort_values("p_partkey")
        packing = {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": -999}
        raw = np.where(pdf["p_size"] == 7, -999, pdf["p_size"]).astype(">i2")
        key = pdf["p_partkey"].to_numpy()
        return encoders.netcdf({"part": len(pdf)}, {"size": (["part"], raw, packing), "part": (["part"], key.astype(">f8"), {}), "code": (["part"], (key % 1000).astype(">i4"), {})})

    rows = part.select("p_partkey", "p_size", F.floor(F.col("p_partkey") / ROWS).alias("file"))
    folder = encoders.write_groups(rows, "file", _folder(spark, "packed"), "nc", encode)
    return encoders.no_nan(files.netcdf(spark, folder, variables=["size", "code"])).select("part", "size", "code")


@query(f"SELECT CAST(0 - vec_id AS DOUBLE) AS lat, CAST(dim AS DOUBLE) AS lon, CASE WHEN value > 0.2 THEN NULL ELSE CAST(value AS DOUBLE) END AS level FROM {_DIMS}", "embeddings")
def scan_geotiff(spark, embeddings):
    """Rasters of 64 columns whose cell centres are the ids, with a missing value."""

    def encode(pdf):
        pdf = pdf.sort_values("vec")
        first, last = int(pdf["vec"].iloc[0]), int(pdf["vec"].iloc[-1])
        data = np.full((1, last - first + 1, 64), -9999.0)
        data[0, pdf["vec"].to_numpy() - first] = encoders.rows_of(pdf, "embedding")
        data[data > np.float32(0.2)] = -9999.0
        return encoders.tiff(data, -0.5, 0.5 - first, 1.0, 1.0, "-9999")

    folder = encoders.write_groups(_vectors(embeddings), "file", _folder(spark, "tiff"), "tif", encode)
    return encoders.no_nan(files.geotiff(spark, folder, band_names=["level"])).select("lat", "lon", "level")


def _csv(spark, part, name):
    def encode(pdf):
        out = io.StringIO()
        order = ["p_partkey", "p_name", "p_size"] if int(pdf["file"].iloc[0]) % 2 else ["p_size", "p_partkey", "p_name"]
        lines = csv.writer(out, lineterminator="\n")
        lines.writerow(order)
        lines.writerows(pdf.sort_values("p_partkey")[order].astype(str).values.tolist())
        return out.getvalue().encode()

    rows = part.select("p_partkey", "p_name", F.lpad(F.col("p_size").cast("string"), 4, "0").alias("p_size"), F.floor(F.col("p_partkey") / 512).alias("file"))
    return encoders.write_groups(rows, "file", _folder(spark, name), "csv", encode)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part", "part")
def scan_csv(spark, part):
    """Files whose columns stand in different orders; digits stay text unless declared."""
    return files.csv_points(spark, _csv(spark, part, "csv"), numeric_columns=["p_size"], variables=["p_partkey", "p_size"]).select("p_partkey", "p_size")


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part", "part")
def scan_csv_inferred(spark, part):
    """Without a declaration, columns of numbers only are numbers."""
    return files.csv_points(spark, _csv(spark, part, "inferred")).select("p_partkey", "p_name", "p_size")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS FACILITY_ID, o_orderpriority AS POLID, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS ANN_VALUE FROM orders WHERE o_orderkey % 2 = 0", "orders")
def scan_ff10(spark, orders):
    """Zipped members chosen by a glob, with header and comment lines; blank numbers are missing. The odd keys are in members that the glob leaves out."""

    def encode(pdf):
        members = {}
        for odd, name in ((0, "egu_even.csv"), (1, "other_odd.csv")):
            out = io.StringIO()
            out.write("#FORMAT=FF10_POINT\n" + ",".join(files.FF10_POINT).lower() + "\n  # a comment\n\n")
            lines = csv.writer(out, lineterminator="\n")
            for key, priority, price, status in pdf[pdf["o_orderkey"] % 2 == odd][["o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"]].itertuples(index=False):
                cells = dict.fromkeys(files.FF10_POINT, "") | {"FACILITY_ID": key, "POLID": priority, "ANN_VALUE": "" if status == "P" else repr(price), "COMMENT": 'a "quoted", comment'}
                lines.writerow(cells.values())
            members[name] = out.getvalue().encode()
        return encoders.zipped(members)

    rows = orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", F.floor(F.col("o_orderkey") / ROWS).alias("file"))
    folder = encoders.write_groups(rows, "file", _folder(spark, "ff10"), "zip", encode)
    got = files.ff10(spark, folder, member_glob="egu*", skip_header_row=True, variables=["FACILITY_ID", "POLID", "ANN_VALUE"])
    return encoders.no_nan(got).select("FACILITY_ID", "POLID", "ANN_VALUE")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS NAME, c_acctbal AS BAL, p AS part_index, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_parts, 4 + p AS n_vertices,
       CAST(c_nationkey AS DOUBLE) AS xmin, CAST(c_nationkey + CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS xmax, 'Polygon' AS shape_type
       FROM customer, (SELECT unnest([0, 1])::INTEGER AS p) WHERE c_custkey % 7 <> 0 AND (p = 0 OR c_custkey % 2 = 0)""",
    "customer",
)
def scan_shapefile(spark, customer):
    """A polygon a customer, of two parts for even keys; every seventh record is marked as deleted."""

    def encode(pdf):
        shapes = []
        for key, x in zip(pdf["c_custkey"], pdf["c_nationkey"].astype(float)):
            one = [(x, 0.0), (x, 1.0), (x + 1, 1.0), (x, 0.0)]
            shapes.append([one] if key % 2 else [one, [(x + 2, 0.0), (x + 2, 1.0), (x + 3, 1.0), (x + 3, 0.0), (x + 2, 0.0)]])
        rows = [[str(k), repr(float(b))] for k, b in zip(pdf["c_custkey"], pdf["c_acctbal"])]
        return encoders.shapefile_zip(shapes, [("NAME", "C", 12), ("BAL", "N", 20)], rows, [k % 7 == 0 for k in pdf["c_custkey"]])

    rows = customer.select("c_custkey", "c_nationkey", "c_acctbal", F.floor(F.col("c_custkey") / ROWS).alias("file"))
    folder = encoders.write_groups(rows, "file", _folder(spark, "shapes"), "zip", encode)
    got = files.shapefile(spark, folder, nvert_max=5)
    return got.select("NAME", "BAL", "part_index", "n_parts", "n_vertices", "xmin", "xmax", "shape_type")


@query("SELECT conv_id, turn, role, text FROM conversations", "conversations")
def scan_json(spark, conversations):
    folder = _folder(spark, "json")
    conversations.select("conv_id", "turn", "role", "text").write.json(folder)
    return files.json_points(spark, folder, "conv_id long, turn long, role string, text string")


def _zarr_v2(spark, embeddings) -> str:
    """An array [vec, 64] in chunks of 256 x 16, byte shuffled blosc frames, written by the tasks that hold the vectors."""
    base = _folder(spark, "zarr2")
    total = embeddings.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]
    meta = {"zarr_format": 2, "shape": [total, 64], "chunks": [256, 16], "dtype": "<f4", "fill_value": 0.0, "order": "C", "filters": None, "compressor": {"id": "blosc"}}
    objects.put(base, "v/.zarray", zarr.json.dumps(meta).encode())
    objects.put(base, "v/.zattrs", b'{"_ARRAY_DIMENSIONS": ["vec", "dim"]}')

    def save(pdf):
        row = int(pdf["file"].iloc[0])
        block = np.zeros((256, 64), "<f4")
        block[pdf["vec"].to_numpy() - row * 256] = encoders.rows_of(pdf, "embedding")
        for k in range(4):
            objects.put(base, f"v/{row}.{k}", codecs.blosc_encode(np.ascontiguousarray(block[:, 16 * k : 16 * k + 16]).tobytes(), 4))
        return pdf[["vec"]].iloc[:1]

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec"), "embedding", F.floor(F.col("vec_id") / 256).alias("file"))
    rows.groupBy("file").applyInPandas(save, "vec long").agg(F.count("*")).collect()  # a single row
    return base


def _read(spark, base, variable, **options):
    spark.dataSource.register(zarr.ZarrSource)
    return spark.read.format("zarr").options(variable=variable, **options).load(base)


@query(f"SELECT CAST(vec_id AS INTEGER) AS vec, CAST(dim AS INTEGER) AS dim, CAST(value AS DOUBLE) AS value FROM {_DIMS}", "embeddings")
def scan_zarr(spark, embeddings):
    return _read(spark, _zarr_v2(spark, embeddings), "v").select("vec", "dim", "value")


@query(f"SELECT CAST((vec_id - 3) // 7 AS INTEGER) AS pos_vec, CAST(list_position([60, 2, 17], dim) - 1 AS INTEGER) AS pos_dim, CAST(value AS DOUBLE) AS value FROM {_DIMS} WHERE vec_id >= 3 AND (vec_id - 3) % 7 = 0 AND dim IN (60, 2, 17)", "embeddings")
def select_zarr(spark, embeddings):
    """A stride along one axis and chosen indices of the other, pushed into the read; the stride runs over the whole axis."""
    return _read(spark, _zarr_v2(spark, embeddings), "v", select='{"axes": [{"slice": [3, 1000000000, 7]}, [60, 2, 17]]}').select("pos_vec", "pos_dim", "value")


@query("SELECT max(vec_id) + 1 AS n_vec, CAST(64 AS BIGINT) AS n_dim, 'vec,dim' AS dims FROM embeddings", "embeddings")
def probe_zarr(spark, embeddings):
    """Shape and names from the metadata of a stored array; no chunk is touched."""
    got = _read(spark, _zarr_v2(spark, embeddings), "v", mode="shape")
    return got.select(F.col("shape")[0].alias("n_vec"), F.col("shape")[1].alias("n_dim"), F.array_join("dims", ",").alias("dims"))


def _schema() -> zarr_sink.OutputSchema:
    return zarr_sink.OutputSchema({"t": 0, "dim": 64}, "t", {"v": zarr_sink.OutputVar(["t", "dim"], "f4")}, {"t": 64, "dim": 32}, {"t": 256, "dim": 64}, {"dim": (np.arange(64), {}), "t": (None, {"units": "seconds since 1970-01-01"})})


def _written(spark, embeddings):
    """Written in two parts; the second one finds the first's last shard open and commits it anew."""
    base = _folder(spark, "zarr3")
    cells = embeddings.select(F.col("vec_id").cast("double").alias("t"), F.posexplode("embedding").alias("dim", "v"))
    middle = embeddings.agg(F.avg("vec_id")).first()[0] or 0
    with settings.WRITERS["zarr"](base, _schema()) as writer:
        writer.record(cells.where(F.col("t") <= middle))
        writer.flush()
        writer.record(cells.where(F.col("t") > middle))
    return base


@query(f"SELECT CAST(vec_id AS DOUBLE) AS at, CAST(dim AS INTEGER) AS dim, CAST(value AS DOUBLE) AS value FROM {_DIMS}", "embeddings")
def write_zarr(spark, embeddings):
    """Sharded arrays written in order of time and read back, with the time coordinate joined to its cells."""
    base = _written(spark, embeddings)
    at = _read(spark, base, "t").select("t", F.col("value").alias("at"))
    return _read(spark, base, "v").join(at, "t").select("at", "dim", "value")


@query("SELECT CAST(n // 256 AS BIGINT) AS shard, CAST(min(vec_id) AS DOUBLE) AS t_start, CAST(max(vec_id) AS DOUBLE) AS t_end, count(*) AS n_records FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings) GROUP BY 1", "embeddings")
def output_manifest(spark, embeddings):
    rows = [(s["shard"], s["t_start"], s["t_end"], s["n_records"]) for s in zarr_sink.manifest(_written(spark, embeddings))["shards"]]  # one row a shard
    return spark.createDataFrame(rows, "shard long, t_start double, t_end double, n_records long")


@query("SELECT page_id, 'downloaded' AS status, true AS ok, strlen(html) AS bytes FROM pages", "pages")
def fetch_cache(spark, pages):
    """Every page as a file, fetched into a new cache and held against its manifest."""
    base, root = _folder(spark, "pages"), _folder(spark, "cache")

    def save(batches):
        for pdf in batches:
            for i, html in zip(pdf["page_id"], pdf["html"]):
                objects.put(base, f"{i}.html", (html or "").encode())
            yield pdf[["page_id"]]

    pages.select("page_id", "html").mapInPandas(save, "page_id long").agg(F.count("*")).collect()  # a single row
    place = base if "://" in base else f"file://{base.removeprefix('file:')}"
    asked = pages.select("page_id", F.concat(F.lit(place + "/"), F.col("page_id").cast("string"), F.lit(".html")).alias("url"))
    got = cache.fetch(asked.select("url"), root)
    held = cache.verify(spark, root, got)
    return asked.join(got, "url").join(held, "key").select("page_id", "status", "ok", "bytes")


def _daily(spark, events) -> str:
    """Events by day as NetCDF files: a CF time axis in order, and the value of each record."""

    def encode(pdf):
        pdf = pdf.sort_values(["us", "event_id"])
        axis = (pdf["us"].to_numpy() / 1e6).astype(">f8")
        return encoders.netcdf({"time": 0}, {"time": (["time"], axis, {"units": "seconds since 1970-01-01 00:00:00", "calendar": "standard"}), "value": (["time"], pdf["value"].to_numpy(">f8"), {}), "event": (["time"], pdf["event_id"].to_numpy(">f8"), {})})

    rows = events.where("ts is not null").select(F.date_format("ts", "yyyyMMdd").alias("file"), times.micros(F.col("ts")).alias("us"), "event_id", "value")
    return encoders.write_groups(rows, "file", _folder(spark, "daily"), "nc", encode)


def _provider(spark, events, records: int):
    """A provider of the daily files, and half past noon of every day that has one."""
    days = durable(events.where("ts is not null").select(F.col("ts").cast("date").alias("day")).distinct())
    first, last = days.agg(F.min(F.col("day").cast("timestamp_ntz")), F.max(F.col("day").cast("timestamp_ntz"))).first()
    day = datetime.timedelta(days=1)
    c = Cadence(first, datetime.timedelta(hours=12), day, last + 2 * day, records_per_sample=records)
    p = Provider(spark, Source("daily", "netcdf", _daily(spark, events) + "/%Y%m%d.nc", c, variables=("event", "value")), window=(first, last + day))
    return p, days.select((F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL '12:30' HOUR TO MINUTE")).alias("at"))


_NOON = "(SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(ts AS DATE) + INTERVAL '12 hours' AS noon FROM events)"


@query(f"SELECT d.noon AS anchor, CAST(e.event_id AS DOUBLE) AS event, e.value FROM {_NOON} d ASOF JOIN (SELECT CAST(ts AS DATE) AS day, ts, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL) e ON e.day = d.day AND d.noon >= e.ts", "events")
def provider_record(spark, events):
    """The record current at noon of every day, sliced out of that day's file by its own time axis."""
    p, asked = _provider(spark, events, 1)
    return p.refresh_all(asked, "at").select("anchor", "event", "value")


@query(
    f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, ts, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n FROM events),
        f AS (SELECT d.day, d.noon, max(e.ts) AS at FROM {_NOON} d JOIN e ON e.day = d.day AND e.ts <= d.noon GROUP BY ALL),
        g AS (SELECT f.day, f.noon, min(e.n) AS n FROM f JOIN e ON e.day = f.day AND e.ts = f.at GROUP BY ALL)
        SELECT g.noon AS anchor, t.k AS time_idx, epoch(g.noon + t.k * INTERVAL '12 hours') AS time, CAST(e.event_id AS DOUBLE) AS event, e.value
        FROM g, (SELECT unnest([0, 1])::INTEGER AS k) t JOIN e ON e.day = g.day AND e.n = g.n + t.k""",
    "events",
)
def provider_bracket(spark, events):
    """The record current at noon of every day and its successor, with the instants of both ticks as their coordinate."""
    p, asked = _provider(spark, events, 2)
    return p.refresh_all(asked, "at").select("anchor", "time_idx", "time", "event", "value")


@query("SELECT strftime(ts, '%Y%m%d') AS file, count(*) AS n_records FROM events GROUP BY 1", "events")
def time_lengths(spark, events):
    """How many records each daily file holds, from its header."""
    return netcdf.time_lengths(spark, _daily(spark, events)).select(F.regexp_extract("path", r"([^/]*)\.nc$", 1).alias("file"), "n_records")


@query(
    f"""SELECT n_nationkey, 'cds://{requests.DATASET}?{{"area":[' || (n_nationkey + 1) || ',-1,' || -(n_nationkey + 1) || ',1],"data_format":"netcdf","day":["01","08"],"download_format":"unarchived","month":["' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || '"],"pressure_level":["1000","850"],"product_type":["reanalysis"],"time":[' || (SELECT string_agg('"' || lpad(CAST(h AS VARCHAR), 2, '0') || ':00"', ',' ORDER BY h) FROM range(24) t(h)) || '],"variable":["geopotential","temperature"],"year":["' || (2000 + n_nationkey) || '"]}}' AS url FROM nation""",
    "nation",
)
def cds_request_json(spark, nation):
    box = decode.request_area(F.lit(0.0), F.col("n_nationkey").cast("double"), F.lit(0.0), -F.col("n_nationkey").cast("double"))
    wish = [F.array(*map(F.lit, x)) for x in ((8, 1, 8), ("temperature", "geopotential"), (850, 1000))]
    made = requests.month_urls(nation, F.col("n_nationkey") + 2000, F.col("n_regionkey") + 1, *wish, box)
    return made.select("n_nationkey", "url")


@query("SELECT i AS tick_index, TIMESTAMP '2024-01-01' + i * INTERVAL '3 hours' AS anchor, epoch(TIMESTAMP '2024-01-01' + i * INTERVAL '3 hours') AS epoch_s FROM range(0, 240) t(i)")
def stream_ticks(spark):
    """The ticks of a month as a stream, in micro-batches, each exactly once."""
    folder = _folder(spark, "ticks")
    spark.dataSource.register(TickSource)
    ticks = spark.readStream.format("cadence_ticks").options(start="2024-01-01 00:00:00", step_seconds="10800", end="2024-01-31 00:00:00", ticks_per_batch="100").load()
    running = ticks.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{folder}/rows")


@query("SELECT epoch(TIMESTAMP '2024-01-01' + i * INTERVAL '3 hours') AS at, CAST(x AS INTEGER) AS x, CAST(i * 10 + x AS DOUBLE) AS value FROM range(0, 240) t(i), range(0, 3) u(x)")
def stream_shards(spark):
    """A stream of records appended to sharded arrays micro-batch by micro-batch; batches end inside shards, which are committed anew."""
    base = _folder(spark, "streamed")
    spark.dataSource.register(TickSource)
    ticks = spark.readStream.format("cadence_ticks").options(start="2024-01-01 00:00:00", step_seconds="10800", end="2024-01-31 00:00:00", ticks_per_batch="90").load()
    cells = ticks.select(F.col("epoch_s").alias("t"), F.explode(F.array(*map(F.lit, range(3)))).alias("x"), "tick_index").select("t", "x", (F.col("tick_index") * 10 + F.col("x")).cast("double").alias("v"))
    schema = zarr_sink.OutputSchema({"t": 0, "x": 3}, "t", {"v": zarr_sink.OutputVar(["t", "x"])}, {"t": 16, "x": 3}, {"t": 64, "x": 3}, {"x": (np.arange(3), {}), "t": (None, {"units": "seconds since 1970-01-01"})})
    running = zarr_sink.sink(cells, base, schema, f"{base}-progress", processingTime="0 seconds")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    at = _read(spark, base, "t").select("t", F.col("value").alias("at"))
    return _read(spark, base, "v").join(at, "t").select("at", "x", "value")


@query("SELECT max(abs(o_totalprice - (o_totalprice + CAST(1e-7 AS DOUBLE)))) AS most, true AS same_mask, count(*) AS n FROM orders", "orders")
def max_difference(spark, orders):
    """Two versions of an array: the largest difference, and whether their missing cells are the same."""
    gone = F.when(F.col("o_orderstatus") == "none", F.lit(math.nan))
    a, b = F.coalesce(gone, F.col("o_totalprice")), F.coalesce(gone, F.col("o_totalprice") + F.lit(1e-7))
    return orders.agg(*decode.difference(a, b), F.count("*").alias("n"))


@query("SELECT CAST(vec_id AS INTEGER) AS c0, CAST(d AS INTEGER) AS c1 FROM (SELECT DISTINCT vec_id // 10 AS vec_id FROM embeddings), (SELECT unnest([0, 3]) AS d)", "embeddings")
def chunk_product(spark, embeddings):
    """Ids of the chunks that hold two columns of every vector: the product of the chunk ids met on each axis."""
    total = embeddings.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]
    return select.chunk_table(spark, [(total, 10), (64, 16, [1, 50])], ["c0", "c1"])
