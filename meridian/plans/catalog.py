"""Registered queries of the engine's own operators: name -> (query, DuckDB SQL). The SQL says the same over the same tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decode, keys, times
from ..operators import cadence, select

Q: dict = {}
SQL: dict = {}


def query(sql: str, *tables: str):
    def add(f):
        def run(spark, sf_dir):
            return f(spark, *[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        Q[f.__name__], SQL[f.__name__] = run, sql
        return f

    return add


# A. Keys, addresses, cache


@query("SELECT page_id, sha256(url) AS cache_key FROM pages", "pages")
def cache_key(spark, pages):
    return pages.select("page_id", keys.cache_key(F.col("url")).alias("cache_key"))


@query("SELECT page_id, sha256(url || '#bytes=0-99') AS cache_key FROM pages", "pages")
def cache_key_range(spark, pages):
    return pages.select("page_id", keys.cache_key(F.col("url"), 0, 99).alias("cache_key"))


@query("SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, count(*) AS n FROM pages GROUP BY 1", "pages")
def url_scheme(spark, pages):
    return pages.groupBy(keys.scheme_of(F.col("url")).alias("scheme")).agg(F.count("*").alias("n"))


_EXT = r"lower(regexp_extract(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[^/]\.([A-Za-z0-9]{{1,8}})$', 1))"


@query(f"SELECT page_id, {_EXT.format('url')} AS ext, {_EXT.format("url || '/f.NC?x=1.y'")} AS ext_of_file FROM pages", "pages")
def url_ext(spark, pages):
    return pages.select("page_id", keys.ext_of(F.col("url")).alias("ext"), keys.ext_of(F.concat("url", F.lit("/f.NC?x=1.y"))).alias("ext_of_file"))


@query("SELECT page_id, 'blobs/' || substr(sha256(url), 1, 2) || '/' || sha256(url) || '.html' AS path, 'meta/' || sha256(url) || '.json' AS manifest FROM pages", "pages")
def blob_path(spark, pages):
    key = keys.cache_key(F.col("url"))
    return pages.select("page_id", keys.blob_path(key, F.lit("html")).alias("path"), keys.manifest_path(key).alias("manifest"))


@query("SELECT p_partkey, 'https://bucket' || p_size || '.s3.us-east-2.amazonaws.com/' || replace(p_name, ' ', '/') AS address FROM part", "part")
def s3_rewrite(spark, part):
    url = F.concat(F.lit("s3://bucket"), F.col("p_size").cast("string"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")))
    return part.select("p_partkey", keys.s3_https(url, "us-east-2").alias("address"))


@query("SELECT n_nationkey, 'file:///data/' || n_name || '/data/x' AS path FROM nation", "nation")
def datadir_expand(spark, nation):
    return nation.select("n_nationkey", keys.expand_variable(F.concat(F.lit("file://${DATADIR}/"), "n_name", F.lit("$DATADIR/x")), "DATADIR", "/data").alias("path"))


@query(
    """SELECT n_nationkey, '{"auth_realm":null,"bytes":' || length(n_name) || ',"etag":null,"fetched_at":null,"last_modified":null,"schema":"manifest/v1","sha256_content":"' || sha256(n_name) || '","source_loader":null,"url":"https://x/' || n_name || '"}' AS manifest FROM nation""",
    "nation",
)
def manifest_json(spark, nation):
    made = keys.manifest_json(schema=F.lit("manifest/v1"), url=F.concat(F.lit("https://x/"), "n_name"), sha256_content=F.sha2("n_name", 256), bytes=F.length("n_name"))
    return nation.select("n_nationkey", made.alias("manifest"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'hit' ELSE 'miss' END
       WHEN o_orderpriority = '2-HIGH' THEN 'hit' WHEN o_orderstatus = 'O' THEN 'revalidate'
       WHEN epoch_us(TIMESTAMP '1996-01-01') - epoch_us(o_orderdate) <= 31536000000000 THEN 'hit' ELSE 'miss' END AS verdict FROM orders""",
    "orders",
)
def freshness_verdict(spark, orders):
    pinned = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("F"))
    now = F.lit("1996-01-01").cast("timestamp")
    verdict = keys.freshness(F.col("o_orderpriority") == "2-HIGH", pinned, F.col("o_orderstatus"), F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("timestamp"), F.lit(365 * 86400), now)
    return orders.select("o_orderkey", verdict.alias("verdict"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "customer", "orders")
def offline_miss(spark, customer, orders):
    held = orders.where("o_orderstatus = 'F'")
    return customer.join(held, customer["c_custkey"] == held["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, length(text) = n_chars AS size_ok, sha256(text) AS digest, strlen(text) AS bytes FROM documents", "documents")
def integrity_check(spark, documents):
    text = F.col("text")
    return documents.select("doc_id", (F.length(text) == F.col("n_chars")).alias("size_ok"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'ok' WHEN bool_and(event_type = 'click') THEN 'absent' ELSE 'unknown' END AS outcome FROM events GROUP BY user_id", "events")
def mirror_outcome(spark, events):
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(keys.fetch_outcome(kind == "purchase", kind == "click").alias("outcome"))


@query("SELECT DISTINCT date_trunc('day', ts) AS file_anchor, strftime(ts, 'https://x/%Y/%m/f%Y%m%d.nc') AS url FROM events", "events")
def prefetch_urls(spark, events):
    return cadence.prefetch(events.select(F.col("ts").alias("anchor")), "2024-01-01", 86400, "https://x/%Y/%m/f%Y%m%d.nc")


@query("""SELECT n_nationkey, 'cds://set?{"area":[' || n_regionkey || ',1],"name":"' || n_name || '","variable":["t","u"]}' AS url, 'set' AS dataset, n_name AS name FROM nation""", "nation")
def job_url_codec(spark, nation):
    request = F.struct(F.array(F.col("n_regionkey"), F.lit(1)).alias("area"), F.col("n_name").alias("name"), F.array(F.lit("t"), F.lit("u")).alias("variable"))
    made = nation.select("n_nationkey", keys.job_url("set", request).alias("url"))
    return made.select("*", keys.job_dataset(F.col("url")).alias("dataset"), F.get_json_object(keys.job_request(F.col("url")), "$.name").alias("name"))


@query("SELECT event_id, lower(trim(event_type)) IN ('1', 'true', 'yes', 'on', 'view') AS flag FROM events", "events")
def truthy_text(spark, events):
    return events.select("event_id", keys.truthy(F.when(F.col("event_type") == "view", F.lit(" YES ")).otherwise(F.col("event_type"))).alias("flag"))


# B. Decoding


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 1 THEN NULL ELSE l_quantity * CAST(0.01 AS DOUBLE) + CAST(280 AS DOUBLE) END AS value FROM lineitem", "lineitem")
def cf_unpack(spark, lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", decode.unpack(F.col("l_quantity"), 0.01, 280, 1, "null").alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value FROM part", "part")
def nodata_null(spark, part):
    return part.select("p_partkey", decode.no_data(F.col("p_size"), 7, "null").alias("value"))


@query("SELECT p_partkey, CAST(-121.5 AS DOUBLE) + (p_partkey % 50 + CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS x, CAST(40 AS DOUBLE) - (p_partkey // 50 + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE) AS y FROM part", "part")
def cell_centres(spark, part):
    row, col = F.floor(F.col("p_partkey") / 50), F.col("p_partkey") % 50
    return part.select("p_partkey", decode.centre_x(col, -121.5, 0.5).alias("x"), decode.centre_y(row, 40, 0.25).alias("y"))


@query("SELECT p_partkey, CAST(0.5 AS DOUBLE) * (p_partkey % 50 + CAST(0.5 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * (p_partkey // 50 + CAST(0.5 AS DOUBLE)) + CAST(-121.5 AS DOUBLE) AS x FROM part", "part")
def affine_centres(spark, part):
    row, col = F.floor(F.col("p_partkey") / 50), F.col("p_partkey") % 50
    return part.select("p_partkey", decode.affine_centre(row, col, 0.5, 0.25, -121.5).alias("x"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events", "events")
def blank_to_nan(spark, events):
    cell = F.when(F.col("event_type") == "click", F.lit("  ")).otherwise(F.col("value").cast("string"))
    return events.select("event_id", decode.blank_to_missing(cell, "null").alias("value"))


@query("SELECT page_id FROM pages WHERE url GLOB '*/*[0-4]?*' AND NOT url GLOB '*[!a-z]9*'", "pages")
def glob_members(spark, pages):
    return pages.where(F.col("url").rlike(keys.glob_regex("*/*[0-4]?*")) & ~F.col("url").rlike(keys.glob_regex("*[!a-z]9*"))).select("page_id")


@query("SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index, source, doc_id, dense_rank() OVER (ORDER BY source) - 1 AS member FROM documents", "documents")
def member_concat(spark, documents):
    names = documents.select("source").distinct()
    rank = names.select(F.col("source"), (F.row_number().over(W.orderBy("source")) - 1).cast("long").alias("member"))  # one row a member
    index = (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    return documents.join(F.broadcast(rank), "source").select(index.alias("index"), "source", "doc_id", "member")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'F') AS live, count(*) FILTER (o_orderstatus = 'F') AS deleted FROM orders GROUP BY 1", "orders")
def deletion_filter(spark, orders):
    live = decode.is_live(F.when(F.col("o_orderstatus") == "F", F.lit("*")))
    return orders.groupBy("o_orderpriority").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("deleted"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders", "orders")
def dbf_date(spark, orders):
    return orders.select("o_orderkey", decode.compact_date(F.col("o_orderdate")).alias("day"))


@query("SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'Null' WHEN 1 THEN 'Point' WHEN 3 THEN 'PolyLine' WHEN 5 THEN 'Polygon' WHEN 8 THEN 'MultiPoint' ELSE 'Unknown' END AS kind FROM part", "part")
def shape_type_name(spark, part):
    return part.select("p_partkey", decode.shape_type_name(F.col("p_size") % 10).alias("kind"))


# C. Time


@query("SELECT event_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-15 01:30:00') AS anchor FROM events", "events")
def snap_down(spark, events):
    return events.select("event_id", times.snap_down(F.col("ts"), times.instant("2024-01-15 01:30:00"), 6 * 3600).alias("anchor"))


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01') AS file_anchor, count(*) AS n FROM events GROUP BY 1", "events")
def file_anchor(spark, events):
    return events.groupBy(times.snap_down(F.col("ts"), times.instant("2024-01-01"), 86400).alias("file_anchor")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, 'https://x/%Y/%j/f_%Y%m%d_%H%M.nc') AS url FROM events", "events")
def url_template(spark, events):
    return events.select("event_id", times.url_at(F.col("ts"), "https://x/%Y/%j/f_%Y%m%d_%H%M.nc").alias("url"))


@query("SELECT i AS tick_index, TIMESTAMP '2024-01-01' + i * INTERVAL '3 hours' AS anchor, epoch(TIMESTAMP '2024-01-01' + i * INTERVAL '3 hours') AS epoch_s FROM range(4, 24) t(i)")
def refresh_times(spark):
    return cadence.ticks(spark, "2024-01-01", 3 * 3600, lower="2024-01-01 11:00:00", upper="2024-01-04")


@query("SELECT event_id, epoch(ts) AS epoch_s FROM events", "events")
def epoch_seconds(spark, events):
    return events.select("event_id", times.epoch_seconds(F.col("ts")).alias("epoch_s"))


@query("SELECT l_orderkey, l_linenumber, TIMESTAMP '2018-11-08' + CAST(l_quantity AS INTEGER) * INTERVAL '1 hour' AS t FROM lineitem", "lineitem")
def cf_time_decode(spark, lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", times.cf_time(F.col("l_quantity"), "hours since 2018-11-08 00:00:00").alias("t"))


@query("SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, string_agg(CAST(day(d) AS VARCHAR), ',' ORDER BY d) AS days FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL '1 day')) AS d) GROUP BY 1, 2")
def months_in_span(spark):
    got = cadence.months_in_span(spark, "2023-12-31 01:00:00", "2024-02-01 22:00:00")
    return got.withColumn("days", F.array_join(F.col("days").cast("array<string>"), ","))


@query("SELECT event_id, ((event_id - 1) % 24 + 24) % 24 + 1 AS record FROM events", "events")
def mod1_record(spark, events):
    return events.select("event_id", times.mod1(F.col("event_id"), F.lit(24)).alias("record"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', ts) AS back FROM events", "events")
def rfc3339(spark, events):
    text = events.select("event_id", times.rfc3339(F.col("ts")).alias("text"))
    return text.select("event_id", "text", times.parse_rfc3339(F.col("text")).alias("back"))


@query("SELECT c_custkey, CAST(ceil(greatest(c_acctbal / 200, 3) + 1) AS INTEGER) AS north, CAST(floor(least(c_acctbal / 100, 9) - 1) AS INTEGER) AS west, CAST(floor(least(c_acctbal / 200, 3) - 1) AS INTEGER) AS south, CAST(ceil(greatest(c_acctbal / 100, 9) + 1) AS INTEGER) AS east FROM customer", "customer")
def request_area(spark, customer):
    bal = F.col("c_acctbal")
    area = decode.request_area(bal / 100, bal / 200, F.lit(9.0), F.lit(3.0))
    return customer.select("c_custkey", *[area[i].alias(n) for i, n in enumerate(("north", "west", "south", "east"))])


@query(f"SELECT p_partkey, ({list(decode.LEVELS_HPA)})[CAST(round_even((p_size % 36) + CAST(0.5 AS DOUBLE), 0) AS INTEGER) + 1] AS hpa FROM part", "part")
def request_levels(spark, part):
    return part.select("p_partkey", decode.level_hpa(F.bround(F.col("p_size") % 36 + F.lit(0.5), 0) + 1).alias("hpa"))


# D. Arrays and selection: embeddings as an array of [vec, dim]

_DIMS = "(SELECT vec_id, i AS dim, embedding[i + 1] AS value FROM embeddings, range(64) t(i))"


def _cells(embeddings):
    return embeddings.select(F.col("vec_id").cast("int").alias("vec"), F.posexplode("embedding").alias("dim", "value"))


@query(f"SELECT vec_id AS vec, CAST(dim AS INTEGER) AS dim, value FROM {_DIMS}".replace("vec_id AS vec", "CAST(vec_id AS INTEGER) AS vec"), "embeddings")
def array_cells(spark, embeddings):
    return _cells(embeddings)


@query("SELECT vec_id, p AS pos, embedding[([24, 2, 9, 6])[p + 1] + 1] AS value FROM embeddings, range(4) t(p)", "embeddings")
def gather_permuted(spark, embeddings):
    got = embeddings.select("vec_id", F.posexplode(select.gather(F.col("embedding"), [24, 2, 9, 6])).alias("pos", "value"))
    return got.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT vec_id, p AS pos, embedding[3 + 7 * p + 1] AS value FROM embeddings, range(8) t(p)", "embeddings")
def slice_strided(spark, embeddings):
    picked = select.axis_indices({"slice": [3, 58, 7]}, 64)
    got = embeddings.select("vec_id", F.posexplode(select.gather(F.col("embedding"), picked)).alias("pos", "value"))
    return got.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT CAST(r AS INTEGER) AS pos_vec, CAST(c AS INTEGER) AS pos_dim, embedding[([5, 1, 60])[c + 1] + 1] AS value FROM embeddings, range(4) t(r), range(3) u(c) WHERE vec_id = ([9, 0, 4, 9])[r + 1]", "embeddings")
def select_2d(spark, embeddings):
    got = select.take(_cells(embeddings), spark, {"vec": [9, 0, 4, 9], "dim": {"indices": [5, 1, 60]}}, {"vec": 10, "dim": 64})
    return got.select("pos_vec", "pos_dim", "value")


@query(f"SELECT CAST(vec_id // 10 AS INTEGER) AS c0, CAST(dim // 16 AS INTEGER) AS c1, (vec_id // 10) || '.' || (dim // 16) AS key, count(*) AS n, min(value) AS low, max(value) AS high FROM {_DIMS} GROUP BY ALL", "embeddings")
def needed_chunks(spark, embeddings):
    wanted = select.chunk_table(spark, [(_length(embeddings), 10), (64, 16)], ["c0", "c1"])
    by = _cells(embeddings).withColumns({"c0": select.chunk_of(F.col("vec"), 10), "c1": select.chunk_of(F.col("dim"), 16)})
    by = by.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return wanted.join(by, ["c0", "c1"]).withColumn("key", select.chunk_key(F.col("c0"), F.col("c1")))


@query(f"SELECT CAST(vec_id // 20 AS INTEGER) AS shard, count(DISTINCT vec_id) AS n_rows, count(*) AS n_cells, min(value) AS low, max(value) AS high FROM {_DIMS} GROUP BY 1", "embeddings")
def shard_stats(spark, embeddings):
    e = embeddings.withColumn("shard", select.chunk_of(F.col("vec_id"), 20))
    return e.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(F.size("embedding")).cast("long").alias("n_cells"), F.min(F.array_min("embedding")).alias("low"), F.max(F.array_max("embedding")).alias("high"))


def _length(embeddings) -> int:
    """How long the axis of vectors is: one past the greatest id."""
    return embeddings.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]


@query(f"SELECT CAST(vec_id AS INTEGER) AS vec, CAST(dim AS INTEGER) AS dim, CAST(vec_id * 64 + dim AS BIGINT) AS c_order, CAST(dim * (SELECT max(vec_id) + 1 FROM embeddings) + vec_id AS BIGINT) AS f_order FROM {_DIMS}", "embeddings")
def linear_index(spark, embeddings):
    at, shape = [F.col("vec"), F.col("dim")], [_length(embeddings), 64]
    return _cells(embeddings).select("vec", "dim", select.linear_index(at, shape).alias("c_order"), select.linear_index(at, shape, "F").alias("f_order"))


@query("SELECT CAST(vec_id // 7 AS INTEGER) AS chunk, CAST(least(7, (SELECT max(vec_id) + 1 FROM embeddings) - (vec_id // 7) * 7) AS INTEGER) AS inside, CAST(min(vec_id % 7) AS INTEGER) AS first FROM embeddings GROUP BY vec_id // 7", "embeddings")
def edge_clip(spark, embeddings):
    chunk = select.chunk_of(F.col("vec_id"), 7)
    return embeddings.groupBy(chunk.alias("chunk")).agg(F.min(select.within_chunk(F.col("vec_id"), 7)).alias("first")).withColumn("inside", select.clip_edge(F.col("chunk"), 7, _length(embeddings)))


@query("SELECT n.n_nationkey, r.r_regionkey, coalesce(c.n, 0) AS n FROM nation n CROSS JOIN region r LEFT JOIN (SELECT n_nationkey, n_regionkey, count(*) AS n FROM nation GROUP BY ALL) c ON c.n_nationkey = n.n_nationkey AND c.n_regionkey = r.r_regionkey", "nation", "region")
def fill_absent(spark, nation, region):
    stored = nation.groupBy("n_nationkey", F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    grid = nation.select("n_nationkey").withColumn("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(region.count() - 1))))
    return grid.join(stored, ["n_nationkey", "r_regionkey"], "left").withColumn("n", select.or_fill(F.col("n")))


@query("SELECT l_orderkey, p AS vertex, list_extract(q, least(p + 1, len(q))) AS x FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), range(64) t(p) WHERE p < (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))", "lineitem")
def ring_pad(spark, lineitem):
    part = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"])
    rings = lineitem.groupBy("l_orderkey").agg(part.alias("ring"))
    longest = rings.agg(F.max(F.size("ring")).alias("longest"))
    padded = rings.join(F.broadcast(longest)).select("l_orderkey", F.posexplode(select.pad_ring(F.col("ring"), F.col("longest"))).alias("vertex", "x"))
    return padded.withColumn("vertex", F.col("vertex").cast("long"))


# E. Cadence, lookup, append

_TICKS = "(SELECT TIMESTAMP '2024-01-01' + i * INTERVAL '45 minutes' AS anchor FROM range(0, 960) t(i))"


def _ticks(spark):
    return cadence.ticks(spark, "2024-01-01", 2700, upper="2024-01-31").select("anchor")


_EARLY_TICKS = "(SELECT TIMESTAMP '2023-12-30' + i * INTERVAL '45 minutes' AS anchor FROM range(0, 1024) t(i))"
_ALL_RECORDS = "(SELECT ts, min(event_id) AS event_id FROM events GROUP BY ts)"


def _early_ticks(spark):
    """Ticks from two days before the first event: the lookup meets anchors without a record though no record is left out."""
    return cadence.ticks(spark, "2023-12-30", 2700, upper="2024-01-31").select("anchor")


@query(f"SELECT anchor, r.ts, r.event_id FROM {_EARLY_TICKS} t ASOF LEFT JOIN {_ALL_RECORDS} r ON t.anchor >= r.ts", "events")
def asof_record(spark, events):
    return cadence.at_or_before(_early_ticks(spark), events, "anchor", "ts", "event_id")


@query(f"SELECT anchor, coalesce(r.ts, (SELECT min(ts) FROM {_ALL_RECORDS})) AS ts, coalesce(r.event_id, (SELECT arg_min(event_id, ts) FROM {_ALL_RECORDS})) AS event_id FROM {_EARLY_TICKS} t ASOF LEFT JOIN {_ALL_RECORDS} r ON t.anchor >= r.ts", "events")
def asof_clamped(spark, events):
    return cadence.at_or_before(_early_ticks(spark), events, "anchor", "ts", "event_id", clamp=True)


@query("SELECT user_id, event_id, ts, coalesce(lead(ts) OVER w, ts) AS next_ts, coalesce(lead(event_id) OVER w, event_id) AS next_event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "events")
def bracket(spark, events):
    return cadence.brackets(events.select("user_id", "event_id", "ts"), "ts", "event_id", F.col("user_id"))


@query("SELECT event_id, ts, coalesce(lead(ts) OVER w, ts) AS next_ts, coalesce(lead(event_id) OVER w, event_id) AS next_event_id FROM events WINDOW w AS (ORDER BY ts, event_id)", "events")
def bracket_seam(spark, events):
    return cadence.seam_brackets(events.select("event_id", "ts"), "ts", "event_id", F.to_date("ts"))


@query(
    f"""WITH f AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1),
        p AS (SELECT CAST(ts AS DATE) AS day, ts, min(n) AS n FROM (SELECT ts, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) - 1 AS n FROM events) GROUP BY ALL),
        a AS (SELECT anchor, CAST(anchor AS DATE) AS day FROM {_TICKS})
        SELECT a.anchor, CASE WHEN a.anchor BETWEEN lo AND hi THEN p.n ELSE epoch_us(a.anchor - TIMESTAMP '2024-01-01') // 3600000000 END AS record_index
        FROM a LEFT JOIN f ON f.day = a.day ASOF LEFT JOIN p ON p.day = a.day AND a.anchor >= p.ts""",
    "events",
)
def record_index(spark, events):
    asked = _ticks(spark).withColumn("day", F.to_date("anchor"))
    records = events.select(F.to_date("ts").alias("day"), "ts")
    return cadence.record_index(asked, records, "anchor", "day", "ts", times.instant("2024-01-01"), 3600).select("anchor", "record_index")


@query("SELECT day, event_id, value FROM (SELECT CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n = 6", "events")
def record_slice(spark, events):
    return cadence.record_slice(events.select(F.to_date("ts").alias("day"), "ts", "event_id", "value"), "day", "ts", "event_id", 5)


@query("SELECT (n - 1) // 64 AS shard, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n_records FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) GROUP BY 1", "events")
def time_shards(spark, events):
    return cadence.time_shards(events, "ts", "event_id", 64)


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'", "events")
def resume_after(spark, events):
    return cadence.resume_after(events.select("event_id", "ts"), "ts", "2024-01-20 12:00:00")


# F. Sets, checks, registry


@query("SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "orders")
def requested_minus_present(spark, orders):
    name = F.col("o_custkey").alias("name")
    return orders.where("o_orderstatus = 'P'").select(name).distinct().exceptAll(orders.where("o_orderstatus = 'F'").select(name).distinct())


@query("SELECT n_name AS name FROM nation INTERSECT SELECT n_name FROM nation WHERE n_regionkey > 2", "nation")
def reserved_clash(spark, nation):
    return nation.select(F.col("n_name").alias("name")).intersect(nation.where("n_regionkey > 2").select("n_name"))


@query("SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer", "supplier", "customer")
def union_distinct(spark, supplier, customer):
    return supplier.select(F.col("s_nationkey").alias("key")).union(customer.select("c_nationkey")).distinct()


@query("SELECT p_brand, array_to_string(list_reverse_sort(list(DISTINCT p_size)), ',') AS sizes FROM part GROUP BY 1", "part")
def levels_sorted_desc(spark, part):
    return part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_size"), False).cast("array<string>"), ",").alias("sizes"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2", "events")
def lru_two(spark, events):
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("n", n).where("n <= 2").select("user_id", "event_id")


@query("SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(abs(a.v - b.v) <= 1e-6 + 1e-9 * abs(b.v), false) AS same FROM (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_size > 3) a FULL JOIN (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_retailprice + 1e-3 ELSE p_retailprice + 1e-8 END AS v FROM part WHERE p_size < 40) b USING (p_partkey)", "part")
def tolerance_compare(spark, part):
    a = part.where("p_size > 3").select("p_partkey", F.col("p_retailprice").alias("a"))
    b = part.where("p_size < 40").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_retailprice") + 1e-3).otherwise(F.col("p_retailprice") + 1e-8).alias("b"))
    both = a.join(b, "p_partkey", "full_outer")
    one_sided = F.col("a").isNull() | F.col("b").isNull()
    return both.select("p_partkey", (decode.close_to(F.col("a"), F.col("b")) & ~one_sided).alias("same"))


@query("SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 4", "documents")
def coverage_gate(spark, documents):
    return documents.groupBy("source").agg(F.countDistinct("lang").alias("n")).where("n = 4").select("source")


@query("SELECT sha256(text) AS key, min(doc_id) AS first FROM documents GROUP BY 1", "documents")
def first_match(spark, documents):
    return documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min("doc_id").alias("first"))


# R. Relational regression: decoded data are ordinary DataFrames


@query("SELECT n_name, count(*) AS n, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3", "customer", "nation")
def join_group(spark, customer, nation):
    return customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("best")).where("n > 3")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", "customer", "orders")
def join_left(spark, customer, orders):
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", "orders", "lineitem")
def join_semi(spark, orders, lineitem):
    return orders.join(lineitem.where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first, max(l_extendedprice) AS most FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
def rollup(spark, lineitem):
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_extendedprice").alias("most"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
def cube(spark, orders):
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS place, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders")
def rank_lag(spark, orders):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", F.rank().over(w).cast("long").alias("place"), F.lag("o_orderkey").over(w).alias("previous"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
def top_k(spark, orders):
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", "events")
def tumbling(spark, events):
    return events.groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) + 1 FROM part q WHERE q.p_brand = p.p_brand)", "part")
def correlated(spark, part):
    mean = part.groupBy("p_brand").agg((F.avg("p_retailprice") + 1).alias("mean"))
    return part.join(mean, "p_brand").where("p_retailprice > mean").select("p_partkey")


@query("SELECT l_returnflag, max_by(l_orderkey, struct_pack(a := l_extendedprice, b := l_orderkey)) AS latest FROM lineitem GROUP BY 1", "lineitem")
def arg_max(spark, lineitem):
    return lineitem.groupBy("l_returnflag").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("latest"))


def flagship(spark, sf_dir):
    """Events by their cadence anchor, with the anchor's address and cache key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    anchor = times.snap_down(F.col("ts"), times.instant("2024-01-01"), 3 * 3600)
    by = events.groupBy(anchor.alias("anchor")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    by = by.withColumn("url", times.url_at(F.col("anchor"), "https://x/%Y/f%Y%m%d%H.nc"))
    return by.withColumn("cache_key", keys.cache_key(F.col("url")))


Q["flagship"] = flagship
SQL["flagship"] = "SELECT anchor, n, first, last, strftime(anchor, 'https://x/%Y/f%Y%m%d%H.nc') AS url, sha256(strftime(anchor, 'https://x/%Y/f%Y%m%d%H.nc')) AS cache_key FROM (SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2024-01-01') AS anchor, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1)"

from . import stores  # noqa: E402,F401  (registers the queries that write and read files)
