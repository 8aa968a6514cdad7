"""Profiles, rasters, archive bookkeeping, ordered writing, format round trips and relational extensions."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import affine as A
from loamgrid.functions import geometry as G
from loamgrid.functions import measure as M
from loamgrid.functions import schema as X
from loamgrid.functions import tiles as T
from loamgrid.functions import values as V
from loamgrid.operators import profile as P
from loamgrid.operators import raster as R
from loamgrid.operators import spatial_join as J
from loamgrid.operators import vector_tiles as VT
from loamgrid.queries.base import BXS, PTS, PXS, boxes, pixels, points, q, query, sq, table
from loamgrid.queries.places import Z10
from loamgrid.sources import geojson, geoparquet, geotiff, pmtiles
from loamgrid.sources.files import local_path, scratch
from loamgrid.streaming import windows as W

S = SparkSession

# --- profiles

_STAT = lambda c, t, lo="min", hi="max": f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, count({c}) AS values, CAST({lo}({c}) AS VARCHAR) AS min, CAST({hi}({c}) AS VARCHAR) AS max FROM {t}"


@query(" UNION ALL ".join([_STAT("o_orderkey", "orders"), _STAT("o_custkey", "orders"), "SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(o_orderstatus), NULL, NULL FROM orders"]))
def agg4_statistics(spark: S, sf: str) -> DataFrame:
    return P.statistics(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


_TOP = lambda c, t: f"SELECT '{c}' AS name, n AS \"distinct\", CAST(rank AS INT) AS rank, value, cnt AS count FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10 AND n <= 1000"


@query(" UNION ALL ".join([_TOP("o_orderpriority", "orders"), _TOP("o_orderstatus", "orders"), _TOP("o_custkey", "orders")]))
def agg5_top_values(spark: S, sf: str) -> DataFrame:
    """Columns of more than a thousand values have neither count nor top values."""
    return P.top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], 10, 1000)


@query("SELECT CASE k % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' ELSE NULL END AS kind, count(*) AS count FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1")
def agg3_kind_histogram(spark: S, sf: str) -> DataFrame:
    k, a, b = F.col("k") % 4, F.col("xmin"), F.col("ymin")
    ends = F.array(M.point(a, b), M.point(F.col("xmax"), F.col("ymax")))
    shape = F.when(k == 0, G.st_point(a, b)).when(k == 1, G.st_line(ends)).when(k == 2, G.st_polygon(F.array(F.concat(ends, F.array(M.point(a, F.col("ymax")), M.point(a, b))))))
    return P.kinds_of(boxes(spark, sf).select(shape.alias("g")), "g")


@query(f"SELECT {sq('min(xmin)', '1e3')} AS xmin, {sq('min(ymin)', '1e3')} AS ymin, {sq('max(xmax)', '1e3')} AS xmax, {sq('max(ymax)', '1e3')} AS ymax FROM {BXS}")
def agg3_extent(spark: S, sf: str) -> DataFrame:
    return P.extent_of(boxes(spark, sf), "none").select(*[q(F.col(c), 1e3).alias(c) for c in M.BOX])


@query("SELECT o_orderkey AS _row, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def agg8_head(spark: S, sf: str) -> DataFrame:
    return P.head(table(spark, sf, "orders").select(F.col("o_orderkey").alias("_row"), "o_orderstatus"))


# --- rasters over pixel rows

SIX = (100.0, 0.5, 0.25, 50.0, 0.125, -0.5)


@query("SELECT o_orderkey AS k, CAST((100e0 + c*0.5e0 + r*0.25e0)*1000 AS BIGINT) AS x, CAST((50e0 + c*0.125e0 - r*0.5e0)*1000 AS BIGINT) AS y, CAST(c AS BIGINT) AS c, CAST(r AS BIGINT) AS r FROM (SELECT o_orderkey, o_orderkey % 512 AS c, o_custkey % 512 AS r FROM orders)")
def ras8_affine_roundtrip(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 512).alias("c"), (F.col("o_custkey") % 512).alias("r"), A.affine(*SIX).alias("t"))
    x, y = A.pixel_to_world(F.col("t"), F.col("c").cast("double"), F.col("r").cast("double"))
    c, r = A.world_to_pixel(F.col("t"), F.col("x"), F.col("y"))
    placed = o.withColumns({"x": x, "y": y})
    return placed.select("k", F.round(F.col("x") * 1000).cast("long").alias("x"), F.round(F.col("y") * 1000).cast("long").alias("y"), F.round(c).cast("long").alias("c"), F.round(r).cast("long").alias("r"))


@query("SELECT n_nationkey AS k, CAST((100e0)*1e3 AS BIGINT) AS xmin, CAST((50e0 - h*0.5e0)*1e3 AS BIGINT) AS ymin, CAST((100e0 + w*0.5e0 + h*0.25e0)*1e3 AS BIGINT) AS xmax, CAST((50e0 + w*0.125e0)*1e3 AS BIGINT) AS ymax, CAST(ceil(w/16e0) AS BIGINT) AS across, CAST(ceil(h/16e0) AS BIGINT) AS down FROM (SELECT n_nationkey, n_nationkey*8 + 8 AS w, n_nationkey*4 + 4 AS h FROM nation)")
def ras9_world_bounds(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 8 + 8).alias("w"), (F.col("n_nationkey") * 4 + 4).alias("h"))
    b = n.select("k", "w", "h", A.world_bounds(A.affine(*SIX), F.col("w"), F.col("h")).alias("b"))
    across, down = A.tile_grid(F.col("w"), F.col("h"), F.lit(16), F.lit(16))
    return b.select("k", *[F.round(F.col(f"b.{c}") * 1e3).cast("long").alias(c) for c in M.BOX], across.alias("across"), down.alias("down"))


def raster(spark: S, sf: str) -> DataFrame:
    """The 64 x 64 raster as four tiles of 32 x 32; pixels without line items are nodata."""
    p = pixels(spark, sf).select(F.col("c").alias("column"), F.col("r").alias("row"), F.col("v").alias("value"))
    return R.from_pixels(p, (0.0, 1.0, 0.0, 64.0, 0.0, -1.0), 32, "F64", -1.0, 4326)


@query(f"SELECT c // 2 AS c, r // 2 AS r, {sq('avg(v)', '1e6')} AS v FROM {PXS} GROUP BY 1, 2")
def ras19_area_average(spark: S, sf: str) -> DataFrame:
    """The overview by average, read back as pixels."""
    p = R.pixels(R.next_level(raster(spark, sf), "average"))
    return p.select(F.col("column").alias("c"), F.col("row").alias("r"), q(F.col("value"), 1e6).alias("v"))


@query(f"SELECT c, r, CAST(min(v) AS BIGINT) AS v FROM (SELECT c // 2 AS c, r // 2 AS r, v, count(*) AS n, max(count(*)) OVER (PARTITION BY c // 2, r // 2) AS top FROM {PXS} GROUP BY 1, 2, 3) WHERE n = top GROUP BY c, r")
def ras20_area_mode(spark: S, sf: str) -> DataFrame:
    p = R.pixels(R.next_level(raster(spark, sf), "mode"))
    return p.select(F.col("column").alias("c"), F.col("row").alias("r"), F.col("value").cast("long").alias("v"))


@query(f"SELECT CAST(2*c + dc AS BIGINT) AS c, CAST(2*r + dr AS BIGINT) AS r, CAST(v AS BIGINT) AS v FROM {PXS}, range(2) a(dc), range(2) b(dr)")
def ras14_nearest(spark: S, sf: str) -> DataFrame:
    """Each tile at twice its size by the nearest pixel."""
    p = R.pixels(R.resample_tiles(raster(spark, sf), 64, 64, "nearest"))
    return p.select(F.col("column").alias("c"), F.col("row").alias("r"), F.col("value").cast("long").alias("v"))


@query(f"SELECT c, r, CAST(v AS BIGINT) AS v FROM {PXS}")
def src52_geotiff_roundtrip(spark: S, sf: str) -> DataFrame:
    """Tiles written to a file and read again."""
    path = _local(spark, "raster.tif")
    geotiff.write(raster(spark, sf), path, {0: (64, 64)})
    p = R.pixels(geotiff.read(spark, path))
    return p.select(F.col("column").alias("c"), F.col("row").alias("r"), F.col("value").cast("long").alias("v"))


def _local(spark: S, name: str) -> str:
    """A place for one file: the shared folder if it is a path, else a folder of the driver."""
    path = local_path(scratch(spark, name))
    if path is None:
        path = os.path.join(tempfile.mkdtemp(prefix="loamgrid-"), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


# --- archives


@query("SELECT content, \"first\", length, CAST(coalesce(sum(length) OVER (ORDER BY \"first\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT o_custkey AS content, min(o_orderkey) AS \"first\", CAST(any_value(o_custkey % 97 + 1) AS BIGINT) AS length FROM orders GROUP BY o_custkey)")
def snk25_offsets(spark: S, sf: str) -> DataFrame:
    """Contents in the order of their first tile, with the sum of the lengths before each."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("content")).agg(F.min("o_orderkey").alias("first"), (F.first("o_custkey") % 97 + 1).cast("long").alias("length"))
    return pmtiles.with_offsets(c).select("content", "first", "length", "offset")


@query(f"SELECT CAST(10 AS INT) AS z, x, y, count(*) AS n_features FROM {Z10} GROUP BY x, y")
def til11_vector_tiles(spark: S, sf: str) -> DataFrame:
    """Points encoded by tile: features of each."""
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    p = points(spark, sf).select(F.col("k").alias("fid"), G.st_point(F.col("lng"), F.col("lat")).alias("geometry"), F.lit(10).alias("z"), x.alias("x"), y.alias("y"))
    return VT.encode(p, "orders").select("z", "x", "y", "n_features")


@query("SELECT CAST(6 AS INT) AS z, x // 16 AS x, y // 16 AS y, CAST(count(*) AS VARCHAR) AS data FROM " + Z10 + " GROUP BY x // 16, y // 16")
def snk24_pmtiles_roundtrip(spark: S, sf: str) -> DataFrame:
    """An archive of tile counts written and read again."""
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(6))
    tiles = points(spark, sf).groupBy(F.lit(6).alias("z"), x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).cast("string").cast("binary").alias("data"))
    path = _local(spark, "counts.pmtiles")
    pmtiles.write(tiles, path)
    return pmtiles.read(spark, path).select("z", "x", "y", F.col("data").cast("string").alias("data"))


# --- vector formats

_PLACES = f"SELECT k, {sq('lng', '1e3')} AS x, {sq('lat', '1e3')} AS y, k % 3 = 0 AS flag, 'o' || CAST(k AS VARCHAR) AS name FROM {PTS}"


def places(spark: S, sf: str) -> DataFrame:
    p = points(spark, sf)
    g = G.st_point(F.col("lng"), F.col("lat"))
    return p.select("k", (F.col("k") % 3 == 0).alias("flag"), F.concat(F.lit("o"), F.col("k").cast("string")).alias("name"), g.alias("geometry")).withMetadata("geometry", {"geometry": True, "kind": "Point", "epsg": 4326})


def _placed(df: DataFrame) -> DataFrame:
    e = df.select("*", G.st_bbox(F.col("geometry")).alias("e"))
    return e.select("k", q(F.col("e.xmin"), 1e3).alias("x"), q(F.col("e.ymin"), 1e3).alias("y"), "flag", "name")


@query(_PLACES)
def snk3_geoparquet_roundtrip(spark: S, sf: str) -> DataFrame:
    path = scratch(spark, "places.parquet")
    geoparquet.write(places(spark, sf), path)
    return _placed(geoparquet.read(spark, path))


@query(f"SELECT * FROM ({_PLACES}) WHERE x BETWEEN -20000 AND 50000 AND y BETWEEN -10000 AND 40000")
def src11_geoparquet_box(spark: S, sf: str) -> DataFrame:
    """A box filter that reaches the scan of an optimised file."""
    path = scratch(spark, "places.parquet")
    geoparquet.write(places(spark, sf), path, hilbert=True, files=4)
    return _placed(geoparquet.read(spark, path, (-20.0, -10.0, 50.0, 40.0)))


@query(f"SELECT {sq('min(lng)', '1e3')} AS xmin, {sq('min(lat)', '1e3')} AS ymin, {sq('max(lng)', '1e3')} AS xmax, {sq('max(lat)', '1e3')} AS ymax FROM {PTS}")
def src18_footer_extent(spark: S, sf: str) -> DataFrame:
    path = scratch(spark, "places.parquet")
    geoparquet.write(places(spark, sf), path)
    row = spark.createDataFrame([geoparquet.extent(spark, path)], "xmin double, ymin double, xmax double, ymax double")
    return row.select(*[q(F.col(c), 1e3).alias(c) for c in M.BOX])


@query(_PLACES)
def snk14_geojson_roundtrip(spark: S, sf: str) -> DataFrame:
    path = _local(spark, "places.geojson")
    geojson.write(places(spark, sf), path, fid=None)
    return _placed(geojson.read(spark, path))


@query(_PLACES)
def src28_geojson_lines(spark: S, sf: str) -> DataFrame:
    """One feature a line: written and read in parallel, schema inferred over all lines."""
    path = scratch(spark, "places.ndjson")
    geojson.feature_text(places(spark, sf), fid=None).write.text(path)
    return _placed(geojson.read_lines(spark, path))


@query("SELECT k, '{\"type\":\"Feature\",\"id\":' || k || ',\"geometry\":null,\"properties\":{\"name\":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE '\"c' || k || '\"' END || ',\"raw\":\"' || lower(hex('r' || k)) || '\"}}' AS feature FROM (SELECT c_custkey AS k FROM customer)")
def snk15_feature_text(spark: S, sf: str) -> DataFrame:
    """Null geometry and null properties are kept; binary is hexadecimal."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), F.lit(None).cast("binary").alias("geometry"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("name"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).cast("binary").alias("raw"))
    return geojson.feature_text(c).select(F.get_json_object("feature", "$.id").cast("long").alias("k"), "feature")


@query(f"SELECT k, CASE WHEN k % 6 = 0 THEN NULL ELSE {sq('lng', '1e3')} END AS x, k % 6 = 0 AS none FROM {PTS}")
def snk11_empty_to_null(spark: S, sf: str) -> DataFrame:
    """An empty point is written as null."""
    empty = F.lit(bytes.fromhex("0101000000000000000000f87f000000000000f87f"))
    p = points(spark, sf).select("k", F.when(F.col("k") % 6 == 0, empty).otherwise(G.st_point(F.col("lng"), F.col("lat"))).alias("geometry"))
    out, _ = geoparquet.layout(p, "geometry")
    return out.select("k", q(F.col("xmin"), 1e3).alias("x"), F.col("geometry").isNull().alias("none"))


# --- extensions: joins, windows, sets

CITY = "(SELECT c_custkey AS id, ((c_custkey*3571+17) % 360000)/1e3 - 180e0 AS xmin, ((c_custkey*1299+3) % 170000)/1e3 - 85e0 AS ymin, ((c_custkey*3571+17) % 360000)/1e3 - 177e0 AS xmax, ((c_custkey*1299+3) % 170000)/1e3 - 83e0 AS ymax FROM customer)"


def cities(spark: S, sf: str) -> DataFrame:
    x, y = ((F.col("c_custkey") * 3571 + 17) % 360000) / 1e3, ((F.col("c_custkey") * 1299 + 3) % 170000) / 1e3
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (x - 180.0).alias("xmin"), (y - 85.0).alias("ymin"), (x - 177.0).alias("xmax"), (y - 83.0).alias("ymax"))


@query(f"SELECT id, count(*) AS n, min(k) AS first_k FROM {PTS} p JOIN {CITY} c ON p.lng >= c.xmin AND p.lng <= c.xmax AND p.lat >= c.ymin AND p.lat <= c.ymax GROUP BY id")
def ext_points_in_boxes(spark: S, sf: str) -> DataFrame:
    pairs = J.points_in_boxes(points(spark, sf), cities(spark, sf), 4.0, "lng", "lat", salt=2)
    return pairs.groupBy(F.col("b.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("a.k").alias("first_k"))


@query(f"SELECT a.id AS a, b.id AS b FROM {CITY} a JOIN {CITY} b ON a.id < b.id AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin")
def ext_box_join(spark: S, sf: str) -> DataFrame:
    c = cities(spark, sf)
    return J.box_join(c, c, 4.0).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(f"SELECT id, count(*) AS n FROM {PTS} p JOIN {CITY} c ON p.lng > c.xmin AND p.lng < c.xmax AND p.lat > c.ymin AND p.lat < c.ymax AND (p.lat - c.ymin) < (p.lng - c.xmin) * 2e0/3e0 - 1e-9 GROUP BY id")
def ext_points_in_polygons(spark: S, sf: str) -> DataFrame:
    """Points inside the lower right half of each box, 1e-9 and more below its diagonal."""
    c = cities(spark, sf)
    a, b = M.point(F.col("xmin") + 1.5e-9, F.col("ymin")), M.point(F.col("xmax"), F.col("ymax") - 1e-9)
    wedge = c.select("id", *M.BOX, G.st_polygon(F.array(F.array(a, M.point(F.col("xmax"), F.col("ymin")), b, a))).alias("geometry"))
    pairs = J.points_in_polygons(points(spark, sf), wedge, 4.0, "lng", "lat")
    return pairs.groupBy(F.col("b.id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.event_id, max_by(b.value, b.ts) AS last_value FROM events a LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id")
def ext_as_of_join(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return J.as_of(e.select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["last_value"]).select("event_id", "last_value")


@query("SELECT a.event_id, max_by(b.value, b.ts) AS last_value FROM events a LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ts) b ON b.ts <= a.ts GROUP BY a.event_id")
def ext_as_of_hot_key(spark: S, sf: str) -> DataFrame:
    """The latest click of anybody: one key for all rows, worked on day by day."""
    e = table(spark, sf, "events").withColumn("all", F.lit(1))
    clicks = e.where("event_type = 'click'").groupBy("all", "ts").agg(F.max("value").alias("last_value"))
    return J.as_of(e.select("event_id", "all", "ts"), clicks, ["all"], "ts", ["last_value"], F.date_trunc("day", F.col("ts"))).select("event_id", "last_value")


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s")
def ext_sessions(spark: S, sf: str) -> DataFrame:
    s = W.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(f"SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum({sq('value')}) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", q(F.col("value")).alias("value"))
    t = W.tumbling(e)
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(f"SELECT r_name, n_name, count(*) AS n, {sq('sum(floor(o_totalprice*100+5e-1))', '1e0')} AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(spark: S, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(q(F.col("o_totalprice"))).alias("cents"))


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def ext_anti_join(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return c.join(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("SELECT o_custkey AS k, o_orderkey, CAST(r AS INT) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def ext_top_per_group(spark: S, sf: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("r", r).where("r <= 3").select(F.col("o_custkey").alias("k"), "o_orderkey", "r")


# --- schema


@query("SELECT c_custkey AS k, c_name AS third, 'string' AS tag, c_acctbal < 0 AS negative FROM customer")
def prj5_attributes(spark: S, sf: str) -> DataFrame:
    """Cells by place and by name, and their types."""
    c = table(spark, sf, "customer")
    by_name = F.col(X.field_by_name(c.schema, "c_acctbal").name)
    return c.select(X.attribute(c, 0).alias("k"), X.attribute(c, X.field_index(c.schema, "c_name")).alias("third"), X.type_tag(F.col("c_name")).alias("tag"), (by_name < 0).alias("negative"))


@query("SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS whole, CAST(o_orderkey % 2 = 0 AS VARCHAR) AS flag, lower(hex(o_orderpriority)) AS raw FROM orders")
def prj8_report_values(spark: S, sf: str) -> DataFrame:
    """Values as a report shows them."""
    from pyspark.sql import types as ST

    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), V.report_json(F.col("o_custkey"), ST.LongType()).alias("whole"), V.report_json(F.col("o_orderkey") % 2 == 0, ST.BooleanType()).alias("flag"), V.report_json(F.col("o_orderpriority").cast("binary"), ST.BinaryType()).alias("raw"))


@query("SELECT n_nationkey AS k, 4 AS a, 6 AS b, n_nationkey % 2 = 0 AS good FROM nation")
def ras2_pixel_counts(spark: S, sf: str) -> DataFrame:
    """Pixels of a band, bytes of a tile, and whether a tile is whole."""
    data = F.lit(bytes(8))
    n = table(spark, sf, "nation")
    bands = F.array(F.struct(F.lit("U16").alias("dtype"), F.when(F.col("n_nationkey") % 2 == 0, data).otherwise(F.lit(bytes(7))).alias("data")))
    return n.select(F.col("n_nationkey").alias("k"), A.pixel_count(data, F.lit("U16")).cast("int").alias("a"), A.tile_bytes(F.lit(2), F.lit(1), F.array(F.lit("U8"), F.lit("I16"))).alias("b"), A.well_formed(F.lit(2), F.lit(2), bands).alias("good"))
