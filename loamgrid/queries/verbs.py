"""The jobs, run on files that the queries write themselves, and readers of formats that others write."""

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.core import errors as E
from loamgrid.functions import affine as A
from loamgrid.functions import crs as C
from loamgrid.functions import geometry as G
from loamgrid.functions import measure as M
from loamgrid.functions import schema as X
from loamgrid.functions import tiles as T
from loamgrid.functions import values as V
from loamgrid.operators import raster as R
from loamgrid.operators import spatial_join as J
from loamgrid.operators import vector_tiles as VT
from loamgrid.plans import jobs
from loamgrid.queries import fixtures
from loamgrid.queries.base import LNS, PTS, PXS, VTX, hilbert_sql, lines, pixels, points, q, query, sq, table, vertices
from loamgrid.queries.places import GRID, Z10
from loamgrid.queries.reports import CITY, SIX, _PLACES, _local, _placed, cities, places, raster
from loamgrid.sources import binary, files, geojson, geoparquet, geotiff, images, pmtiles
from loamgrid.sources.files import scratch
from loamgrid.streaming import windows as W

S = SparkSession


def _written(spark: S, sf: str, **options) -> str:
    path = scratch(spark, "places.parquet")
    geoparquet.write(places(spark, sf), path, **options)
    return path


# --- jobs


@query(_PLACES)
def job1_convert(spark: S, sf: str) -> DataFrame:
    """Parquet to one GeoJSON document and back to Parquet."""
    there, back = _local(spark, "there.geojson"), scratch(spark, "back.parquet")
    jobs.convert(spark, _written(spark, sf), there)
    jobs.convert(spark, there, back)
    return _placed(jobs.read_layer(spark, back))


@query("SELECT count(*) AS features, true AS timed, true AS sized FROM orders")
def job1_convert_report(spark: S, sf: str) -> DataFrame:
    out = jobs.convert(spark, _written(spark, sf), scratch(spark, "again.parquet"))
    return spark.createDataFrame([(out["features"], out["seconds"] > 0, out["bytes"] is None or out["bytes"] > 0)], "features long, timed boolean, sized boolean")


@query(f"SELECT k, {sq('lng * pi() / 180e0 * 6378137e0', '1e1')} AS x, {sq('ln(tan(pi()/4e0 + radians(lat)/2e0)) * 6378137e0', '1e1')} AS y, 3857 AS epsg FROM {PTS}")
def job2_reproject(spark: S, sf: str) -> DataFrame:
    target = scratch(spark, "moved.parquet")
    jobs.reproject(spark, _written(spark, sf), target, "EPSG:3857")
    df = jobs.read_layer(spark, target)
    return df.select("k", G.st_bbox(F.col("geometry")).alias("e"), F.lit(df.schema["geometry"].metadata["epsg"]).alias("epsg")).select("k", q(F.col("e.xmin"), 1e1).alias("x"), q(F.col("e.ymin"), 1e1).alias("y"), "epsg")


BOX_ = "-20.5,-10.25,50,40"
_INSIDE = "lng BETWEEN -20.5e0 AND 50e0 AND lat BETWEEN -10.25e0 AND 40e0"


@query(f"SELECT count(*) AS scanned, count(*) FILTER ({_INSIDE}) AS kept, count(*) FILTER ({_INSIDE}) AS stored, count(*) FILTER ({_INSIDE}) AS stored_json FROM {PTS}")
def job3_filter_bbox(spark: S, sf: str) -> DataFrame:
    """The same box over Parquet, where it reaches the scan, and over GeoJSON."""
    source, target, doc, again = _written(spark, sf), scratch(spark, "kept.parquet"), _local(spark, "all.geojson"), scratch(spark, "kept.parquet")
    out = jobs.filter_bbox(spark, source, target, jobs.parse_bbox(BOX_))
    jobs.convert(spark, source, doc)
    jobs.filter_bbox(spark, doc, again, jobs.parse_bbox(BOX_))
    return spark.createDataFrame([(out["scanned"], out["kept"], jobs.read_layer(spark, target).count(), jobs.read_layer(spark, again).count())], "scanned long, kept long, stored long, stored_json long")


_EXTENT = f"(SELECT min(lng) AS x0, min(lat) AS y0, max(lng) AS x1, max(lat) AS y1 FROM {PTS})"
_OWN_GRID = f"(SELECT k, CAST(trunc((lng - x0)/(x1 - x0) * 65535e0) AS INT) AS qx, CAST(trunc((lat - y0)/(y1 - y0) * 65535e0) AS INT) AS qy FROM {PTS}, {_EXTENT})"


@query(f"SELECT k, CAST(row_number() OVER (ORDER BY d, k) AS BIGINT) AS place FROM {hilbert_sql(_OWN_GRID, 'qx', 'qy', 16, 'k')}")
def job4_optimize_order(spark: S, sf: str) -> DataFrame:
    """The rows of an optimised file as they lie in it, numbered by their files and places; the source is in the order of the keys."""
    source, target = scratch(spark, "plain.parquet"), scratch(spark, "ordered.parquet")
    geoparquet.write(places(spark, sf).repartitionByRange(4, "k").sortWithinPartitions("k"), source)
    jobs.optimize(spark, source, target, files=3)
    rows = spark.read.parquet(target).select("k", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").select("k", (F.col("before") + F.col("i") + 1).alias("place"))


@query("SELECT * FROM (VALUES ('k', 'Int64', 1), ('flag', 'Bool', 2), ('name', 'String', 3)) t(name, type, place), (SELECT 'Point' AS kind, 4326 AS epsg, 'geoparquet' AS format, " + f"{sq('x0', '1e3')} AS xmin, {sq('y1', '1e3')} AS ymax FROM {_EXTENT})")
def job5_inspect(spark: S, sf: str) -> DataFrame:
    out = jobs.inspect(spark, _written(spark, sf))
    one = out["layers"][0]
    fields = [(f["name"], f["type"], i + 1, one["geometry"]["kind"], one["epsg"], out["format"], float(one["extent"][0]), float(one["extent"][3])) for i, f in enumerate(one["fields"])]
    df = spark.createDataFrame(fields, "name string, type string, place int, kind string, epsg int, format string, xmin double, ymax double")
    return df.withColumns({"xmin": q(F.col("xmin"), 1e3), "ymax": q(F.col("ymax"), 1e3)})


@query("SELECT 1 AS spec_version, 'loamgrid' AS generator, 'geoparquet' AS format, 1 AS layers, 3 AS fields, true AS beside")
def job6_metadata(spark: S, sf: str) -> DataFrame:
    """The sidecar, read back from beside the data."""
    path = _written(spark, sf)
    jobs.metadata(spark, path)
    doc = spark.read.option("multiLine", True).json(jobs.sidecar_path(path))
    return doc.select(F.col("spec_version").cast("int").alias("spec_version"), "generator", "format", F.size("layers").alias("layers"), F.size(F.col("layers")[0]["fields"]).alias("fields"), F.lit(jobs.sidecar_path(path).startswith(path)).alias("beside"))


_KEYS = "SELECT o_orderkey AS k FROM orders"


@query(f"SELECT 'k' AS name, 'Int64' AS type, 0 AS nulls, count(*) AS values, CAST(min(k) AS VARCHAR) AS min, CAST(max(k) AS VARCHAR) AS max, CASE WHEN count(*) <= 1000 THEN count(*) END AS \"distinct\", CASE WHEN count(*) <= 1000 THEN 1 END AS top FROM ({_KEYS}) UNION ALL SELECT 'flag', 'Bool', 0, count(*), NULL, NULL, 2, greatest(count(*) FILTER (k % 3 = 0), count(*) FILTER (k % 3 <> 0)) FROM ({_KEYS}) UNION ALL SELECT 'name', 'String', 0, count(*), NULL, NULL, CASE WHEN count(*) <= 1000 THEN count(*) END, CASE WHEN count(*) <= 1000 THEN 1 END FROM ({_KEYS})")
def job8_profile(spark: S, sf: str) -> DataFrame:
    """Each field of the report: counts, extremes, distinct values up to a thousand and the count of the commonest."""
    out = jobs.profile(spark, _written(spark, sf))
    said = lambda v: None if v is None else str(v)
    rows = [(f["name"], f["type"], f["null_count"], f["value_count"], said(f["min"]), said(f["max"]), f["distinct"], f["top"][0]["count"] if f["top"] else None) for f in out["fields"]]
    return spark.createDataFrame(rows, "name string, type string, nulls int, values long, min string, max string, distinct long, top long")


@query(f"SELECT count(*) AS features, 0 AS no_geometry, count(*) AS points, 4326 AS epsg, {sq('min(lng)', '1e3')} AS xmin, {sq('min(lat)', '1e3')} AS ymin, {sq('max(lng)', '1e3')} AS xmax, {sq('max(lat)', '1e3')} AS ymax, 5 AS sample FROM {PTS}")
def job8_profile_geometry(spark: S, sf: str) -> DataFrame:
    out = jobs.profile(spark, _written(spark, sf), sample_n=5)
    g = out["geometry"]
    df = spark.createDataFrame([(out["feature_count"], g["null_count"], g["kinds"]["Point"], g["epsg"], *map(float, g["extent"]), len(out["sample"]))], "features long, no_geometry int, points long, epsg int, xmin double, ymin double, xmax double, ymax double, sample int")
    return df.withColumns({c: q(F.col(c), 1e3) for c in M.BOX})


@query(f"SELECT k, {sq('lng * pi() / 180e0 * 6378137e0', '1e1')} AS x, true AS told FROM {PTS}")
def job9_convert_store(spark: S, sf: str) -> DataFrame:
    """From address to address, with progress on the way."""
    as_uri = lambda p: p if files.local_path(p) is None or p.startswith("file:") else f"file://{os.path.abspath(p)}"
    source, target, told = as_uri(_written(spark, sf)), as_uri(scratch(spark, "moved.parquet")), []
    jobs.convert_store(spark, source, target, 3857, progress=lambda done, all_: told.append((done, all_)))
    df = jobs.read_layer(spark, target)
    return df.select("k", q(G.st_bbox(F.col("geometry"))["xmin"], 1e1).alias("x"), F.lit(all(a <= b for a, b in told) and bool(told)).alias("told"))


@query(f"SELECT k, 64 + 45 + 24 + length(name) + 8 + 8 AS bytes FROM (SELECT k, 'o' || k AS name FROM {PTS})")
def snk6_byte_estimate(spark: S, sf: str) -> DataFrame:
    p = places(spark, sf)
    return p.select("k", V.byte_estimate(p.schema).alias("bytes"))


@query("SELECT * FROM (VALUES (4326, 3857, false), (4326, 7844, true), (7855, 32755, false), (3857, 3857, true)) t(source_crs, target_crs, identity)")
def bin26_transformer(spark: S, sf: str) -> DataFrame:
    pairs = [C.Transformer.of(a, b) for a, b in (("EPSG:4326", 3857), (4326, "7844"), (7855, 32755), (3857, 3857))]
    return spark.createDataFrame([(*t, t.identity) for t in pairs], "source_crs int, target_crs int, identity boolean")


# --- readers


def _corners(spark: S, sf: str) -> list:
    """Local rows for one file: as the formats are single files, so is the table behind them."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_acctbal").cast("double").alias("bal"))
    return cities(spark, sf).join(c, "id").orderBy("id").toLocalIterator()


@query(f"SELECT id AS fid_, CASE WHEN id % 7 = 0 THEN NULL ELSE {sq('xmin', '1e3')} END AS xmin, CASE WHEN id % 7 = 0 THEN NULL ELSE {sq('ymax', '1e3')} END AS ymax, CASE WHEN id % 7 = 0 THEN NULL ELSE 6000 END AS area, c_name AS name, CASE WHEN id % 5 = 0 THEN NULL ELSE {sq('c_acctbal')} END AS cents, id % 2 = 0 AS even FROM {CITY} JOIN customer ON c_custkey = id")
def src42_shapefile(spark: S, sf: str) -> DataFrame:
    """Boxes with their attributes; null shapes and blank cells."""
    rings, rows = [], []
    for r in _corners(spark, sf):
        x0, y0, x1, y1 = (r[c] for c in M.BOX)
        rings.append(None if r["id"] % 7 == 0 else np.array([(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]))
        rows.append((r["id"], r["c_name"], None if r["id"] % 5 == 0 else r["bal"], r["id"] % 2 == 0))
    path = _local(spark, "boxes")
    fixtures.shapefile(path, rings, [("ID", "N", 10, 0), ("NAME", "C", 30, 0), ("BAL", "N", 14, 2), ("EVEN", "L", 1, 0)], rows, 'GEOGCS["GCS_WGS_1984",AUTHORITY["EPSG","4326"]]')
    df = jobs.read_layer(spark, f"{path}.shp").select("ID", "NAME", "BAL", "EVEN", G.st_bbox(F.col("geometry")).alias("e"), G.st_area(F.col("geometry")).alias("a"))
    return df.select(F.col("ID").alias("fid_"), q(F.col("e.xmin"), 1e3).alias("xmin"), q(F.col("e.ymax"), 1e3).alias("ymax"), q(F.col("a"), 1e3).alias("area"), F.col("NAME").alias("name"), q(F.col("BAL")).alias("cents"), F.col("EVEN").alias("even"))


@query(f"SELECT row_number() OVER (ORDER BY id) AS fid, id % 7 = 0 AS none, CASE WHEN id % 7 = 0 THEN NULL ELSE {sq('xmin', '1e3')} END AS x0, CASE WHEN id % 7 = 0 THEN NULL ELSE {sq('ymax', '1e3')} END AS y2, CASE WHEN id % 5 = 0 THEN NULL ELSE c_name END AS name, CAST(id AS INT) AS n, {sq('c_acctbal')} AS cents FROM {CITY} JOIN customer ON c_custkey = id QUALIFY id % 11 <> 3")
def src33_filegdb(spark: S, sf: str) -> DataFrame:
    """Lines of three vertices from a geodatabase, with deleted rows, null shapes and null cells."""
    shapes, rows = [], []
    for r in _corners(spark, sf):
        x0, y0, x1, y1 = (r[c] for c in M.BOX)
        shapes.append(None if r["id"] % 7 == 0 else np.array([(x0, y0), (x1, y0), (x1, y1)]))
        rows.append(None if r["id"] % 11 == 3 else (None if r["id"] % 5 == 0 else r["c_name"], r["id"], r["bal"]))
    path = _local(spark, "places.gdb")
    fixtures.geodatabase(path, "corners", shapes, rows, 'GEOGCS["GCS_GDA2020"]')
    df = jobs.read_layer(spark, path, jobs.layers(path)[0])
    p = df.withColumn("p", G.st_points(F.col("geometry")))
    return p.select("fid", F.col("geometry").isNull().alias("none"), q(F.col("p")[0]["x"], 1e3).alias("x0"), q(F.col("p")[2]["y"], 1e3).alias("y2"), "name", "n", q(F.col("v")).alias("cents"))


@query("SELECT count(*) FILTER (c_custkey % 11 <> 3) AS gdb, count(*) AS shp, true AS parquet_is_silent FROM customer")
def src6_count_hints(spark: S, sf: str) -> DataFrame:
    """Counts from headers and indexes."""
    path, rows = _local(spark, "places.gdb"), [r["id"] for r in _corners(spark, sf)]
    line = np.array([(0.0, 0.0), (1.0, 1.0)])
    fixtures.geodatabase(path, "lines", [line] * len(rows), [None if i % 11 == 3 else ("n", i, 0.5) for i in rows], "")
    shp = _local(spark, "rings")
    fixtures.shapefile(shp, [np.array([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)])] * len(rows), [("ID", "N", 10, 0)], [(i,) for i in rows], "")
    return spark.createDataFrame([(jobs.feature_count(spark, path), jobs.feature_count(spark, f"{shp}.shp"), jobs.feature_count(spark, "x.parquet") is None)], "gdb long, shp long, parquet_is_silent boolean")


@query("SELECT c, r, CAST(v AS BIGINT) AS v, CAST(143750 + c * 500 AS BIGINT) AS x, CAST(-36750 - r * 500 AS BIGINT) AS y, 'grey' AS band FROM (SELECT i % 40 AS c, i // 40 AS r, (i * 37 + (SELECT count(*) FROM nation)) % 251 AS v FROM range(1200) t(i))")
def src62_image(spark: S, sf: str) -> DataFrame:
    """A grey image with a world file, as pixels with their places on the ground."""
    n = table(spark, sf, "nation").count()
    path = _local(spark, "grey.png")
    fixtures.png(path, ((np.arange(1200) * 37 + n) % 251).astype(np.uint8).reshape(30, 40), "0.5\n0\n0\n-0.5\n144\n-37\n")
    tiles = jobs.read_raster(spark, path, 4326)
    t, band = tiles.select("affine", F.col("bands")[0]["name"].alias("name")).first()
    place = A.pixel_to_world(A.affine(*t), F.col("column").cast("double"), F.col("row").cast("double"))
    return R.pixels(tiles).select(F.col("column").alias("c"), F.col("row").alias("r"), F.col("value").cast("long").alias("v"), F.round(place[0] * 1000).cast("long").alias("x"), F.round(place[1] * 1000).cast("long").alias("y"), F.lit(band).alias("band"))


@query("SELECT * FROM (VALUES ('a.gdb', 'filegdb', 'vector'), ('b/c.SHP', 'shapefile', 'vector'), ('s3://x/y.parquet', 'geoparquet', 'vector'), ('d.geojson', 'geojson', 'vector'), ('d.json', 'geojson', 'vector'), ('e.tif', 'geotiff', 'raster'), ('e.cog', 'geotiff', 'raster'), ('f.JPEG', 'image', 'raster'), ('f.png', 'image', 'raster'), ('g.pmtiles', 'pmtiles', 'vector'), ('noext', NULL, NULL), ('h.xyz', NULL, NULL)) t(path, format, modality)")
def src1_formats(spark: S, sf: str) -> DataFrame:
    rows = []
    for p in ("a.gdb", "b/c.SHP", "s3://x/y.parquet", "d.geojson", "d.json", "e.tif", "e.cog", "f.JPEG", "f.png", "g.pmtiles", "noext", "h.xyz"):
        try:
            rows.append((p, files.format_of(p), files.modality(files.format_of(p))))
        except E.ConvertError:
            rows.append((p, None, None))
    return spark.createDataFrame(rows, "path string, format string, modality string")


_DOC = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},"features":[%s]}'


@query("SELECT c_custkey AS fid, CAST(c_custkey AS DOUBLE) / CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS v, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END AS flag, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Point' ELSE 'LineString' END AS kind, 3857 AS epsg, 'GeometryCollection' AS declared FROM customer")
def src28_geojson_schema(spark: S, sf: str) -> DataFrame:
    """A document of mixed kinds and widening numbers, with ids as numbers and as text and a legacy system."""
    k = F.col("c_custkey")
    number = F.when(k % 2 == 0, k.cast("string")).otherwise((k / 2).cast("string"))
    shape = F.when(k % 3 == 0, F.lit("null")).when(k % 3 == 1, F.lit('{"type":"Point","coordinates":[1,2]}')).otherwise(F.lit('{"type":"LineString","coordinates":[[0,0],[1,1]]}'))
    flag = F.when(k % 3 == 0, F.lit("null")).when(k % 5 == 0, F.lit("true")).otherwise(F.lit("false"))
    name = F.when(k % 4 == 0, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(k.cast("string"))
    one = F.concat(F.lit('{"type":"Feature","id":'), name, F.lit(',"geometry":'), shape, F.lit(',"properties":{"v":'), number, F.lit(',"flag":'), flag, F.lit("}}"))
    path = _local(spark, "mixed.geojson")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_DOC % ",".join(r["f"] for r in table(spark, sf, "customer").select(one.alias("f")).toLocalIterator()))
    df = jobs.read_layer(spark, path)
    about = df.schema["geometry"].metadata
    return df.select("fid", "v", F.col("flag").cast("string").alias("flag"), G.st_kind(F.col("geometry")).alias("kind"), F.lit(about["epsg"]).alias("epsg"), F.lit(about["kind"]).alias("declared"))


# --- rasters


def dense(spark: S, sf: str) -> DataFrame:
    """The 64 x 64 raster as one tile; pixels without line items are 0."""
    p = pixels(spark, sf).select(F.col("c").alias("column"), F.col("r").alias("row"), F.col("v").cast("double").alias("value"))
    grid = spark.range(4096).select((F.col("id") % 64).alias("column"), F.expr("id div 64").alias("row"))
    return R.from_pixels(grid.join(p, ["column", "row"], "left").fillna(0.0, ["value"]), (0.0, 1.0, 0.0, 64.0, 0.0, -1.0), 64, "F64", None, 4326)


DENSE = f"(SELECT i % 64 AS c, i // 64 AS r, coalesce(CAST(v AS DOUBLE), 0e0) AS v FROM range(4096) t(i) LEFT JOIN {PXS} p ON p.c = i % 64 AND p.r = i // 64)"


def _kernel_sql(reach: int, weight) -> str:
    """Each pixel of a raster of twice the size: neighbours by their weights, repeated at the edge."""
    at = lambda v: f"({v} + 5e-1) / 2e0 - 5e-1"
    near = f"SELECT a.c, a.r, greatest(0, least(63, CAST(floor({at('a.c')}) AS BIGINT) + i)) AS sc, greatest(0, least(63, CAST(floor({at('a.r')}) AS BIGINT) + j)) AS sr, {weight(f'(i - ({at("a.c")} - floor({at("a.c")})))')} * {weight(f'(j - ({at("a.r")} - floor({at("a.r")})))')} AS w FROM (SELECT i % 128 AS c, i // 128 AS r FROM range(16384) t(i)) a, range({1 - reach}, {reach + 1}) x(i), range({1 - reach}, {reach + 1}) y(j)"
    return f"SELECT n.c, n.r, {sq('sum(w * v) / sum(w)', '1e3')} AS v FROM ({near}) n JOIN {DENSE} d ON d.c = n.sc AND d.r = n.sr GROUP BY n.c, n.r"


_SINC = lambda t: f"(CASE WHEN abs({t}) < 1e-12 THEN 1e0 ELSE sin(pi() * ({t})) / (pi() * ({t})) END)"
KERNELS = {
    "bilinear": (1, lambda t: f"greatest(0e0, 1e0 - abs({t}))"),
    "cubic": (2, lambda t: f"(CASE WHEN abs({t}) < 1 THEN 15e-1 * pow(abs({t}), 3) - 25e-1 * pow(abs({t}), 2) + 1 WHEN abs({t}) < 2 THEN -5e-1 * pow(abs({t}), 3) + 25e-1 * pow(abs({t}), 2) - 4 * abs({t}) + 2 ELSE 0 END)"),
    "lanczos": (3, lambda t: f"(CASE WHEN abs({t}) < 3 THEN {_SINC(t)} * {_SINC(f'({t}) / 3e0')} ELSE 0 END)"),
}


def _kernel_query(method: str):
    def run(spark: S, sf: str) -> DataFrame:
        p = R.pixels(R.resample_tiles(dense(spark, sf), 128, 128, method))
        return p.select(F.col("column").alias("c"), F.col("row").alias("r"), q(F.col("value"), 1e3).alias("v"))

    return run


for _number, _method in ((15, "bilinear"), (16, "cubic"), (17, "lanczos")):
    query(_kernel_sql(*KERNELS[_method]), name=f"ras{_number}_{_method}")(_kernel_query(_method))


def _inside(p: DataFrame) -> DataFrame:
    """Pixels of 64 x 64 and its overviews: an overview's tile is larger than the overview."""
    side = F.call_function("shiftright", F.lit(64), F.col("level"))
    return p.where((F.col("column") < side) & (F.col("row") < side))


@query(" UNION ALL ".join(f"SELECT {k} AS level, c // {1 << k} AS c, r // {1 << k} AS r, {sq('avg(v)', '1e6')} AS v FROM {DENSE} GROUP BY 2, 3" for k in range(4)))
def ras23_pyramid(spark: S, sf: str) -> DataFrame:
    """All levels down to eight pixels a side; by average, so that each is that of its whole ground."""
    p = _inside(R.pixels(R.pyramid(dense(spark, sf), 64, 64, "average", 8)))
    return p.select("level", F.col("column").alias("c"), F.col("row").alias("r"), q(F.col("value"), 1e6).alias("v"))


@query(" UNION ALL ".join(f"SELECT {k} AS level, c // {1 << k} AS c, r // {1 << k} AS r, {sq('avg(v)', '1e6')} AS v FROM {DENSE} GROUP BY 2, 3" for k in range(2)))
def ras24_raster_convert(spark: S, sf: str) -> DataFrame:
    """A raster file to another with an overview, by the job, read back as pixels."""
    source, target = _local(spark, "source.tif"), _local(spark, "target.tif")
    geotiff.write(dense(spark, sf), source, {0: (64, 64)}, "lzw")
    jobs.convert(spark, source, target, tile=64)
    p = _inside(R.pixels(jobs.read_raster(spark, target)))
    return p.select("level", F.col("column").alias("c"), F.col("row").alias("r"), q(F.col("value"), 1e6).alias("v"))


@query(f"SELECT codec, c, r, CAST(v AS BIGINT) AS v FROM {PXS}, (VALUES ('none'), ('lzw'), ('deflate'), ('packbits')) t(codec)")
def src56_codecs(spark: S, sf: str) -> DataFrame:
    """The raster through every codec that is written."""
    out = None
    for codec in ("none", "lzw", "deflate", "packbits"):
        path = _local(spark, f"{codec}.tif")
        geotiff.write(raster(spark, sf), path, {0: (64, 64)}, codec)
        p = R.pixels(geotiff.read(spark, path)).select(F.lit(codec).alias("codec"), F.col("column").alias("c"), F.col("row").alias("r"), F.col("value").cast("long").alias("v"))
        out = p if out is None else out.unionByName(p)
    return out


@query("SELECT 64 AS width, 64 AS height, 32 AS tile_width, 32 AS tile_height, 1 AS levels, 'F64' AS dtype, -1e0 AS nodata, 4326 AS epsg, 0e0 AS ox, 64e0 AS oy, 1e0 AS pw, -1e0 AS ph, true AS north_up, CAST(4 AS BIGINT) AS tiles, true AS whole")
def src54_raster_profile(spark: S, sf: str) -> DataFrame:
    """What a raster file says of itself, and its tiles."""
    path = _local(spark, "raster.tif")
    geotiff.write(raster(spark, sf), path, {0: (64, 64)})
    about = geotiff.profile(path)
    t = about["affine"]
    tiles = geotiff.read(spark, path).groupBy().agg(F.count(F.lit(1)).alias("tiles"), F.min(A.well_formed(F.col("width"), F.col("height"), F.col("bands"))).alias("whole"))
    own = spark.createDataFrame([(about["width"], about["height"], about["tile_width"], about["tile_height"], about["levels"], about["bands"][0]["dtype"], float(about["bands"][0]["nodata"]), about["epsg"], *map(float, (t[0], t[3], t[1], t[5])))], "width int, height int, tile_width int, tile_height int, levels int, dtype string, nodata double, epsg int, ox double, oy double, pw double, ph double")
    return own.withColumn("north_up", A.is_north_up(A.affine(*t))).join(tiles)


@query(f"SELECT 1 AS levels, 64 AS width, x, y, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT c // 32 AS x, r // 32 AS y, v FROM {PXS}) GROUP BY x, y")
def ras10_raster_layer(spark: S, sf: str) -> DataFrame:
    """Single tiles by the contract of a raster layer."""
    path = _local(spark, "raster.tif")
    geotiff.write(raster(spark, sf), path, {0: (64, 64)})
    layer, rows = jobs.RasterLayer(spark, path), []
    for x in range(2):
        for y in range(2):
            r = layer.read_tile(0, x, y)
            p = R.plane(r["bands"][0].asDict(), r["height"], r["width"])
            rows.append((layer.pyramid_levels(), layer.profile()["width"], x, y, int((~np.isnan(p)).sum()), int(np.nansum(p))))
    assert layer.read_tile(0, 9, 9) is None
    return spark.createDataFrame(rows, "levels int, width int, x long, y long, n long, total long")


_TARGET, _TW, _TH = R.target_grid((0.0, 1.0, 0.0, 64.0, 0.0, -1.0), 64, 64, 4326, 3857, 64)
_TARGET = tuple(map(float, _TARGET))
_SRC = f"SELECT tc, tr, CAST(floor(degrees(({_TARGET[0]!r}::DOUBLE + (tc + 5e-1) * {_TARGET[1]!r}::DOUBLE) / 6378137e0)) AS BIGINT) AS c, CAST(floor(64e0 - degrees(2e0 * atan(exp(({_TARGET[3]!r}::DOUBLE + (tr + 5e-1) * {_TARGET[5]!r}::DOUBLE) / 6378137e0)) - pi() / 2e0)) AS BIGINT) AS r FROM range({_TW}) a(tc), range({_TH}) b(tr)"


@query(f"SELECT CAST(tc AS BIGINT) AS c, CAST(tr AS BIGINT) AS r, {sq('v')} AS v FROM ({_SRC}) s JOIN {DENSE} d ON d.c = s.c AND d.r = s.r")
def ras21_warp(spark: S, sf: str) -> DataFrame:
    """The raster in Web Mercator, each pixel from the one that its centre falls on."""
    p = R.pixels(R.warp(dense(spark, sf), 4326, 3857, (_TARGET, _TW, _TH), "nearest", -1.0, 32)).where(f"column < {_TW} and row < {_TH} and value >= 0")
    return p.select(F.col("column").alias("c"), F.col("row").alias("r"), q(F.col("value")).alias("v"))


# --- tiles and archives


def decoded(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, fid, type, commands, properties) of every feature of encoded tiles (z, x, y, data).

    A task cuts a tile into its features; they are dealt anew and read one by one, so that a large tile is many tasks.
    """

    def cut(batches):
        names = ["z", "x", "y", "layer", "feature", "properties"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()))
        for batch in batches:
            for z, x, y, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, _, keys, values, raw in VT.split(data):
                    for at in range(0, len(raw), 10_000):
                        few = raw[at : at + 10_000]
                        found = [[(k, str(v)) for k, v in VT.properties(f, keys, values).items()] for f in few]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([z] * len(few), [x] * len(few), [y] * len(few), [name] * len(few), few, found), kinds, strict=True)], names)

    def read(batches):
        for batch in batches:
            each = [VT.feature(f) for f in batch.column(4).to_pylist()]
            own = [pa.array([f[n] for f in each], t) for n, t in (("id", pa.int64()), ("type", pa.int32()), ("commands", pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *own, batch.column(5)], ["z", "x", "y", "layer", "fid", "type", "commands", "properties"])

    features = tiles.select("z", "x", "y", "data").mapInArrow(cut, "z int, x long, y long, layer string, feature binary, properties map<string,string>")
    return features.repartition("feature").mapInArrow(read, "z int, x long, y long, layer string, fid long, type int, commands array<long>, properties map<string,string>")


def _unzigzag(v):
    return F.call_function("shiftrightunsigned", v, F.lit(1)).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))


def _px(lng: str, z: int, x: str) -> str:
    return f"CAST(round((({lng} + 180e0) / 360e0 * {1 << z} - {x}) * 4096) AS BIGINT)"


def _py(lat: str, z: int, y: str) -> str:
    return f"CAST(round(((1e0 - ln(tan(radians({lat})) + 1e0/cos(radians({lat})))/pi())/2e0 * {1 << z} - {y}) * 4096) AS BIGINT)"


@query(f"SELECT t.k AS fid, t.x, t.y, 1 AS type, 9 AS head, {_px('lng', 10, 't.x')} AS px, {_py('lat', 10, 't.y')} AS py, 'o' || t.k AS name, CAST(t.k % 3 = 0 AS VARCHAR) AS flag FROM {Z10} t JOIN {PTS} p ON p.k = t.k")
def til9_point_bytes(spark: S, sf: str) -> DataFrame:
    """Points encoded in tiles and decoded again: the command, the pixel and the attributes of each."""
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    p = points(spark, sf).select(F.col("k").alias("fid"), G.st_point(F.col("lng"), F.col("lat")).alias("geometry"), F.lit(10).alias("z"), x.alias("x"), y.alias("y"), F.concat(F.lit("o"), F.col("k").cast("string")).alias("name"), (F.col("k") % 3 == 0).alias("flag"))
    d = decoded(VT.encode(p, "orders"))
    c = F.col("commands")
    return d.select("fid", "x", "y", "type", c[0].cast("int").alias("head"), _unzigzag(c[1]).alias("px"), _unzigzag(c[2]).alias("py"), F.col("properties")["name"].alias("name"), F.lower(F.col("properties")["flag"]).alias("flag"))


_ROUNDED = f"(SELECT k, n, {_px('x', 0, '0')} AS px, {_py('y', 0, '0')} AS py, row_number() OVER (PARTITION BY k ORDER BY n, x, y) AS i, count(*) OVER (PARTITION BY k) AS m FROM {VTX} WHERE abs(y) < 85)"


@query(f"SELECT k AS fid, 2 AS type, CAST(9 AS BIGINT) AS move, CAST((m - 1) * 8 + 2 AS BIGINT) AS line, CAST(m * 2 + 2 AS BIGINT) AS size, CAST(sum(px) FILTER (i = m) AS BIGINT) AS last_px, CAST(sum(py) FILTER (i = m) AS BIGINT) AS last_py FROM {_ROUNDED} WHERE m > 1 GROUP BY k, m")
def til10_line_bytes(spark: S, sf: str) -> DataFrame:
    """Lines in the one tile of level 0: the commands, and the last vertex as the sum of all steps."""
    v = vertices(spark, sf).where("abs(y) < 85").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("v")).where("size(v) > 1")
    p = v.select(F.col("k").alias("fid"), G.st_line(F.transform("v", lambda v: M.point(v["x"], v["y"]))).alias("geometry"), F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    d = decoded(VT.encode(p, "lines"))
    c = F.col("commands")
    total = lambda odd: F.aggregate(F.filter(F.transform(F.concat(F.slice(c, 2, 2), F.slice(c, F.lit(5), F.size(c))), lambda x, i: F.when(i % 2 == odd, _unzigzag(x))), lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda t, x: t + x)
    return d.select("fid", "type", c[0].alias("move"), c[3].alias("line"), F.size(c).cast("long").alias("size"), total(0).alias("last_px"), total(1).alias("last_py"))


@query(f"SELECT layer, x, y, count(*) AS n FROM (SELECT 'all' AS layer, x // 64 AS x, y // 64 AS y FROM {Z10} UNION ALL SELECT 'few', x // 64, y // 64 FROM {Z10} WHERE k % 5 = 0) GROUP BY ALL")
def til15_merged_layers(spark: S, sf: str) -> DataFrame:
    """Two layers in one tile for each place."""
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(4))
    p = points(spark, sf).select(F.col("k").alias("fid"), G.st_point(F.col("lng"), F.col("lat")).alias("geometry"), F.lit(4).alias("z"), x.alias("x"), y.alias("y"))
    d = decoded(VT.merge_layers([VT.encode(p, "all"), VT.encode(p.where("fid % 5 = 0"), "few")]))
    return d.groupBy("layer", "x", "y").agg(F.count(F.lit(1)).alias("n"))


CONTENT = "(SELECT o_orderkey AS id, o_orderkey // 4 % 10 AS content FROM orders)"


@query(f"SELECT min(id) AS tile_id, count(*) AS run, content FROM (SELECT id, content, id - row_number() OVER (PARTITION BY content ORDER BY id) AS g FROM {CONTENT}) GROUP BY content, g")
def snk24_run_merge(spark: S, sf: str) -> DataFrame:
    """Neighbouring tile ids of the same content as one entry, by the writer's own merge of its sorted rows."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), (F.expr("o_orderkey div 4") % 10).alias("offset"), F.lit(1).cast("long").alias("length")).orderBy("tile_id")
    return spark.createDataFrame([(e.tile_id, e.run, e.offset) for e in pmtiles.merged(t.toLocalIterator())], "tile_id long, run long, content long")


def _counts(spark: S, sf: str, z: int) -> DataFrame:
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(z))
    return points(spark, sf).groupBy(F.lit(z).alias("z"), x.alias("x"), y.alias("y")).agg(F.concat(F.min("k").cast("string"), F.lit(":"), F.count(F.lit(1)).cast("string")).cast("binary").alias("data"))


@query(f"SELECT CAST(10 AS INT) AS z, x, y, min(k) || ':' || count(*) AS data FROM {Z10} GROUP BY x, y")
def snk26_leaves_roundtrip(spark: S, sf: str) -> DataFrame:
    """An archive with leaves, written and read again."""
    path = _local(spark, "leaves.pmtiles")
    pmtiles.write(_counts(spark, sf, 10), path, leaf_threshold=500, leaf_size=100, tile_type="unknown")
    return pmtiles.read(spark, path).select("z", "x", "y", F.col("data").cast("string").alias("data"))


@query(f"SELECT count(*) AS addressed, ceil(count(*) / 100e0)::BIGINT AS leaves, true AS split, 10 AS min_zoom, 10 AS max_zoom, 'gzip' AS tile_compression, '{{\"a\":1}}' AS metadata FROM (SELECT DISTINCT x, y FROM {Z10})")
def snk26_leaf_split(spark: S, sf: str) -> DataFrame:
    """The header, the root's leaves and the metadata of such an archive; no two tiles hold the same."""
    path = _local(spark, "leaves.pmtiles")
    pmtiles.write(_counts(spark, sf, 10), path, leaf_threshold=100, leaf_size=100, metadata={"a": 1})
    a = pmtiles.Archive(path)
    h = a.header
    return spark.createDataFrame([(sum(e.run for e in a.entries()), len(a.root), all(not e.run for e in a.root), h["min_zoom"], h["max_zoom"], h["tile_compression"], a.metadata().decode().replace(" ", ""))], "addressed long, leaves long, split boolean, min_zoom int, max_zoom int, tile_compression string, metadata string")


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN n END AS n FROM (SELECT k, count(*) OVER (PARTITION BY x, y) AS n FROM {Z10} WHERE k < 400)")
def src67_tile_lookup(spark: S, sf: str) -> DataFrame:
    """Single tiles looked up in an archive; places of the southern edge that it does not have."""
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    own = points(spark, sf).where("k < 400").select("k", F.lit(10).alias("z"), x.alias("x"), y.alias("y"))
    path = _local(spark, "lookup.pmtiles")
    pmtiles.write(own.groupBy("z", "x", "y").agg(F.count(F.lit(1)).cast("string").cast("binary").alias("data")), path, leaf_threshold=20, leaf_size=10)
    a = pmtiles.Archive(path)
    rows = []
    for r in own.toLocalIterator():  # some hundred rows
        found = a.tile(r["z"], r["x"], r["y"] if r["k"] % 2 == 0 else 1023 - r["k"] % 3)
        rows.append((r["k"], None if found is None else int(found)))
    return spark.createDataFrame(rows, "k long, n long")


# --- small functions


@query("SELECT * FROM (VALUES ('4326', 4326), ('EPSG:3857', 3857), ('epsg:7855', 7855), ('urn:ogc:def:crs:EPSG::3857', 3857), ('GEOGCS[\"GCS_GDA2020\",DATUM[\"D\"]]', 7844), ('PROJCS[\"GDA2020_MGA_Zone_55\",GEOGCS[\"GCS_GDA2020\"]]', 7855), ('PROJCS[\"x\",GEOGCS[\"y\",AUTHORITY[\"EPSG\",\"4326\"]],AUTHORITY[\"EPSG\",\"32755\"]]', 32755), ('LOCAL_CS[\"nowhere\"]', NULL)) t(crs, epsg)")
def crs1_codes(spark: S, sf: str) -> DataFrame:
    """Systems as they are given, and their codes."""
    texts = ["4326", "EPSG:3857", "epsg:7855", "urn:ogc:def:crs:EPSG::3857", 'GEOGCS["GCS_GDA2020",DATUM["D"]]', 'PROJCS["GDA2020_MGA_Zone_55",GEOGCS["GCS_GDA2020"]]', 'PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32755"]]', 'LOCAL_CS["nowhere"]']
    rows = [(t, C.parse_crs(t) if re.fullmatch(r"(?i:EPSG:)?\d+", t) else C.epsg_of(t)) for t in texts]
    return spark.createDataFrame(rows, "crs string, epsg int")


@query("SELECT z AS zone, 32600 + z AS north, 32700 + z AS south, CAST(6 * z - 183 AS DOUBLE) AS meridian, 1e7 AS southern_northing, '{\"id\": {\"authority\": \"EPSG\", \"code\": ' || (32600 + z) || '}}' AS projjson FROM range(1, 61) t(z)")
def crs5_zones(spark: S, sf: str) -> DataFrame:
    """The parameters of the transverse zones by their codes."""
    import json

    rows = []
    for z in range(1, 61):
        north, south = C.projection(32600 + z), C.projection(32700 + z)
        rows.append((z, 32600 + z, 32700 + z, north.lon0, south.fn, json.dumps(C.projjson(32600 + z))))
    return spark.createDataFrame(rows, "zone long, north long, south long, meridian double, southern_northing double, projjson string")


@query("SELECT k, length(bin(k)) AS bits, ceil(length(bin(k)) / 7e0)::BIGINT AS bytes, k AS back, -k AS signed, k * 2 - 1 AS zigzag FROM (SELECT o_orderkey + 1 AS k FROM orders)")
def bin3_varints(spark: S, sf: str) -> DataFrame:
    """Integers of variable width: their bytes, read again by both readers, and the zigzag form of the negative."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw = [binary.varuint(k) for k in keys]
            signed = binary.Cursor(b"".join(binary.varint(-k) for k in keys)).varints(len(keys))
            back = [binary.Cursor(r).varuint() for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([k.bit_length() for k in keys], pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(back, pa.int64()), pa.array(signed), pa.array([binary.zigzag(-k) for k in keys], pa.int64())], ["k", "bits", "bytes", "back", "signed", "zigzag"])

    return table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("k")).mapInArrow(run, "k long, bits long, bytes long, back long, signed long, zigzag long")


@query("SELECT o_orderkey AS k, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024*1024 THEN printf('%.2f KB', n / 1024e0) ELSE printf('%.2f MB', n / 1048576e0) END AS said FROM (SELECT o_orderkey, o_orderkey * 97 + 5 AS n FROM orders)")
def dat7_human_bytes(spark: S, sf: str) -> DataFrame:
    said = F.udf(V.human_bytes, "string")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), said(F.col("o_orderkey") * 97 + 5).alias("said"))


_FLAGS = (("0101000000", False, False), ("0101000080", True, False), ("01E9030000", True, False), ("01D1070000", False, True), ("01B90B0000", True, True), ("0020000001", False, False), ("00000003E9", True, False), ("01010000C0", True, True), ("0102000040", False, True))


@query("SELECT n_nationkey AS k, head, has_z, has_m FROM nation, (VALUES " + ", ".join(f"({i}, '{h}', {z}, {m})" for i, (h, z, m) in enumerate(_FLAGS)) + f") t(i, head, has_z, has_m) WHERE i = n_nationkey % {len(_FLAGS)}")
def flt6_dimensions(spark: S, sf: str) -> DataFrame:
    """Third and fourth ordinates by the type code, in both byte orders and both conventions."""
    heads = F.array(*[F.lit(h) for h, _, _ in _FLAGS])
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.get(heads, (F.col("n_nationkey") % len(_FLAGS)).cast("int")).alias("head"))
    wkb = F.unhex("head")
    return n.select("k", "head", G.st_has_z(wkb).alias("has_z"), G.st_has_m(wkb).alias("has_m"))


_DIST = "abs((b.x - a.x) * (a.y - c.y) - (a.x - c.x) * (b.y - a.y)) / sqrt((b.x - a.x)*(b.x - a.x) + (b.y - a.y)*(b.y - a.y))"
_FIRST3 = f"(SELECT k, v[1] AS a, v[3] AS b, v[2] AS c FROM {LNS} WHERE len(v) >= 3)"


@query(f"SELECT k, CAST(CASE WHEN (CASE WHEN a.x = b.x AND a.y = b.y THEN sqrt((c.x - a.x)*(c.x - a.x) + (c.y - a.y)*(c.y - a.y)) ELSE {_DIST} END) > 2e0 THEN 3 ELSE 2 END AS INT) AS n FROM {_FIRST3}")
def geo18_simplify_three(spark: S, sf: str) -> DataFrame:
    """Lines of three vertices: the middle one stays if it is farther than the tolerance from the line of the others."""
    three = lines(spark, sf).where("size(line) >= 3").select("k", F.slice("line", 1, 3).alias("line"))
    return three.select("k", G.st_coord_count(G.st_simplify(G.st_line(F.col("line")), 2.0)).alias("n"))


@query("SELECT * FROM (VALUES ('c_custkey', 0, 'long', true), ('c_name', 1, 'string', true)) t(name, place, kind, found), (SELECT 'Customer' AS alias, 25 AS width)")
def prj1_fields(spark: S, sf: str) -> DataFrame:
    """Fields by place and by name, with an alias and a width."""
    c = X.described(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "Customer", 25)
    meta = X.field_by_name(c.schema, "c_name").metadata
    rows = [(X.field(c.schema, i).name, X.field_index(c.schema, n), X.field(c.schema, i).dataType.simpleString().replace("bigint", "long"), X.field_by_name(c.schema, n) is not None, meta["alias"], meta["width"]) for i, n in enumerate(c.columns)]
    return spark.createDataFrame(rows, "name string, place int, kind string, found boolean, alias string, width int")


# --- windows and sets


@query("SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s FROM events) GROUP BY s")
def ext_sliding(spark: S, sf: str) -> DataFrame:
    t = W.sliding(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


_EVENTS = "(SELECT date_trunc('hour', ts) AS w, ((event_id*7919+104729) % 360000)/1e3 - 180e0 AS lng, ((event_id*6101+7) % 160000)/1e3 - 80e0 AS lat FROM events)"
_EVENT_TILES = f"(SELECT w, CAST(floor((lng + 180e0)/360e0*64) AS BIGINT) AS x, CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0/cos(radians(lat)))/pi())/2e0*64) AS BIGINT) AS y FROM {_EVENTS})"


@query(f"SELECT w AS window_start, d + 1365 AS tile_id, count(*) AS n FROM {hilbert_sql(_EVENT_TILES, 'x', 'y', 6, 'w')} GROUP BY ALL")
def ext_tile_counts(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    placed = e.withColumns({"lng": ((F.col("event_id") * 7919 + 104729) % 360000) / 1e3 - 180.0, "lat": ((F.col("event_id") * 6101 + 7) % 160000) / 1e3 - 80.0})
    return W.tile_counts(placed).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_WIDE = "(SELECT c_custkey AS id, ((c_custkey*3571+17) % 360000)/1e3 - 180e0 AS xmin, ((c_custkey*1299+3) % 170000)/1e3 - 85e0 AS ymin, ((c_custkey*3571+17) % 360000)/1e3 - 180e0 + CASE WHEN c_custkey % 50 = 0 THEN 90e0 ELSE 1e0 END AS xmax, ((c_custkey*1299+3) % 170000)/1e3 - 85e0 + CASE WHEN c_custkey % 50 = 0 THEN 20e0 ELSE 5e-1 END AS ymax FROM customer)"


@query(f"SELECT a.id AS a, b.id AS b FROM {_WIDE} a JOIN {_WIDE} b ON a.id < b.id AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin")
def ext_box_join_sizes(spark: S, sf: str) -> DataFrame:
    """Boxes of very different sizes: each touches few cells of its own level."""
    x, y = ((F.col("c_custkey") * 3571 + 17) % 360000) / 1e3 - 180.0, ((F.col("c_custkey") * 1299 + 3) % 170000) / 1e3 - 85.0
    big = F.col("c_custkey") % 50 == 0
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), x.alias("xmin"), y.alias("ymin"), (x + F.when(big, 90.0).otherwise(1.0)).alias("xmax"), (y + F.when(big, 20.0).otherwise(0.5)).alias("ymax"))
    return J.box_join(c, c, 1.0, salt=2).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("SELECT event_id, min(user_id) AS user_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_id")
def ext_distinct_events(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return W.distinct_events(e.unionByName(e)).select("event_id", "user_id")


@query("SELECT c_custkey AS k, 'both' AS side FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders UNION ALL (SELECT c_custkey, 'left' FROM customer EXCEPT SELECT o_custkey, 'left' FROM orders)")
def ext_sets(spark: S, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("left")))
