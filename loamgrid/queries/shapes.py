"""Lines, boxes and WKB: measures, envelopes, kinds, simplification."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions import measure as M
from loamgrid.functions.crs import transform_points
from loamgrid.queries.base import BXS, LNS, PTS, VTX, boxes, lines, points, q, query, sq, vertices
from loamgrid.queries.places import CLAMP, MX

S = SparkSession


def ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed counter-clockwise ring around a box."""
    return F.array(M.point(west, south), M.point(east, south), M.point(east, north), M.point(west, north), M.point(west, south))


def donuts(spark: S, sf: str) -> DataFrame:
    """(k, polygon): each order's box with a hole over a quarter of each side; every fifth has none."""
    b = boxes(spark, sf)
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    hole = ring(F.col("xmin") + w / 4, F.col("ymin") + h / 4, F.col("xmin") + w / 2, F.col("ymin") + h / 2)
    outer = ring(*[F.col(c) for c in M.BOX])
    return b.select("k", *M.BOX, F.when(F.col("k") % 5 == 0, F.array(outer)).otherwise(F.array(outer, hole)).alias("polygon"))


@query(f"SELECT k, CAST(min(x)*4 AS BIGINT) AS xmin, CAST(min(y)*4 AS BIGINT) AS ymin, CAST(max(x)*4 AS BIGINT) AS xmax, CAST(max(y)*4 AS BIGINT) AS ymax FROM {VTX} GROUP BY k")
def geo4_bbox(spark: S, sf: str) -> DataFrame:
    e = lines(spark, sf).select("k", M.bbox(F.col("line")).alias("e"))
    return e.select("k", *[(F.col(f"e.{c}") * 4).cast("long").alias(c) for c in M.BOX])


@query(f"SELECT k, count(*)::INT AS n FROM {VTX} GROUP BY k")
def geo3_coord_count(spark: S, sf: str) -> DataFrame:
    return lines(spark, sf).select("k", M.coord_count(F.array("line")).alias("n"))


@query(f"SELECT k, coalesce(sum(floor(sqrt((bx-x)*(bx-x) + (b_y-y)*(b_y-y)) * 1e6 + 5e-1)::BIGINT), 0)::BIGINT AS d FROM (SELECT k, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM {VTX} WINDOW w AS (PARTITION BY k ORDER BY n, x, y)) GROUP BY k")
def geo12_segments(spark: S, sf: str) -> DataFrame:
    """Lengths of the segments, rounded one by one."""
    pairs = lines(spark, sf).select("k", F.transform(M._pairs(F.col("line")), lambda s: q(M.distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]), 1e6)).alias("d"))
    return pairs.select("k", F.aggregate("d", F.lit(0).cast("long"), lambda t, x: t + x).alias("d"))


@query(f"SELECT k, {sq('list_sum(list_transform(range(1, len(v)), lambda i: sqrt((v[i+1].x-v[i].x)*(v[i+1].x-v[i].x) + (v[i+1].y-v[i].y)*(v[i+1].y-v[i].y))))', '1e4')} AS d FROM {LNS} WHERE len(v) > 1 UNION ALL SELECT k, CAST(0 AS BIGINT) FROM {LNS} WHERE len(v) < 2")
def geo13_length(spark: S, sf: str) -> DataFrame:
    return lines(spark, sf).select("k", q(M.length(F.col("line")), 1e4).alias("d"))


@query(f"SELECT k, CASE WHEN len(v) < 3 THEN CAST(0 AS BIGINT) ELSE CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i].x*v[i % len(v) + 1].y - v[i % len(v) + 1].x*v[i].y)) * 16 AS BIGINT) END AS a32 FROM {LNS}")
def geo14_signed_area(spark: S, sf: str) -> DataFrame:
    """Coordinates are quarters, so that twice the area times sixteen is a whole number."""
    return lines(spark, sf).select("k", F.round(M.signed_area(F.col("line")) * 32).cast("long").alias("a32"))


@query(f"SELECT k, {sq('(xmax-xmin)*(ymax-ymin)*(CASE WHEN k % 5 = 0 THEN 1e0 ELSE 15e0/16e0 END)', '256e0')} AS a FROM {BXS}")
def geo16_polygon_area(spark: S, sf: str) -> DataFrame:
    return donuts(spark, sf).select("k", q(M.polygon_area(F.col("polygon")), 256.0).alias("a"))


@query(f"SELECT k, false AS empty_line, k % 4 = 0 AS empty_polygon, CASE WHEN k % 5 = 0 THEN 5 ELSE 10 END AS n FROM {BXS}")
def flt5_empty(spark: S, sf: str) -> DataFrame:
    d = donuts(spark, sf)
    p = F.when(F.col("k") % 4 == 0, F.slice("polygon", 1, 0)).otherwise(F.col("polygon"))
    return d.select("k", M.line_is_empty(F.get("polygon", F.lit(0))).alias("empty_line"), M.polygon_is_empty(p).alias("empty_polygon"), M.coord_count(F.col("polygon")).alias("n"))


@query(f"SELECT k, CAST(len(v) AS INT) AS n, {sq('list_sum(list_transform(v, lambda p: floor(6378137e0 * radians(p.x) * 1e2 + 5e-1)))', '1e0')} AS x FROM {LNS}")
def crs8_transform_points(spark: S, sf: str) -> DataFrame:
    """Whole lines to Web Mercator; eastings rounded to centimetres and added."""
    moved = lines(spark, sf).select("k", transform_points(F.col("line"), 4326, 3857).alias("m"))
    return moved.select("k", F.size("m").alias("n"), F.aggregate(F.transform("m", lambda p: q(p["x"])), F.lit(0).cast("long"), lambda t, x: t + x).alias("x"))


# --- WKB




@query(f"SELECT k, {sq('lng', '1e3')} AS xmin, {sq('lat', '1e3')} AS ymin, {sq('lng', '1e3')} AS xmax, {sq('lat', '1e3')} AS ymax, 'Point' AS kind, false AS empty, 1 AS n FROM {PTS}")
def geo5_point_wkb(spark: S, sf: str) -> DataFrame:
    """Points to WKB and back: envelope, kind, emptiness, count."""
    w = points(spark, sf).select("k", G.st_point(F.col("lng"), F.col("lat")).alias("w"))
    e = w.select("k", "w", G.st_bbox(F.col("w")).alias("e"))
    return e.select("k", *[q(F.col(f"e.{c}"), 1e3).alias(c) for c in M.BOX], G.st_kind(F.col("w")).alias("kind"), G.st_is_empty(F.col("w")).alias("empty"), G.st_coord_count(F.col("w")).alias("n"))


@query(f"SELECT k, CAST(min(x)*4 AS BIGINT) AS xmin, CAST(max(y)*4 AS BIGINT) AS ymax, count(*)::INT AS n, 'LineString' AS kind FROM {VTX} GROUP BY k")
def geo8_line_wkb(spark: S, sf: str) -> DataFrame:
    w = lines(spark, sf).select("k", G.st_line(F.col("line")).alias("w")).select("k", "w", G.st_bbox(F.col("w")).alias("e"))
    return w.select("k", (F.col("e.xmin") * 4).cast("long").alias("xmin"), (F.col("e.ymax") * 4).cast("long").alias("ymax"), G.st_coord_count(F.col("w")).alias("n"), G.st_kind(F.col("w")).alias("kind"))


@query(f"SELECT k, {sq('(xmax-xmin)*(ymax-ymin)*(CASE WHEN k % 5 = 0 THEN 1e0 ELSE 15e0/16e0 END)', '256e0')} AS a, 'Polygon' AS kind FROM {BXS}")
def geo16_polygon_wkb(spark: S, sf: str) -> DataFrame:
    w = donuts(spark, sf).select("k", G.st_polygon(F.col("polygon")).alias("w"))
    return w.select("k", q(G.st_area(F.col("w")), 256.0).alias("a"), G.st_kind(F.col("w")).alias("kind"))


@query(f"SELECT k, n, CAST(x*4 AS BIGINT) AS x, CAST(y*4 AS BIGINT) AS y FROM (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY n, x, y) AS INT) AS n, x, y FROM {VTX})")
def geo8_wkb_vertices(spark: S, sf: str) -> DataFrame:
    """Lines to WKB and back to their vertices."""
    w = lines(spark, sf).select("k", G.st_points(G.st_line(F.col("line"))).alias("p"))
    return w.select("k", F.posexplode("p").alias("n", "p")).select("k", (F.col("n") + 1).alias("n"), (F.col("p.x") * 4).cast("long").alias("x"), (F.col("p.y") * 4).cast("long").alias("y"))


@query(f"SELECT k, {sq(MX)} AS x_cm, {sq(f'6378137e0 * ln(tan(pi()/4 + radians({CLAMP})/2))')} AS y_cm FROM {PTS}")
def crs9_transform_wkb(spark: S, sf: str) -> DataFrame:
    """The same projection over WKB as over columns."""
    w = points(spark, sf).select("k", G.st_bbox(G.st_transform(G.st_point(F.col("lng"), F.col("lat")), 4326, 3857)).alias("e"))
    return w.select("k", q(F.col("e.xmin")).alias("x_cm"), q(F.col("e.ymin")).alias("y_cm"))


@query("SELECT k, '{\"type\":\"Point\",\"coordinates\":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']}' AS j FROM (SELECT k, CAST(min(x) AS DOUBLE) AS x, CAST(min(y) AS DOUBLE) AS y FROM " + VTX + " GROUP BY k)")
def geo10_geojson(spark: S, sf: str) -> DataFrame:
    corner = vertices(spark, sf).groupBy("k").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return corner.select("k", G.st_as_geojson(G.st_point(F.col("x"), F.col("y"))).alias("j"))


@query(f"SELECT k, CAST(min(x)*4 AS BIGINT) AS x, count(*)::INT AS n FROM {VTX} GROUP BY k")
def geo9_from_geojson(spark: S, sf: str) -> DataFrame:
    w = lines(spark, sf).select("k", G.st_from_geojson(F.concat(F.lit('{"type":"MultiPoint","coordinates":'), F.to_json(F.transform("line", lambda p: F.array(p["x"], p["y"]))), F.lit("}"))).alias("w"))
    return w.select("k", (G.st_bbox(F.col("w"))["xmin"] * 4).cast("long").alias("x"), G.st_coord_count(F.col("w")).alias("n"))


@query()
def geo17_simplify(spark: S, sf: str) -> DataFrame:
    """Douglas-Peucker: vertices kept of each line; no SQL."""
    w = lines(spark, sf).select("k", G.st_line(F.col("line")).alias("w"))
    return w.select("k", G.st_coord_count(G.st_simplify(F.col("w"), 1.0)).alias("n"))
