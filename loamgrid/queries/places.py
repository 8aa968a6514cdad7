"""Points: systems, tiles, ordering keys, day numbers, and the filters over boxes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import crs as C
from loamgrid.functions import index as I
from loamgrid.functions import measure as M
from loamgrid.functions import tiles as T
from loamgrid.functions import values as V
from loamgrid.queries.base import BXS, PTS, boxes, hilbert_sql, points, q, query, sq, table, undecided

R, TOP = "6378137e0", "85.05112877980659e0"
CLAMP = f"greatest(-{TOP}, least({TOP}, lat))"
MX, MY = f"{R} * radians(lng)", f"{R} * ln(tan(pi()/4 + radians({CLAMP})/2))"
S = SparkSession


@query(f"SELECT k, {sq(MX)} AS x_cm, {sq(MY)} AS y_cm FROM {PTS}")
def crs11_mercator_forward(spark: S, sf: str) -> DataFrame:
    x, y = C.mercator_forward(F.col("lng"), F.col("lat"))
    return points(spark, sf).select("k", q(x).alias("x_cm"), q(y).alias("y_cm"))


@query(f"SELECT k, {sq('degrees(x/6378137e0)', '1e7')} AS lng_e7, {sq('degrees(2*atan(exp(y/6378137e0)) - pi()/2)', '1e7')} AS lat_e7 FROM (SELECT k, lng * 1e5 AS x, lat * 2e5 AS y FROM {PTS})")
def crs12_mercator_inverse(spark: S, sf: str) -> DataFrame:
    a, b = C.mercator_inverse(F.col("lng") * 1e5, F.col("lat") * 2e5)
    return points(spark, sf).select("k", q(a, 1e7).alias("lng_e7"), q(b, 1e7).alias("lat_e7"))


def _tm_forward_sql(p: C.Projection, lng: str, lat: str, source: str, keep: str) -> str:
    n = C.ELLIPSOIDS[p.ellipsoid].n
    s, e = C.series(n), 2 * n**0.5 / (1 + n)
    one = f"(SELECT {keep}, sinh(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat})))) AS t, radians({lng} - {p.lon0!r}::DOUBLE) AS w FROM {source})"
    two = f"(SELECT {keep}, atan2(t, cos(w)) AS xi, asinh(sin(w) / sqrt(t*t + cos(w)*cos(w))) AS eta FROM {one})"
    xs = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j}*xi) * cosh({2 * j}*eta)" for j, a in enumerate(s.alpha, 1)]])
    es = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j}*xi) * sinh({2 * j}*eta)" for j, a in enumerate(s.alpha, 1)]])
    return f"(SELECT {keep}, {p.fe!r}::DOUBLE + {p.k0 * s.radius!r}::DOUBLE * ({es}) AS e, {p.fn!r}::DOUBLE + {p.k0 * s.radius!r}::DOUBLE * ({xs}) AS n FROM {two})"


def _tm_inverse_sql(p: C.Projection, x: str, y: str, source: str, keep: str) -> str:
    s = C.series(C.ELLIPSOIDS[p.ellipsoid].n)
    m = f"{p.k0 * s.radius!r}::DOUBLE"
    one = f"(SELECT {keep}, ({y} - {p.fn!r}::DOUBLE) / {m} AS a, ({x} - {p.fe!r}::DOUBLE) / {m} AS b FROM {source})"
    xs = " - ".join(["a", *[f"{c!r}::DOUBLE * sin({2 * j}*a) * cosh({2 * j}*b)" for j, c in enumerate(s.beta, 1)]])
    es = " - ".join(["b", *[f"{c!r}::DOUBLE * cos({2 * j}*a) * sinh({2 * j}*b)" for j, c in enumerate(s.beta, 1)]])
    two = f"(SELECT {keep}, {xs} AS xi, {es} AS eta FROM {one})"
    three = f"(SELECT {keep}, xi, eta, atan2(sin(xi), sqrt(sinh(eta)*sinh(eta) + cos(xi)*cos(xi))) AS chi FROM {two})"
    ls = " + ".join(["chi", *[f"{d!r}::DOUBLE * sin({2 * j}*chi)" for j, d in enumerate(s.delta, 1)]])
    return f"(SELECT {keep}, {p.lon0!r}::DOUBLE + degrees(atan2(sinh(eta), cos(xi))) AS lng, degrees({ls}) AS lat FROM {three})"


NEAR = f"(SELECT k, 9e0 + lng/90e0 AS lng, lat FROM {PTS})"


@query(f"SELECT k, {sq('e')} AS e_cm, {sq('n')} AS n_cm FROM {_tm_forward_sql(C.projection(32632), 'lng', 'lat', NEAR, 'k')}")
def crs13_utm_forward(spark: S, sf: str) -> DataFrame:
    e, n = C.transform(9.0 + F.col("lng") / 90.0, F.col("lat"), 4326, 32632)
    return points(spark, sf).select("k", q(e).alias("e_cm"), q(n).alias("n_cm"))


ENS = f"(SELECT k, 5e5 + lng*1e3 AS x, lat*1e5 AS y FROM {PTS})"


@query(f"SELECT k, {sq('lng', '1e7')} AS lng_e7, {sq('lat', '1e7')} AS lat_e7 FROM {_tm_inverse_sql(C.projection(32633), 'x', 'y', ENS, 'k')}")
def crs14_utm_inverse(spark: S, sf: str) -> DataFrame:
    """Places at which the rounding hangs on the last bits are computed once more, by the C library as in the SQL's engine."""
    grid = points(spark, sf).select("k", (500000.0 + F.col("lng") * 1e3).alias("x"), (F.col("lat") * 1e5).alias("y"))
    a, b = C.transform(F.col("x"), F.col("y"), 32633, 4326)
    near = undecided(F.col("a"), 1e7) | undecided(F.col("b"), 1e7)
    moved = grid.withColumns({"a": a, "b": b}).withColumn("c", C.transform_in_c(F.when(near, F.col("x")), F.when(near, F.col("y")), 32633, 4326))
    return moved.select("k", q(F.coalesce("c.x", "a"), 1e7).alias("lng_e7"), q(F.coalesce("c.y", "b"), 1e7).alias("lat_e7"))


MGA = _tm_inverse_sql(C.projection(7855), "x", "y", f"(SELECT k, 5e5 + lng*1e3 AS x, 5e6 + lat*1e4 AS y FROM {PTS})", "k")


@query(f"SELECT k, {sq('e')} AS e_cm, {sq('n')} AS n_cm FROM {_tm_forward_sql(C.projection(32755), 'lng', 'lat', MGA, 'k')}")
def crs7_mga55_to_utm55(spark: S, sf: str) -> DataFrame:
    grid = points(spark, sf).select("k", (500000.0 + F.col("lng") * 1e3).alias("x"), (5e6 + F.col("lat") * 1e4).alias("y"))
    return C.transform_columns(grid, "x", "y", 7855, 32755).select("k", q(F.col("x")).alias("e_cm"), q(F.col("y")).alias("n_cm"))


@query(f"SELECT k, CAST(lng * 1e3 AS BIGINT) AS x, CAST(lat * 1e3 AS BIGINT) AS y FROM {PTS}")
def crs10_identity(spark: S, sf: str) -> DataFrame:
    x, y = C.transform(F.col("lng"), F.col("lat"), 4326, 7844)
    return points(spark, sf).select("k", F.round(x * 1e3).cast("long").alias("x"), F.round(y * 1e3).cast("long").alias("y"))


# --- keys

GRID = f"(SELECT k, CAST(trunc((lng + 180e0)/360e0 * 65535e0) AS INT) AS qx, CAST(trunc((lat + 85e0)/170e0 * 65535e0) AS INT) AS qy FROM {PTS})"
WORLD = (-180.0, -85.0, 180.0, 85.0)


@query(f"SELECT k, qx, qy FROM {GRID}")
def idx2_quantize(spark: S, sf: str) -> DataFrame:
    return points(spark, sf).select("k", I.quantize(F.col("lng"), F.lit(WORLD[0]), F.lit(WORLD[2])).alias("qx"), I.quantize(F.col("lat"), F.lit(WORLD[1]), F.lit(WORLD[3])).alias("qy"))


@query(f"SELECT k, d FROM {hilbert_sql(f'(SELECT o_orderkey AS k, o_orderkey*7919 % 65536 AS x, o_orderkey*6101 % 65536 AS y FROM orders)', 'x', 'y', 16, 'k')}")
def idx1_hilbert16(spark: S, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("k"), I.hilbert(k * 7919 % 65536, k * 6101 % 65536).alias("d"))


@query(f"SELECT k, d FROM {hilbert_sql(GRID, 'qx', 'qy', 16, 'k')}")
def idx3_hilbert_key(spark: S, sf: str) -> DataFrame:
    return points(spark, sf).select("k", I.hilbert_key(F.col("lng"), F.col("lat"), tuple(map(F.lit, WORLD))).alias("d"))


@query(f"SELECT CAST(round(min(xmin)*1e3) AS BIGINT) AS xmin, CAST(round(min(ymin)*1e3) AS BIGINT) AS ymin, CAST(round(max(xmax)*1e3) AS BIGINT) AS xmax, CAST(round(max(ymax)*1e3) AS BIGINT) AS ymax FROM {BXS} WHERE k % 7 <> 0")
def idx4_union_bbox(spark: S, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("ymax", F.when(F.col("k") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("ymax")))
    return b.agg(*M.union_bbox()).select(*[F.round(F.col(c) * 1e3).cast("long").alias(c) for c in M.BOX])


Z10 = "(SELECT k, CAST(greatest(0, least(1023, floor((lng + 180e0)/360e0*1024))) AS BIGINT) AS x, CAST(greatest(0, least(1023, floor((1e0 - ln(tan(radians(" + CLAMP + ")) + 1e0/cos(radians(" + CLAMP + f")))/pi())/2e0*1024))) AS BIGINT) AS y FROM {PTS})"


@query(f"SELECT k, x, y FROM {Z10}")
def til_point_to_tile(spark: S, sf: str) -> DataFrame:
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    return points(spark, sf).select("k", x.alias("x"), y.alias("y"))


@query(f"SELECT k, CAST(349525 AS BIGINT) + d AS id FROM {hilbert_sql(Z10, 'x', 'y', 10, 'k')}")
def idx5_tile_id(spark: S, sf: str) -> DataFrame:
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    return points(spark, sf).select("k", I.tile_id(10, x, y).alias("id"))


@query("SELECT k, CAST(z AS INT) AS z, x, y FROM (SELECT o_orderkey AS k, 3 + o_orderkey % 9 AS z, o_orderkey*13 % pow(2, 3 + o_orderkey % 9)::BIGINT AS x, o_orderkey*7 % pow(2, 3 + o_orderkey % 9)::BIGINT AS y FROM orders)")
def idx6_tile_id_inverse(spark: S, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    z = (3 + k % 9).cast("int")
    n = T.per_side(z)
    t = I.tile_of_id(I.tile_id(z, k * 13 % n, k * 7 % n))
    return table(spark, sf, "orders").select(k.alias("k"), t["z"].alias("z"), t["x"].alias("x"), t["y"].alias("y"))


# --- tiles

_LNG = lambda x: f"({x}/1024e0*360e0 - 180e0)"
_LAT = lambda y: f"degrees(atan(sinh(pi()*(1e0 - 2e0*{y}/1024e0))))"


@query(f"SELECT k, {sq(_LNG('x'), '1e7')} AS xmin, {sq(_LAT('(y+1)'), '1e7')} AS ymin, {sq(_LNG('(x+1)'), '1e7')} AS xmax, {sq(_LAT('y'), '1e7')} AS ymax FROM {Z10}")
def til2_tile_bbox(spark: S, sf: str) -> DataFrame:
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    b = points(spark, sf).select("k", T.tile_bbox(F.lit(10), x, y).alias("b"))
    return b.select("k", *[q(F.col(f"b.{c}"), 1e7).alias(c) for c in M.BOX])


@query(f"SELECT k, CAST(round((lng + 180e0)/360e0*1048576e0) AS BIGINT) AS px, CAST(round((1e0 - ln(tan(radians({CLAMP})) + 1e0/cos(radians({CLAMP})))/pi())/2e0*1048576e0) AS BIGINT) AS py FROM {PTS}")
def til3_pixel(spark: S, sf: str) -> DataFrame:
    x, y = T.pixel(F.col("lng"), F.col("lat"), F.lit(8), F.lit(0), F.lit(0))
    return points(spark, sf).select("k", x.alias("px"), y.alias("py"))


@query(f"SELECT k, x // 4 * 4 AS mx, y // 4 * 4 AS my FROM {Z10}")
def flt10_metatile(spark: S, sf: str) -> DataFrame:
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    a, b = T.metatile(x, y, 4)
    return points(spark, sf).select("k", a.alias("mx"), b.alias("my"))


@query("SELECT n_nationkey AS k, x + dx AS x, y + dy AS y FROM (SELECT n_nationkey, CAST(n_nationkey AS BIGINT)*4 AS x, CAST(n_nationkey AS BIGINT)*8 AS y FROM nation), range(4) a(dx), range(4) b(dy)")
def til5_sub_tiles(spark: S, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    each = T.sub_tiles(k.cast("long") * 4, k.cast("long") * 8, 4)
    return table(spark, sf, "nation").select(k.alias("k"), F.explode(each).alias("t")).select("k", "t.x", "t.y")


@query(f"SELECT k, {sq(_LNG('mx'), '1e7')} AS xmin, {sq(_LAT('(my+4)'), '1e7')} AS ymin, {sq(_LNG('(mx+4)'), '1e7')} AS xmax, {sq(_LAT('my'), '1e7')} AS ymax FROM (SELECT k, x // 4 * 4 AS mx, y // 4 * 4 AS my FROM {Z10})")
def til6_metatile_bbox(spark: S, sf: str) -> DataFrame:
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(10))
    b = points(spark, sf).select("k", T.metatile_bbox(F.lit(10), *T.metatile(x, y, 4), 4).alias("b"))
    return b.select("k", *[q(F.col(f"b.{c}"), 1e7).alias(c) for c in M.BOX])


@query("SELECT n_nationkey AS k, n_nationkey % 4 * 256 AS x, n_nationkey // 4 * 256 AS y, 256 AS width, 256 AS height FROM nation")
def til7_sub_tile_rect(spark: S, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    r = T.sub_tile_rect(k % 4, F.expr("cast(n_nationkey div 4 as int)"), 256)
    return table(spark, sf, "nation").select(k.alias("k"), r.alias("r")).select("k", "r.*")


@query("SELECT n_nationkey AS k, CAST(pow(2, n_nationkey) AS BIGINT) AS per_side, CASE WHEN n_nationkey <= 2 THEN 0.5e0 WHEN n_nationkey <= 5 THEN 0.1e0 WHEN n_nationkey <= 8 THEN 0.02e0 WHEN n_nationkey <= 11 THEN 0.004e0 WHEN n_nationkey <= 14 THEN 0.0008e0 WHEN n_nationkey <= 17 THEN 0.00015e0 ELSE 0.00003e0 END AS tolerance FROM nation")
def geo19_tolerance(spark: S, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("k"), T.per_side(k).alias("per_side"), M.tolerance_for_zoom(k).alias("tolerance"))


# --- filters and distances

BOX = (-20.0, -10.0, 50.0, 40.0)


@query(f"SELECT k FROM {BXS} WHERE xmin <= 50e0 AND xmax >= -20e0 AND ymin <= 40e0 AND ymax >= -10e0")
def flt1_bbox_filter(spark: S, sf: str) -> DataFrame:
    return boxes(spark, sf).where(M.box_intersects(BOX)).select("k")


@query(f"SELECT k, CAST(round(xmax*1e3) AS BIGINT) AS edge, xmax = 10.25e0 OR xmin = 50e0 AS touching FROM {BXS} WHERE xmin <= 50e0 AND xmax >= 10.25e0 AND ymin <= 40e0 AND ymax >= -10e0")
def flt1_boundary_inclusive(spark: S, sf: str) -> DataFrame:
    """Every box that meets or touches the window, and whether it only touches its sides."""
    touching = (F.col("xmax") == 10.25) | (F.col("xmin") == 50.0)
    return boxes(spark, sf).where(M.box_intersects((10.25, -10.0, 50.0, 40.0))).select("k", F.round(F.col("xmax") * 1e3).cast("long").alias("edge"), touching.alias("touching"))


@query(f"SELECT count(*) AS scanned, count(*) FILTER (xmin <= 50e0 AND xmax >= -20e0 AND ymin <= 40e0 AND ymax >= -10e0) AS kept FROM {BXS}")
def flt2_filter_counts(spark: S, sf: str) -> DataFrame:
    return boxes(spark, sf).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(M.box_intersects(BOX)).alias("kept"))


@query(f"SELECT k, {sq('sqrt((lng-12e0)*(lng-12e0) + (lat-55e0)*(lat-55e0))', '1e6')} AS d FROM {PTS}")
def geo12_distance(spark: S, sf: str) -> DataFrame:
    return points(spark, sf).select("k", q(M.distance(F.lit(12.0), F.lit(55.0), F.col("lng"), F.col("lat")), 1e6).alias("d"))


# --- values


@query("SELECT o_orderkey AS k, CAST(trunc((CAST(o_orderkey AS DOUBLE)/7e0 - 25569e0) * 864e8) AS BIGINT) AS micros FROM orders")
def dat1_days_to_micros(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), V.days_to_micros(F.col("o_orderkey").cast("double") / 7.0).alias("micros"))


@query("SELECT o_orderkey AS k, " + sq("epoch_us(o_orderdate)/864e8 + 25569e0", "1e6") + " AS days_e6 FROM orders")
def dat2_micros_to_days(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), q(V.timestamp_to_days(F.col("o_orderdate")), 1e6).alias("days_e6"))


@query("SELECT o_orderkey AS k, CAST(date_diff('day', DATE '1899-12-30', make_date((1900 + o_orderkey % 200)::INT, (1 + o_orderkey % 12)::INT, (1 + o_orderkey % 28)::INT)) AS DOUBLE) AS days FROM orders")
def dat3_date_to_days(spark: S, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("k"), V.date_to_days((1900 + k % 200).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int")).alias("days"))


@query("SELECT c_custkey AS k, lower(hex(c_name)) AS h FROM customer")
def dat4_hex_lower(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), V.hex_lower(F.col("c_name")).alias("h"))


@query(f"SELECT k, CAST(greatest(-2147483648e0, least(2147483647e0, round(lng * 2e0 * 1e7))) AS INT) AS e7 FROM {PTS}")
def dat6_degrees_to_e7(spark: S, sf: str) -> DataFrame:
    return points(spark, sf).select("k", V.degrees_to_e7(F.col("lng") * 2.0).alias("e7"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def dat5_json_text(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", V.json_text(F.col("props"), "$.k").alias("v"))


@query(f"SELECT id, count(*) AS n, {sq('min(lng)', '1e3')} AS west, {sq('max(lng)', '1e3')} AS east FROM (SELECT p.lng, h.id FROM {PTS} p JOIN (SELECT k, CAST(1365 AS BIGINT) + d AS id FROM " + hilbert_sql(Z10, "x // 16", "y // 16", 6, "k") + ") h USING (k)) GROUP BY id")
def flagship_tiles(spark: S, sf: str) -> DataFrame:
    """Orders by level-6 tile: counts and extent, in the order of the curve."""
    x, y = T.tile_of(F.col("lng"), F.col("lat"), F.lit(6))
    keyed = points(spark, sf).select(I.tile_id(6, x, y).alias("id"), "lng")
    return keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), q(F.min("lng"), 1e3).alias("west"), q(F.max("lng"), 1e3).alias("east"))
