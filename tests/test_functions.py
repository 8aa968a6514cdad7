import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loamgrid.core.errors import CrsError, SchemaError
from loamgrid.core.geometry import Geometry, array, to_wkb
from loamgrid.functions import affine as A
from loamgrid.functions import crs as C
from loamgrid.functions import geometry as G
from loamgrid.functions import index as I
from loamgrid.functions import measure as M
from loamgrid.functions import tiles as T
from loamgrid.functions import values as V
from loamgrid.sources import pmtiles


def row(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_published_transverse_mercator_point(spark):
    e, n = row(spark, *C.transform(F.lit(12.0), F.lit(55.0), 4326, 32632))
    assert e == pytest.approx(691875.632, abs=1e-3) and n == pytest.approx(6098907.825, abs=1e-3)
    lng, lat = row(spark, *C.transform(F.lit(691875.632), F.lit(6098907.825), 32632, 4326))
    assert (lng, lat) == (pytest.approx(12, abs=1e-8), pytest.approx(55, abs=1e-8))
    assert C.transform_array(np.array([[10.0, 0.0]]), 4326, 32632)[0, 0] == pytest.approx(611280.651, abs=1e-3)


def test_mercator(spark):
    x, y, px, top = row(spark, *C.mercator_forward(F.lit(10.0), F.lit(0.0)), C.mercator_forward(F.lit(180.0), F.lit(0.0))[0], C.mercator_forward(F.lit(0.0), F.lit(90.0))[1])
    assert x == pytest.approx(1113194.9079, abs=1e-4) and abs(y) < 1e-6
    assert px == pytest.approx(math.pi * C.RADIUS) and top == pytest.approx(math.pi * C.RADIUS, rel=1e-9)


@pytest.mark.parametrize(("a", "b"), [(4326, 3857), (4326, 32733), (7844, 7855), (7855, 32755), (3857, 32601)])
def test_columns_and_arrays_agree_and_come_back(spark, a, b):
    start = C.transform_array(np.array([[146.5, -37.0]]), 4326, a)
    if a in (4326, 7844) and b == 32733:
        start = np.array([[16.0, -20.0]])
    moved = C.transform_array(start, a, b)
    got = row(spark, *C.transform(F.lit(float(start[0, 0])), F.lit(float(start[0, 1])), a, b))
    assert list(got) == pytest.approx(moved[0].tolist(), rel=1e-12, abs=1e-6)
    if b != 32601:
        assert C.transform_array(moved, b, a)[0] == pytest.approx(start[0], abs=1e-6)


def test_rounding_at_a_tie_agrees_with_the_sql(spark, tmp_path):
    """The latitude of the first key is 62.76126555 degrees but for some 1e-14, on either side by the engine's functions."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(k,) for k in (4307788, 1, 2, 3)], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = entry.queries()["crs14_utm_inverse"](spark, str(tmp_path)).orderBy("k").collect()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        assert [tuple(r) for r in found] == c.execute(f"SELECT * FROM ({entry.oracle_sql()['crs14_utm_inverse']}) ORDER BY k").fetchall()


def test_codes():
    assert C.parse_crs("EPSG:7855") == C.parse_crs("epsg:7855") == C.parse_crs("7855") == 7855
    with pytest.raises(CrsError):
        C.parse_crs("WGS84")
    with pytest.raises(CrsError):
        C.projection(27700)
    wkt = 'PROJCS["x",GEOGCS["g",AUTHORITY["EPSG","7844"]],UNIT["m",1,AUTHORITY["EPSG","9001"]],AUTHORITY["EPSG","7855"]]'
    assert C.epsg_of(wkt) == 7855
    assert C.epsg_of('PROJCRS["x",BASEGEOGCRS["g",ID["EPSG",7844]],ID["EPSG",7855]]') == 7855
    assert C.epsg_of('GEOGCS["GCS_GDA2020",DATUM["D_GDA2020",SPHEROID["GRS_1980",1,2]]]') == 7844
    assert C.epsg_of('PROJCS["GDA2020_MGA_Zone_55",UNIT["m",1]]') == 7855
    assert C.epsg_of({"id": {"authority": "EPSG", "code": 4326}}) == 4326 and C.epsg_of("urn:ogc:def:crs:OGC:1.3:CRS84") == 4326
    assert C.epsg_of("nothing known") is None and C.epsg_of(None) is None
    assert C.is_identity(4326, 7844) and not C.is_identity(4326, 3857)


def test_hilbert_goldens(spark):
    cells = {(0, 0): 0, (1, 0): 1, (40000, 12345): 3831144387, (65535, 0): 4294967295, (65535, 65535): 2863311530}
    got = row(spark, *[I.hilbert(F.lit(x), F.lit(y)) for x, y in cells])
    assert list(got) == list(cells.values())
    small = spark.range(16).select(I.hilbert(F.col("id") % 4, F.expr("id div 4"), 2).alias("d"))
    assert sorted(r["d"] for r in small.collect()) == list(range(16))


def test_tile_ids(spark):
    ids = {(0, 0, 0): 0, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 0, 0): 5, (3, 0, 0): 21, (4, 0, 0): 85, (5, 0, 0): 341}
    got = row(spark, *[I.tile_id(F.lit(z), F.lit(x), F.lit(y)) for z, x, y in ids])
    assert list(got) == list(ids.values())
    assert list(row(spark, I.tile_id(F.lit(1), F.lit(2), F.lit(0)), I.tile_id(F.lit(32), F.lit(0), F.lit(0)), I.tile_id(F.lit(0), F.lit(-1), F.lit(0)))) == [None] * 3
    back = spark.range(400).select("id", I.tile_of_id(F.col("id")).alias("t")).select("id", I.tile_id(F.col("t.z"), F.col("t.x"), F.col("t.y")).alias("again")).collect()
    assert all(r["id"] == r["again"] for r in back)


def test_tile_ids_of_all_levels_there_and_back(spark):
    """Against the plain walk of one tile; 200,000 ids there and back take seconds, not minutes."""
    ids = [pmtiles.tile_id(z, (x * 2654435761) % (1 << z), (x * 40503 + 17) % (1 << z)) for z in range(32) for x in (0, 1, 12345, 987654321)]
    last = pmtiles.tile_id(31, (1 << 31) - 1, 0)
    rows = spark.createDataFrame([(i,) for i in [*ids, last, last + 1, -1, None]], "i long").coalesce(1).select("i", I.tile_of_id(F.col("i")).alias("t"))
    for r in rows.withColumn("again", I.tile_id(F.col("t.z"), F.col("t.x"), F.col("t.y"))).collect():
        known = r["i"] is not None and 0 <= r["i"] <= last
        assert (tuple(r["t"]), r["again"]) == (pmtiles.tile_of(r["i"]), r["i"]) if known else (r["t"], r["again"]) == (None, None)
    began, k = time.time(), F.col("id")
    n = T.per_side((3 + k % 9).cast("int"))
    t = spark.range(200_000).select((k * 13 % n).alias("x"), (k * 7 % n).alias("y"), I.tile_of_id(I.tile_id((3 + k % 9).cast("int"), k * 13 % n, k * 7 % n)).alias("t"))
    assert t.where("t.x = x and t.y = y").count() == 200_000
    assert time.time() - began < 20


def test_quantize(spark):
    nan, inf = float("nan"), float("inf")
    q = lambda v, a=0.0, b=10.0: I.quantize(F.lit(v), F.lit(a), F.lit(b))
    assert list(row(spark, q(10.0), q(-1.0), q(11.0), q(nan), q(inf), q(5.0, 3.0, 3.0))) == [65535, 0, 65535, None, None, None]


def test_union_of_boxes(spark):
    df = spark.createDataFrame([(0.0, -2.0, 4.0, 1.0), (-1.0, 0.0, 1.0, 6.0), (float("nan"), -99.0, 99.0, 99.0)], "xmin double, ymin double, xmax double, ymax double")
    assert tuple(df.agg(*M.union_bbox()).first()) == (-1, -2, 4, 6)


def test_nested_measures(spark):
    pt = lambda x, y: M.point(F.lit(float(x)), F.lit(float(y)))
    sq = lambda s: F.array(pt(0, 0), pt(s, 0), pt(s, s), pt(0, s), pt(0, 0))
    got = row(spark, M.signed_area(sq(1)), M.signed_area(F.reverse(sq(1))), M.polygon_area(F.array(sq(10), sq(2))), M.polygon_area(F.array(sq(10), sq(2), sq(2), F.slice(sq(3), 1, 2))), M.polygon_area(F.array(sq(1), sq(9))), M.length(F.array(pt(0, 0), pt(3, 4))), M.length(F.array(pt(0, 0))), M.distance(F.lit(0), F.lit(0), F.lit(3), F.lit(4)))
    assert list(got) == [1, -1, 96, 92, 0, 5, 0, 5]


def test_tile_grid(spark):
    b = row(spark, T.tile_bbox(F.lit(0), F.lit(0), F.lit(0)))[0]
    assert tuple(b) == pytest.approx((-180, -85.0511287798, 180, 85.0511287798))
    got = row(spark, *T.pixel(F.lit(180.0), F.lit(-89.0), F.lit(0), F.lit(0), F.lit(0)), *T.metatile(F.lit(7), F.lit(11), 4), F.size(T.sub_tiles(F.lit(0), F.lit(0), 4)), T.sub_tile_rect(F.lit(2), F.lit(1), 256))
    assert list(got[:5]) == [4096, 4096, 4, 8, 16] and tuple(got[5]) == (512, 256, 256, 256)


def test_values(spark):
    got = row(spark, V.days_to_micros(F.lit(25569.5)), V.date_to_days(F.lit(2020), F.lit(1), F.lit(1)), V.date_to_days(F.lit(2020), F.lit(13), F.lit(1)), V.degrees_to_e7(F.lit(999.0)), V.hex_lower(F.lit(b"\xab")))
    assert list(got) == [43_200_000_000, 43831.0, None, 2**31 - 1, "ab"]
    assert V.human_bytes(12) == "12 B" and V.human_bytes(2048) == "2.00 KB"


def test_checked_rows(spark):
    from pyspark.sql import types as S

    df = spark.createDataFrame([(1, None)], "a long, b string")
    loose = S.StructType([S.StructField("b", S.StringType()), S.StructField("a", S.LongType(), False)])
    assert V.checked(df, loose).first()["a"] == 1
    strict = S.StructType([S.StructField("b", S.StringType(), False)])
    with pytest.raises(Exception, match="null in b"):
        V.checked(df, strict).collect()
    assert issubclass(SchemaError, Exception)


def test_affine(spark):
    t = A.north_up(10.0, 20.0, 2.0, 3.0)
    x, y, c, r, up, size = row(spark, *A.pixel_to_world(t, F.lit(1), F.lit(1)), *A.world_to_pixel(t, F.lit(12.0), F.lit(17.0)), A.is_north_up(t), A.tile_bytes(F.lit(4), F.lit(2), F.array(F.lit("U8"), F.lit("F64"))))
    assert (x, y, c, r, up, size) == (12, 17, 1, 1, True, 72)
    assert row(spark, *A.world_to_pixel(A.affine(0, 0, 0, 0, 0, 0), F.lit(1.0), F.lit(1.0)))[0] is None


def test_wkb_columns(spark):
    line = to_wkb(Geometry(2, array([(0, 0), (3, 4)])))
    point = to_wkb(Geometry(1, array([(1, 2)])))
    df = spark.createDataFrame([(1, point), (2, line), (3, None), (4, b"junk")], "k int, g binary")
    boxes = {r["k"]: r["e"] for r in df.select("k", G.st_bbox(F.col("g")).alias("e")).collect()}
    assert tuple(boxes[1]) == (1, 2, 1, 2) and tuple(boxes[2]) == (0, 0, 3, 4) and boxes[3] is None and boxes[4] is None
    good = df.where("k < 4")
    got = {r["k"]: tuple(r)[1:] for r in good.select("k", G.st_kind(F.col("g")), G.st_coord_count(F.col("g")), G.st_length(F.col("g")), G.st_as_geojson(F.col("g"))).collect()}
    assert got[2] == ("LineString", 2, 5.0, '{"type":"LineString","coordinates":[[0.0,0.0],[3.0,4.0]]}') and got[3] == (None,) * 4
    back = good.select(G.st_from_geojson(G.st_as_geojson(F.col("g"))).alias("g")).collect()
    assert [r["g"] for r in back] == [point, line, None]
    assert G.st_transform(F.col("g"), 4326, 7844) is not None
    with pytest.raises(CrsError):
        G.st_transform(F.col("g"), 4326, 1)
