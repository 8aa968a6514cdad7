import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loamgrid.core import geometry as G
from loamgrid.core.errors import ConvertError, Unsupported
from loamgrid.functions.geometry import st_contains_point, st_point
from loamgrid.operators import profile as P
from loamgrid.operators import raster as R
from loamgrid.operators import spatial_join as J
from loamgrid.plans import cli, jobs
from loamgrid.sources import geojson, geoparquet, geotiff
from loamgrid.streaming import windows as W
from tests.test_formats import THREE, places, png_bytes

GRADIENT = np.tile(np.array([0.0, 80.0, 160.0, 240.0]), (4, 1))


def at(p, x, y, method):
    return R.sample(p, np.array([x]), np.array([y]), method)[0]


def test_kernels():
    assert at(GRADIENT, 2.5, 1.5, "nearest") == 160
    assert at(GRADIENT, 1.0, 0.5, "bilinear") == 40 and at(GRADIENT, 1.0, 0.5, "average") == 40
    assert math.isnan(at(GRADIENT, 4.5, 0, "nearest")) and math.isnan(at(GRADIENT, -0.1, 1, "bilinear"))
    flat = np.full((8, 8), 7.0)
    for m in R.METHODS:
        assert at(flat, 3.3, 4.1, m) == pytest.approx(7)
    line = np.tile(np.arange(8.0), (8, 1))
    assert at(line, 4.2, 4, "cubic") == pytest.approx(3.7)
    assert R.resample(GRADIENT, 2, 2, "average")[0, 0] == 40
    five = np.full((4, 4), 5.0)
    five[0, 0] = 99
    assert R.resample(five, 2, 2, "mode")[0, 0] == 5
    assert R.resample(np.array([[2.0, 1.0], [1.0, 2.0]]), 1, 1, "mode")[0, 0] == 1


def test_packing():
    assert np.frombuffer(R.packed(np.array([[0.5, 1.5, -0.5, 300.0, np.nan]]), "U8"), np.uint8).tolist() == [1, 2, 0, 255, 0]
    assert np.frombuffer(R.packed(np.array([[-2.5, np.nan]]), "I16", -9), "<i2").tolist() == [-3, -9]
    with pytest.raises(Unsupported):
        R.plane({"dtype": "Rgb8", "data": b""}, 1, 1)


def test_overview_sizes():
    assert R.level_sizes(1024, 512) == [(512, 256), (256, 128)] and R.level_sizes(4, 4) == [(2, 2)] and R.level_sizes(1, 1) == []


def test_overviews_span_tiles(spark):
    df = spark.range(36).select((F.col("id") % 6).alias("column"), F.expr("id div 6").alias("row"), F.col("id").cast("double").alias("value"))
    tiles = R.from_pixels(df, (0.0, 1.0, 0.0, 6.0, 0.0, -1.0), 4, "F64", -1.0, 4326)
    assert tiles.count() == 4
    level = R.next_level(tiles)
    got = {(r["column"], r["row"]): r["value"] for r in R.pixels(level).collect()}
    want = {(c, r): np.mean([(2 * r + i) * 6 + 2 * c + j for i in (0, 1) for j in (0, 1)]) for c in range(3) for r in range(3)}
    assert got == want
    t = level.first()
    assert t["level"] == 1 and t["affine"]["pw"] == 2 and (t["affine"]["ox"], t["affine"]["oy"]) == (0, 6)


def test_warp_to_the_same_place_is_identity(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("column"), F.expr("id div 8").alias("row"), F.col("id").cast("double").alias("value"))
    tiles = R.from_pixels(df, (0.0, 1.0, 0.0, 8.0, 0.0, -1.0), 4, "F64", -1.0, 4326)
    out = R.warp(tiles, 4326, 7844, ((0.0, 1.0, 0.0, 8.0, 0.0, -1.0), 8, 8), "nearest", tile=4)
    assert {(r["column"], r["row"]): r["value"] for r in R.pixels(out).collect()} == {(i % 8, i // 8): float(i) for i in range(64)}


def test_profile(spark):
    rows = [(0.0, 0.0, "a", 1), (1.0, 1.0, "a", 2), (2.0, 2.0, "b", 3), (3.0, 3.0, "b", None)]
    df = spark.createDataFrame(rows, "lng double, lat double, cat string, score int").select(st_point(F.col("lng"), F.col("lat")).alias("geometry"), "cat", "score", F.when(F.col("lng") < 1, float("nan")).otherwise(F.col("lng")).alias("w")).withMetadata("geometry", {"geometry": True, "epsg": 4326})
    out = P.profile(df, sample_n=2)
    assert out["feature_count"] == 4 and out["geometry"] == {"null_count": 0, "kinds": {"Point": 4}, "extent": [0, 0, 3, 3], "epsg": 4326}
    cat, score, w = out["fields"]
    assert cat["distinct"] == 2 and cat["top"] == [{"value": "a", "count": 2}, {"value": "b", "count": 2}] and cat["min"] is None
    assert (score["null_count"], score["value_count"], score["min"], score["max"], score["distinct"]) == (1, 3, 1, 3, 3)
    assert (w["min"], w["max"], w["distinct"], w["top"]) == (1.0, 3.0, None, []) and len(out["sample"]) == 2
    few = P.profile(df, top_n=1, sample_n=0, distinct_limit=2)["fields"]
    assert few[0]["distinct"] == 2 and len(few[0]["top"]) == 1 and few[1]["distinct"] is None and few[1]["top"] == []


def test_vector_jobs(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.parquet", "b.geojson", "c.parquet"))
    geoparquet.write(places(spark, THREE), a)
    assert jobs.convert(spark, a, b)["features"] == 3
    assert jobs.reproject(spark, b, c, "EPSG:3857")["features"] == 3
    moved = geoparquet.read(spark, c, covering=True)
    assert moved.schema["geometry"].metadata["epsg"] == 3857
    assert moved.agg(F.max("xmax")).first()[0] == pytest.approx(2 * 1113194.9079, abs=1e-3)
    for source in (a, b):
        out = jobs.filter_bbox(spark, source, str(tmp_path / "d.geojson"), (9, 9, 11, 11))
        assert (out["scanned"], out["kept"]) == (3, 1)
    assert jobs.optimize(spark, a, str(tmp_path / "o.parquet"))["features"] == 3
    found = jobs.inspect(spark, a)["layers"][0]
    assert found["extent"] == [0, 0, 20, 20] and found["fields"][0]["name"] == "id" and found["epsg"] == 4326
    assert jobs.metadata(spark, a)["spec_version"] == 1
    with open(jobs.sidecar_path(a), encoding="utf-8") as f:
        assert json.load(f)["generator"] == "loamgrid"
    with pytest.raises(ConvertError):
        jobs.convert(spark, a, str(tmp_path / "x.tif"))
    with pytest.raises(Unsupported):
        jobs.inspect(spark, str(tmp_path / "x.tif"))


def test_raster_jobs(spark, tmp_path):
    src, out = str(tmp_path / "i.png"), str(tmp_path / "o.tif")
    planes = [np.full((4, 4), v, np.uint8) for v in (10, 20, 30)]
    with open(src, "wb") as f:
        f.write(png_bytes(planes, [0]))
    with open(str(tmp_path / "i.pgw"), "w", encoding="utf-8") as f:
        f.write("0.01\n0\n0\n-0.01\n144.905\n-37.855\n")
    stats = jobs.convert(spark, src, out, source_crs=4326)
    assert (stats["width"], stats["height"], stats["levels"]) == (4, 4, 2)
    assert geotiff.profile(out)["levels"] == 2 and geotiff.profile(out)["epsg"] == 4326
    jobs.convert(spark, out, str(tmp_path / "w.tif"), to_crs=3857, build_pyramid=False)
    about = geotiff.profile(str(tmp_path / "w.tif"))
    assert about["epsg"] == 3857 and about["width"] == 4
    row = geotiff.read(spark, str(tmp_path / "w.tif")).where("level = 0").first()
    assert max(np.frombuffer(bytes(row["bands"][2]["data"]), np.uint8)) == 30


def test_command_line(spark, tmp_path):
    a = str(tmp_path / "a.parquet")
    geoparquet.write(places(spark, THREE), a)
    assert cli.run(spark, ["filter-bbox", a, str(tmp_path / "b.geojson"), "--bbox", "9,9,11,11"])["kept"] == 1
    assert cli.run(spark, ["profile", a, "--sample-n", "0"])["feature_count"] == 3
    assert cli.run(spark, ["convert", a, str(tmp_path / "h.parquet"), "--hilbert"])["features"] == 3
    assert jobs.parse_bbox("1,2,1,2") == (1, 2, 1, 2)
    for bad in ("1,2,3", "2,0,1,1", "a,b,c,d"):
        with pytest.raises(ConvertError):
            jobs.parse_bbox(bad)


def test_lines_of_features(spark, tmp_path):
    path = str(tmp_path / "n")
    geojson.feature_text(places(spark, THREE), fid=None).write.text(path)
    df = geojson.read_lines(spark, path)
    assert df.count() == 3 and df.columns == ["fid", "geometry", "id"]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "a", 1.0), (2, "2024-01-01 00:10:00", 1, "a", 2.0), (3, "2024-01-01 02:00:00", 1, "b", 4.0), (3, "2024-01-01 02:00:00", 1, "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = W.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, W.tumbling(df).collect()))
    assert sorted(r["n"] for r in W.sessions(df).collect()) == [2, 2]
    assert W.distinct_events(df).count() == 3
    assert W.sliding(df).count() > 0
    pts = df.withColumns({"lng": F.lit(1.0), "lat": F.lit(2.0)})
    assert sum(r["n"] for r in W.tile_counts(pts).collect()) == 4


def test_every_query_has_a_stable_schema(spark):
    names = entry.queries()
    assert len(names) >= 60 and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


def test_points_on_an_edge_are_not_inside(spark):
    ring, hole = G.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), G.array([(1, 1), (2, 1), (2, 2), (1, 2)])
    one, two = G.Geometry(G.POLYGON, [ring, hole]), G.Geometry(G.MULTIPOLYGON, [[ring, hole], [ring + 10]])
    places = {(3, 3): True, (0.5, 1): True, (2, 0): False, (0, 2): False, (4, 2): False, (2, 4): False, (4, 4): False, (0, 0): False, (1.5, 1.5): False, (1, 1.5): False, (1.5, 2): False, (5, 1): False}
    rows = [(bytearray(G.to_wkb(g)), float(x), float(y), held) for g in (one, two) for (x, y), held in places.items()]
    rows += [(None, 1.0, 1.0, None), (bytearray(G.to_wkb(one)), None, 1.0, None), (bytearray(G.to_wkb(two)), 11.0, 11.0, True), (bytearray(G.to_wkb(G.Geometry(G.POLYGON, []))), 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "g binary, x double, y double, held boolean").coalesce(1)
    assert [r for r in df.withColumn("got", st_contains_point(F.col("g"), F.col("x"), F.col("y"))).collect() if r["got"] != r["held"]] == []


def test_optimize_keeps_the_source_order_of_rows_of_one_key(spark, tmp_path):
    """The second file is the largest, so that a scan hands it out first."""
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    rows = places(spark, [(i, 5.0 + (i % 2), 5.0 + (i % 2)) for i in range(4000)]).withColumn("text", F.when(F.col("id") > 3000, F.sha2(F.col("id").cast("string"), 512)))
    geoparquet.write(rows.repartitionByRange(2, "id").sortWithinPartitions("id"), a)
    jobs.optimize(spark, a, b, files=1)
    got = [r["id"] for r in geoparquet.read(spark, b).coalesce(1).collect()]
    assert got == sorted(range(4000), key=lambda i: (i % 2, i))
    assert geoparquet.read(spark, b).columns == geoparquet.read(spark, a).columns


def test_cells_of_large_boxes_cover_little_more_than_them(spark):
    """Boxes of 90 x 20 among small ones: few cells, little beside them, and the pairs of a plain comparison."""
    rows = [(i, float(i * 37 % 200 - 100), float(i * 53 % 120 - 60)) for i in range(300)]
    box = [(i, x, y, x + (90.0 if i % 10 == 0 else 1.0), y + (20.0 if i % 10 == 0 else 0.5)) for i, x, y in rows]
    df = spark.createDataFrame(box, "id int, xmin double, ymin double, xmax double, ymax double")
    cells = J._in_cells(df.where("id % 10 = 0"), 1.0, []).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.lit(4.0), "_l")).alias("area")).collect()
    assert len(cells) == 30 and all(r["n"] <= 81 and r["area"] <= 4 * 90 * 20 for r in cells)
    got = [(r["i"], r["j"]) for r in J.box_join(df, df, 1.0, salt=2).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()]
    assert sorted(got) == [(a[0], b[0]) for a in box for b in box if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]]
