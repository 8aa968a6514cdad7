import json
import os
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgrid.core import geometry as G
from loamgrid.core.errors import ConvertError, GdbError, GeoJsonError, ImageError, LayerAmbiguous, Malformed, PmTilesError, SchemaError, ShapefileError, TiffError, TileError, Unsupported
from loamgrid.functions.geometry import st_point
from loamgrid.operators import vector_tiles as V
from loamgrid.sources import binary, filegdb, files, geojson, geoparquet, geotiff, images, pmtiles, shapefile
from loamgrid.sources.binary import Cursor, varuint, zigzag


def places(spark, rows, epsg=4326):
    df = spark.createDataFrame(rows, "id int, lng double, lat double")
    return df.select("id", st_point(F.col("lng"), F.col("lat")).alias("geometry")).withMetadata("geometry", {"geometry": True, "kind": "Point", "epsg": epsg})


THREE = [(0, 0.0, 0.0), (1, 10.0, 10.0), (2, 20.0, 20.0)]


def test_formats_by_name():
    assert files.format_of("a/b.GDB/") == "filegdb" and files.format_of("x.JSON") == "geojson" and files.modality("geotiff") == "raster"
    for bad in ("noext", ".parquet", "x.xyz"):
        with pytest.raises(ConvertError):
            files.format_of(bad)


# --- GeoParquet


def test_geoparquet_footer_layout_and_box(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    geoparquet.write(places(spark, THREE).coalesce(1), path)
    one = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(one) == 1
    schema = pq.read_schema(f"{path}/{one[0]}")
    geo = json.loads(schema.metadata[b"geo"])
    assert schema.names == ["geometry", "id", "xmin", "ymin", "xmax", "ymax"]
    assert geo["version"] == "1.1.0" and geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["xmin"]
    df = geoparquet.read(spark, path)
    assert df.columns == ["geometry", "id"] and df.schema["geometry"].metadata["epsg"] == 4326
    kept = geoparquet.read(spark, path, (9, 9, 11, 11))
    assert [r["id"] for r in kept.collect()] == [1]
    assert "PushedFilters: [IsNotNull(xmin)" in kept._jdf.queryExecution().executedPlan().toString()
    assert geoparquet.extent(spark, path) == (0, 0, 20, 20)


def test_geoparquet_names(spark, tmp_path):
    df = places(spark, THREE).withColumnRenamed("geometry", "SHAPE")
    out, name = geoparquet.layout(df)
    assert name == "geometry" and out.columns[0] == "geometry"
    assert geoparquet.layout(df, keep_name=True)[1] == "SHAPE"
    with pytest.raises(SchemaError):
        geoparquet.layout(df.withColumn("geometry", F.lit("clash")), "SHAPE")


def test_hilbert_order_shrinks_the_row_groups(spark, tmp_path):
    rnd = np.random.default_rng(2)
    df = places(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.uniform(-80, 80, (2000, 2)))])

    def spread(path):
        total = 0.0
        for f in os.listdir(path):
            if f.endswith(".parquet"):
                t = pq.read_table(f"{path}/{f}")
                for a in range(0, len(t), 100):
                    x, y = (t.column(c).to_numpy()[a : a + 100] for c in ("xmin", "ymin"))
                    total += np.ptp(x) * np.ptp(y)
        return total

    geoparquet.write(df, str(tmp_path / "a.parquet"), batch_rows=100)
    geoparquet.write(df, str(tmp_path / "b.parquet"), hilbert=True, batch_rows=100)
    assert spread(str(tmp_path / "b.parquet")) * 2 < spread(str(tmp_path / "a.parquet"))
    assert geoparquet.read(spark, str(tmp_path / "b.parquet")).count() == 2000


def test_degenerate_extent_keeps_the_order(spark):
    df, _ = geoparquet.layout(places(spark, [(i, 5.0, 5.0) for i in range(20)]).coalesce(1))
    assert [r["id"] for r in geoparquet.hilbert_sorted(df, 1).collect()] == list(range(20))


# --- GeoJSON


def doc(tmp_path, value, name="x.geojson"):
    path = str(tmp_path / name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))
    return path


def feature(g, props=None, fid=None):
    out = {"type": "Feature", "geometry": g, "properties": props}
    return out | ({"id": fid} if fid is not None else {})


PT = {"type": "Point", "coordinates": [1, 2]}


def test_geojson_schema_and_values(spark, tmp_path):
    fs = [feature(PT, {"v": 1, "b": True, "m": [1], "late": None}, "42"), feature(None, {"v": 2.5, "b": None, "new": "x", "m": "t"}, 7), feature(PT, {"v": None, "b": False}, "no")]
    path = doc(tmp_path, {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": fs})
    df = geojson.read(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("fid", "bigint"), ("geometry", "binary"), ("v", "double"), ("b", "boolean"), ("m", "string"), ("late", "string"), ("new", "string")]
    meta = df.schema["geometry"].metadata
    assert meta["epsg"] == 3857 and meta["kind"] == "Point"
    rows = df.collect()
    assert [r["fid"] for r in rows] == [42, 7, None] and [r["v"] for r in rows] == [1.0, 2.5, None]
    assert rows[1]["geometry"] is None and rows[0]["m"] == "[1]" and rows[1]["m"] == "t"


def test_geojson_bare_documents_and_bad_ones(spark, tmp_path):
    assert geojson.read(spark, doc(tmp_path, feature(PT, {"a": 1}))).count() == 1
    assert geojson.read(spark, doc(tmp_path, PT)).count() == 1
    mixed = {"type": "FeatureCollection", "features": [feature(PT), feature({"type": "LineString", "coordinates": [[0, 0], [1, 1]]})]}
    assert geojson.read(spark, doc(tmp_path, mixed)).schema["geometry"].metadata["kind"] == "GeometryCollection"
    for bad in ("[]", "42", "{}", '{"type":"FeatureCollection"}', '{"type":"FeatureCollection","features":[{"a":}'):
        with pytest.raises(GeoJsonError):
            list(geojson.features(doc(tmp_path, bad)))


def test_geojson_streams_across_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(geojson, "CHUNK", 7)
    fs = [feature(PT, {"n": f"é日🎉{i}", "q": 'a"}]{[\\', "k": i * 1.5}) for i in range(20)]
    path = doc(tmp_path, json.dumps({"name": "x", "features": fs, "type": "FeatureCollection"}, ensure_ascii=False))
    assert list(geojson.features(path)) == fs


def test_geojson_writing(spark, tmp_path):
    df = places(spark, THREE).withColumn("bad", F.lit(float("nan"))).withColumn("raw", F.lit(b"\x0f")).withColumn("fid", F.lit(5).cast("long"))
    path = str(tmp_path / "w.geojson")
    assert geojson.write(df, path) == 3
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    assert out["features"][0] == {"type": "Feature", "id": 5, "geometry": {"type": "Point", "coordinates": [0.0, 0.0]}, "properties": {"id": 0, "bad": None, "raw": "0f"}}
    assert geojson.read(spark, path).count() == 3


# --- Shapefile


def shapefile_bytes(path, shapes, kind, fields, records, prj=None):
    shp, shx, at = b"", b"", 50
    for i, s in enumerate(shapes):
        shp += struct.pack(">ii", i + 1, len(s) // 2) + s
        shx += struct.pack(">ii", at, len(s) // 2)
        at += 4 + len(s) // 2
    head = lambda n: struct.pack(">i20xi", 9994, n) + struct.pack("<ii8d", 1000, kind, 0, 0, 9, 9, 0, 0, 0, 0)
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<BBBBIHH20x", 3, 120, 1, 1, len(records), 33 + 32 * len(fields), width)
    for name, k, size, dec in fields:
        dbf += name.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([size, dec]) + bytes(14)
    dbf += b"\r" + b"".join(records)
    for ext, data in (("shp", head(50 + len(shp) // 2) + shp), ("shx", head(50 + len(shx) // 2) + shx), ("dbf", dbf)):
        with open(f"{path}.{ext}", "wb") as f:
            f.write(data)
    if prj:
        with open(f"{path}.prj", "w", encoding="utf-8") as f:
            f.write(prj)


def shape_polygon(rings):
    xy = np.concatenate(rings)
    starts = np.cumsum([0, *[len(r) for r in rings[:-1]]])
    return struct.pack("<i4dii", 5, 0, 0, 9, 9, len(rings), len(xy)) + starts.astype("<i4").tobytes() + xy.astype("<f8").tobytes()


def test_shapefile(spark, tmp_path):
    outer = np.array([(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], float)
    hole = np.array([(1, 1), (2, 1), (2, 2), (1, 1)], float)
    fields = [("NAME", "C", 5, 0), ("N", "N", 6, 0), ("X", "N", 8, 2), ("D", "D", 8, 0), ("OK", "L", 1, 0)]
    records = [b" " + b"abc  " + b"    12" + b"   1.50 " + b"20200101" + b"T", b"*" + b"gone " + b"     1" + b"    1.00" + b"20200101" + b"F", b" " + b"     " + b"  zz  " + b"        " + b"        " + b"?"]
    path = str(tmp_path / "s")
    shapefile_bytes(path, [shape_polygon([outer, hole]), struct.pack("<i", 0), struct.pack("<i", 0)], 5, fields, records, 'GEOGCS["GCS_GDA2020",DATUM["D"]]')
    for per in (1, 100):
        df = shapefile.read(spark, f"{path}.shp", per)
        rows = sorted(df.collect(), key=lambda r: r["fid"])
        assert [r["fid"] for r in rows] == [1, 3] and df.schema["geometry"].metadata["epsg"] == 7844
        assert (rows[0]["NAME"], rows[0]["N"], rows[0]["X"], rows[0]["OK"]) == ("abc", 12, 1.5, True) and rows[0]["D"].isoformat().startswith("2020-01-01")
        assert tuple(rows[1])[2:] == (None if False else rows[1]["NAME"], None, None, None, None) and rows[1]["geometry"] is None
        g = G.from_wkb(bytes(rows[0]["geometry"]))
        assert g.kind == G.POLYGON and len(g.data) == 2 and G.signed_area(g.data[0]) > 0
    assert shapefile.index(open(f"{path}.shx", "rb").read())[0].tolist() == [100, len(shape_polygon([outer, hole]))]


def test_shapes_of_other_kinds():
    assert shapefile.shape(struct.pack("<idd", 1, 3, 4)).data.tolist() == [[3, 4]]
    assert shapefile.shape(struct.pack("<i4di2d", 8, 0, 0, 1, 1, 1, 5, 6)).kind == G.MULTIPOINT
    with pytest.raises(Unsupported):
        shapefile.shape(struct.pack("<i", 11))
    with pytest.raises(ShapefileError):
        shapefile.shape(struct.pack("<id", 1, 3))
    with pytest.raises(ShapefileError):
        shapefile.header(bytes(100))


# --- File geodatabase


def utf16(s):
    return bytes([len(s)]) + s.encode("utf-16-le")


def gdb_table(path, number, fields, rows, version=3, utf8=True, shape_code=0, holes=(), sparse=None):
    section = struct.pack("<IIh", 4, shape_code | (1 << 8 if utf8 else 0), len(fields)) + b"".join(fields)
    body = struct.pack("<i", len(section)) + section
    at, offsets = 40 + len(body), []
    for i, r in enumerate(rows):
        if i in holes:
            offsets.append(0)
            continue
        offsets.append(at)
        body += struct.pack("<i", len(r)) + r
        at += 4 + len(r)
    live = sum(o > 0 for o in offsets)
    head = struct.pack("<iiiiqqq", version, live if version == 3 else 0, 100, 5, live, 40 + len(body), 40)
    with open(f"{path}/a{number:08x}.gdbtable", "wb") as f:
        f.write(head + body)
    blocks = sparse or [0]
    raw = b"".join(o.to_bytes(5, "little") for o in offsets).ljust(1024 * 5, b"\0")
    raw = b"".join(raw if k == len(blocks) - 1 else bytes(1024 * 5) for k in range(len(blocks)))
    n = len(blocks)
    index = struct.pack("<IIiI", 3, n, 1024 * (max(blocks) + 1), 5) if version == 3 else struct.pack("<IQI", 4, n, 5)
    if sparse:
        bits = np.zeros(max(blocks) + 1, np.uint8)
        bits[blocks] = 1
        tail = struct.pack("<IIII", 1, len(bits), n, 0) + np.packbits(bits, bitorder="little").tobytes()
    else:
        tail = struct.pack("<IIII", 0, n, n, 0)
    with open(f"{path}/a{number:08x}.gdbtablx", "wb") as f:
        f.write(index + raw + tail)


def simple_field(name, code, nullable=True, width=None):
    head = utf16(name) + b"\0" + bytes([code])
    flag = bytes([1 if nullable else 4])
    if code == filegdb.OBJECTID:
        return head + b"\x04\x02"
    if code in (filegdb.STRING, filegdb.XML):
        return head + struct.pack("<I", 255) + flag + b"\0"
    if code in (filegdb.BINARY, filegdb.GUID):
        return head + flag + b"\0"
    return head + bytes([width or 4]) + flag + b"\0"


def shape_field(wkt="", scale=100.0):
    raw = wkt.encode("utf-16-le")
    return utf16("SHAPE") + b"\0" + bytes([filegdb.GEOMETRY]) + b"\0\x07" + struct.pack("<H", len(raw)) + raw + b"\x01" + struct.pack("<ddd", -10.0, -20.0, scale) + struct.pack("<d", 0.01) + struct.pack("<4d", 0, 0, 9, 9) + b"\0" + struct.pack("<I", 1) + struct.pack("<d", 5.0)


def signed(n):
    """The signed form: six bits and the sign in the first byte."""
    a = abs(n)
    out, first = bytearray(), a & 0x3F | (0x40 if n < 0 else 0)
    a >>= 6
    out.append(first | (0x80 if a else 0))
    while a:
        out.append(a & 0x7F | (0x80 if a > 0x7F else 0))
        a >>= 7
    return bytes(out)


def text(s):
    return varuint(len(s.encode())) + s.encode()


def gdb(tmp_path, layers):
    path = str(tmp_path / "x.gdb")
    os.makedirs(path, exist_ok=True)
    fields = [simple_field("ID", filegdb.OBJECTID), simple_field("Name", filegdb.STRING), simple_field("FileFormat", filegdb.INT32)]
    gdb_table(path, 1, fields, [b"\0" + text(n) + struct.pack("<i", 0) for n in ("GDB_SystemCatalog", *layers)])
    return path


@pytest.mark.parametrize(("version", "sparse"), [(3, None), (4, None), (3, [1, 5])])
def test_filegdb(spark, tmp_path, version, sparse):
    path = gdb(tmp_path, ["lines"])
    fields = [simple_field("OBJECTID", filegdb.OBJECTID), shape_field('GEOGCS["GCS_GDA2020"]'), simple_field("name", filegdb.STRING), simple_field("n", filegdb.INT16, width=2), simple_field("at", filegdb.DATETIME, width=8), simple_field("g", filegdb.GUID), simple_field("must", filegdb.FLOAT64, False, 8)]
    line = varuint(3) + varuint(3) + varuint(1) + varuint(0) * 4 + signed(1000) + signed(2000) + signed(50) + signed(-100) + signed(-200) + signed(0)
    point = varuint(1) + varuint(1001) + varuint(2001)
    rows = [bytes([0]) + varuint(len(line)) + line + text("é") + struct.pack("<h", -3) + struct.pack("<d", 25569.5) + bytes(range(16)) + struct.pack("<d", 1.5), b"", bytes([0b11111]) + struct.pack("<d", 2.5), bytes([0]) + varuint(len(point)) + point + text("") + struct.pack("<h", 1) + struct.pack("<d", 0.0) + bytes(16) + struct.pack("<d", 0.5)]
    gdb_table(path, 2, fields, rows, version, True, 3, (1,), sparse)
    assert filegdb.layers(path) == {"lines": 2}
    df = filegdb.read(spark, path)
    assert df.schema["geometry"].metadata["epsg"] == 7844 and df.columns == ["fid", "geometry", "name", "n", "at", "g", "must"]
    got = sorted(df.collect(), key=lambda r: r["fid"])
    base = 5 * 1024 if sparse else 0
    assert [r["fid"] - base for r in got] == [1, 3, 4]
    assert G.from_wkb(bytes(got[0]["geometry"])).data.tolist() == [[0, 0], [0.5, -1], [-1.5, -1]]
    assert (got[0]["name"], got[0]["n"], bytes(got[0]["g"]), got[0]["must"]) == ("é", -3, bytes(range(16)), 1.5) and got[0]["at"].isoformat().startswith("1970-01-01T12:00")
    assert tuple(got[1])[1:6] == (None,) * 5 and got[1]["must"] == 2.5
    assert G.from_wkb(bytes(got[2]["geometry"])).data.tolist() == [[0, 0]]


def test_filegdb_layers_and_errors(tmp_path):
    path = gdb(tmp_path, ["a", "b"])
    with pytest.raises(LayerAmbiguous):
        filegdb.pick(path, None)
    with pytest.raises(GdbError):
        filegdb.pick(path, "c")
    meta = filegdb.GeometryMeta("", 0.0, 0.0, 1.0, (0, 0, 0, 0))
    assert G.is_empty(filegdb.shape(varuint(1) + varuint(0) + varuint(0), meta)) and G.is_empty(filegdb.shape(varuint(5) + varuint(0), meta))
    for code in (9, 0x80000003, 32):
        with pytest.raises(Unsupported):
            filegdb.shape(varuint(code) + bytes(9), meta)
    with pytest.raises(GdbError):
        filegdb.shape(varuint(3) + varuint(2) + varuint(2) + bytes(4) + varuint(9), meta)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=20))
def test_signed_integers_at_once(values):
    data = b"".join(signed(v) for v in values)
    assert data == b"".join(map(binary.varint, values))
    c = binary.Cursor(data + b"\x07")
    assert c.varints(len(values)).tolist() == values and c.left == 1
    with pytest.raises(Malformed):
        binary.Cursor(data).varints(len(values) + 1)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**62), 2**62))
def test_integers_on_the_wire(n):
    assert Cursor(signed(n)).varint() == n
    assert Cursor(varuint(abs(n))).varuint() == abs(n)
    z = zigzag(n)
    assert z >= 0 and (z >> 1 ^ -(z & 1)) == n


# --- PMTiles and vector tiles


def test_vector_tile_goldens():
    assert V.commands(G.Geometry(1, G.array([(0, 0)])), 0, 0, 0) == [9, 4096, 4096]
    assert V.commands(G.Geometry(4, G.array([(0, 0), (0, 0)])), 0, 0, 0)[0] == 17
    line = V.commands(G.Geometry(2, G.array([(0, 0), (90, 0), (0, 0)])), 0, 0, 0)
    assert (line[0], line[3]) == (9, 18)
    ring = V.commands(G.Geometry(3, [G.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])]), 0, 0, 0)
    assert ring[-1] == 15 and len(ring) == 11
    with pytest.raises(Unsupported):
        V.commands(G.Geometry(7, []), 0, 0, 0)
    layer = V.Layer("l", 0, 0, 0)
    assert not layer.add(None, []) and not layer.add(G.Geometry(3, []), [])
    layer.add(G.Geometry(1, G.array([(0, 0)])), [("a", 1), ("b", -5), ("c", "x"), ("d", 1.5), ("e", True), ("f", None), ("g", b"no")], 7)
    layer.add(G.Geometry(1, G.array([(1, 1)])), [("a", 1)], -1)
    got = V.decode(V.decompressed(V.compressed(V.tile_bytes([layer.finish()]))))["l"]
    assert got["extent"] == 4096 and got["features"][0] == {"id": 7, "type": 1, "commands": [9, 4096, 4096], "properties": {"a": 1, "b": -5, "c": "x", "d": 1.5, "e": True}}
    assert got["features"][1]["id"] is None and len(layer.values) == 5


def test_vector_tiles_over_a_frame(spark):
    df = places(spark, THREE)
    tiles = V.encode(V.to_tiles(df, 2), "pts", fid="id")
    assert tiles.agg(F.sum("n_features")).first()[0] == 3
    both = V.merge_layers([tiles, V.encode(V.to_tiles(df, 2), "again", fid=None)])
    for r in both.collect():
        assert list(V.decode(bytes(r["data"]))) == ["pts", "again"]


def test_pmtiles_runs_contents_and_lookup(spark, tmp_path):
    path = str(tmp_path / "t.pmtiles")
    rows = [(2, x, y, b"same", 0) for x in range(4) for y in range(4)]
    h = pmtiles.write(spark.createDataFrame(rows, "z int, x long, y long, data binary, n int"), path, "n", metadata={"name": "t"})
    assert (h["addressed"], h["contents"], h["entries"]) == (16, 1, 1)
    a = pmtiles.Archive(path)
    assert a.tile(2, 3, 3) == b"same" and a.tile(3, 0, 0) is None and json.loads(a.metadata()) == {"name": "t"}
    assert pmtiles.read(spark, path).count() == 16
    again = spark.createDataFrame([(1, 0, 0, b"old", 1), (1, 0, 0, b"new", 2), (1, 1, 1, b"other", 1)], "z int, x long, y long, data binary, n int")
    h = pmtiles.write(again, path, "n", tile_compression="none")
    assert h["contents"] == 2 and pmtiles.Archive(path).tile(1, 0, 0) == b"new"
    assert [r["data"] for r in pmtiles.read(spark, path).where("z = 1 and x = 1 and y = 1").collect()] == [b"other"]
    with pytest.raises(PmTilesError):
        pmtiles.write(again.limit(0), path, "n")


def test_pmtiles_leaves(spark, tmp_path):
    path = str(tmp_path / "leaves.pmtiles")
    df = spark.range(256).select(F.lit(4).alias("z"), (F.col("id") % 16).alias("x"), F.expr("id div 16").alias("y"), F.col("id").cast("string").cast("binary").alias("data"))
    h = pmtiles.write(df, path, leaf_threshold=100, leaf_size=40)
    a = pmtiles.Archive(path)
    assert h["entries"] == 256 and len(a.root) == 7 and all(not e.run for e in a.root)
    for i in (0, 77, 255):
        assert a.tile(4, i % 16, i // 16) == str(i).encode()
    assert {bytes(r["data"]) for r in pmtiles.read(spark, path).collect()} == {str(i).encode() for i in range(256)}


def test_pmtiles_parts():
    entries = [pmtiles.Entry(1, 2, 10, 0), pmtiles.Entry(5, 1, 20, 10), pmtiles.Entry(6, 1, 5, 0)]
    assert pmtiles.decode_directory(pmtiles.encode_directory(entries)) == entries
    assert pmtiles.find(entries, 2).tile_id == 1 and pmtiles.find(entries, 3) is None and pmtiles.find(entries, 0) is None
    for z, x, y in ((0, 0, 0), (5, 3, 30), (12, 4095, 0), (31, 5, 7)):
        assert pmtiles.tile_of(pmtiles.tile_id(z, x, y)) == (z, x, y)
    with pytest.raises(TileError):
        pmtiles.tile_id(1, 2, 0)
    with pytest.raises(PmTilesError):
        pmtiles.parse_header(b"PMTiles\x02" + bytes(119))
    with pytest.raises(Unsupported):
        pmtiles.decompress(b"", "brotli")


# --- rasters


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=6000), st.lists(st.sampled_from([b"a", b"bb" * 300, b"\0" * 200]), max_size=40).map(b"".join)))
def test_codecs_round_trip(data):
    for codec in ("none", "packbits", "lzw", "deflate"):
        assert geotiff.decompress(geotiff.compress(data, codec), codec) == data


def test_lzw_over_many_code_widths():
    data = np.random.default_rng(1).integers(0, 50, 60_000).astype(np.uint8).tobytes()
    assert geotiff.unlzw(geotiff.lzw(data)) == data


def strip_tiff(path, pixels, predictor=1, order="<", big=False):
    """A file of one strip, by hand."""
    h, w = pixels.shape
    rows = np.diff(pixels, axis=1, prepend=np.zeros((h, 1), pixels.dtype)) if predictor == 2 else pixels
    data = zlib.compress(rows.astype(pixels.dtype.newbyteorder(order)).tobytes())
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8 * pixels.dtype.itemsize), (259, 3, 8), (273, 4, 16), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (317, 3, predictor), (339, 3, 1)]
    at = 16 + len(data)
    if big:
        ifd = struct.pack(order + "Q", len(tags)) + b"".join(struct.pack(order + "HHQ", t, k, 1) + (struct.pack(order + "H6x", v) if k == 3 else struct.pack(order + "I4x", v)) for t, k, v in tags) + bytes(8)
        head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ", 43, 8, 0, at)
    else:
        ifd = struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "H2x", v) if k == 3 else struct.pack(order + "I", v)) for t, k, v in tags) + bytes(4)
        head = ((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)).ljust(16, b"\0")
    with open(path, "wb") as f:
        f.write(head + data + ifd)


@pytest.mark.parametrize(("predictor", "order", "big"), [(1, "<", False), (2, "<", False), (1, ">", False), (2, ">", True)])
def test_strips_predictors_and_byte_orders(spark, tmp_path, predictor, order, big):
    path, pixels = str(tmp_path / "s.tif"), np.arange(12, dtype=np.uint16).reshape(3, 4) * 999
    strip_tiff(path, pixels, predictor, order, big)
    row = geotiff.read(spark, path).first()
    assert np.frombuffer(bytes(row["bands"][0]["data"]), "<u2").reshape(3, 4).tolist() == pixels.tolist()


@pytest.mark.parametrize(("codec", "big"), [("none", False), ("packbits", None), ("lzw", None), ("deflate", None), ("none", True)])
def test_tiled_round_trip(spark, tmp_path, codec, big):
    path = str(tmp_path / "t.tif")
    t = (144.0, 0.0005, 0.0, -37.0, 0.0, -0.0005)
    bands = lambda v: [("b1", "F32", -9.0, None, None, None, np.full((2, 2), v, "<f4").tobytes()), ("b2", "F32", -9.0, None, None, None, np.full((2, 2), -v, "<f4").tobytes())]
    rows = [(0, x, y, 2, 2, (144.0 + x * 0.001, *t[1:3], -37.0 - y * 0.001, *t[4:]), bands(10.0 * (1 + x + 2 * y)), 7855) for x in (0, 1) for y in (0, 1)]
    geotiff.write(spark.createDataFrame(rows, geotiff.SCHEMA), path, {0: (4, 4)}, codec, big=big)
    with open(path, "rb") as f:
        assert f.read(4)[2] == (43 if big else 42)
    about = geotiff.profile(path)
    assert about["epsg"] == 7855 and about["affine"] == pytest.approx(t) and about["bands"] == [{"dtype": "F32", "nodata": -9.0}] * 2
    got = {(r["x"], r["y"]): np.frombuffer(bytes(r["bands"][1]["data"]), "<f4")[0] for r in geotiff.read(spark, path).collect()}
    assert got == {(0, 0): -10, (1, 0): -20, (0, 1): -30, (1, 1): -40}
    with pytest.raises(TiffError):
        geotiff.Tiff(__file__)


def png_bytes(planes, filters):
    h, w = planes[0].shape
    raw = np.stack(planes, -1).reshape(h, -1).astype(int)
    n, out, above = len(planes), b"", np.zeros(raw.shape[1], int)
    for i in range(h):
        left = np.concatenate([np.zeros(n, int), raw[i][:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        best = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        k = filters[i % len(filters)]
        out += bytes([k]) + ((raw[i] - (0, left, above, (left + above) // 2, best)[k]) % 256).astype(np.uint8).tobytes()
        above = raw[i]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    color = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png_with_world_file(spark, tmp_path, n):
    rnd = np.random.default_rng(n)
    planes = [rnd.integers(0, 256, (7, 5)).astype(np.uint8) for _ in range(n)]
    path = str(tmp_path / "i.png")
    with open(path, "wb") as f:
        f.write(png_bytes(planes, [0, 1, 2, 3, 4]))
    with pytest.raises(ImageError):
        images.read(spark, path)
    with open(str(tmp_path / "i.pgw"), "w", encoding="utf-8") as f:
        f.write("0.5\n0\n0\n-0.5\n144\n-37\n")
    row = images.read(spark, path, 4326).first()
    assert [np.frombuffer(bytes(b["data"]), np.uint8).reshape(7, 5).tolist() for b in row["bands"]] == [p.tolist() for p in planes]
    assert (row["affine"]["ox"], row["affine"]["oy"]) == (143.75, -36.75)


def test_rotated_world_file():
    assert images.parse_world("2 1 4 -2 100 50") == (97, 2, 4, 50.5, 1, -2)
