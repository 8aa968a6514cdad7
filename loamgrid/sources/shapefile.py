"""Shapefiles: .shp, .shx and .dbf are required, .prj says the coordinate system.

Partitions are ranges of the index; each opens the files and reads its own stretch of shapes and records.
Two-dimensional shapes only. Records that the table marks as deleted are left out; fid is the index plus one.
"""

import datetime
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamgrid.core import geometry as G
from loamgrid.core.errors import ShapefileError, Unsupported
from loamgrid.functions import crs as C
from loamgrid.sources.binary import Cursor
from loamgrid.sources.files import exists, open_file, read_bytes

RECORDS = 50_000  #: of a partition
#: Shape type codes.
SHAPES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint", 11: "PointZ", 13: "PolyLineZ", 15: "PolygonZ", 18: "MultiPointZ", 21: "PointM", 23: "PolyLineM", 25: "PolygonM", 28: "MultiPointM", 31: "MultiPatch"}
KINDS = {1: "Point", 3: "MultiLineString", 5: "MultiPolygon", 8: "MultiPoint"}
EPOCH = datetime.date(1899, 12, 30)


class Header(NamedTuple):
    shape: int
    box: tuple[float, float, float, float]
    size: int


def header(data: bytes) -> Header:
    if len(data) < 100:
        raise ShapefileError("the header has 100 bytes")
    code, size, version, shape = struct.unpack_from(">i", data)[0], struct.unpack_from(">i", data, 24)[0], *struct.unpack_from("<ii", data, 28)
    if code != 9994 or version != 1000:
        raise ShapefileError(f"file code {code}, version {version}")
    if shape not in SHAPES:
        raise ShapefileError(f"shape type {shape}")
    return Header(shape, struct.unpack_from("<4d", data, 36), size * 2)


def index(data: bytes) -> np.ndarray:
    """(offset, length) in bytes of every record."""
    header(data)
    words = np.frombuffer(data[100 : 100 + (len(data) - 100) // 8 * 8], ">i4").reshape(-1, 2)
    return words.astype(np.int64) * 2


class DbfField(NamedTuple):
    name: str
    kind: str
    width: int
    decimals: int
    at: int


class Dbf(NamedTuple):
    records: int
    start: int
    width: int
    fields: list[DbfField]


def dbf_header(data: bytes) -> Dbf:
    c = Cursor(data, 4, error=ShapefileError)
    records, start, width = c.number("I"), c.number("H"), c.number("H")
    fields, at = [], 1
    c.at = 32
    while c.left and c.peek() != 0x0D and c.at + 32 <= start:
        name = c.take(11).split(b"\0")[0].decode("latin-1")
        kind = chr(c.uint(1))
        c.take(4)
        size, decimals = c.uint(1), c.uint(1)
        c.take(14)
        fields.append(DbfField(name, kind, size, decimals, at))
        at += size
    return Dbf(records, start, width, fields)


def column(f: DbfField) -> T.StructField:
    """Numbers without decimals are integers; unknown kinds are text. All may be null."""
    kind = {"L": T.BooleanType(), "D": T.TimestampType(), "F": T.DoubleType()}.get(f.kind)
    if f.kind == "N":
        kind = T.DoubleType() if f.decimals else T.LongType()
    return T.StructField(f.name, kind or T.StringType(), True, {"width": f.width})


def dbf_value(raw: bytes, f: DbfField):
    """Blank values and values that do not parse are null."""
    text = raw.decode("utf-8", "replace") if f.kind == "C" else raw.decode("latin-1")
    text = text.rstrip(" \0") if f.kind == "C" else text.strip(" \0")
    if f.kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if not text:
        return None
    try:
        if f.kind == "N" and not f.decimals:
            n = int(text)
            return n if -(1 << 63) <= n < 1 << 63 else None
        if f.kind in "NF":
            return float(text)
        if f.kind == "D":
            return datetime.datetime(int(text[:4]), int(text[4:6]), int(text[6:8]), tzinfo=datetime.UTC) if len(text) == 8 else None
    except ValueError:
        return None
    return text


def shape(content: bytes) -> G.Geometry | None:
    """The geometry of a record; a null shape is None."""
    c = Cursor(content, error=ShapefileError)
    kind = c.number("i")
    if kind == 0:
        return None
    if kind == 1:
        return G.Geometry(G.POINT, G.array([(c.number("d"), c.number("d"))]))
    if kind not in KINDS:
        raise Unsupported(f"shape type {SHAPES.get(kind, kind)}")
    c.take(32)
    if kind == 8:
        return G.Geometry(G.MULTIPOINT, _coords(c, c.number("i")))
    n_parts, n = c.number("i"), c.number("i")
    starts = [c.number("i") for _ in range(n_parts)]
    if any(not 0 <= s <= n for s in starts) or sorted(starts) != starts:
        raise ShapefileError("parts out of order")
    pieces = [p for p in np.split(_coords(c, n), starts[1:]) if len(p)] if n_parts else []
    if kind == 3:
        return G.Geometry(G.LINESTRING, pieces[0] if pieces else G.array([])) if len(pieces) < 2 else G.Geometry(G.MULTILINESTRING, pieces)
    return G.from_polygons(G.polygons_from_esri(pieces)) if pieces else G.Geometry(G.POLYGON, [])


def _coords(c: Cursor, n: int) -> np.ndarray:
    return np.frombuffer(c.take(16 * n), "<f8").reshape(-1, 2)


def sibling(path: str, ext: str) -> str:
    """The file of the same stem, in lower or upper case."""
    stem = path[: path.rindex(".")]
    for e in (ext, ext.upper()):
        if exists(f"{stem}.{e}"):
            return f"{stem}.{e}"
    raise ShapefileError(f"no .{ext} beside {path}")


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loamgrid_shapefile"

    def schema(self) -> T.StructType:
        return schema_of(self.options["path"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records", RECORDS)))


def schema_of(path: str) -> T.StructType:
    head = header(read_bytes(path, 0, 100))
    try:
        wkt = read_bytes(sibling(path, "prj")).decode("utf-8", "replace")
    except ShapefileError:
        wkt = None
    meta = {"geometry": True, "kind": KINDS.get(head.shape, "GeometryCollection"), "extent": list(head.box), **C.metadata(wkt)}
    fields = [column(f) for f in dbf_header(read_bytes(sibling(path, "dbf"), 0, 65535)).fields]
    return T.StructType([T.StructField("fid", T.LongType()), T.StructField("geometry", T.BinaryType(), True, meta), *fields])


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self) -> list[InputPartition]:
        n = len(index(read_bytes(sibling(self.path, "shx"))))
        return [_Range(a, min(n, a + self.records)) for a in range(0, n, self.records)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        low, high = partition.low, partition.high
        with open_file(sibling(self.path, "shx")) as f:
            f.seek(100 + 8 * low)
            where = np.frombuffer(f.read(8 * (high - low)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        dbf_path = sibling(self.path, "dbf")
        dbf = dbf_header(read_bytes(dbf_path, 0, 65535))
        with open_file(self.path) as shp, open_file(dbf_path) as table:
            for i, (at, size) in enumerate(where.tolist(), low):
                table.seek(dbf.start + i * dbf.width)
                raw = table.read(dbf.width)
                if raw[:1] == b"*":
                    continue
                shp.seek(at + 8)
                g = shape(shp.read(size))
                yield (i + 1, None if g is None else G.to_wkb(g), *[dbf_value(raw[f.at : f.at + f.width], f) for f in dbf.fields])


def read(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    schema = schema_of(path)
    df = spark.read.format("loamgrid_shapefile").schema(schema).option("path", path).option("records", str(records)).load()
    return df.withMetadata("geometry", schema["geometry"].metadata)
