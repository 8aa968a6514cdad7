"""File geodatabases: a catalog of layers, each a table with an index of its rows.

Partitions are ranges of 1024-row index blocks. Two-dimensional shapes; curves are taken as their vertices.
The row number is the object id: fid is the index plus one. Deleted rows have no offset.
"""

import datetime
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamgrid.core import geometry as G
from loamgrid.core.errors import GdbError, LayerAmbiguous, Unsupported
from loamgrid.functions import crs as C
from loamgrid.sources.binary import Cursor
from loamgrid.sources.files import open_file, read_bytes

BLOCK = 1024
BLOCKS = 64  #: index blocks of a partition
#: Field type codes.
INT16, INT32, FLOAT32, FLOAT64, STRING, DATETIME, OBJECTID, GEOMETRY, BINARY, RASTER, GUID, GLOBALID, XML, INT64, DATE, TIME, DATETIME_OFFSET = range(17)
SQL = {INT16: T.ShortType(), INT32: T.IntegerType(), INT64: T.LongType(), FLOAT32: T.FloatType(), FLOAT64: T.DoubleType(), STRING: T.StringType(), XML: T.StringType(), BINARY: T.BinaryType(), GUID: T.BinaryType(), GLOBALID: T.BinaryType(), DATETIME: T.TimestampType(), DATE: T.TimestampType(), TIME: T.TimestampType(), DATETIME_OFFSET: T.TimestampType()}
SHAPE_KINDS = {0: None, 1: "Point", 2: "MultiPoint", 3: "MultiLineString", 4: "MultiPolygon"}
POINTS, MULTIPOINTS, LINES, POLYGONS = (1, 52), (8, 53), (3, 50), (5, 51)


class GeometryMeta(NamedTuple):
    wkt: str
    x: float
    y: float
    scale: float
    extent: tuple[float, float, float, float]


@dataclass
class Column:
    name: str
    alias: str
    code: int
    nullable: bool
    width: int | None = None
    shape: GeometryMeta | None = None


@dataclass
class Table:
    version: int
    rows: int
    flags: int
    columns: list[Column] = field(default_factory=list)

    @property
    def utf8(self) -> bool:
        return bool(self.flags & 1 << 8)

    @property
    def shape_code(self) -> int:
        return self.flags & 0xFF

    @property
    def has_m(self) -> bool:
        return bool(self.flags & 1 << 30)

    @property
    def has_z(self) -> bool:
        return bool(self.flags & 1 << 31)


def table_header(path: str) -> Table:
    """Header and field section, read without the rows."""
    with open_file(path) as f:
        head = f.read(40)
        c = Cursor(head, error=GdbError)
        version = c.number("i")
        if version not in (3, 4):
            raise GdbError(f"table version {version}")
        old_rows = c.number("i")
        c.take(8)
        new_rows, _, at = c.number("q"), c.number("q"), c.number("q")
        f.seek(at)
        size = struct.unpack("<i", f.read(4))[0]
        section = Cursor(f.read(size + 4), error=GdbError)
    return fields(section, Table(version, old_rows if version == 3 else new_rows, 0))


def fields(c: Cursor, table: Table) -> Table:
    c.number("I")  # the section's own version
    table.flags = c.number("I")
    for _ in range(c.number("h")):
        name = c.text(2 * c.uint(1), "utf-16-le")
        alias = c.text(2 * c.uint(1), "utf-16-le")
        code = c.uint(1)
        if code > DATETIME_OFFSET:
            raise GdbError(f"field type {code}")
        col = Column(name, alias or name, code, True)
        if code == GEOMETRY:
            col.shape = shape_meta(c, table)
        elif code == OBJECTID:
            col.width, col.nullable = c.uint(1), False
            c.uint(1)
        else:
            if code in (STRING, XML):
                col.width = c.number("I")
            elif code not in (BINARY, RASTER, GUID, GLOBALID):
                col.width = c.uint(1)
            col.nullable = bool(c.uint(1) & 1)
            c.take(c.varuint())  # a default value
        table.columns.append(col)
    return table


def shape_meta(c: Cursor, table: Table) -> GeometryMeta:
    c.take(2)
    wkt = c.text(c.number("H"), "utf-16-le")
    flags = c.uint(1)
    x, y, scale = c.number("d"), c.number("d"), c.number("d")
    if scale == 0:
        raise GdbError("a coordinate scale of zero")
    further = bool(flags & 2) + bool(flags & 4)  # M and Z: origin and scale, then a tolerance after that of x and y
    c.take(16 * further + 8 + 8 * further)
    extent = tuple(c.number("d") for _ in range(4))
    c.take(16 * (table.has_z + table.has_m))
    c.take(1)
    grids = c.number("I")
    if not 1 <= grids <= 3:
        raise GdbError(f"{grids} grids")
    c.take(8 * grids)
    return GeometryMeta(wkt, x, y, scale, extent)


@dataclass
class Index:
    """Where rows lie: blocks of 1024 offsets; in sparse tables a bitmap says which blocks there are."""

    blocks: int
    width: int
    present: np.ndarray  #: logical numbers of the stored blocks, ascending

    def offsets(self, path: str, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(row, offset) of the live rows in the stored blocks low to high."""
        with open_file(path) as f:
            f.seek(16 + low * BLOCK * self.width)
            raw = np.frombuffer(f.read((high - low) * BLOCK * self.width), np.uint8).reshape(-1, self.width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : self.width] = raw
        at = wide.view("<u8").ravel()
        for k in np.flatnonzero(at).tolist():
            yield int(self.present[low + k // BLOCK]) * BLOCK + k % BLOCK, int(at[k])


def index(path: str) -> Index:
    with open_file(path) as f:
        c = Cursor(f.read(16), error=GdbError)
        version = c.number("I")
        if version == 3:
            blocks, rows, width = c.number("I"), c.number("i"), c.number("I")
            if rows < 0 or (not blocks and rows):
                raise GdbError("row count and blocks disagree")
        elif version == 4:
            blocks, width = c.number("Q"), c.number("I")
        else:
            raise GdbError(f"index version {version}")
        if not 4 <= width <= 6:
            raise GdbError(f"offsets of {width} bytes")
        if not blocks:
            return Index(0, width, np.zeros(0, np.int64))
        f.seek(16 + blocks * BLOCK * width)
        c = Cursor(f.read(), error=GdbError)
    words, bits, again = c.number("I"), c.number("I"), c.number("I")
    c.number("I")
    if again != blocks:
        raise GdbError("block counts disagree")
    if not words:
        if bits != blocks:
            raise GdbError("block counts disagree")
        return Index(blocks, width, np.arange(blocks))
    present = np.flatnonzero(np.unpackbits(np.frombuffer(c.take(-(-bits // 8)), np.uint8), bitorder="little"))
    if len(present) != blocks:
        raise GdbError("the bitmap and the block count disagree")
    return Index(blocks, width, present)


def row_blob(f, at: int) -> bytes:
    f.seek(at)
    head = f.read(4)
    n = struct.unpack("<i", head)[0] if len(head) == 4 else 0
    if n <= 0:
        raise GdbError(f"a row of {n} bytes at {at}")
    data = f.read(n)
    if len(data) < n:
        raise GdbError(f"a row is cut at {at}")
    return data


def days(value: float) -> datetime.datetime:
    """Days since 1899-12-30; microseconds truncated towards zero, as seen from 1970."""
    micros = int((value - 25569.0) * 86_400_000_000.0)
    return datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(microseconds=micros)


NUMBERS = {INT16: "h", INT32: "i", INT64: "q", FLOAT32: "f", FLOAT64: "d"}


def row(blob: bytes, fid: int, table: Table) -> tuple[bytes | None, list]:
    """(WKB, attribute values) of a row."""
    c = Cursor(blob, error=GdbError)
    nulls = c.take(-(-sum(f.nullable for f in table.columns) // 8))
    wkb, out, seen = None, [], 0
    for f in table.columns:
        if f.code == OBJECTID:
            continue
        null = False
        if f.nullable:
            null = bool(nulls[seen // 8] >> seen % 8 & 1)
            seen += 1
        if null:
            if f.code != GEOMETRY:
                out.append(None)
        elif f.code == GEOMETRY:
            g = shape(c.take(c.varuint()), f.shape)
            wkb = G.to_wkb(g)
        elif f.code in NUMBERS:
            out.append(c.number(NUMBERS[f.code]))
        elif f.code in (DATETIME, DATE, TIME, DATETIME_OFFSET):
            out.append(days(c.number("d")))
            if f.code == DATETIME_OFFSET:
                c.take(2)
        elif f.code in (STRING, XML):
            out.append(c.text(c.varuint(), "utf-8" if table.utf8 or f.code == XML else "utf-16-le"))
        elif f.code == BINARY:
            out.append(c.take(c.varuint()))
        elif f.code in (GUID, GLOBALID):
            out.append(c.take(16))
        else:
            raise Unsupported("raster fields")
    return wkb, out


def shape(blob: bytes, meta: GeometryMeta) -> G.Geometry:
    c = Cursor(blob, error=GdbError)
    code = c.varuint()
    if code & 0xC0000000:
        raise Unsupported("shapes with Z or M")
    curves, kind = bool(code & 0x20000000), code & 0xFF
    if kind in POINTS:
        x, y = c.varuint(), c.varuint()
        if not x and not y:
            return G.Geometry(G.POINT, G.array([]))
        place = lambda v, o: (v - 1) / meta.scale + o if v else np.nan
        return G.Geometry(G.POINT, G.array([(place(x, meta.x), place(y, meta.y))]))
    if kind not in (*MULTIPOINTS, *LINES, *POLYGONS):
        raise Unsupported(f"shape code {kind}")
    n = c.varuint()
    parts = 1
    if n and kind not in MULTIPOINTS:
        parts = c.varuint()
    if not n or not parts:
        return G.Geometry(G.MULTIPOINT, G.array([])) if kind in MULTIPOINTS else G.Geometry(G.LINESTRING, G.array([])) if kind in LINES else G.Geometry(G.POLYGON, [])
    if curves:
        c.varuint()
    for _ in range(4):
        c.varuint()  # the envelope
    counts = [c.varuint() for _ in range(parts - 1)]
    if sum(counts) > n:
        raise GdbError("parts have more vertices than the shape")
    steps = c.varints(2 * n).reshape(-1, 2)
    xy = np.cumsum(steps, axis=0) / meta.scale + (meta.x, meta.y)
    if kind in MULTIPOINTS:
        return G.Geometry(G.MULTIPOINT, xy)
    pieces = np.split(xy, np.cumsum(counts).astype(int)) if counts else [xy]
    if kind in LINES:
        return G.Geometry(G.LINESTRING, pieces[0]) if len(pieces) == 1 else G.Geometry(G.MULTILINESTRING, pieces)
    return G.from_polygons(G.polygons_from_esri(pieces))


# --- layers


def table_path(gdb: str, fid: int, ext: str = "gdbtable") -> str:
    return f"{gdb.rstrip('/')}/a{fid:08x}.{ext}"


def layers(gdb: str) -> dict[str, int]:
    """Names of the layers and their table numbers; system tables are left out."""
    path = table_path(gdb, 1)
    table, ix = table_header(path), index(table_path(gdb, 1, "gdbtablx"))
    names = [f.name for f in table.columns if f.code not in (OBJECTID, GEOMETRY)]
    if "Name" not in names:
        raise GdbError("the catalog has no names")
    out = {}
    with open_file(path) as f:
        for i, at in ix.offsets(table_path(gdb, 1, "gdbtablx"), 0, ix.blocks):
            name = row(row_blob(f, at), i + 1, table)[1][names.index("Name")]
            if name and not name.upper().startswith("GDB_"):
                out[name] = i + 1
    return out


def pick(gdb: str, layer: str | None) -> tuple[str, int]:
    found = layers(gdb)
    if layer is None:
        if len(found) != 1:
            raise LayerAmbiguous(f"layers: {', '.join(found)}")
        return next(iter(found.items()))
    if layer not in found:
        raise GdbError(f"no layer {layer}; there are {', '.join(found)}")
    return layer, found[layer]


def schema_of(table: Table) -> T.StructType:
    out = [T.StructField("fid", T.LongType())]
    shapes = [f for f in table.columns if f.code == GEOMETRY]
    if shapes:
        meta = {"geometry": True, "kind": SHAPE_KINDS.get(table.shape_code) or "GeometryCollection", "source_name": shapes[0].name, "extent": list(shapes[0].shape.extent), **C.metadata(shapes[0].shape.wkt)}
        out.append(T.StructField("geometry", T.BinaryType(), True, meta))
    for f in table.columns:
        if f.code in (OBJECTID, GEOMETRY):
            continue
        if f.code == RASTER:
            raise Unsupported("raster fields")
        meta = {"alias": f.alias} | ({"width": f.width} if f.width else {}) | ({"guid": True} if f.code in (GUID, GLOBALID) else {}) | ({"xml": True} if f.code == XML else {})
        out.append(T.StructField(f.name, SQL[f.code], f.nullable, meta))
    return T.StructType(out)


class FileGdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loamgrid_filegdb"

    def schema(self) -> T.StructType:
        return schema_of(table_header(table_path(self.options["path"], pick(self.options["path"], self.options.get("layer"))[1])))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], pick(self.options["path"], self.options.get("layer"))[1], int(self.options.get("blocks", BLOCKS)))


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, gdb: str, number: int, blocks: int):
        self.table, self.tablx, self.blocks = table_path(gdb, number), table_path(gdb, number, "gdbtablx"), blocks

    def partitions(self) -> list[InputPartition]:
        n = index(self.tablx).blocks
        return [_Range(a, min(n, a + self.blocks)) for a in range(0, n, self.blocks)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        table, ix = table_header(self.table), index(self.tablx)
        shaped = any(f.code == GEOMETRY for f in table.columns)
        with open_file(self.table) as f:
            for i, at in ix.offsets(self.tablx, partition.low, partition.high):
                wkb, values = row(row_blob(f, at), i + 1, table)
                yield (i + 1, *([wkb] if shaped else []), *values)


def read(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(FileGdbSource)
    name, number = pick(path, layer)
    schema = schema_of(table_header(table_path(path, number)))
    df = spark.read.format("loamgrid_filegdb").schema(schema).option("path", path).option("layer", name).load()
    return df.withMetadata("geometry", schema["geometry"].metadata) if "geometry" in df.columns else df


def sizes(path: str) -> int:
    """Bytes of a table, for reports."""
    return len(read_bytes(path))
