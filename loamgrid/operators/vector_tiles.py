"""Vector tiles: features by tile, encoded by an Arrow function.

Geometry is longitude and latitude. Coordinates are placed in the tile as they are: no clipping, no buffer,
no change of ring orientation. Features without geometry, or without coordinates, are left out;
collections are refused. Keys and values are interned over the layer, in the order they come.
"""

import gzip
import math
import struct
from collections.abc import Iterable, Iterator
from datetime import datetime
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.core import geometry as G
from loamgrid.core import wkbarray as W
from loamgrid.core.errors import Malformed, SchemaError, Unsupported
from loamgrid.functions import tiles
from loamgrid.functions.crs import MAX_LATITUDE
from loamgrid.sources.binary import Cursor, varuint, zigzag

EXTENT, VERSION = 4096, 2
MOVE, LINE, CLOSE = 1, 2, 7
GZIP_LEVEL = 6

# --- wire format


def tag(number: int, wire: int) -> bytes:
    return varuint(number << 3 | wire)


def varint_field(number: int, value: int) -> bytes:
    return tag(number, 0) + varuint(value)


def bytes_field(number: int, value: bytes) -> bytes:
    return tag(number, 2) + varuint(len(value)) + value


def string_field(number: int, value: str) -> bytes:
    return bytes_field(number, value.encode())


def packed(values: Iterable[int]) -> bytes:
    return b"".join(map(varuint, values))


# --- geometry


def geometry_class(g: G.Geometry) -> int:
    """1 points, 2 lines, 3 polygons."""
    if g.kind == G.COLLECTION:
        raise Unsupported("a geometry collection in a vector tile")
    return {G.POINT: 1, G.MULTIPOINT: 1, G.LINESTRING: 2, G.MULTILINESTRING: 2, G.POLYGON: 3, G.MULTIPOLYGON: 3}[g.kind]


def place(xy: np.ndarray, z: Any, x: Any, y: Any, extent: int = EXTENT) -> np.ndarray:
    """Pixels inside the tile, rounded half away from zero."""
    n = np.ldexp(1.0, z)
    lat = np.radians(np.clip(xy[:, 1], -MAX_LATITUDE, MAX_LATITUDE))
    across = (xy[:, 0] + 180.0) / 360.0 * n - x
    down = (1.0 - np.log(np.tan(lat) + 1.0 / np.cos(lat)) / math.pi) / 2.0 * n - y
    v = np.column_stack([across, down]) * extent
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


class Path:
    """A feature's commands; coordinates are steps from the last."""

    def __init__(self):
        self.commands: list[int] = []
        self.last = np.zeros((1, 2), np.int64)

    def add(self, command: int, points: np.ndarray) -> None:
        if not len(points):
            return
        steps = np.diff(np.concatenate([self.last, points]), axis=0)
        self.last = points[-1:]
        self.commands.append(command | len(points) << 3)
        self.commands += (steps << 1 ^ steps >> 63).ravel().tolist()

    def line(self, points: np.ndarray) -> None:
        self.add(MOVE, points[:1])
        self.add(LINE, points[1:])

    def ring(self, points: np.ndarray, closed: bool) -> None:
        points = points[:-1] if closed and len(points) > 1 else points
        if len(points):
            self.line(points)
            self.commands.append(CLOSE | 1 << 3)


def commands(g: G.Geometry, z: int, x: int, y: int, extent: int = EXTENT) -> list[int]:
    kind, path = geometry_class(g), Path()
    if kind == 1:
        path.add(MOVE, place(g.data, z, x, y, extent))
        return path.commands
    for part in G.parts(g):
        if not len(part):
            continue
        if kind == 2:
            path.line(place(part, z, x, y, extent))
        else:
            path.ring(place(part, z, x, y, extent), len(part) > 1 and bool((part[0] == part[-1]).all()))
    return path.commands


def varuints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of many numbers: seven bits to a byte, the lowest first."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[(ends - size)[own] + k] = (v[own] >> np.uint64(7 * k) & np.uint64(0x7F)) | np.where(size[own] > k + 1, 0x80, 0).astype(np.uint64)
    return out, ends


def flat_paths(flat: W.Flat, z: np.ndarray, x: np.ndarray, y: np.ndarray, extent: int = EXTENT) -> dict[int, bytes]:
    """The packed commands of those points and lines that have finite vertices, at least one, all at once."""
    broken = np.bincount(flat.ring_row[flat.point_ring[~np.isfinite(flat.xy).all(axis=1)]], minlength=len(flat.kind)) > 0
    rings = np.flatnonzero(np.isin(flat.kind[flat.ring_row], (G.POINT, G.LINESTRING)) & (flat.ring_n > 0) & ~broken[flat.ring_row])
    if not len(rings):
        return {}
    n, row = flat.ring_n[rings], flat.ring_row[rings]
    own = np.repeat(row, n)
    at = place(flat.xy[W.spread((np.cumsum(flat.ring_n) - flat.ring_n)[rings], n)], z[own], x[own], y[own], extent)
    first = np.cumsum(n) - n
    steps = np.diff(at, axis=0, prepend=np.zeros((1, 2), np.int64))
    steps[first] = at[first]
    steps = steps << 1 ^ steps >> 63
    size = np.where(n > 1, 2 * n + 2, 3)
    begin = np.cumsum(size) - size
    values = np.zeros(int(size.sum()), np.int64)
    values[begin] = MOVE | 1 << 3
    more = n > 1
    values[begin[more] + 3] = LINE | (n[more] - 1) << 3
    turn = np.arange(len(at)) - np.repeat(first, n)
    where = np.repeat(begin, n) + 1 + 2 * turn + (turn > 0)
    values[where], values[where + 1] = steps[:, 0], steps[:, 1]
    data, ends = varuints(values)
    raw, stop = data.tobytes(), ends[begin + size - 1]
    return {r: raw[a:b] for r, a, b in zip(row.tolist(), np.concatenate([[0], stop[:-1]]).tolist(), stop.tolist(), strict=True)}


# --- layers


def value_message(v: Any, single: bool = False) -> bytes | None:
    """A value; None for what a tile has no form for. single: a 32-bit float."""
    if isinstance(v, bool | np.bool_):
        return varint_field(7, int(v))
    if isinstance(v, int | np.integer):
        return varint_field(4, int(v)) if v >= 0 else tag(6, 0) + varuint(zigzag(int(v)))
    if isinstance(v, float | np.floating):
        return tag(2, 5) + struct.pack("<f", v) if single else tag(3, 1) + struct.pack("<d", v)
    if isinstance(v, datetime | pd.Timestamp):
        ts = pd.Timestamp(v)
        ts = ts.tz_convert("UTC").tz_localize(None) if ts.tzinfo else ts
        return tag(3, 1) + struct.pack("<d", ts.value / 1000 / 86_400_000_000.0 + 25569.0)
    return string_field(1, v) if isinstance(v, str) else None


def feature_ends(kind: int, path: bytes, fid: int | None) -> tuple[bytes, bytes]:
    """What lies before a feature's attributes, and what lies behind them."""
    return varint_field(1, fid) if fid is not None and fid >= 0 else b"", varint_field(3, kind) + bytes_field(4, path)


class Layer:
    def __init__(self, name: str, z: int, x: int, y: int, extent: int = EXTENT, single: frozenset[str] = frozenset()):
        self.name, self.tile, self.extent, self.single = name, (z, x, y), extent, single
        self.features: list[bytes] = []
        self.keys: dict[str, int] = {}
        self.values: dict[bytes, int] = {}

    def add(self, g: G.Geometry | None, attributes: Iterable[tuple[str, Any]], fid: int | None = None) -> bool:
        """Adds a feature; False if it has nothing to show."""
        if g is None:
            return False
        kind, path = geometry_class(g), commands(g, *self.tile, self.extent)
        if not path:
            return False
        self.add_packed(*feature_ends(kind, packed(path), fid), attributes)
        return True

    def add_packed(self, head: bytes, tail: bytes, attributes: Iterable[tuple[str, Any]]) -> None:
        """Adds a feature of which all but the attributes is encoded (``feature_ends``)."""
        tags = []
        for key, v in attributes:
            body = None if v is None or v is pd.NaT else value_message(v, key in self.single)
            if body is not None:
                tags += [self.keys.setdefault(key, len(self.keys)), self.values.setdefault(body, len(self.values))]
        self.features.append(head + bytes_field(2, packed(tags)) + tail if tags else head + tail)

    def finish(self) -> bytes:
        parts = [string_field(1, self.name), *(bytes_field(2, f) for f in self.features), *(string_field(3, k) for k in self.keys), *(bytes_field(4, v) for v in self.values)]
        return b"".join(parts) + varint_field(5, self.extent) + varint_field(15, VERSION)


def tile_bytes(layers: Iterable[bytes]) -> bytes:
    return b"".join(bytes_field(3, x) for x in layers)


def compressed(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    return gzip.compress(data, level, mtime=0)


def decompressed(data: bytes) -> bytes:
    return gzip.decompress(data)


def decode(data: bytes) -> dict[str, dict]:
    """Layers of a tile: name, extent, and features with id, type, commands and properties. For tests and looking."""
    out = {}
    for name, extent, keys, values, raw in split(data):
        out[name] = {"extent": extent, "features": [{**feature(f), "properties": properties(f, keys, values)} for f in raw]}
    return out


def split(data: bytes) -> Iterable[tuple[str, int, list[str], list[Any], list[bytes]]]:
    """(name, extent, keys, values, features as they are encoded) of each layer of a tile."""
    for number, body in messages(data):
        if number != 3:
            continue
        name, extent, keys, values, raw = "", EXTENT, [], [], []
        for n, v in messages(body):
            if n == 2:
                raw.append(v)
            elif n == 1:
                name = v.decode()
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
        yield name, extent, keys, values, raw


def feature(f: bytes) -> dict[str, Any]:
    one = dict(messages(f))
    return {"id": one.get(1), "type": one.get(3, 0), "commands": _unpack(one.get(4, b""))}


def properties(f: bytes, keys: list[str], values: list[Any]) -> dict[str, Any]:
    tags = _unpack(dict(messages(f)).get(2, b"")) if keys else ()
    return {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}


def messages(data: bytes) -> Iterable[tuple[int, Any]]:
    """(number, value) of each field; numbers of one byte, as most are, without a cursor."""
    at, end = 0, len(data)

    def number(at: int) -> tuple[int, int]:
        if at < end and data[at] < 0x80:
            return data[at], at + 1
        c = Cursor(data, at)
        return c.varuint(), c.at

    while at < end:
        key, at = number(at)
        wire = key & 7
        if wire == 0:
            v, at = number(at)
        else:
            size, at = number(at) if wire == 2 else (8 if wire == 1 else 4, at)
            v = data[at : at + size] if at + size <= end else Cursor(data, at).take(size)
            at += size
        yield key >> 3, v


def _unpack(data: bytes) -> list[int]:
    if data.isascii():  # one byte each
        return list(data)
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 0x7F) << shift
        if b < 0x80:
            out.append(n)
            n = shift = 0
        else:
            shift += 7
    if shift or out and max(out) >> 64:
        raise Malformed("a number that is cut off or of more than 64 bits")
    return out


def _value(data: bytes) -> Any:
    number, v = next(iter(messages(data)))
    if number == 1:
        return v.decode()
    if number in (2, 3):
        return struct.unpack("<f" if number == 2 else "<d", v)[0]
    return -(v + 1) // 2 if number == 6 and v & 1 else v // 2 if number == 6 else bool(v) if number == 7 else v


# --- over frames


def tiles_of_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, z: int) -> Column:
    """array<struct<x, y>>: every tile of the level that an envelope touches."""
    level = F.lit(z)
    x0, y0 = tiles.tile_of(xmin, ymax, level)
    x1, y1 = tiles.tile_of(xmax, ymin, level)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def to_tiles(df: DataFrame, z: int, box: Column | None = None, geometry: str = "geometry") -> DataFrame:
    """Rows with z, x, y: one for each tile that the geometry's envelope touches."""
    from loamgrid.functions.geometry import st_bbox

    if {"z", "x", "y"} & set(df.columns):
        raise SchemaError("columns z, x or y are there already")
    e = box if box is not None else F.struct(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]) if {"xmin", "ymin", "xmax", "ymax"} <= set(df.columns) else st_bbox(F.col(geometry))
    with_box = df.withColumn("_e", e).where("_e is not null")
    each = with_box.withColumn("_t", F.explode(tiles_of_box(F.col("_e.xmin"), F.col("_e.ymin"), F.col("_e.xmax"), F.col("_e.ymax"), z)))
    return each.select(*[F.col(f"`{c}`") for c in df.columns], F.lit(z).alias("z"), F.col("_t.x").alias("x"), F.col("_t.y").alias("y"))


def encode(df: DataFrame, layer: str, geometry: str = "geometry", fid: str | None = "fid", extent: int = EXTENT, gzip_level: int | None = None) -> DataFrame:
    """(z, x, y, data, n_features) of rows with z, x, y: a tile with one layer for each place.

    Geometry and ids are encoded where the rows lie. Then rows are dealt and sorted by tile, and a task puts one tile
    after the other together: what it holds is one tile's message. A tile's features meet in one task, as they are
    one message.
    """
    attributes = [f for f in df.schema if f.name not in (geometry, fid, "z", "x", "y", "xmin", "ymin", "xmax", "ymax") and not isinstance(f.dataType, T.BinaryType)]
    single = frozenset(f.name for f in attributes if isinstance(f.dataType, T.FloatType))
    names = [f.name for f in attributes]
    has_id = fid is not None and fid in df.columns
    keep = df.select("z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(geometry).alias("_g"), *([F.col(fid).cast("long").alias("_id")] if has_id else []), *[F.col(f"`{n}`") for n in names])

    kind = {"z": pa.int32(), "x": pa.int64(), "y": pa.int64(), "data": pa.binary(), "n_features": pa.int64()}

    def finished(done: list[Layer]) -> pa.RecordBatch:
        rows = []
        for one in done:
            data = tile_bytes([one.finish()])
            rows.append((*one.tile, data if gzip_level is None else compressed(data, gzip_level), len(one.features)))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kind.values(), strict=True)], list(kind))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            ids, heads, tails, at = column("_id").to_pylist() if has_id else [None] * batch.num_rows, [], [], 0
            for part in W.slices(column("_g")):
                flat = W.Flat(part)
                own = [np.asarray(column(n).slice(at, len(part)).fill_null(0), np.int64) for n in "zxy"]
                paths = flat_paths(flat, *own, extent)
                for i in range(len(part)):
                    path, kind = paths.get(i), 1 if flat.kind[i] == G.POINT else 2
                    if path is None and flat.valid[i]:
                        g = G.from_wkb(flat.bytes_of(i))
                        kind, path = geometry_class(g), packed(commands(g, *(int(v[i]) for v in own), extent))
                    head, tail = feature_ends(kind, path, ids[at + i]) if path else (None, None)
                    heads.append(head)
                    tails.append(tail)
                at += len(part)
            yield pa.RecordBatch.from_arrays([*(column(n) for n in ("z", "x", "y")), pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), *(column(n) for n in names)], ["z", "x", "y", "_head", "_tail", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in batch.schema.names}
            rows = zip(*(columns[n] for n in names), strict=True) if names else [()] * batch.num_rows
            for z, x, y, head, tail, values in zip(columns["z"], columns["x"], columns["y"], columns["_head"], columns["_tail"], rows, strict=True):
                if out is None or out.tile != (z, x, y):
                    if out is not None:
                        done.append(out)
                    out = Layer(layer, z, x, y, extent, single)
                if tail is not None:
                    out.add_packed(head, tail, zip(names, values, strict=True))
                if len(done) >= 1000:
                    yield finished(done)
                    done = []
        if out is not None:
            yield finished([*done, out])

    keep = keep.withColumn("z", F.col("z").cast("int"))
    kinds = T.StructType([*(keep.schema[n] for n in ("z", "x", "y")), *(T.StructField(n, T.BinaryType()) for n in ("_head", "_tail")), *(keep.schema[n] for n in names)])
    placed = keep.mapInArrow(shaped, kinds).repartition("z", "x", "y").sortWithinPartitions("z", "x", "y")
    return placed.mapInArrow(run, "z int, x long, y long, data binary, n_features long")


def merge_layers(frames: list[DataFrame]) -> DataFrame:
    """Tiles of several layers, in the order given, as one tile for each place. Layers must not be compressed."""
    each = None
    for k, df in enumerate(frames):
        one = df.select("z", "x", "y", F.lit(k).alias("k"), "data")
        each = one if each is None else each.unionByName(one)
    joined = F.array_sort(F.collect_list(F.struct("k", "data")))
    return each.groupBy("z", "x", "y").agg(joined.alias("d")).select("z", "x", "y", F.expr("aggregate(d, cast('' as binary), (t, e) -> concat(t, e.data))").alias("data"))
