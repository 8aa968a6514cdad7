"""GeoTIFF: tiled or stripped files as rows of tiles, and tiled files from them.

A tile is (level, x, y, width, height, affine, bands); bands hold their bytes little-endian. Partitions are
ranges of a file's tiles. Classic and big files of either byte order; no compression, PackBits, LZW and
DEFLATE; horizontal differencing; chunky and planar layout. Edge tiles keep the full tile size.
"""

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamgrid.core.errors import TiffError, Unsupported
from loamgrid.functions.affine import FIELDS
from loamgrid.sources.files import local_path, open_file, scratch

#: Tags, value types and codes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, SUBFILE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 254
PIXEL_SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CODECS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
KINDS = {(1, 8): "U8", (1, 16): "U16", (1, 32): "U32", (2, 8): "I8", (2, 16): "I16", (2, 32): "I32", (3, 32): "F32", (3, 64): "F64"}
DTYPES = {"U8": "u1", "U16": "u2", "U32": "u4", "I8": "i1", "I16": "i2", "I32": "i4", "F32": "f4", "F64": "f8", "Rgb8": "u1", "Rgba8": "u1"}
PROJECTED_KEY, GEOGRAPHIC_KEY, MODEL_KEY, RASTER_KEY = 3072, 2048, 1024, 1025
GEOGRAPHIC = frozenset((4326, 7844, 4283, 4269, 4267, 4258, 4979, 4937))
TILES = 256  #: of a partition
BAND = T.StructType([T.StructField(n, k) for n, k in (("name", T.StringType()), ("dtype", T.StringType()), ("nodata", T.DoubleType()), ("unit", T.StringType()), ("scale", T.DoubleType()), ("offset", T.DoubleType()), ("data", T.BinaryType()))])
AFFINE = T.StructType([T.StructField(n, T.DoubleType()) for n in FIELDS])
SCHEMA = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("affine", AFFINE), T.StructField("bands", T.ArrayType(BAND)), T.StructField("epsg", T.IntegerType())])


# --- codecs


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while at + run < n and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """Codes from the highest bit on, 9 to 12 wide, one code earlier than the table would need."""
    out, table, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    bits = held = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise TiffError(f"LZW code {code}")
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, size, width = {bytes([i]): i for i in range(256)}, 258, 9

    def emit(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    emit(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        emit(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            emit(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = data[i : i + 1]
    if word:
        emit(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    emit(257)
    if bits:
        out.append(held << 8 - bits & 0xFF)
    return bytes(out)


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data)
    return {"none": bytes, "packbits": unpackbits, "lzw": unlzw}[codec](data)


def compress(data: bytes, codec: str, level: int = 6) -> bytes:
    if codec == "deflate":
        return zlib.compress(data, level)
    return {"none": bytes, "packbits": packbits, "lzw": lzw}[codec](data)


# --- reading


@dataclass
class Level:
    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, default: Any = None) -> Any:
        found = self.tags.get(tag)
        return found[0] if found else default

    @property
    def tiled(self) -> bool:
        return TILE_WIDTH in self.tags

    @property
    def size(self) -> tuple[int, int]:
        return self.one(WIDTH), self.one(HEIGHT)

    @property
    def tile(self) -> tuple[int, int]:
        return (self.one(TILE_WIDTH), self.one(TILE_HEIGHT)) if self.tiled else (self.one(WIDTH), min(self.one(STRIP_ROWS, self.one(HEIGHT)), self.one(HEIGHT)))

    @property
    def grid(self) -> tuple[int, int]:
        (w, h), (a, b) = self.size, self.tile
        return -(-w // a), -(-h // b)

    @property
    def kinds(self) -> list[str]:
        n = self.one(SAMPLES, 1)
        bits = self.tags.get(BITS, (1,)) * n
        formats = self.tags.get(SAMPLE_FORMAT, (1,)) * n
        try:
            return [KINDS[1 if f == 4 else f, b] for f, b in zip(formats[:n], bits[:n], strict=True)]
        except KeyError as e:
            raise Unsupported(f"samples of format and bits {e}") from e


class Tiff:
    """The directories of a file, read without its pixels."""

    def __init__(self, path: str):
        self.path = path
        with open_file(path) as f:
            head = f.read(16)
            if head[:2] not in (b"II", b"MM"):
                raise TiffError("no TIFF")
            self.order = "<" if head[:2] == b"II" else ">"
            version = struct.unpack(self.order + "H", head[2:4])[0]
            if version not in (42, 43):
                raise TiffError(f"version {version}")
            self.big = version == 43
            at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
            self.levels: list[Level] = []
            seen = set()
            while at:
                if at in seen:
                    raise TiffError("directories go round in a circle")
                seen.add(at)
                tags, at = self._directory(f, at)
                self.levels.append(Level(tags, self.order))
        if not self.levels:
            raise TiffError("no image")

    def _directory(self, f, at: int) -> tuple[dict[int, tuple], int]:
        o, big = self.order, self.big
        f.seek(at)
        n = struct.unpack(o + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        raw = f.read(n * size + (8 if big else 4))
        if n > 4096 or len(raw) < n * size + (8 if big else 4):
            raise TiffError("a directory is cut")
        tags = {}
        for i in range(n):
            entry = raw[i * size : i * size + size]
            tag, kind = struct.unpack(o + "HH", entry[:4])
            count = struct.unpack(o + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
            code = TYPES.get(kind)
            if code is None:
                continue
            length, inline = struct.calcsize("<" + code) * count, entry[12:] if big else entry[8:]
            if length > len(inline):
                f.seek(struct.unpack(o + ("Q" if big else "I"), inline)[0])
                inline = f.read(length)
            if len(inline) < length:
                raise TiffError(f"values of tag {tag} are cut")
            tags[tag] = (inline[:length].rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{o}{count * len(code)}{code[0]}", inline[:length])
        return tags, struct.unpack(o + ("Q" if big else "I"), raw[n * size :])[0]

    @property
    def epsg(self) -> int | None:
        """The projected key before the geographic; 0 and 32767 say nothing."""
        raw = self.levels[0].tags.get(GEOKEYS, ())
        keys = {raw[i]: raw[i + 3] for i in range(4, len(raw) - 3, 4) if raw[i + 1] == 0}
        return next((keys[k] for k in (PROJECTED_KEY, GEOGRAPHIC_KEY) if keys.get(k) not in (None, 0, 32767)), None)

    def affine(self, level: int = 0) -> tuple[float, ...] | None:
        """The transform of a level: tie point and pixel size, or a matrix; those of lower levels are scaled."""
        base = self.levels[0]
        scale, tie, matrix = base.tags.get(PIXEL_SCALE), base.tags.get(TIEPOINT), base.tags.get(MATRIX)
        if matrix and len(matrix) >= 8:
            out = (matrix[3], matrix[0], matrix[1], matrix[7], matrix[4], matrix[5])
        elif scale and tie and len(tie) >= 6:
            out = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])
        else:
            return None
        (w, h), (a, b) = base.size, self.levels[level].size
        return out[0], out[1] * w / a, out[2] * h / b, out[3], out[4] * w / a, out[5] * h / b

    @property
    def nodata(self) -> float | None:
        try:
            return float(self.levels[0].one(NODATA, ""))
        except ValueError:
            return None

    def tile(self, f, level: int, x: int, y: int) -> list[np.ndarray]:
        """The bands of a tile, each of the full tile size."""
        lv = self.levels[level]
        kinds, (w, h), (across, down) = lv.kinds, lv.tile, lv.grid
        if not 0 <= x < across or not 0 <= y < down:
            raise TiffError(f"no tile {level}/{x}/{y}")
        if len(set(kinds)) > 1:
            raise Unsupported("bands of different types")
        codec = CODECS.get(lv.one(COMPRESSION, 1))
        if codec is None:
            raise Unsupported(f"compression {lv.one(COMPRESSION)}")
        at, sizes = (lv.tags.get(TILE_AT), lv.tags.get(TILE_BYTES)) if lv.tiled else (lv.tags.get(STRIP_AT), lv.tags.get(STRIP_BYTES))
        if not at or not sizes:
            raise TiffError("no offsets")
        planar, n, dtype = lv.one(PLANAR, 1) == 2, len(kinds), np.dtype(DTYPES[kinds[0]]).newbyteorder(self.order)
        parts = []
        for plane in range(n if planar else 1):
            k = plane * across * down + y * across + x
            if not sizes[k]:
                parts.append(np.zeros((h, w, 1 if planar else n), dtype.newbyteorder("<")))
                continue
            f.seek(at[k])
            raw = decompress(f.read(sizes[k]), codec)
            per = 1 if planar else n
            want = h * w * per * dtype.itemsize
            if len(raw) < want and lv.tiled:
                raise TiffError(f"a tile of {len(raw)} bytes, {want} wanted")
            pixels = np.frombuffer(raw[:want].ljust(want, b"\0"), dtype).reshape(h, w, per).astype(dtype.newbyteorder("<"))
            predictor = lv.one(PREDICTOR, 1)
            if predictor == 2:
                pixels = np.cumsum(pixels, axis=1, dtype=pixels.dtype)
            elif predictor != 1:
                raise Unsupported(f"predictor {predictor}")
            parts.append(pixels)
        return [p[:, :, 0] for p in parts] if planar else [parts[0][:, :, b] for b in range(n)]


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loamgrid_geotiff"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("tiles", TILES)))


@dataclass
class _Tiles(InputPartition):
    level: int
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, tiles: int):
        self.path, self.tiles = path, tiles

    def partitions(self) -> list[InputPartition]:
        out = []
        for k, lv in enumerate(Tiff(self.path).levels):
            n = lv.grid[0] * lv.grid[1]
            out += [_Tiles(k, a, min(n, a + self.tiles)) for a in range(0, n, self.tiles)]
        return out

    def read(self, partition: _Tiles) -> Iterator[tuple]:
        tiff, k = Tiff(self.path), partition.level
        lv = tiff.levels[k]
        (w, h), across, base = lv.tile, lv.grid[0], tiff.affine(k)
        with open_file(self.path) as f:
            for i in range(partition.low, partition.high):
                x, y = i % across, i // across
                own = None if base is None else (base[0] + x * w * base[1] + y * h * base[2], base[1], base[2], base[3] + x * w * base[4] + y * h * base[5], base[4], base[5])
                bands = [(f"band_{b + 1}", kind, tiff.nodata, None, None, None, np.ascontiguousarray(p).tobytes()) for b, (kind, p) in enumerate(zip(lv.kinds, tiff.tile(f, k, x, y), strict=True))]
                yield (k, x, y, w, h, own, bands, tiff.epsg)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of all levels. A filter on level and place keeps what is read by a task small, not what is opened."""
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("loamgrid_geotiff").option("path", path).load()


def profile(path: str) -> dict:
    """What a raster's schema says: size, tiles, levels, bands, transform and system."""
    t = Tiff(path)
    lv = t.levels[0]
    return {"width": lv.size[0], "height": lv.size[1], "tile_width": lv.tile[0], "tile_height": lv.tile[1], "levels": len(t.levels), "bands": [{"dtype": k, "nodata": t.nodata} for k in lv.kinds], "affine": t.affine(), "epsg": t.epsg}


# --- writing


class _Part(NamedTuple):
    level: int
    x: int
    y: int
    data: bytes


def write(tiles: DataFrame, path: str, sizes: dict[int, tuple[int, int]] | None = None, codec: str = "deflate", level: int = 6, epsg: int | None = None, big: bool | None = None) -> None:
    """Tiles of one or more levels as one little-endian file. Of tiles given for one place the one whose bytes come first stays.

    Tasks encode the tiles; the driver streams them to the file in order and then writes the directories.
    sizes: width and height of each level; without them, whole tiles. big: 64-bit offsets; by default where 32 bits do not reach.
    """
    target = local_path(path)
    if target is None:
        raise Unsupported("a raster is one file on a local or mounted path")
    spark = tiles.sparkSession

    def one(kinds: Any, datas: Any, width: int, height: int) -> bytes:
        planes = [np.frombuffer(bytes(d), np.dtype(DTYPES[k]).newbyteorder("<")).reshape(height, width) for k, d in zip(kinds, datas, strict=True)]
        return compress(np.ascontiguousarray(np.stack(planes, axis=-1)).tobytes(), codec, level)

    def encode(kinds: pd.Series, datas: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(kinds, datas, width, height, strict=True)], dtype=object)

    packed = F.pandas_udf(encode, T.BinaryType())
    own = tiles.select("level", "x", "y", "width", "height", "affine", F.transform("bands", lambda b: b["dtype"]).alias("kinds"), F.get("bands", F.lit(0))["nodata"].alias("nodata"), packed(F.transform("bands", lambda b: b["dtype"]), F.transform("bands", lambda b: b["data"]), "width", "height").alias("data"), *(["epsg"] if "epsg" in tiles.columns else []))
    where = scratch(spark, "tiff")
    order = F.row_number().over(Window.partitionBy("level", "x", "y").orderBy("data"))
    own.withColumn("_r", order).where("_r = 1").drop("_r").write.parquet(where)
    rows = spark.read.parquet(where)
    about = rows.groupBy("level").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("width").alias("w"), F.max("height").alias("h"), F.first("kinds").alias("kinds"), F.first("nodata").alias("nodata"), F.min_by("affine", F.struct("y", "x")).alias("affine"), *([F.max("epsg").alias("epsg")] if "epsg" in rows.columns else [])).orderBy("level").collect()
    if not about:
        raise TiffError("no tiles")
    code = epsg or (about[0]["epsg"] if "epsg" in rows.columns else None)
    if big is None:
        total = rows.agg(F.sum(F.length("data").cast("long")), F.count(F.lit(1))).first()
        big = total[0] + 64 * total[1] + (1 << 20) >= 1 << 32
    at, places = 16 if big else 8, {}
    with open(f"{target}.part", "wb") as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else b"II*\0" + bytes(4))
        for r in rows.select("level", "x", "y", "data").orderBy("level", "y", "x").toLocalIterator():
            places[r["level"], r["x"], r["y"]] = at, len(r["data"])
            out.write(r["data"])
            at += len(r["data"])
        link = 8 if big else 4
        for a in about:
            out.write(bytes(at % 2))
            at += at % 2
            blob, next_at = directory(a, places, (sizes or {}).get(a["level"]), at, codec, code if a["level"] == about[0]["level"] else None, big)
            out.seek(link)
            out.write(struct.pack("<Q" if big else "<I", at))
            out.seek(at)
            out.write(blob)
            link, at = next_at, at + len(blob)
    os.replace(f"{target}.part", target)


def directory(a: Any, places: dict, size: tuple[int, int] | None, at: int, codec: str, epsg: int | None, big: bool = False) -> tuple[bytes, int]:
    """A level's directory with its values behind it, and where the link to the next one is."""
    across, down, kinds = a["x"] + 1, a["y"] + 1, a["kinds"]
    width, height = size or (across * a["w"], down * a["h"])
    found = [places.get((a["level"], x, y), (0, 0)) for y in range(down) for x in range(across)]
    formats = {"U": 1, "I": 2, "F": 3}
    tags: list[tuple[int, str, tuple]] = [
        (SUBFILE, "I", (1 if a["level"] else 0,)), (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", tuple(8 * np.dtype(DTYPES[k]).itemsize for k in kinds)), (COMPRESSION, "H", ({"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}[codec],)),
        (PHOTOMETRIC, "H", (2 if len(kinds) == 3 and set(kinds) == {"U8"} else 1,)), (SAMPLES, "H", (len(kinds),)), (PLANAR, "H", (1,)), (TILE_WIDTH, "I", (a["w"],)), (TILE_HEIGHT, "I", (a["h"],)), (TILE_AT, "Q" if big else "I", tuple(p for p, _ in found)), (TILE_BYTES, "I", tuple(n for _, n in found)), (SAMPLE_FORMAT, "H", tuple(formats[k[0]] for k in kinds)),
    ]
    t = a["affine"]
    if t is not None and not a["level"]:
        if t["rx"] or t["ry"]:
            tags.append((MATRIX, "d", (t["pw"], t["rx"], 0.0, t["ox"], t["ry"], t["ph"], 0.0, t["oy"], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
        else:
            tags += [(PIXEL_SCALE, "d", (t["pw"], -t["ph"], 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, t["ox"], t["oy"], 0.0))]
    if epsg:
        geographic = epsg in GEOGRAPHIC
        tags.append((GEOKEYS, "H", (1, 1, 0, 3, MODEL_KEY, 0, 1, 2 if geographic else 1, RASTER_KEY, 0, 1, 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, epsg)))
    if a["nodata"] is not None:
        tags.append((NODATA, "s", (f"{a['nodata']:g}",)))
    tags.sort()
    number, room, entry = ("<Q", 8, "<HHQ") if big else ("<H", 4, "<HHI")
    body, behind = [struct.pack(number, len(tags))], b""
    base = at + struct.calcsize(number) + (struct.calcsize(entry) + room) * len(tags) + room
    for tag, code, values in tags:
        raw = values[0].encode() + b"\0" if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        kind = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}[code]
        count = len(raw) if code == "s" else len(values)
        if len(raw) <= room:
            body.append(struct.pack(entry, tag, kind, count) + raw.ljust(room, b"\0"))
        else:
            body.append(struct.pack(entry + ("Q" if big else "I"), tag, kind, count, base + len(behind)))
            behind += raw + bytes(len(raw) % 2)
    return b"".join(body) + bytes(room) + behind, base - room
