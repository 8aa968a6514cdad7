"""PMTiles archives, version 3: one file of tiles under a two-level directory of tile ids.

Reading: the directories are the index, and ranges of entries are the partitions; a filter on z, x and y for
one tile reads that tile only. Writing: tiles are sorted, compared by content and given offsets by
Spark; the driver streams contents and directory entries to the file in order, so that it never holds
more than a leaf of entries, the directories' bytes and one tile.
"""

import gzip
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from loamgrid.core.errors import PmTilesError, TileError, Unsupported
from loamgrid.functions.index import tile_id as tile_id_column
from loamgrid.sources.binary import Cursor, varuint
from loamgrid.sources.files import local_path, read_bytes, scratch

HEADER = 127
#: Codes of compressions and tile types.
COMPRESSIONS = {0: "unknown", 1: "none", 2: "gzip", 3: "brotli", 4: "zstd"}
TILE_TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif"}
LEAF_THRESHOLD, LEAF_SIZE = 16_384, 4_096
BOUNDS = (-180.0, -85.0, 180.0, 85.0)
ENTRIES = 20_000  #: of a partition
_FIELDS = "root_at root_n meta_at meta_n leaves_at leaves_n data_at data_n addressed entries contents clustered internal tile_compression tile_type min_zoom max_zoom west south east north center_zoom center_lng center_lat".split()
_LAYOUT = "<11QBBBBBBiiiiBii"


class Entry(NamedTuple):
    tile_id: int
    run: int  #: 0 for a pointer to a leaf
    length: int
    offset: int


def parse_header(data: bytes) -> dict:
    if len(data) < HEADER:
        raise PmTilesError("the header has 127 bytes")
    if data[:7] != b"PMTiles":
        raise PmTilesError("no tile archive")
    if data[7] != 3:
        raise PmTilesError(f"version {data[7]}")
    out = dict(zip(_FIELDS, struct.unpack_from(_LAYOUT, data, 8), strict=True))
    return out | {"internal": COMPRESSIONS.get(out["internal"], "unknown"), "tile_compression": COMPRESSIONS.get(out["tile_compression"], "unknown"), "tile_type": TILE_TYPES.get(out["tile_type"], "unknown"), "clustered": bool(out["clustered"])}


def header_bytes(h: dict) -> bytes:
    code = lambda table, name: next(k for k, v in table.items() if v == name)
    own = h | {"internal": code(COMPRESSIONS, h["internal"]), "tile_compression": code(COMPRESSIONS, h["tile_compression"]), "tile_type": code(TILE_TYPES, h["tile_type"]), "clustered": int(h["clustered"])}
    return b"PMTiles\x03" + struct.pack(_LAYOUT, *(own[k] for k in _FIELDS))


def compress(data: bytes, how: str) -> bytes:
    if how == "none":
        return data
    if how == "gzip":
        return gzip.compress(data, mtime=0)
    raise Unsupported(f"compression {how}")


def decompress(data: bytes, how: str) -> bytes:
    if how in ("none", "unknown"):
        return data
    if how == "gzip":
        return gzip.decompress(data)
    raise Unsupported(f"compression {how}")


def encode_directory(entries: list[Entry]) -> bytes:
    """Column after column: id steps, runs, lengths, offsets (0 for what follows on)."""
    out, last = [varuint(len(entries))], 0
    for e in entries:
        out.append(varuint(e.tile_id - last))
        last = e.tile_id
    out += [varuint(e.run) for e in entries]
    out += [varuint(e.length) for e in entries]
    for i, e in enumerate(entries):
        follows = i and e.offset == entries[i - 1].offset + entries[i - 1].length
        out.append(varuint(0 if follows else e.offset + 1))
    return b"".join(out)


def decode_directory(data: bytes) -> list[Entry]:
    c = Cursor(data, error=PmTilesError)
    n = c.varuint()
    if n > len(data):
        raise PmTilesError(f"a directory of {n} entries in {len(data)} bytes")
    ids, last = [], 0
    for _ in range(n):
        last += c.varuint()
        ids.append(last)
    runs, lengths = [c.varuint() for _ in range(n)], [c.varuint() for _ in range(n)]
    out: list[Entry] = []
    for i in range(n):
        v = c.varuint()
        if not v and not i:
            raise PmTilesError("the first offset follows nothing")
        out.append(Entry(ids[i], runs[i], lengths[i], v - 1 if v else out[-1].offset + out[-1].length))
    return out


def find(entries: list[Entry], tile_id: int) -> Entry | None:
    """The entry whose run covers the tile, or the leaf that may have it."""
    low, high = 0, len(entries)
    while low < high:
        mid = (low + high) // 2
        if entries[mid].tile_id <= tile_id:
            low = mid + 1
        else:
            high = mid
    if not low:
        return None
    e = entries[low - 1]
    return e if not e.run or tile_id < e.tile_id + e.run else None


def tile_id(z: int, x: int, y: int) -> int:
    """Tiles of lower levels, then the place on the Hilbert curve."""
    if not 0 <= z <= 31 or not 0 <= x < 1 << z or not 0 <= y < 1 << z:
        raise TileError(f"no tile {z}/{x}/{y}")
    d = 0
    for k in range(z - 1, -1, -1):
        cell = 1 << k
        rx, ry = int(x & cell > 0), int(y & cell > 0)
        d += cell * cell * (3 * rx ^ ry)
        x, y = x & cell - 1, y & cell - 1
        if not ry:
            if rx:
                x, y = cell - 1 - x, cell - 1 - y
            x, y = y, x
    return ((1 << 2 * z) - 1) // 3 + d


def tile_of(i: int) -> tuple[int, int, int]:
    z = 0
    while ((1 << 2 * (z + 1)) - 1) // 3 <= i:
        z += 1
    t, x, y = i - ((1 << 2 * z) - 1) // 3, 0, 0
    for k in range(z):
        cell = 1 << k
        rx = t >> 1 & 1
        ry = (t ^ rx) & 1
        if not ry:
            if rx:
                x, y = cell - 1 - x, cell - 1 - y
            x, y = y, x
        x, y, t = x + cell * rx, y + cell * ry, t >> 2
    return z, x, y


class Archive:
    """Lookups in an archive; leaves are kept as they are read."""

    def __init__(self, path: str):
        self.path = path
        self.header = parse_header(read_bytes(path, 0, HEADER))
        self.root = self._directory(self.header["root_at"], self.header["root_n"])
        self.leaves: dict[int, list[Entry]] = {}

    def _directory(self, at: int, n: int) -> list[Entry]:
        return decode_directory(decompress(read_bytes(self.path, at, n), self.header["internal"]))

    def leaf(self, e: Entry) -> list[Entry]:
        if e.offset not in self.leaves:
            found = self._directory(self.header["leaves_at"] + e.offset, e.length)
            if any(not x.run for x in found):
                raise Unsupported("leaves below leaves")
            self.leaves[e.offset] = found
        return self.leaves[e.offset]

    def metadata(self) -> bytes:
        return decompress(read_bytes(self.path, self.header["meta_at"], self.header["meta_n"]), self.header["internal"])

    def raw(self, e: Entry) -> bytes:
        return read_bytes(self.path, self.header["data_at"] + e.offset, e.length)

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        """A tile, decompressed; None if the archive has none there."""
        i = tile_id(z, x, y)
        e = find(self.root, i)
        if e and not e.run:
            e = find(self.leaf(e), i)
        return decompress(self.raw(e), self.header["tile_compression"]) if e else None

    def entries(self) -> Iterator[Entry]:
        for e in self.root:
            yield from [e] if e.run else self.leaf(e)


SCHEMA = "tile_id long, z int, x long, y long, data binary"


class PmTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loamgrid_pmtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("decompress", "true") == "true")


@dataclass
class _Entries(InputPartition):
    root: list[Entry]  #: tiles, or pointers to leaves


class _Reader(DataSourceReader):
    def __init__(self, path: str, decompressed: bool):
        self.path, self.decompressed, self.only = path, decompressed, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("z",), ("x",), ("y",), ("tile_id",)):
                self.only[f.attribute[0]] = f.value
            yield f

    def wanted(self) -> int | None:
        if "tile_id" in self.only:
            return self.only["tile_id"]
        return tile_id(self.only["z"], self.only["x"], self.only["y"]) if {"z", "x", "y"} <= set(self.only) else None

    def partitions(self) -> list[InputPartition]:
        archive, i = Archive(self.path), self.wanted()
        if i is not None:
            e = find(archive.root, i)
            return [_Entries([e] if e else [])]
        step = max(1, ENTRIES // (LEAF_SIZE if any(not e.run for e in archive.root) else 1))
        return [_Entries(archive.root[a : a + step]) for a in range(0, len(archive.root), step)] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        archive, i = Archive(self.path), self.wanted()
        for top in partition.root:
            for e in [top] if top.run else archive.leaf(top):
                if i is not None and not e.tile_id <= i < e.tile_id + e.run:
                    continue
                data = archive.raw(e)
                data = decompress(data, archive.header["tile_compression"]) if self.decompressed else data
                for k in range(e.run):
                    yield (e.tile_id + k, *tile_of(e.tile_id + k), data)


def read(spark: SparkSession, path: str, decompressed: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PmTilesSource)
    return spark.read.format("loamgrid_pmtiles").option("path", path).option("decompress", str(decompressed).lower()).load()


def latest(tiles: DataFrame, order: str | None = None) -> DataFrame:
    """(tile_id, z, data): one row for each tile; the last by ``order`` wins."""
    own = tiles.select(tile_id_column(F.col("z").cast("int"), F.col("x"), F.col("y")).alias("tile_id"), F.col("z").cast("int").alias("z"), "data", (F.col(order) if order else F.monotonically_increasing_id()).alias("seq"))
    bad = F.assert_true(F.col("tile_id").isNotNull(), F.lit("a tile outside its level"))
    return own.withColumn("_ok", bad).groupBy("tile_id").agg(F.max_by("z", "seq").alias("z"), F.max_by("data", "seq").alias("data"))


def with_offsets(contents: DataFrame, first: str = "first", length: str = "length") -> DataFrame:
    """Rows with the column ``offset``: the sum of the lengths before them, in the order of ``first``.

    Sums of ranges are added up on the driver, one number for each range; inside a range a window does it.
    """
    spark = contents.sparkSession
    path = scratch(spark, "contents")
    contents.repartitionByRange(F.col(first)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    total, starts = 0, []
    for r in ranges.groupBy("_range").agg(F.sum(length).alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], total))
        total += r["n"]
    before = F.sum(length).over(Window.partitionBy("_range").orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    start = spark.createDataFrame(starts, "_range int, _start long")
    return ranges.join(start, "_range").withColumn("offset", F.col("_start") + F.coalesce(before, F.lit(0))).drop("_range", "_start")


def write(tiles: DataFrame, path: str, order: str | None = None, tile_compression: str = "gzip", internal: str = "gzip", tile_type: str = "mvt", metadata: dict | bytes = b"{}", min_zoom: int | None = None, max_zoom: int | None = None, bounds: tuple = BOUNDS, center: tuple | None = None, leaf_threshold: int = LEAF_THRESHOLD, leaf_size: int = LEAF_SIZE, compressed: bool = False) -> dict:
    """Writes (z, x, y, data) rows; returns the header. compressed: the data are so already."""
    target = local_path(path)
    if target is None:
        raise Unsupported("an archive is one file on a local or mounted path")
    spark = tiles.sparkSession
    if not compressed and tile_compression != "none":
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda d: compress(bytes(d), tile_compression), na_action="ignore")

        squeeze = F.pandas_udf(run, T.BinaryType())
        packed = tiles.withColumn("data", squeeze("data"))
    else:
        packed = tiles
    where = scratch(spark, "tiles")
    latest(packed, order).withColumn("h", F.sha2("data", 256)).write.parquet(where)
    own = spark.read.parquet(where)
    contents = with_offsets(own.groupBy("h").agg(F.min("tile_id").alias("first"), F.first(F.length("data")).cast("long").alias("length")))
    placed = scratch(spark, "placed")
    contents.write.parquet(placed)
    contents = spark.read.parquet(placed)
    zooms = own.agg(F.min("z"), F.max("z")).first()
    if zooms[0] is None:
        raise PmTilesError("no tiles")
    low, high = zooms[0] if min_zoom is None else min_zoom, zooms[1] if max_zoom is None else max_zoom
    rows = own.join(contents.select("h", "offset", "length"), "h").select("tile_id", "offset", "length").orderBy("tile_id")
    root, leaves, n_entries, addressed = _directories(rows, leaf_threshold, leaf_size, internal)
    meta = compress(metadata if isinstance(metadata, bytes) else json.dumps(metadata).encode(), internal)
    root_bytes = compress(encode_directory(root), internal)
    sums = contents.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    west, south, east, north = bounds
    mid = center or ((west + east) / 2, (south + north) / 2, low)
    e7 = lambda v: max(-(1 << 31), min((1 << 31) - 1, int(abs(v) * 1e7 + 0.5) * (1 if v >= 0 else -1)))
    at = [HEADER, HEADER + len(root_bytes), HEADER + len(root_bytes) + len(meta)]
    h = dict(zip(_FIELDS, (at[0], len(root_bytes), at[1], len(meta), at[2], len(leaves), at[2] + len(leaves), sums["bytes"], addressed, n_entries, sums["n"], True, internal, tile_compression, tile_type, low, high, e7(west), e7(south), e7(east), e7(north), mid[2], e7(mid[0]), e7(mid[1])), strict=True))
    data = own.join(contents.select("h", "first", "offset"), (own["h"] == contents["h"]) & (own["tile_id"] == contents["first"])).select("offset", "data").orderBy("offset")
    with open(f"{target}.part", "wb") as out:
        out.write(header_bytes(h) + root_bytes + meta + leaves)
        for r in data.toLocalIterator():
            out.write(r["data"])
    os.replace(f"{target}.part", target)
    return h


def merged(rows: Iterator) -> Iterator[Entry]:
    """Neighbouring tiles of the same content as one entry. rows: (tile_id, offset, length), sorted."""
    last = None
    for r in rows:
        if last and last.tile_id + last.run == r["tile_id"] and (last.offset, last.length) == (r["offset"], r["length"]):
            last = last._replace(run=last.run + 1)
        else:
            if last:
                yield last
            last = Entry(r["tile_id"], 1, r["length"], r["offset"])
    if last:
        yield last


def _directories(rows: DataFrame, threshold: int, size: int, internal: str) -> tuple[list[Entry], bytes, int, int]:
    """(root, leaves, entries, tiles); a root alone up to the threshold."""
    held: list[Entry] = []
    leaves, root, n, tiles, split = bytearray(), [], 0, 0, False

    def leaf() -> None:
        packed = compress(encode_directory(held[:size]), internal)
        root.append(Entry(held[0].tile_id, 0, len(packed), len(leaves)))
        leaves.extend(packed)
        del held[:size]

    for e in merged(rows.toLocalIterator()):
        held.append(e)
        n, tiles = n + 1, tiles + e.run
        split = split or len(held) > threshold
        while split and len(held) > size:
            leaf()
    if not split:
        return held, b"", n, tiles
    while held:
        leaf()
    return root, bytes(leaves), n, tiles
