"""End-to-end jobs: convert, reproject, filter, optimize, inspect, metadata, profile."""

import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamgrid.core.errors import ConvertError, Unsupported
from loamgrid.functions import crs as C
from loamgrid.functions.geometry import st_bbox, st_transform
from loamgrid.functions.measure import BOX
from loamgrid.functions.values import type_name
from loamgrid.operators import profile as P
from loamgrid.operators import raster as R
from loamgrid.sources import filegdb, geojson, geoparquet, geotiff, images, pmtiles, shapefile
from loamgrid.sources.files import format_of, local_path, modality, write_text

VERSION, SPEC_VERSION = "0.1.0", 1
TILE = 256


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A vector layer of any format."""
    fmt = format_of(path)
    if modality(fmt) == "raster":
        raise ConvertError(f"{path} is a raster")
    if fmt == "filegdb":
        return filegdb.read(spark, path, layer)
    return {"geoparquet": geoparquet.read, "geojson": geojson.read, "shapefile": shapefile.read, "pmtiles": pmtiles.read}[fmt](spark, path)


def read_raster(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """A raster's tiles; epsg only for images, which do not say."""
    fmt = format_of(path)
    if fmt == "image":
        return images.read(spark, path, epsg)
    if fmt != "geotiff":
        raise ConvertError(f"{path} is no raster")
    return geotiff.read(spark, path)


def layers(path: str) -> list[str]:
    return list(filegdb.layers(path)) if format_of(path) == "filegdb" else ["default"]


def feature_count(spark: SparkSession, path: str, layer: str | None = None) -> int | None:
    """What a source says of its number of features without being read; None where it does not say."""
    fmt = format_of(path)
    if fmt == "filegdb":
        return filegdb.table_header(filegdb.table_path(path, filegdb.pick(path, layer)[1])).rows
    if fmt == "shapefile":
        return len(shapefile.index(shapefile.read_bytes(shapefile.sibling(path, "shx"))))
    return None


@dataclass
class RasterLayer:
    """A raster file by its contract: what it is, its levels, and single tiles."""

    spark: SparkSession
    path: str

    def profile(self) -> dict:
        return geotiff.profile(self.path)

    def pyramid_levels(self) -> int:
        return self.profile()["levels"]

    def read_tile(self, level: int, x: int, y: int) -> Any:
        """One tile; None where there is none. Only the tiles of one partition are read for it."""
        return read_raster(self.spark, self.path).where((F.col("level") == level) & (F.col("x") == x) & (F.col("y") == y)).first()


class Progress:
    """Calls ``tell(done, all)`` with the tasks of the stages that run, every so many seconds, while a block runs; once more at its end."""

    def __init__(self, spark: SparkSession, tell: Callable[[int, int], None] | None, every: float = 2.0):
        self.tracker, self.tell, self.every, self.ended = spark.sparkContext.statusTracker(), tell, every, threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _now(self) -> tuple[int, int]:
        found = [i for i in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if i]
        return sum(i.numCompletedTasks for i in found), sum(i.numTasks for i in found)

    def _watch(self) -> None:
        while not self.ended.wait(self.every):
            self.tell(*self._now())

    def __enter__(self) -> "Progress":
        if self.tell:
            self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.ended.set()
        if self.tell:
            self.thread.join()
            self.tell(*self._now())


def reprojected(df: DataFrame, to_crs: int | str) -> DataFrame:
    """The layer in another system. Its own comes from its metadata, WKT included."""
    name = P.geometry_of(df)
    if name is None:
        raise ConvertError("no geometry to reproject")
    meta = df.schema[name].metadata
    source, target = meta.get("epsg"), C.parse_crs(to_crs)
    if source is None:
        raise ConvertError(f"the layer's system is not known: {meta.get('crs')}")
    own = df.drop(*BOX) if set(BOX) <= set(df.columns) else df
    return own.withColumn(name, st_transform(F.col(f"`{name}`"), source, target)).withMetadata(name, meta | C.metadata(target))


def write_layer(df: DataFrame, path: str, **options: Any) -> int:
    """Writes a layer by the path's format; returns the rows written. Parquet and GeoJSON can be written."""
    fmt = format_of(path)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if fmt == "geoparquet":
        geoparquet.write(counted, path, **options)
        return seen.get["n"]
    if fmt == "geojson":
        return geojson.write(df, path, P.geometry_of(df) or "geometry")
    raise Unsupported(f"writing {fmt}")


def size_of(path: str) -> int | None:
    local = local_path(path)
    if local is None:
        return None
    if os.path.isdir(local):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(local) for f in names)
    return os.path.getsize(local)


def convert(spark: SparkSession, source: str, target: str, to_crs: int | str | None = None, layer: str | None = None, source_crs: int | None = None, method: str = "bilinear", build_pyramid: bool = True, progress: Callable[[int, int], None] | None = None, **options: Any) -> dict:
    """Vector to vector or raster to raster, reprojected on the way if asked. progress: see ``Progress``."""
    if progress:
        with Progress(spark, progress):
            return convert(spark, source, target, to_crs, layer, source_crs, method, build_pyramid, **options)
    began, kinds = time.time(), (modality(format_of(source)), modality(format_of(target)))
    if kinds[0] != kinds[1]:
        raise ConvertError(f"{kinds[0]} to {kinds[1]}")
    if kinds[0] == "raster":
        return convert_raster(spark, source, target, to_crs, source_crs, method, build_pyramid, **options)
    df = read_layer(spark, source, layer)
    if to_crs is not None:
        df = reprojected(df, to_crs)
    n = write_layer(df, target, **options)
    return {"features": n, "seconds": time.time() - began, "bytes": size_of(target)}


def convert_store(spark: SparkSession, source: str, target: str, to_crs: int | str | None = None, **options: Any) -> dict:
    """Between object stores: both ends are GeoParquet addresses, read and written through Hadoop's and Arrow's file systems."""
    for path in (source, target):
        if format_of(path) != "geoparquet":
            raise Unsupported(f"{path}: only Parquet goes from store to store")
    return convert(spark, source, target, to_crs=to_crs, **options)


def reproject(spark: SparkSession, source: str, target: str, to_crs: int | str, **options: Any) -> dict:
    return convert(spark, source, target, to_crs=to_crs, **options)


def convert_raster(spark: SparkSession, source: str, target: str, to_crs: int | str | None, source_crs: int | None, method: str, build_pyramid: bool, tile: int = TILE, codec: str = "deflate", level: int = 6) -> dict:
    """Level 0 by tiles: cut or warped to the tile size, with overviews."""
    began = time.time()
    if format_of(target) != "geotiff":
        raise Unsupported(f"writing {format_of(target)}")
    tiles = read_raster(spark, source, source_crs).where("level = 0")
    if format_of(source) == "geotiff":
        about = geotiff.profile(source)
        width, height, affine, epsg = about["width"], about["height"], about["affine"], about["epsg"]
    else:
        first = tiles.first()
        width, height, affine, epsg = first["width"], first["height"], tuple(first["affine"]), first["epsg"]
    if to_crs is not None:
        wanted = C.parse_crs(to_crs)
        if epsg is None or affine is None:
            raise ConvertError("the raster's place is not known")
        grid = R.target_grid(affine, width, height, epsg, wanted, width)
        tiles = R.warp(tiles, epsg, wanted, grid, method, tile=tile)
        affine, width, height = grid
        epsg = wanted
    sizes = {0: (width, height)}
    if build_pyramid:
        for k, size in enumerate(R.level_sizes(width, height), 1):
            sizes[k] = size
        tiles = R.pyramid(tiles, width, height)
    geotiff.write(tiles, target, sizes, codec, level, epsg)
    return {"width": width, "height": height, "levels": len(sizes), "seconds": time.time() - began, "bytes": size_of(target)}


def filter_bbox(spark: SparkSession, source: str, target: str, box: tuple[float, float, float, float], layer: str | None = None, **options: Any) -> dict:
    """Whole features whose envelope touches the box; null and empty geometries never do."""
    began = time.time()
    if format_of(source) == "geoparquet":
        kept = geoparquet.read(spark, source, box)
        scanned = spark.read.parquet(source).count()  # from the footers
        n = write_layer(kept, target, **options)
        return {"scanned": scanned, "kept": n, "seconds": time.time() - began}
    df = read_layer(spark, source, layer)
    name, seen = P.geometry_of(df), Observation()
    e = st_bbox(F.col(f"`{name}`"))
    x0, y0, x1, y1 = map(float, box)
    kept = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("_e", e).where((F.col("_e.xmin") <= x1) & (F.col("_e.xmax") >= x0) & (F.col("_e.ymin") <= y1) & (F.col("_e.ymax") >= y0)).drop("_e")
    n = write_layer(kept, target, **options)
    return {"scanned": seen.get["n"] if format_of(target) == "geoparquet" else df.count(), "kept": n, "seconds": time.time() - began}


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    try:
        a, b, c, d = (float(v) for v in text.split(","))
    except ValueError as e:
        raise ConvertError(f"{text!r} is no xmin,ymin,xmax,ymax") from e
    if a > c or b > d:
        raise ConvertError("a minimum is above its maximum")
    return a, b, c, d


def optimize(spark: SparkSession, source: str, target: str, batch_rows: int = geoparquet.BATCH_ROWS, files: int | None = None) -> dict:
    """Parquet to Parquet in Hilbert order, with covering columns; rows of one key as they lie in the source."""
    df = geoparquet.read(spark, source, place="_place")
    seen = Observation()
    geoparquet.write(df.observe(seen, F.count(F.lit(1)).alias("n")), target, hilbert=True, batch_rows=batch_rows, files=files, place="_place")
    return {"features": seen.get["n"], "bytes_in": size_of(source), "bytes_out": size_of(target)}


def inspect(spark: SparkSession, path: str) -> dict:
    """Schema, system and declared extent of each layer."""
    if modality(format_of(path)) == "raster":
        raise Unsupported("inspection of rasters")
    out = []
    for name in layers(path):
        df = read_layer(spark, path, name if name != "default" else None)
        g = P.geometry_of(df)
        meta = df.schema[g].metadata if g else {}
        extent = meta.get("extent") or (geoparquet.extent(spark, path) if format_of(path) == "geoparquet" else None)
        fields = [{"name": f.name, "type": type_name(f), "nullable": f.nullable, "alias": f.metadata.get("alias"), "width": f.metadata.get("width")} for f in P.attributes(df, g)]
        out.append({"name": name, "geometry": {"name": g, "kind": meta.get("kind")} if g else None, "epsg": meta.get("epsg"), "crs": meta.get("crs"), "extent": list(extent) if extent else None, "fields": fields})
    return {"path": path, "format": format_of(path), "layers": out}


def sidecar_path(path: str) -> str:
    return f"{path.rstrip('/')}.metadata.json"


def metadata(spark: SparkSession, path: str, target: str | None = None) -> dict:
    """The inspection with its maker and versions, written beside the data."""
    out = {"spec_version": SPEC_VERSION, "generator": "loamgrid", "version": VERSION, **inspect(spark, path)}
    where = target or sidecar_path(path)
    write_text(spark, where, json.dumps(out, indent=2, default=str))
    return out


def profile(spark: SparkSession, path: str, layer: str | None = None, **options: Any) -> dict:
    return P.profile(read_layer(spark, path, layer), **options)
