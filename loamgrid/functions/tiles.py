"""The slippy-map grid as column expressions. Rows count southwards."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions.crs import MAX_LATITUDE

EXTENT = 4096


def per_side(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), z)


def world_x(lng: Column, z: Column) -> Column:
    """Longitude in tiles from the western edge."""
    return (lng + 180.0) / 360.0 * per_side(z)


def world_y(lat: Column, z: Column) -> Column:
    """Latitude, clamped, in tiles from the northern edge."""
    rad = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * per_side(z)


def tile_of(lng: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point."""
    last = per_side(z) - 1
    place = lambda v: F.greatest(F.lit(0), F.least(last, F.floor(v))).cast("long")
    return place(world_x(lng, z)), place(world_y(lat, z))


def _lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / per_side(z)))))


def _lng(x: Column, z: Column) -> Column:
    return x / per_side(z) * 360.0 - 180.0


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    return F.struct(_lng(x, z).alias("xmin"), _lat(y + 1, z).alias("ymin"), _lng(x + 1, z).alias("xmax"), _lat(y, z).alias("ymax"))


def pixel(lng: Column, lat: Column, z: Column, x: Column, y: Column, extent: int = EXTENT) -> tuple[Column, Column]:
    """Place inside a tile, rounded half away from zero; outside it is not clipped."""
    return F.round((world_x(lng, z) - x) * float(extent)).cast("long"), F.round((world_y(lat, z) - y) * float(extent)).cast("long")


def metatile(x: Column, y: Column, grid: int) -> tuple[Column, Column]:
    """North-western tile of the block of grid x grid tiles that holds a tile."""
    g = F.lit(grid).cast("long")
    return F.call_function("div", x.cast("long"), g) * grid, F.call_function("div", y.cast("long"), g) * grid


def sub_tiles(x: Column, y: Column, grid: int) -> Column:
    """array<struct<x, y>> of a metatile, row after row."""
    k = F.sequence(F.lit(0), F.lit(grid - 1))
    return F.flatten(F.transform(k, lambda dy: F.transform(k, lambda dx: F.struct((x + dx).alias("x"), (y + dy).alias("y")))))


def metatile_bbox(z: Column, x: Column, y: Column, grid: int) -> Column:
    a, b = tile_bbox(z, x, y), tile_bbox(z, x + grid - 1, y + grid - 1)
    return F.struct(a["xmin"].alias("xmin"), b["ymin"].alias("ymin"), b["xmax"].alias("xmax"), a["ymax"].alias("ymax"))


def sub_tile_rect(dx: Column, dy: Column, extent: int) -> Column:
    return F.struct((dx * extent).alias("x"), (dy * extent).alias("y"), F.lit(extent).alias("width"), F.lit(extent).alias("height"))
