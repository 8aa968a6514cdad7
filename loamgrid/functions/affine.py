"""Affine transforms of rasters: struct<ox, pw, rx, oy, ry, ph>, in the order of the six-number tuple.

x = ox + column * pw + row * rx;  y = oy + column * ry + row * ph.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("ox", "pw", "rx", "oy", "ry", "ph")


def affine(*six: float | Column) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in zip(FIELDS, six, strict=True)])


def north_up(x: float, y: float, width: float, height: float) -> Column:
    """Origin at the upper left, pixels of the given size."""
    return affine(x, width, 0.0, y, 0.0, -height)


def is_north_up(t: Column) -> Column:
    return (t["rx"] == 0) & (t["ry"] == 0)


def pixel_to_world(t: Column, column: Column, row: Column) -> tuple[Column, Column]:
    return t["ox"] + column * t["pw"] + row * t["rx"], t["oy"] + column * t["ry"] + row * t["ph"]


def world_to_pixel(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Null for a transform that cannot be inverted."""
    det = t["pw"] * t["ph"] - t["rx"] * t["ry"]
    det = F.nullif(det, F.lit(0.0))
    dx, dy = x - t["ox"], y - t["oy"]
    return (t["ph"] * dx - t["rx"] * dy) / det, (t["pw"] * dy - t["ry"] * dx) / det


def world_bounds(t: Column, width: Column, height: Column) -> Column:
    """Envelope of the four corners."""
    corners = [pixel_to_world(t, F.lit(0.0) if not a else width.cast("double"), F.lit(0.0) if not b else height.cast("double")) for a in (0, 1) for b in (0, 1)]
    xs, ys = zip(*corners, strict=True)
    return F.struct(F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))


def scaled(t: Column, across: Column, down: Column) -> Column:
    """The transform of a grid whose pixels are so many times as wide and as high; rotation terms follow."""
    return affine(t["ox"], t["pw"] * across, t["rx"] * down, t["oy"], t["ry"] * across, t["ph"] * down)


#: Bytes of each pixel type.
PIXEL_BYTES = {"U8": 1, "U16": 2, "U32": 4, "I8": 1, "I16": 2, "I32": 4, "F32": 4, "F64": 8, "Rgb8": 3, "Rgba8": 4}


def pixel_bytes(kind: Column) -> Column:
    out = None
    for k, n in PIXEL_BYTES.items():
        out = F.when(kind == k, F.lit(n)) if out is None else out.when(kind == k, F.lit(n))
    return out


def pixel_count(data: Column, kind: Column) -> Column:
    return F.call_function("div", F.length(data), pixel_bytes(kind))


def tile_bytes(width: Column, height: Column, kinds: Column) -> Column:
    """Bytes of all bands of a tile. kinds: array of pixel types."""
    return width * height * F.aggregate(F.transform(kinds, pixel_bytes), F.lit(0), lambda t, x: t + x)


def well_formed(width: Column, height: Column, bands: Column) -> Column:
    """Every band has exactly the bytes of its pixels."""
    return F.forall(bands, lambda b: F.length(b["data"]) == width * height * pixel_bytes(b["dtype"]))


def tile_grid(width: Column, height: Column, tile_width: Column, tile_height: Column) -> tuple[Column, Column]:
    return F.ceil(width / tile_width).cast("long"), F.ceil(height / tile_height).cast("long")
