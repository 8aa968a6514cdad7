"""Raster operators over rows of tiles: resampling, overviews and warping.

Rasters stay cut up: an overview tile is made from the four tiles below it, a warped tile from the source
tiles that its outline touches. Kernels are array operations in Arrow functions. Integers are rounded
half away from zero and clamped; nodata is kept out of the kernels; ties of the mode go to the smallest value.
"""

import math
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.core.errors import Unsupported
from loamgrid.functions.crs import transform_array
from loamgrid.sources.files import scratch
from loamgrid.sources.geotiff import DTYPES, SCHEMA

METHODS = ("nearest", "bilinear", "cubic", "lanczos", "average", "mode")
MIN_DIMENSION, MAX_LEVELS = 256, 16


def plane(band: dict, height: int, width: int) -> np.ndarray:
    """A band's pixels as doubles; nodata as NaN."""
    if band["dtype"] in ("Rgb8", "Rgba8"):
        raise Unsupported(f"resampling of {band['dtype']}")
    out = np.frombuffer(bytes(band["data"]), np.dtype(DTYPES[band["dtype"]]).newbyteorder("<")).reshape(height, width).astype(np.float64)
    if band.get("nodata") is not None:
        out = np.where(out == band["nodata"], np.nan, out)
    return out


def packed(values: np.ndarray, dtype: str, nodata: float | None = None) -> bytes:
    """Doubles to a pixel type; NaN becomes nodata, or 0."""
    kind = np.dtype(DTYPES[dtype]).newbyteorder("<")
    filled = np.where(np.isnan(values), 0.0 if nodata is None else nodata, values)
    if kind.kind in "ui":
        info = np.iinfo(kind)
        filled = np.clip(np.sign(filled) * np.floor(np.abs(filled) + 0.5), info.min, info.max)
    return filled.astype(kind).tobytes()


# --- kernels: values at places (in pixels from the corner), NaN outside


def _clamped(p: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    return p[np.clip(r, 0, p.shape[0] - 1), np.clip(c, 0, p.shape[1] - 1)]


def sample(p: np.ndarray, x: np.ndarray, y: np.ndarray, method: str = "bilinear") -> np.ndarray:
    """Area methods are bilinear at a point. Neighbours beyond the edge repeat it; places outside have no value."""
    inside = (x >= 0) & (y >= 0) & (x < p.shape[1]) & (y < p.shape[0])
    x, y = np.where(inside, x, 0.0), np.where(inside, y, 0.0)
    if method == "nearest":
        out = _clamped(p, np.floor(x).astype(int), np.floor(y).astype(int))
    else:
        reach = {"cubic": 2, "lanczos": 3}.get(method, 1)
        weigh = {"cubic": catmull_rom, "lanczos": lanczos}.get(method, tent)
        c0, r0 = np.floor(x - 0.5), np.floor(y - 0.5)
        dx, dy = x - 0.5 - c0, y - 0.5 - r0
        total, weight, plain = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape)
        for j in range(1 - reach, reach + 1):
            for i in range(1 - reach, reach + 1):
                w = weigh(i - dx) * weigh(j - dy)
                v = _clamped(p, (c0 + i).astype(int), (r0 + j).astype(int))
                known = ~np.isnan(v)
                total += np.where(known, w * np.where(known, v, 0.0), 0.0)
                weight += np.where(known, w, 0.0)
                plain += w
        # weights are brought to one where they are not (a wide kernel, missing neighbours)
        whole = np.isclose(weight, plain) & (method != "lanczos")
        out = np.where(np.abs(weight) < 1e-12, np.nan, total / np.where(whole, 1.0, np.where(np.abs(weight) < 1e-12, 1.0, weight)))
    return np.where(inside, out, np.nan)


def tent(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(t))


def catmull_rom(t: np.ndarray) -> np.ndarray:
    a = np.abs(t)
    return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))


def lanczos(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


def resample(p: np.ndarray, width: int, height: int, method: str = "average") -> np.ndarray:
    """A plane in another size. Average and mode take all pixels that a target pixel touches, if it gets smaller."""
    h, w = p.shape
    width, height = max(1, width), max(1, height)
    sx, sy = w / width, h / height
    if method not in ("average", "mode") or (sx <= 1 and sy <= 1):
        x, y = np.meshgrid((np.arange(width) + 0.5) * sx, (np.arange(height) + 0.5) * sy)
        return sample(p, x, y, method)
    c0, c1 = _reach(width, sx, w)
    r0, r1 = _reach(height, sy, h)
    if method == "average":
        known = ~np.isnan(p)
        sums, counts = _box(np.where(known, p, 0.0), r0, r1, c0, c1), _box(known.astype(float), r0, r1, c0, c1)
        return np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
    out = np.full((height, width), np.nan)
    for i in range(height):
        for j in range(width):
            v = p[r0[i] : r1[i], c0[j] : c1[j]]
            v = v[~np.isnan(v)]
            if len(v):
                values, counts = np.unique(v, return_counts=True)
                out[i, j] = values[np.argmax(counts)]
    return out


def _reach(n: int, step: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.clip(np.floor(np.arange(n) * step).astype(int), 0, size)
    high = np.clip(np.ceil(np.arange(1, n + 1) * step).astype(int), 0, size)
    return low, np.maximum(high, low)


def _box(p: np.ndarray, r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    s[1:, 1:] = p.cumsum(axis=0).cumsum(axis=1)
    return s[r1][:, c1] - s[r0][:, c1] - s[r1][:, c0] + s[r0][:, c0]


# --- over frames


def _tile(row: dict, planes: list[np.ndarray], bands: list[dict], affine: tuple | None, **key: Any) -> dict:
    h, w = planes[0].shape
    own = [{**{k: b[k] for k in ("name", "dtype", "nodata", "unit", "scale", "offset")}, "data": packed(p, b["dtype"], b["nodata"])} for p, b in zip(planes, bands, strict=True)]
    t = None if affine is None else dict(zip(("ox", "pw", "rx", "oy", "ry", "ph"), affine, strict=True))
    return {"level": row["level"], "x": row["x"], "y": row["y"], "width": w, "height": h, "affine": t, "bands": own, "epsg": row["epsg"]} | key


def _six(t: dict | None) -> tuple | None:
    return None if t is None else tuple(t[k] for k in ("ox", "pw", "rx", "oy", "ry", "ph"))


def _arrow() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(SCHEMA)


def resample_tiles(tiles: DataFrame, width: int, height: int, method: str = "average") -> DataFrame:
    """Each tile in another size over the same ground."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                planes = [resample(plane(b, row["height"], row["width"]), width, height, method) for b in row["bands"]]
                t, a, b = _six(row["affine"]), row["width"] / width, row["height"] / height
                t = None if t is None else (t[0], t[1] * a, t[2] * b, t[3], t[4] * a, t[5] * b)
                out.append(_tile(row, planes, row["bands"], t))
            yield pa.RecordBatch.from_pylist(out, schema=_arrow())

    return tiles.select(*SCHEMA.fieldNames()).mapInArrow(run, SCHEMA)


def next_level(tiles: DataFrame, method: str = "average") -> DataFrame:
    """The overview of one level: each four neighbouring tiles become one of the same size."""
    keyed = tiles.select(*SCHEMA.fieldNames(), F.call_function("div", F.col("x"), F.lit(2)).cast("int").alias("px"), F.call_function("div", F.col("y"), F.lit(2)).cast("int").alias("py"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["y"], r["x"]))
        px, py = rows[0]["px"], rows[0]["py"]
        w, h = rows[0]["width"], rows[0]["height"]
        planes = []
        for k, b in enumerate(rows[0]["bands"]):
            whole = np.full((2 * h, 2 * w), np.nan)
            for r in rows:
                i, j = r["y"] - 2 * py, r["x"] - 2 * px
                whole[i * h : i * h + r["height"], j * w : j * w + r["width"]] = plane(r["bands"][k], r["height"], r["width"])
            used = whole[: h * (1 + max(r["y"] - 2 * py for r in rows)), : w * (1 + max(r["x"] - 2 * px for r in rows))]
            small = resample(used, -(-used.shape[1] // 2), -(-used.shape[0] // 2), method)
            full = np.full((h, w), np.nan)
            full[: small.shape[0], : small.shape[1]] = small
            planes.append(full)
        r = rows[0]
        t = _six(r["affine"])
        if t is not None:
            i, j = r["y"] - 2 * py, r["x"] - 2 * px
            ox, oy = t[0] - j * w * t[1] - i * h * t[2], t[3] - j * w * t[4] - i * h * t[5]
            t = (ox, 2 * t[1], 2 * t[2], oy, 2 * t[4], 2 * t[5])
        return pa.Table.from_pylist([_tile(r, planes, r["bands"], t, level=r["level"] + 1, x=px, y=py)], schema=_arrow())

    return keyed.groupBy("px", "py").applyInArrow(run, SCHEMA)


def level_sizes(width: int, height: int, min_dimension: int = MIN_DIMENSION, max_levels: int = MAX_LEVELS) -> list[tuple[int, int]]:
    """Sizes of the overviews: halved until both sides are small enough, one at least, as long as something gets smaller."""
    out = []
    for _ in range(max_levels):
        w, h = max(1, width // 2), max(1, height // 2)
        if (w, h) == (width, height):
            break
        out.append((w, h))
        if w <= min_dimension and h <= min_dimension:
            break
        width, height = w, h
    return out


def pyramid(tiles: DataFrame, width: int, height: int, method: str = "average", min_dimension: int = MIN_DIMENSION, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Level 0 and all overviews. Each level is written, so that the next one is not planned on all below it."""
    spark, out, current = tiles.sparkSession, tiles, tiles
    for _ in level_sizes(width, height, min_dimension, max_levels):
        path = scratch(spark, "level")
        next_level(current, method).write.parquet(path)
        current = spark.read.schema(SCHEMA).parquet(path)
        out = out.unionByName(current)
    return out


def target_grid(affine: tuple, width: int, height: int, source: int, target: int, target_width: int) -> tuple[tuple, int, int]:
    """(transform, width, height) around the corners and the centre of a raster in another system; pixels keep their shape."""
    corners = np.array([(affine[0] + c * affine[1] + r * affine[2], affine[3] + c * affine[4] + r * affine[5]) for c in (0, width) for r in (0, height)])
    low, high = corners.min(axis=0), corners.max(axis=0)
    box = np.array([(low[0], low[1]), (high[0], low[1]), (low[0], high[1]), (high[0], high[1]), tuple((low + high) / 2)])
    moved = transform_array(box, source, target)
    (x0, y0), (x1, y1) = moved.min(axis=0), moved.max(axis=0)
    pixel = (x1 - x0) / target_width
    rows = max(1, int(math.floor((y1 - y0) / pixel + 0.5)))
    return (x0, pixel, 0.0, y1, 0.0, -(y1 - y0) / rows), target_width, rows


def warp(tiles: DataFrame, source: int, target: int, grid: tuple[tuple, int, int], method: str = "bilinear", nodata: float = 0.0, tile: int = 256, step: int = 16) -> DataFrame:
    """Level 0 in another system, cut in tiles of the target grid.

    A source tile goes to the target tiles that its outline, moved and widened by the kernel's reach, falls
    on; each target tile puts its sources together and samples once for all pixels. Places outside the
    source, or without data there, get nodata.
    """
    t, width, height = grid
    across, down = -(-width // tile), -(-height // tile)

    def places(affine: pd.DataFrame, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for k in range(len(w)):
            a = affine.iloc[k]
            edge = np.linspace(-3, w.iloc[k] + 3, step + 1), np.linspace(-3, h.iloc[k] + 3, step + 1)
            c, r = (g.ravel() for g in np.meshgrid(*edge))
            world = np.column_stack([a.ox + c * a.pw + r * a.rx, a.oy + c * a.ry + r * a.ph])
            moved = transform_array(world, source, target)
            moved = moved[np.isfinite(moved).all(axis=1)]
            if not len(moved):
                out.append([])
                continue
            px, py = (moved[:, 0] - t[0]) / t[1], (moved[:, 1] - t[3]) / t[5]
            slack = tile // step + 1
            x0, x1 = int((px.min() - slack) // tile), int((px.max() + slack) // tile)
            y0, y1 = int((py.min() - slack) // tile), int((py.max() + slack) // tile)
            out.append([{"x": x, "y": y} for y in range(max(0, y0), min(down - 1, y1) + 1) for x in range(max(0, x0), min(across - 1, x1) + 1)])
        return pd.Series(out)

    kind = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
    dealt = tiles.where("level = 0").select(*SCHEMA.fieldNames(), F.explode(F.pandas_udf(places, kind)("affine", "width", "height")).alias("_t"))
    keyed = dealt.select(*SCHEMA.fieldNames(), F.col("_t.x").alias("tx"), F.col("_t.y").alias("ty"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tx, ty = rows[0]["tx"], rows[0]["ty"]
        x0, y0 = min(r["x"] for r in rows), min(r["y"] for r in rows)
        w, h = rows[0]["width"], rows[0]["height"]
        size = (max(r["y"] for r in rows) - y0 + 1) * h, (max(r["x"] for r in rows) - x0 + 1) * w
        r0 = rows[0]
        a = _six(r0["affine"])
        ox, oy = a[0] - (r0["x"] - x0) * w * a[1] - (r0["y"] - y0) * h * a[2], a[3] - (r0["x"] - x0) * w * a[4] - (r0["y"] - y0) * h * a[5]
        c, r = np.meshgrid(tx * tile + np.arange(tile) + 0.5, ty * tile + np.arange(tile) + 0.5)
        world = np.column_stack([(t[0] + c * t[1] + r * t[2]).ravel(), (t[3] + c * t[4] + r * t[5]).ravel()])
        back = transform_array(world, target, source)
        det = a[1] * a[5] - a[2] * a[4]
        dx, dy = back[:, 0] - ox, back[:, 1] - oy
        sx, sy = ((a[5] * dx - a[2] * dy) / det).reshape(tile, tile), ((a[1] * dy - a[4] * dx) / det).reshape(tile, tile)
        good = np.isfinite(sx) & np.isfinite(sy) & (c < width) & (r < height)
        planes, bands = [], []
        for k, b in enumerate(r0["bands"]):
            whole = np.full(size, np.nan)
            for one in rows:
                i, j = (one["y"] - y0) * h, (one["x"] - x0) * w
                whole[i : i + one["height"], j : j + one["width"]] = plane(one["bands"][k], one["height"], one["width"])
            v = sample(whole, np.where(good, sx, -1.0), np.where(good, sy, -1.0), method)
            planes.append(np.where(np.isnan(v), nodata if b["nodata"] is None else b["nodata"], v))
            bands.append(b)
        own = (t[0] + tx * tile * t[1] + ty * tile * t[2], t[1], t[2], t[3] + tx * tile * t[4] + ty * tile * t[5], t[4], t[5])
        return pa.Table.from_pylist([_tile(r0, planes, bands, own, level=0, x=tx, y=ty, epsg=target)], schema=_arrow())

    return keyed.groupBy("tx", "ty").applyInArrow(run, SCHEMA)


def pixels(tiles: DataFrame, band: int = 0) -> DataFrame:
    """(level, column, row, value) of one band: pixels of the whole level, nodata left out."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = plane(row["bands"][band], row["height"], row["width"])
                r, c = np.nonzero(~np.isnan(p))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), row["level"], np.int32)), pa.array(c + row["x"] * row["width"]), pa.array(r + row["y"] * row["height"]), pa.array(p[r, c])], ["level", "column", "row", "value"])

    return tiles.select(*SCHEMA.fieldNames()).mapInArrow(run, "level int, column long, row long, value double")


def from_pixels(df: DataFrame, affine: tuple, tile: int = 256, dtype: str = "F64", nodata: float | None = None, epsg: int | None = None) -> DataFrame:
    """Tiles of level 0 from (column, row, value); a pixel given several times keeps its largest value."""
    keyed = df.select(F.col("column").cast("long").alias("column"), F.col("row").cast("long").alias("row"), F.col("value").cast("double").alias("value")).withColumns({"tx": F.expr(f"column div {tile}"), "ty": F.expr(f"row div {tile}")})

    def run(table: pa.Table) -> pa.Table:
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        p = np.full((tile, tile), np.nan)
        table = table.sort_by("value")  # the last one stays
        p[table.column("row").to_numpy() - ty * tile, table.column("column").to_numpy() - tx * tile] = table.column("value").to_numpy()
        t = (affine[0] + tx * tile * affine[1] + ty * tile * affine[2], affine[1], affine[2], affine[3] + tx * tile * affine[4] + ty * tile * affine[5], affine[4], affine[5])
        band = {"name": "band_1", "dtype": dtype, "nodata": nodata, "unit": None, "scale": None, "offset": None}
        return pa.Table.from_pylist([_tile({"level": 0, "x": tx, "y": ty, "epsg": epsg}, [p], [band], t)], schema=_arrow())

    return keyed.groupBy("tx", "ty").applyInArrow(run, SCHEMA)
