"""Functions over WKB columns, as Arrow-batched functions.

Points on their own are better kept as two columns, which the native expressions handle; these are for
geometry of any kind. A null stays null. Bytes that are no geometry are an error, but for the envelope,
which is null for them.
"""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.core import geometry as G
from loamgrid.core import wkbarray as W
from loamgrid.functions.crs import is_identity, projection, transform_array

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])


def _each(s: pd.Series, f) -> pd.Series:
    return pd.Series([None if v is None else f(bytes(v)) for v in s], dtype=object)


def _of_geometry(f, kind: T.DataType):
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda b: f(G.from_wkb(b)))

    return F.pandas_udf(run, kind)


def _measured(of_flat, of_geometry, kind: pa.DataType):
    """An Arrow function over WKB: flat arrays for plain rows, one by one for the others."""

    def run(wkb: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(wkb):
            flat = W.Flat(part)
            values = of_flat(flat)
            for i in flat.others.tolist():
                values[i] = of_geometry(flat.bytes_of(i))
            out.append(pa.array(values, kind, mask=~flat.valid))
        return pa.concat_arrays(out)

    return run


def bbox_of(wkb: pa.Array) -> np.ndarray:
    """(rows, 4); NaN for null, for no finite vertex and for bytes that are no geometry."""
    out = []
    for part in W.slices(wkb):
        flat = W.Flat(part)
        boxes = flat.boxes()
        for i in flat.others.tolist():
            boxes[i] = G.bbox_from_wkb(flat.bytes_of(i)) or np.nan
        out.append(boxes)
    return np.concatenate(out)


@F.arrow_udf(BBOX)
def _bbox(wkb: pa.Array) -> pa.Array:
    boxes = bbox_of(wkb)
    return pa.StructArray.from_arrays([pa.array(c) for c in boxes.T.copy()], BBOX.fieldNames(), mask=pa.array(np.isnan(boxes[:, 0])))


def st_bbox(wkb: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>; null without a finite vertex."""
    return _bbox(wkb)


@F.arrow_udf(T.BinaryType())
def _point(x: pa.Array, y: pa.Array) -> pa.Array:
    return W.points(x, y)


def st_point(x: Column, y: Column) -> Column:
    return _point(x.cast("double"), y.cast("double"))


@F.arrow_udf(T.BinaryType())
def _line(lists: pa.Array) -> pa.Array:
    return W.lines(lists)


@F.arrow_udf(T.BinaryType())
def _polygon(lists: pa.Array) -> pa.Array:
    return W.polygons(lists)


def st_line(points: Column) -> Column:
    """array<struct<x, y>> to WKB."""
    return _line(points)


def st_polygon(rings: Column) -> Column:
    return _polygon(rings)


POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_kind = _of_geometry(lambda g: g.name, T.StringType())
_count = F.arrow_udf(_measured(W.Flat.counts, lambda b: G.coord_count(G.from_wkb(b)), pa.int32()), T.IntegerType())
_empty = F.arrow_udf(_measured(lambda f: f.first_counts() == 0, lambda b: G.is_empty(G.from_wkb(b)), pa.bool_()), T.BooleanType())
_area = F.arrow_udf(_measured(W.Flat.areas, lambda b: G.area(G.from_wkb(b)), pa.float64()), T.DoubleType())
_length = F.arrow_udf(_measured(W.Flat.lengths, lambda b: G.length(G.from_wkb(b)), pa.float64()), T.DoubleType())
_geojson = _of_geometry(lambda g: json.dumps(G.to_geojson(g), separators=(",", ":")), T.StringType())
_normal = _of_geometry(G.to_wkb, T.BinaryType())
_points = _of_geometry(lambda g: [{"x": x, "y": y} for x, y in G.coordinates(g).tolist()], POINTS)


@F.pandas_udf(T.BinaryType())
def _from_geojson(s: pd.Series) -> pd.Series:
    def one(v):
        g = G.from_geojson(v) if v is not None else None
        return None if g is None else G.to_wkb(g)

    return pd.Series([one(v) for v in s], dtype=object)


def st_kind(wkb: Column) -> Column:
    """Natively from the type code; typed empties keep their kind."""
    code = F.when(F.hex(F.substring(wkb, 1, 1)) == "01", F.hex(F.substring(wkb, 2, 1))).otherwise(F.hex(F.substring(wkb, 5, 1)))
    names = F.create_map(*[F.lit(v) for k, n in G.KINDS.items() for v in (f"{k:02d}", n)])
    return names[code]


def _type_code(wkb: Column) -> Column:
    """The unsigned type code behind the byte order."""
    big = F.hex(F.substring(wkb, 2, 4))
    own = F.when(F.hex(F.substring(wkb, 1, 1)) == "01", F.concat(*[F.substring(big, 7 - 2 * i, 2) for i in range(4)])).otherwise(big)
    return F.conv(own, 16, 10).cast("long")


def st_has_z(wkb: Column) -> Column:
    """Natively from the type code: thousands of 1 or 3, or the top flag."""
    code = _type_code(wkb)
    return code.bitwiseAND(F.lit(1 << 31)).cast("boolean") | F.floor(code.bitwiseAND(F.lit(0xFFFF)) / 1000).isin(1, 3)


def st_has_m(wkb: Column) -> Column:
    """Natively from the type code: thousands of 2 or 3, or the flag below the top."""
    code = _type_code(wkb)
    return code.bitwiseAND(F.lit(1 << 30)).cast("boolean") | F.floor(code.bitwiseAND(F.lit(0xFFFF)) / 1000).isin(2, 3)


def st_coord_count(wkb: Column) -> Column:
    return _count(wkb)


def st_is_empty(wkb: Column) -> Column:
    return _empty(wkb)


def st_area(wkb: Column) -> Column:
    return _area(wkb)


def st_length(wkb: Column) -> Column:
    return _length(wkb)


def st_as_geojson(wkb: Column) -> Column:
    return _geojson(wkb)


def st_from_geojson(text: Column) -> Column:
    return _from_geojson(text)


def st_normalize(wkb: Column) -> Column:
    """Little-endian at every level."""
    return _normal(wkb)


def st_points(wkb: Column) -> Column:
    """All vertices, in order."""
    return _points(wkb)


def st_transform(wkb: Column, source: int, target: int) -> Column:
    """Every vertex; the column itself if nothing changes. Codes are checked when the plan is made."""
    projection(source), projection(target)
    if is_identity(source, target):
        return wkb

    change = lambda p: transform_array(p, source, target)

    def run(wkb: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(wkb):
            flat = W.Flat(part)
            moved = flat.moved(change)
            rows = [None if not v else moved[a:b].tobytes() for v, a, b in zip(flat.valid.tolist(), flat.starts.tolist(), flat.ends.tolist(), strict=True)]
            for i in flat.others.tolist():
                rows[i] = G.to_wkb(G.with_coordinates(G.from_wkb(flat.bytes_of(i)), change))
            out.append(pa.array(rows, pa.binary()))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, T.BinaryType())(wkb)


def st_simplify(wkb: Column, tolerance: float | Column) -> Column:
    t = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))

    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else G.to_wkb(G.simplify(G.from_wkb(bytes(v)), float(x))) for v, x in zip(s, t, strict=True)], dtype=object)

    return F.pandas_udf(run, T.BinaryType())(wkb, t)


def st_contains_point(wkb: Column, x: Column, y: Column) -> Column:
    """Whether the inside of a polygon holds a point (even-odd rule); a point that lies on an edge is not held."""

    def run(shapes: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in W.slices(shapes):
            flat = W.Flat(part)
            px, py = (np.asarray(v.slice(at, len(part)).fill_null(np.nan)) for v in (x, y))
            given = np.asarray(x.slice(at, len(part)).is_valid()) & np.asarray(y.slice(at, len(part)).is_valid())
            held = flat.holds(px, py)
            for i in np.setdiff1d(np.flatnonzero(flat.valid & given), np.flatnonzero(flat.kind == G.POLYGON)).tolist():
                rings = G.parts(G.from_wkb(flat.bytes_of(i)))
                sizes = np.array([len(r) for r in rings], np.int64)
                held[i] = W.holds(np.concatenate([np.zeros((0, 2)), *rings]), sizes, np.zeros(len(rings), np.int64), px[i : i + 1], py[i : i + 1])[0]
            out.append(pa.array(held, pa.bool_(), mask=~(flat.valid & given)))
            at += len(part)
        return pa.concat_arrays(out)

    return F.arrow_udf(run, T.BooleanType())(wkb, x.cast("double"), y.cast("double"))
