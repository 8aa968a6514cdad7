"""Measures and tests of nested geometry as column expressions.

A point is struct<x, y>, a line or ring array<point>, a polygon array<ring> with the exterior first, a
multipolygon array<polygon>. All are built-in higher-order functions; nothing leaves the JVM.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar, in the units of the input."""
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def _pairs(line: Column) -> Column:
    """Each vertex with the next one."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.arrays_zip(F.slice(line, 1, n).alias("a"), F.slice(line, 2, n).alias("b"))


def length(line: Column) -> Column:
    """Sum of the segments; fewer than two vertices have none."""
    each = F.transform(_pairs(line), lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(_sum(each))


def signed_area(ring: Column) -> Column:
    """Shoelace over a ring, closed or not; positive counter-clockwise, 0 below three vertices."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_sum(cross) / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(polygon: Column) -> Column:
    """Exterior less holes, 0 at least."""
    areas = F.transform(polygon, ring_area)
    return F.when(F.size(polygon) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), areas[0] - _sum(F.slice(areas, 2, F.greatest(F.size(polygon) - 1, F.lit(0))))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def bbox(points: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax> of the finite vertices; null if there is none."""
    good = F.filter(points, lambda c: finite(c["x"]) & finite(c["y"]))
    side = lambda f, k: f(F.transform(good, lambda c: c[k]))
    box = F.struct(side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"))
    return F.when(F.size(good) > 0, box)


def coord_count(polygon: Column) -> Column:
    """Vertices of all rings, closing ones included."""
    return F.aggregate(polygon, F.lit(0), lambda t, r: t + F.size(r))


def line_is_empty(line: Column) -> Column:
    return F.coalesce(F.size(line), F.lit(0)) <= 0


def polygon_is_empty(polygon: Column) -> Column:
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) <= 0, F.lit(True)).otherwise(line_is_empty(F.get(polygon, F.lit(0))))


def box_intersects(box: tuple[float, float, float, float], columns: tuple[str, ...] = BOX) -> Column:
    """Closed on all four sides; comparisons that reach a Parquet scan."""
    x0, y0, x1, y1 = map(float, box)
    a, b, c, d = map(F.col, columns)
    return (a <= x1) & (c >= x0) & (b <= y1) & (d >= y0)


def boxes_intersect(a: str, b: str) -> Column:
    """Of two frames under aliases a and b, both with covering columns."""
    return (F.col(f"{a}.xmin") <= F.col(f"{b}.xmax")) & (F.col(f"{a}.xmax") >= F.col(f"{b}.xmin")) & (F.col(f"{a}.ymin") <= F.col(f"{b}.ymax")) & (F.col(f"{a}.ymax") >= F.col(f"{b}.ymin"))


def union_bbox(columns: tuple[str, ...] = BOX) -> list[Column]:
    """Aggregates of the covering columns; boxes with a side that is not finite are left out."""
    good = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])
    return [(F.min if c.endswith("min") else F.max)(F.when(good, F.col(c))).alias(c) for c in columns]


#: Degrees of tolerance up to each zoom level, and beyond.
TOLERANCES = ((2, 0.5), (5, 0.1), (8, 0.02), (11, 0.004), (14, 0.0008), (17, 0.00015))
FINEST = 0.00003


def tolerance_for_zoom(z: Column) -> Column:
    out = None
    for top, t in TOLERANCES:
        out = F.when(z <= top, F.lit(t)) if out is None else out.when(z <= top, F.lit(t))
    return out.otherwise(F.lit(FINEST))
