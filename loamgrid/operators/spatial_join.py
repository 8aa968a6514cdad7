"""Joins by place. Each is an equality join on grid cells or tiles, with an exact test behind it.

Cells have levels, each of twice the size of the one below. A box lies on the first level on which it is at most
``ACROSS`` cells wide and high, so that it touches 81 of them at most, however large it is, and its cells cover little
more than itself; it meets larger boxes on their level. A pair of boxes that share several cells is kept in one only:
the cell of the north-western corner of their common part. Cells far more crowded than others are split by the
adaptive planner or, for a known hot cell, by ``salt``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.geometry import st_contains_point
from loamgrid.functions.measure import BOX


ACROSS = 8


def _level(size: float) -> Column:
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / (size * ACROSS)
    return F.when(side > 1, F.ceil(F.log2(side))).otherwise(0).cast("int")


def _levels(df: DataFrame, size: float) -> list[int]:
    """The levels that there are boxes on: a few numbers."""
    return sorted(r[0] for r in df.where("xmin is not null").select(_level(size)).distinct().collect() if r[0] is not None)


def _size(size: float, level: str = "_l") -> Column:
    return F.pow(F.lit(2.0), F.col(level)) * size


def _in_cells(df: DataFrame, size: float, others: list[int]) -> DataFrame:
    """One row for each cell of the box's own level, and of the larger ones of ``others``, that it touches."""
    above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("_own"))
    each = df.withColumn("_own", _level(size)).withColumn("_l", F.explode(F.concat(F.array("_own"), above)))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / _size(size)), F.floor(F.col(high) / _size(size))))
    return each.withColumn("_cx", cells("xmin", "xmax")).withColumn("_cy", cells("ymin", "ymax"))


def box_join(left: DataFrame, right: DataFrame, size: float, salt: int = 1) -> DataFrame:
    """Pairs whose boxes touch, as columns under a. and b. (structs). size: of the smallest cells, about that of a usual box."""
    place = F.pmod(F.xxhash64(*BOX), F.lit(salt)).cast("int")

    def side(df: DataFrame, name: str, others: list[int], dealt: Column) -> DataFrame:
        """What pairs are tested by lies flat beside the struct; one hash stands for the cell in the sort."""
        each = _in_cells(df.select(F.struct("*").alias(name), *BOX), size, others).withColumn("_s", dealt)
        first = [F.floor(F.col(c) / _size(size)).alias(f"_{name}{c}_first") for c in ("xmin", "ymin")]
        own = [F.col(c).alias(f"_{name}{c}") for c in BOX]
        return each.select(name, F.xxhash64("_l", "_cx", "_cy", "_s").alias("_key"), *[F.col(c).alias(f"_{name}{c}") for c in ("_l", "_cx", "_cy", "_s", "_own")], *own, *first)

    a = side(left, "a", _levels(right, size), place)
    b = side(right, "b", _levels(left, size), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    touch = (F.col("_axmin") <= F.col("_bxmax")) & (F.col("_axmax") >= F.col("_bxmin")) & (F.col("_aymin") <= F.col("_bymax")) & (F.col("_aymax") >= F.col("_bymin"))
    same = (F.col("_a_cx") == F.col("_b_cx")) & (F.col("_a_cy") == F.col("_b_cy")) & (F.col("_a_l") == F.col("_b_l")) & (F.col("_a_s") == F.col("_b_s"))
    first = (F.greatest("_axmin_first", "_bxmin_first") == F.col("_a_cx")) & (F.greatest("_aymin_first", "_bymin_first") == F.col("_a_cy"))
    level = F.col("_a_l") == F.greatest("_a_own", "_b_own")
    return a.join(b.hint("merge"), "_key").where(touch & first & level & same).select("a", "b")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y", salt: int = 1) -> DataFrame:
    """Points (columns under a.) with the boxes (under b.) that hold them, edges included."""
    levels = _levels(boxes, size) or [0]
    p = points.select(F.struct("*").alias("a"), F.explode(F.array(*map(F.lit, levels))).alias("_l"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    p = p.select("a", "_l", F.floor(F.col("_x") / _size(size)).alias("_cx"), F.floor(F.col("_y") / _size(size)).alias("_cy"), F.pmod(F.xxhash64("_x", "_y"), F.lit(salt)).cast("int").alias("_s"))
    b = _in_cells(boxes.select(F.struct("*").alias("b"), *BOX), size, []).select("b", "_l", "_cx", "_cy", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_s"))
    inside = (F.col(f"a.{x}") >= F.col("b.xmin")) & (F.col(f"a.{x}") <= F.col("b.xmax")) & (F.col(f"a.{y}") >= F.col("b.ymin")) & (F.col(f"a.{y}") <= F.col("b.ymax"))
    return p.join(b, ["_l", "_cx", "_cy", "_s"]).where(inside).select("a", "b")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", geometry: str = "geometry") -> DataFrame:
    """Points with the polygons (WKB, with covering columns) that hold them."""
    return points_in_boxes(points, polygons, size, x, y).where(st_contains_point(F.col(f"b.{geometry}"), F.col(f"a.{x}"), F.col(f"a.{y}")))


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str], part: Column | None = None) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its time.

    One sort of both sides together and a running last value; no pairs are made. part: an expression that never falls as
    time rises (a day of it, say): a key is then worked on part by part, so that a hot key is many tasks, and what
    is the latest at the end of a part is carried to the next ones, one row for each key and part.
    """
    own = F.lit(0) if part is None else part
    a = left.select("*", F.lit(1).alias("_side"), own.alias("_part"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in columns])
    b = right.select(*by, on, F.lit(0).alias("_side"), own.alias("_part"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*by, "_part").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(F.col("_side") == 0, F.struct(*[f"_{c}" for c in columns]))
    running = both.withColumn("_last", F.last(found, ignorenulls=True).over(before)).where("_side = 1")
    if part is not None:
        ends = both.groupBy(*by, "_part").agg(F.max_by(found, F.when(F.col("_side") == 0, F.col(on))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_q"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        same = F.col("_part").eqNullSafe(F.col("_q"))
        for i, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
        running = running.join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return running.select(*left.columns, *[F.col(f"_last._{c}").alias(c) for c in columns])
