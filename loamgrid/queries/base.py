"""What the queries share: the registry, derived geometry, and their SQL twins.

Doubles are returned as rounded integers (``q``), so that engines agree bit for bit; sums are of rounded rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import measure as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(v: Column, scale: float = 1e2) -> Column:
    return F.floor(v * scale + 0.5).cast("long")


def undecided(v: Column, scale: float = 1e2) -> Column:
    """Whether ``q`` of a value hangs on its last bits, in which engines' functions differ."""
    return F.abs(v * scale - F.floor(v * scale) - 0.5) < 1e-4


def sq(v: str, scale: str = "1e2") -> str:
    return f"CAST(floor(({v}) * {scale} + 5e-1) AS BIGINT)"


def lng(key: str = "o_orderkey") -> Column:
    return ((F.col(key) * 7919 + 104729) % 360000) / 1e3 - 180.0


def lat(key: str = "o_orderkey") -> Column:
    return ((F.col(key) * 6101 + 7) % 170000) / 1e3 - 85.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lng, lat) of every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), lng().alias("lng"), lat().alias("lat"))


PTS = "(SELECT o_orderkey AS k, ((o_orderkey*7919+104729) % 360000)/1e3 - 180e0 AS lng, ((o_orderkey*6101+7) % 170000)/1e3 - 85e0 AS lat FROM orders)"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, x, y) of every line item: the order's place and an offset in quarters, exact in binary."""
    i = table(spark, sf_dir, "lineitem")
    x = F.floor(((F.col("l_orderkey") * 7919 + 104729) % 360000) / 1e3) - 180.0 + (F.col("l_partkey") % 64) / 4.0
    y = F.floor(((F.col("l_orderkey") * 6101 + 7) % 170000) / 1e3) - 85.0 + (F.col("l_suppkey") % 32) / 4.0
    return i.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x"), y.alias("y"))


VTX = "(SELECT l_orderkey AS k, l_linenumber AS n, floor(((l_orderkey*7919+104729) % 360000)/1e3) - 180e0 + (l_partkey % 64)/4e0 AS x, floor(((l_orderkey*6101+7) % 170000)/1e3) - 85e0 + (l_suppkey % 32)/4e0 AS y FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, line): the vertices of each order in the order of their numbers."""
    each = F.array_sort(F.collect_list(F.struct("n", "x", "y")))
    return vertices(spark, sf_dir).groupBy("k").agg(F.transform(each, lambda v: M.point(v["x"], v["y"])).alias("line"))


#: (k, v): v is a list of structs in the same order.
LNS = f"(SELECT k, list({{'n': n, 'x': x, 'y': y}} ORDER BY n, x, y) AS v FROM {VTX} GROUP BY k)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, xmin, ymin, xmax, ymax): a box at each order's place, sides from its customer and price."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), lng().alias("xmin"), lat().alias("ymin"), (lng() + (F.col("o_custkey") % 16 + 1) / 4.0).alias("xmax"), (lat() + (F.col("o_orderkey") % 8 + 1) / 4.0).alias("ymax"))


BXS = "(SELECT o_orderkey AS k, ((o_orderkey*7919+104729) % 360000)/1e3 - 180e0 AS xmin, ((o_orderkey*6101+7) % 170000)/1e3 - 85e0 AS ymin, ((o_orderkey*7919+104729) % 360000)/1e3 - 180e0 + (o_custkey % 16 + 1)/4e0 AS xmax, ((o_orderkey*6101+7) % 170000)/1e3 - 85e0 + (o_orderkey % 8 + 1)/4e0 AS ymax FROM orders)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, r, v): a raster of 64 x 64 from line items; the largest value of each pixel."""
    i = table(spark, sf_dir, "lineitem")
    return i.groupBy((F.col("l_orderkey") % 64).alias("c"), (F.col("l_partkey") % 64).alias("r")).agg(F.max("l_quantity").alias("v"))


PXS = "(SELECT l_orderkey % 64 AS c, l_partkey % 64 AS r, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def hilbert_sql(source: str, x: str, y: str, order: int, keep: str) -> str:
    """A subquery with ``keep`` and d, the Hilbert distance of (x, y): the steps written out."""
    inner = f"(SELECT {keep}, CAST({x} AS BIGINT) AS hx, CAST({y} AS BIGINT) AS hy, CAST(0 AS BIGINT) AS d FROM {source})"
    for k in range(order - 1, -1, -1):
        s, m = 1 << k, (1 << k) - 1
        rx, ry = f"((hx // {s}) % 2)", f"((hy // {s}) % 2)"
        lx, ly = f"(hx % {s})", f"(hy % {s})"
        fx, fy = (f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN {m} - {v} ELSE {v} END)" for v in (lx, ly))
        inner = f"(SELECT {keep}, CASE WHEN {ry} = 0 THEN {fy} ELSE {fx} END AS hx, CASE WHEN {ry} = 0 THEN {fx} ELSE {fy} END AS hy, d + CAST({s * s} AS BIGINT) * xor(3 * {rx}, {ry}) AS d FROM {inner})"
    return f"(SELECT {keep}, d FROM {inner})"
