"""A dataset's profile: counts, extent, kinds, and for each attribute nulls, range, distinct and top values.

Two passes whatever the number of columns: one aggregate over all columns, and one grouping of unpivoted
values that is combined in each task. Floats, binary and XML have no distinct count; a column of more
than ``distinct_limit`` values has neither count nor top values.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions.geometry import st_bbox, st_kind
from loamgrid.functions.measure import BOX, finite
from loamgrid.functions.values import is_hashable, report_json, type_name

TOP_N, SAMPLE_N, DISTINCT_LIMIT = 10, 5, 10_000
ORDERED = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType, T.ByteType)


def geometry_of(df: DataFrame) -> str | None:
    return next((f.name for f in df.schema if f.metadata.get("geometry")), None)


def attributes(df: DataFrame, geometry: str | None) -> list[T.StructField]:
    hidden = {geometry, "fid", "_row", *(BOX if geometry else ())}
    return [f for f in df.schema if f.name not in hidden]


def top_values(df: DataFrame, names: list[str], top_n: int = TOP_N, distinct_limit: int = DISTINCT_LIMIT) -> DataFrame:
    """(name, distinct, rank, value, count): the most frequent values of each column, the smaller first on ties."""
    kinds = {f.name: f.dataType for f in df.schema}
    values = F.array(*[F.struct(F.lit(n).alias("name"), report_json(F.col(f"`{n}`"), kinds[n]).alias("value")) for n in names])
    each = df.select(F.explode(values).alias("v")).select("v.*").where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))
    numeric = [n for n in names if isinstance(kinds[n], ORDERED)]
    number = F.when(F.col("name").isin(numeric), F.expr("try_cast(value as double)")) if numeric else F.lit(None).cast("double")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("count"), number.asc_nulls_last(), "value")))
    sizes = each.groupBy("name").agg(F.count(F.lit(1)).alias("distinct"))
    return ranked.where(F.col("rank") <= top_n).join(F.broadcast(sizes), "name").where(F.col("distinct") <= distinct_limit).select("name", "distinct", "rank", "value", "count")


def statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, nulls, values, min, max) of each column; NaN is left out of the range."""
    kinds = {f.name: f.dataType for f in df.schema}
    aggregates = []
    for n in names:
        c, k = F.col(f"`{n}`"), kinds[n]
        ordered = isinstance(k, ORDERED)
        good = F.when(~F.isnan(c), c) if isinstance(k, T.FloatType | T.DoubleType) else c
        low, high = (F.min(good).cast("string"), F.max(good).cast("string")) if ordered else (F.lit(None).cast("string"),) * 2
        aggregates.append(F.struct(F.lit(n).alias("name"), F.count_if(c.isNull()).alias("nulls"), F.count(c).alias("values"), low.alias("min"), high.alias("max")).alias(n))
    one = df.agg(F.array(*aggregates).alias("s"))
    return one.select(F.explode("s").alias("s")).select("s.*")


def extent_of(df: DataFrame, geometry: str) -> DataFrame:
    """One row: xmin .. ymax of the finite coordinates, from the covering columns if there are any."""
    box = df if set(BOX) <= set(df.columns) else df.select(st_bbox(F.col(f"`{geometry}`")).alias("e")).select(*[F.col(f"e.{n}").alias(n) for n in BOX])
    good = reduce(lambda a, b: a & b, [finite(F.col(n)) for n in BOX])
    return box.agg(*[(F.min if n.endswith("min") else F.max)(F.when(good, F.col(n))).alias(n) for n in BOX])


def kinds_of(df: DataFrame, geometry: str) -> DataFrame:
    """(kind, count); null geometry has the kind null."""
    return df.groupBy(st_kind(F.col(f"`{geometry}`")).alias("kind")).agg(F.count(F.lit(1)).alias("count"))


def head(df: DataFrame, n: int = SAMPLE_N) -> DataFrame:
    return df.limit(n) if "_row" not in df.columns else df.orderBy("_row").limit(n)


def profile(df: DataFrame, top_n: int = TOP_N, sample_n: int = SAMPLE_N, distinct_limit: int = DISTINCT_LIMIT) -> dict:
    """The whole report."""
    geometry = geometry_of(df)
    fields = attributes(df, geometry)
    names = [f.name for f in fields]
    out: dict = {"feature_count": df.count()}
    if geometry:
        kinds = {r["kind"]: r["count"] for r in kinds_of(df, geometry).collect()}
        row = extent_of(df, geometry).first()
        out["geometry"] = {"null_count": kinds.pop(None, 0), "kinds": kinds, "extent": None if row[0] is None else list(row), "epsg": df.schema[geometry].metadata.get("epsg")}
    stats = {r["name"]: r for r in statistics(df, names).collect()} if names else {}
    counted = [f.name for f in fields if is_hashable(f)]
    tops: dict[str, list] = {}
    for r in top_values(df, counted, top_n, distinct_limit).orderBy("name", "rank").collect() if counted else []:
        tops.setdefault(r["name"], []).append(r)
    out["fields"] = []
    for f in fields:
        s, t = stats[f.name], tops.get(f.name)
        number = _number(f.dataType)
        distinct = (t[0]["distinct"] if t else 0 if s["values"] == 0 else None) if f.name in counted else None
        out["fields"].append({"name": f.name, "type": type_name(f), "nullable": f.nullable, "null_count": s["nulls"], "value_count": s["values"], "min": number(s["min"]), "max": number(s["max"]), "distinct": distinct, "top": [{"value": number(r["value"]), "count": r["count"]} for r in t or []]})
    rows = head(df.select(*names, *([F.hex(geometry).alias(geometry)] if geometry else [])), sample_n).collect() if sample_n else []
    out["sample"] = [r.asDict(recursive=True) for r in rows]
    return out


def _number(kind: T.DataType):
    if isinstance(kind, T.ShortType | T.IntegerType | T.LongType | T.ByteType):
        return lambda v: None if v is None else int(v)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return lambda v: None if v is None else float(v)
    return lambda v: v
