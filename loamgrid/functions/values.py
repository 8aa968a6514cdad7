"""Conversions of single values: day numbers, hexadecimal, sizes, names of types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIX_EPOCH_DAYS = 25569.0  #: from 1899-12-30 to 1970-01-01
DAY_MICROS = 86_400_000_000.0


def days_to_micros(days: Column) -> Column:
    """Days since 1899-12-30 to microseconds since 1970, truncated towards zero."""
    return ((days - UNIX_EPOCH_DAYS) * DAY_MICROS).cast("long")


def days_to_timestamp(days: Column) -> Column:
    return F.timestamp_micros(days_to_micros(days))


def micros_to_days(micros: Column) -> Column:
    return micros / DAY_MICROS + UNIX_EPOCH_DAYS


def timestamp_to_days(ts: Column) -> Column:
    return micros_to_days(F.unix_micros(ts.cast("timestamp")))


def date_to_days(year: Column, month: Column, day: Column) -> Column:
    """A calendar date as days since 1899-12-30; null for a date that does not exist."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit("1899-12-30").cast("date")).cast("double")


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def degrees_to_e7(v: Column) -> Column:
    """Ten millionths of a degree, rounded and clamped to an int."""
    top = float(2**31 - 1)
    return F.greatest(F.lit(-top - 1), F.least(F.lit(top), F.round(v * 1e7))).cast("int")


def json_text(doc: Column, path: str) -> Column:
    """A member of a JSON text: strings as they are, anything else serialised."""
    return F.get_json_object(doc, path)


def human_bytes(n: int) -> str:
    size = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024 or unit == "GB":
            return f"{n} B" if unit == "B" else f"{size:.2f} {unit}"
        size /= 1024
    raise AssertionError


#: Names of attribute types in reports.
TYPE_NAMES = {T.BooleanType: "Bool", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "String", T.BinaryType: "Binary", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.NullType: "Null"}
#: Types whose distinct values a profile counts.
HASHABLE = (T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.ByteType, T.DecimalType)


def type_name(field: T.StructField) -> str:
    if field.metadata.get("guid"):
        return "Guid"
    if field.metadata.get("xml"):
        return "Xml"
    return TYPE_NAMES.get(type(field.dataType), field.dataType.simpleString())


def is_hashable(field: T.StructField) -> bool:
    return isinstance(field.dataType, HASHABLE) or bool(field.metadata.get("guid"))


def byte_estimate(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory: a base, then texts and binary (geometry among them) by their length, other values by eight."""
    each = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 24 if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) for f in schema]
    return sum(each, F.lit(64)).cast("long")


def report_json(c: Column, kind: T.DataType) -> Column:
    """A value for a report: binary as hexadecimal, numbers that are not finite as null."""
    if isinstance(kind, T.BinaryType):
        return hex_lower(c)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
    return c.cast("string")


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with exactly the schema's columns, types and nullability; a row that breaks it is an error."""
    out = df.to(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema]))
    for f in schema:
        if not f.nullable:
            out = out.withColumn(f.name, F.when(F.col(f"`{f.name}`").isNotNull(), F.col(f"`{f.name}`")).otherwise(F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType)))
    return out
