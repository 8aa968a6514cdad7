"""Access to a layer's fields: by place and by name, with alias and width as metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.core.errors import SchemaError


def field(schema: T.StructType, i: int) -> T.StructField:
    if not 0 <= i < len(schema):
        raise SchemaError(f"no field {i} of {len(schema)}")
    return schema[i]


def field_index(schema: T.StructType, name: str) -> int | None:
    """Exact and case-sensitive; of fields of one name the last."""
    found = [i for i, f in enumerate(schema) if f.name == name]
    return found[-1] if found else None


def field_by_name(schema: T.StructType, name: str) -> T.StructField | None:
    i = field_index(schema, name)
    return None if i is None else schema[i]


def described(df: DataFrame, name: str, alias: str | None = None, width: int | None = None) -> DataFrame:
    """The frame with an alias and a width on a column."""
    meta = dict(df.schema[name].metadata)
    meta |= {k: v for k, v in (("alias", alias), ("width", width)) if v is not None}
    return df.withMetadata(name, meta)


def attribute(df: DataFrame, i: int) -> Column:
    """A cell by its place."""
    return F.col(f"`{field(df.schema, i).name}`")


def type_tag(c: Column) -> Column:
    """The type of a value; of an untyped null ``void``."""
    return F.typeof(c)
