"""GeoJSON: one collection document, a bare feature or geometry, or one feature to a line.

A collection document is one partition for reading: its features are cut out one at a time with bounded
memory. The schema is inferred over the whole input, by a lattice of kinds for each property. Files of one
feature a line are read by Spark and split like any text.
"""

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamgrid.core import geometry as G
from loamgrid.core.errors import GeoJsonError, SchemaError
from loamgrid.functions import crs as C
from loamgrid.functions.geometry import st_as_geojson
from loamgrid.functions.values import hex_lower, timestamp_to_days
from loamgrid.sources.files import local_path, open_file

CHUNK = 1 << 16
LONG = 1 << 63


def features(path: str) -> Iterator[dict]:
    """Every feature of a document, in order; a bare feature or geometry is one."""
    with open_file(path) as f:
        yield from scan(f)


def scan(f) -> Iterator[dict]:
    header, stream = _head(f)
    if header.get("type") == "FeatureCollection":
        if stream is None:
            raise GeoJsonError("a collection without features")
        yield from stream
    elif header.get("type") == "Feature":
        yield header
    elif header.get("type") in G.CODES:
        yield {"type": "Feature", "geometry": header, "properties": None}
    else:
        raise GeoJsonError("neither a feature collection, a feature nor a geometry")


class _Text:
    """Characters of a stream, with a window that grows only to the value at hand."""

    def __init__(self, f):
        self.f, self.text, self.at, self.rest, self.end = f, "", 0, b"", False

    def more(self) -> bool:
        if self.end:
            return False
        raw = self.f.read(CHUNK)
        self.end = not raw
        raw = self.rest + raw
        cut = len(raw)
        if not self.end:  # a character may be cut at the end of the chunk
            for back in range(1, min(4, len(raw)) + 1):
                b = raw[-back]
                if b & 0xC0 == 0xC0:
                    need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                    cut = len(raw) - back if need > back else len(raw)
                    break
                if b < 0x80:
                    break
        self.rest = raw[cut:]
        self.text = self.text[self.at :] + raw[:cut].decode("utf-8")
        self.at = 0
        return True

    def peek(self) -> str:
        while True:
            while self.at < len(self.text):
                c = self.text[self.at]
                if c not in " \t\r\n﻿":
                    return c
                self.at += 1
            if not self.more():
                return ""

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise GeoJsonError(f"expected {c!r}, found {self.peek()!r}")
        self.at += 1

    def value(self) -> Any:
        """The next JSON value."""
        self.peek()
        decode = json.JSONDecoder().raw_decode
        while True:
            try:
                found, end = decode(self.text, self.at)
                if end < len(self.text) or self.end or self.text[end - 1] in '}]"':  # a number may go on
                    self.at = end
                    return found
            except ValueError as e:
                if self.end:
                    raise GeoJsonError(str(e)) from e
            self._grow()

    def _grow(self) -> None:
        have = len(self.text) - self.at
        while len(self.text) - self.at < 2 * have + CHUNK and self.more():
            pass


def _head(f) -> tuple[dict, Iterator[dict] | None]:
    """Members before the features, and the features themselves; all members of other documents."""
    text = _Text(f)
    if text.peek() != "{":
        raise GeoJsonError("the document is no object")
    text.take("{")
    header: dict = {}
    while text.peek() != "}":
        key = text.value()
        text.take(":")
        if key == "features" and text.peek() == "[":
            header.setdefault("type", "FeatureCollection")
            return header, _features(text)
        header[key] = text.value()
        if text.peek() == ",":
            text.take(",")
    return header, None


def _features(text: _Text) -> Iterator[dict]:
    text.take("[")
    while text.peek() != "]":
        yield text.value()
        if text.peek() == ",":
            text.take(",")
    text.take("]")


def crs_of(path: str) -> Any:
    """4326, or what a legacy ``crs`` member in front of the features says."""
    with open_file(path) as f:
        header, _ = _head(f)
    name = (((header.get("crs") or {}).get("properties")) or {}).get("name")
    return 4326 if name is None else C.epsg_of(name) or name


# --- schema

#: A property's kinds seen so far: null 0, bool 1, int 2, float 4, string 8, other 16.
NULL, BOOL, INT, FLOAT, STRING, OTHER = 0, 1, 2, 4, 8, 16


def kind_of(v: Any) -> int:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOL
    return INT if isinstance(v, int) else FLOAT if isinstance(v, float) else STRING if isinstance(v, str) else OTHER


def type_of(kinds: int) -> T.DataType:
    """Only booleans, only integers, or numbers keep their type; any other mix is text."""
    if kinds == BOOL:
        return T.BooleanType()
    if kinds == INT:
        return T.LongType()
    return T.DoubleType() if kinds in (FLOAT, INT | FLOAT) else T.StringType()


class Fields:
    """Properties in the order they are first seen, their kinds, and whether all features have them."""

    def __init__(self):
        self.kinds: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.n = 0
        self.geometries: set[str] = set()

    def observe(self, feature: dict) -> None:
        self.n += 1
        for k, v in (feature.get("properties") or {}).items():
            self.kinds[k] = self.kinds.get(k, 0) | kind_of(v)
            self.seen[k] = self.seen.get(k, 0) + (v is not None)
        if feature.get("geometry"):
            self.geometries.add(feature["geometry"].get("type"))

    def schema(self, crs: Any) -> T.StructType:
        kind = next(iter(self.geometries)) if len(self.geometries) == 1 else "GeometryCollection"
        meta = {"geometry": True, "kind": kind, **C.metadata(crs)}
        props = [T.StructField(k, type_of(v), self.seen[k] < self.n) for k, v in self.kinds.items()]
        clash = {"fid", "geometry"} & set(self.kinds)
        if clash:
            raise SchemaError(f"properties called {', '.join(sorted(clash))}")
        return T.StructType([T.StructField("fid", T.LongType()), T.StructField("geometry", T.BinaryType(), True, meta), *props])


def infer(found: Iterator[dict], crs: Any = 4326) -> T.StructType:
    fields = Fields()
    for f in found:
        fields.observe(f)
    return fields.schema(crs)


def value_as(v: Any, kind: T.DataType) -> Any:
    """A property as a column's type; what does not convert is null."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(v, bool) or not isinstance(v, int | float):
        return None
    if isinstance(kind, T.LongType):
        return int(v) if float(v).is_integer() and -LONG <= v < LONG else None
    return float(v)


def id_of(v: Any) -> int | None:
    """An integer, or text that is one."""
    if isinstance(v, str):
        try:
            v = int(v)
        except ValueError:
            return None
    return v if isinstance(v, int) and not isinstance(v, bool) and -LONG <= v < LONG else None


def row_of(feature: dict, schema: T.StructType) -> tuple:
    g = G.from_geojson(feature.get("geometry"))
    props = feature.get("properties") or {}
    return (id_of(feature.get("id")), None if g is None else G.to_wkb(g), *[value_as(props.get(f.name), f.dataType) for f in schema[2:]])


class GeoJsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loamgrid_geojson"

    def schema(self) -> T.StructType:
        return infer(features(self.options["path"]), crs_of(self.options["path"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.own = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for f in features(partition.value):
            yield row_of(f, self.own)


def read(spark: SparkSession, path: str) -> DataFrame:
    """fid, geometry and the properties of a document."""
    spark.dataSource.register(GeoJsonSource)
    schema = infer(features(path), crs_of(path))
    df = spark.read.format("loamgrid_geojson").schema(schema).option("path", path).load()
    return df.withMetadata("geometry", schema["geometry"].metadata)


def read_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One feature a line: split and read in parallel. Without a schema it is inferred by one pass over all lines."""
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", "\u001e", "")) != "")

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = Fields()
        for b in batches:
            for v in b.column(0).to_pylist():
                fields.observe(json.loads(v.lstrip("\x1e")))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([fields.kinds, fields.seen, fields.n, sorted(fields.geometries)])])], ["v"])

    if schema is None:
        total = Fields()
        for r in lines.mapInArrow(observe, "v string").collect():  # a row for each task
            kinds, seen, n, geometries = json.loads(r["v"])
            for k, v in kinds.items():
                total.kinds[k] = total.kinds.get(k, 0) | v
                total.seen[k] = total.seen.get(k, 0) + seen[k]
            total.n += n
            total.geometries |= set(geometries)
        schema = total.schema(4326)
    own = schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(own)
        for b in batches:
            rows = [row_of(json.loads(v.lstrip("\x1e")), own) for v in b.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], names=own.fieldNames())

    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return lines.mapInArrow(parse, nullable).withMetadata("geometry", schema["geometry"].metadata)


# --- writing


def feature_text(df: DataFrame, geometry: str = "geometry", fid: str | None = "fid") -> DataFrame:
    """(feature): each row as a compact feature. Nulls are kept; numbers that are not finite are null."""
    props = []
    for f in df.schema:
        if f.name in (geometry, fid):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = hex_lower(c)
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(~F.isnan(c) & (F.abs(c) < math.inf), c)
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = timestamp_to_days(c)
        props.append(c.alias(f.name))
    options = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(*props), options) if props else F.lit("{}")
    shape = F.coalesce(st_as_geojson(F.col(f"`{geometry}`")), F.lit("null")) if geometry in df.columns else F.lit("null")
    number = F.coalesce(F.concat(F.lit('"id":'), F.col(fid).cast("string"), F.lit(",")), F.lit("")) if fid and fid in df.columns else F.lit("")
    return df.select(F.concat(F.lit('{"type":"Feature",'), number, F.lit('"geometry":'), shape, F.lit(',"properties":'), body, F.lit("}")).alias("feature"))


def write(df: DataFrame, path: str, geometry: str = "geometry", fid: str | None = "fid") -> int:
    """One collection document; returns the number of features.

    Tasks write their features as text; the document is put together on the driver from the parts, a
    line at a time. For one feature a line, write ``feature_text`` itself.
    """
    import os
    import shutil
    import tempfile

    target = local_path(path)
    if target is None:
        raise SchemaError("one document can be written to a local path; write feature_text for other stores")
    folder = tempfile.mkdtemp(prefix="geojson-", dir=os.path.dirname(os.path.abspath(target)))
    n = 0
    try:
        feature_text(df, geometry, fid).write.mode("overwrite").text(f"file://{folder}/parts")
        with open(f"{target}.part", "w", encoding="utf-8") as out:
            out.write('{"type":"FeatureCollection","features":[')
            for name in sorted(x for x in os.listdir(f"{folder}/parts") if x.startswith("part-")):
                with open(f"{folder}/parts/{name}", encoding="utf-8", newline="\n") as part:
                    for line in part:
                        out.write(("," if n else "") + line.rstrip("\n"))
                        n += 1
            out.write("]}")
        os.replace(f"{target}.part", target)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return n


def collect_features(spark: SparkSession, path: str) -> list[Row]:
    """All rows, for tests and small files."""
    return read(spark, path).collect()
