"""GeoParquet: Parquet with WKB geometry, covering columns and a ``geo`` key in the footer.

Reading is Spark's own scan, so that columns are pruned and box filters reach the row groups; the footer is
read on the driver through Hadoop's file system. Writing goes through an Arrow writer for each task,
because Spark's Parquet writer takes no footer keys; files appear under their names only at commit.
"""

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loamgrid.core.errors import GeoParquetError, SchemaError
from loamgrid.functions import crs as C
from loamgrid.functions.geometry import st_bbox
from loamgrid.functions.index import ORDER, hilbert_key
from loamgrid.functions.measure import BOX, union_bbox
from loamgrid.sources.files import local_path, scratch

#: Names that geometry columns go by, in the order they are looked for.
GEOMETRY_NAMES = ("geometry", "geom", "SHAPE", "wkb_geometry", "the_geom", "shape")
BATCH_ROWS, COMPRESSION, LEVEL = 10_000, "zstd", 3


def geo_metadata(spark: SparkSession, path: str) -> dict:
    """The ``geo`` key of the first file's footer; empty if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(conf)
    if store.getFileStatus(where).isDirectory():
        files = sorted(str(s.getPath()) for s in store.listStatus(where) if str(s.getPath()).endswith(".parquet"))
        if not files:
            return {}
        where = jvm.org.apache.hadoop.fs.Path(files[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        found = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(found) if found else {}


def parse_geo(meta: dict) -> tuple[str | None, int | None, list[str]]:
    """(primary column, EPSG code, geometry types)."""
    name = meta.get("primary_column")
    column = (meta.get("columns") or {}).get(name) or {}
    code = C.epsg_of(column.get("crs")) if "crs" in column else (4326 if column else None)
    return name, code, column.get("geometry_types") or []


def is_flat_bbox(f: T.StructField) -> bool:
    return f.name in BOX and isinstance(f.dataType, T.FloatType | T.DoubleType)


def is_bbox_struct(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StructType) and len(f.dataType) == 4 and {g.name for g in f.dataType} == set(BOX) and all(isinstance(g.dataType, T.FloatType | T.DoubleType) for g in f.dataType)


def geometry_column(schema: T.StructType, meta: dict) -> str | None:
    primary = parse_geo(meta)[0]
    if primary in schema.fieldNames():
        return primary
    binary = {f.name for f in schema if isinstance(f.dataType, T.BinaryType)}
    return next((n for n in GEOMETRY_NAMES if n in binary), None)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, covering: bool = False, place: str | None = None) -> DataFrame:
    """The layer: geometry with its metadata, and the attributes. Covering columns are hidden, unless asked for.

    box: keeps rows whose envelope touches it. Files with flat covering columns are filtered in the scan.
    place: name of a column with the file and the place in it of each row, which sorts as the rows lie.
    """
    df, meta = spark.read.parquet(path), geo_metadata(spark, path)
    if place:
        df = df.withColumn(place, F.struct("_metadata.file_path", "_metadata.row_index"))
    name = geometry_column(df.schema, meta)
    _, code, kinds = parse_geo(meta)
    flat = {f.name for f in df.schema if is_flat_bbox(f)}
    structs = [f.name for f in df.schema if is_bbox_struct(f)]
    if box is not None:
        df = df.where(box_predicate(df, box, name, flat, structs))
    hidden = [] if covering else [*(flat if name else ()), *structs]
    df = df.drop(*hidden)
    if name:
        df = df.withMetadata(name, {"geometry": True, "kind": kinds[0] if kinds else "Polygon", **C.metadata(code)})
    return df


def box_predicate(df: DataFrame, box: tuple, name: str | None, flat: set[str], structs: list[str]) -> Column:
    x0, y0, x1, y1 = map(float, box)
    if flat >= set(BOX):
        a, b, c, d = (F.col(n) for n in BOX)
    elif structs:
        a, b, c, d = (F.col(f"{structs[0]}.{n}") for n in BOX)
    elif name:
        e = st_bbox(F.col(name))
        a, b, c, d = (e[n] for n in BOX)
    else:
        raise SchemaError("no geometry to filter by")
    return (a <= x1) & (c >= x0) & (b <= y1) & (d >= y0)


def extent(spark: SparkSession, path: str) -> tuple[float, float, float, float] | None:
    """Envelope of a dataset with flat covering columns, from the footers' statistics alone.

    Null if a column is missing. The version-2 scan answers minima and maxima from the footers.
    """
    if not set(BOX) <= set(spark.read.parquet(path).columns):
        return None
    keys = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        row = spark.read.parquet(path).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return None if row[0] is None else tuple(row)


# --- writing


def layout(df: DataFrame, geometry: str | None = None, keep_name: bool = False, add_bbox: bool = True) -> tuple[DataFrame, str]:
    """Columns in file order: geometry, attributes, covering columns. Empty geometry becomes null."""
    name = geometry or next((f.name for f in df.schema if f.metadata.get("geometry")), None) or geometry_column(df.schema, {})
    if not name or name not in df.columns:
        raise SchemaError("no geometry column")
    target = name if keep_name else "geometry"
    others = [c for c in df.columns if c != name and c not in BOX]
    if target in others:
        raise SchemaError(f"an attribute is called {target} as well")
    meta = df.schema[name].metadata
    e = st_bbox(F.col(f"`{name}`"))
    out = df.withColumn("_e", e).select(F.when(F.col("_e").isNotNull(), F.col(f"`{name}`")).alias(target, metadata=meta), *[F.col(f"`{c}`") for c in others], *([F.col(f"_e.{n}").alias(n) for n in BOX] if add_bbox else []))
    return out, target


def hilbert_sorted(df: DataFrame, files: int | None = None, place: str | None = None) -> DataFrame:
    """Rows with covering columns in the order of their centres along the curve over the whole extent.

    The rows are written once, since extent, ranges and sort read them three times. Ranges, then a sort inside
    each, both of which spill; rows without a box come last. Rows of one key stay in the order of ``place``, a
    column that is left out of the result; a scan of several files does not hand them out in their order, so that
    the order of the frame itself is taken only where there is none. A degenerate extent leaves the order as it was.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "layout")
    numbered = df.withColumnRenamed(place, "_row") if place else df.withColumn("_row", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    own = spark.read.schema(numbered.schema).parquet(path)
    row = own.agg(*union_bbox()).first()
    side = [F.lit(v) for v in row] if row[0] is not None else [F.lit(None).cast("double")] * 4
    key = hilbert_key((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, tuple(side), ORDER)
    with_key = own.withColumn("_h", F.coalesce(key, F.lit(1 << 32)))
    n = files or max(1, df.rdd.getNumPartitions())
    return with_key.repartitionByRange(n, "_h", "_row").sortWithinPartitions("_h", "_row").drop("_h", "_row")


def geo_json(name: str, kind: str | None, epsg: int | None, add_bbox: bool) -> str:
    column = {"encoding": "WKB", "geometry_types": [kind] if kind else [], "edges": "planar", "crs": C.projjson(epsg) if epsg else None}
    if add_bbox:
        column["covering"] = {"bbox": {n: [n] for n in BOX}}
    return json.dumps({"version": "1.1.0", "primary_column": name, "columns": {name: column}})


def write(df: DataFrame, path: str, geometry: str | None = None, keep_name: bool = False, add_bbox: bool = True, hilbert: bool = False, batch_rows: int = BATCH_ROWS, compression: str = COMPRESSION, epsg: int | None = None, files: int | None = None, place: str | None = None, mode: str = "overwrite") -> None:
    """place: of ``hilbert_sorted``."""
    spark = df.sparkSession
    out, name = layout(df, geometry, keep_name, add_bbox or hilbert)
    if hilbert:
        out = hilbert_sorted(out, files, place)
    meta = out.schema[name].metadata
    spark.dataSource.register(GeoParquetSink)
    geo = geo_json(name, meta.get("kind"), epsg or meta.get("epsg"), add_bbox or hilbert)
    out.write.format("loamgrid_geoparquet").option("path", path).option("geo", geo).option("rows", str(batch_rows)).option("codec", compression).mode(mode).save()


class GeoParquetSink(DataSource):
    """A folder of GeoParquet files, or one file where the path ends in a file name and there is one task."""

    @classmethod
    def name(cls) -> str:
        return "loamgrid_geoparquet"

    def schema(self) -> T.StructType:
        raise GeoParquetError("read through read()")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.geo, self.rows, self.codec, self.overwrite = options["path"], options["geo"], int(options["rows"]), options["codec"], overwrite
        self.batch = uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        local = local_path(self.path)
        return (fs.LocalFileSystem(), os.path.abspath(local)) if local is not None else fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = self._store()
        store.create_dir(base, recursive=True)
        name, rows, out, held = f"part-{uuid.uuid4().hex}.parquet", 0, None, []
        with store.open_output_stream(f"{base}/_{self.batch}-{name}") as sink:
            for batch in iterator:
                if out is None:
                    schema = batch.schema.with_metadata({b"geo": self.geo.encode()})
                    out = pq.ParquetWriter(sink, schema, compression=self.codec, compression_level=LEVEL if self.codec == "zstd" else None)
                held.append(batch)
                rows += batch.num_rows
                if sum(b.num_rows for b in held) >= self.rows:
                    out.write_table(pa.Table.from_batches(held).replace_schema_metadata(schema.metadata), row_group_size=self.rows)
                    held = []
            if out is not None:
                if held:
                    out.write_table(pa.Table.from_batches(held).replace_schema_metadata(schema.metadata), row_group_size=self.rows)
                out.close()
        if out is None:
            store.delete_file(f"{base}/_{self.batch}-{name}")
            return _Part("", 0)
        return _Part(name, rows)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = self._store()
        names = [m.name for m in messages if m and m.name]
        if self.overwrite and store.get_file_info(base).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.base_name.endswith(".parquet") and not f.base_name.startswith("_"):
                    store.delete_file(f.path)
        for i, name in enumerate(names):
            store.move(f"{base}/_{self.batch}-{name}", f"{base}/part-{i:05d}-{self.batch}.parquet")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, base = self._store()
        if store.get_file_info(base).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.base_name.startswith(f"_{self.batch}"):
                    store.delete_file(f.path)
