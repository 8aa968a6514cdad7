"""Where data lies: formats by name, bytes by path, and scratch folders.

Paths may be in any store that Hadoop knows. Executors read through ``read_bytes``: local paths directly,
others through the file systems that pyarrow knows. The driver can read through Spark itself.
"""

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from loamgrid.core.errors import ConvertError

#: Formats by the last extension, and what they hold.
FORMATS = {"gdb": "filegdb", "shp": "shapefile", "parquet": "geoparquet", "geojson": "geojson", "json": "geojson", "tif": "geotiff", "tiff": "geotiff", "cog": "geotiff", "jpg": "image", "jpeg": "image", "png": "image", "pmtiles": "pmtiles"}
RASTER = ("geotiff", "image")


def format_of(path: str) -> str:
    """By the last extension, in any case; none is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    if not dot or not stem:
        raise ConvertError(f"{path} has no extension")
    return format_of_extension(ext)


def format_of_extension(ext: str) -> str:
    found = FORMATS.get(ext.lower().lstrip("."))
    if not found:
        raise ConvertError(f"unknown format .{ext}")
    return found


def modality(fmt: str) -> str:
    return "raster" if fmt in RASTER else "vector"


def local_path(path: str) -> str | None:
    """The path on this machine, if the address says so."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path if url.scheme else path
    return None


def open_file(path: str):
    """A seekable file for reading, local or in a store that pyarrow knows."""
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def read_bytes(path: str, at: int = 0, n: int | None = None) -> bytes:
    with open_file(path) as f:
        f.seek(at)
        return f.read() if n is None else f.read(n)


def file_size(path: str) -> int:
    with open_file(path) as f:
        f.seek(0, 2)
        return f.tell()


def exists(path: str) -> bool:
    try:
        with open_file(path):
            return True
    except (OSError, FileNotFoundError):
        return False


def list_files(path: str, suffix: str) -> list[str]:
    """The path itself, or the files with the suffix in the folder."""
    local = local_path(path)
    if local is not None and os.path.isdir(local):
        return sorted(os.path.join(local, n) for n in os.listdir(local) if n.lower().endswith(suffix))
    return [path]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the cluster shares; a local one where there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ConvertError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loamgrid-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/loamgrid/{uuid.uuid4().hex}/{name}"


def driver_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file through Spark's own file systems."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Hadoop knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path if local_path(path) is None or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
