"""Durable intermediate tables and the reading of input tables.

Every cut of lineage is a Parquet table below ``spark.checkpoint.dir``, the folder that the
cluster shares between the driver and the executors. Where a session names none, a local folder is made
and set if driver and executors are one process (tests, a laptop); on a cluster that is an error.
"""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}
_MADE: list[str] = []  #: paths that this driver has given out


def let(value: Column, body) -> Column:
    """body(value), with the value computed once; a plain column would be written into a lambda and evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a new local one where a session in one process has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="loamgrid-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/loamgrid/{uuid.uuid4().hex}/{name}")
    return _MADE[-1]


@contextmanager
def tidied(spark: SparkSession):
    """Removes at its end all paths that were given out inside it. Nothing that reads them may be run afterwards."""
    first = len(_MADE)
    yield
    for path in _MADE[first:]:
        remove(spark, path.rsplit("/", 1)[0])
    del _MADE[first:]


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes the frame to a path and returns the reading of it."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``written`` to a path of its own in the shared folder."""
    return written(df, scratch(df.sparkSession, name), codec)


def store_and_sum(df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, dict]:
    """``store``, with aggregates over all rows from the same pass."""
    seen = Observation()
    found = store(df.observe(seen, *sums), name)
    return found, seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, so that it works on any store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
