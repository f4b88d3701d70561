"""What the operators of this package share: the shared scratch folder and small DataFrame helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lets Spark delete the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Where that is unset, a temporary folder is made and kept in the
    session's own setting, on a local master only: on a cluster no other machine would see it, so it is
    an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.keyloom.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
        spark.conf.set("spark.keyloom.scratch", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's part of the shared folder, which is deleted when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/keyloom/{spark.sparkContext.applicationId}"
    fs, p = _fs(spark, root)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path: lineage ends there and survives lost executors.

    The shuffle files of the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def give_back() -> None:
    """Return to the machine what this process has freed and its allocators still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


class Held:
    """What a Python worker makes of broadcast content, kept with it.

    Spark drops a broadcast value from a worker when a task comes that doesn't use it, and what was made of
    it goes too; so the tables of one stage take no memory from the next.
    """

    def __init__(self, content) -> None:
        self.content, self._made = content, None

    def __getstate__(self):
        return self.content

    def __setstate__(self, content) -> None:
        self.content, self._made = content, None

    def get(self, make):
        if self._made is None:
            give_back()
            self._made = make(self.content)
            give_back()
        return self._made


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
