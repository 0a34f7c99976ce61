"""Shared-folder tables and scalable row numbering."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Names this process's intermediate tables, so that they can be deleted together.
RUN = f"run-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own is fine on one machine, as in tests; on a cluster nobody else would see it, so
    that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="seamline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This process's part of the shared folder; deleted when the process ends in order."""
    path = f"{shared_dir(spark)}/seamline/{RUN}"
    if path not in _runs:
        _runs.add(path)
        atexit.register(_quietly, delete, spark, path)
    return path


_runs: set[str] = set()


def _quietly(f, *args) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        f(*args)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, whole or not at all: written under another name and moved into place."""
    where, files = _hadoop(spark, path)
    draft, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(data))
    stream.close()
    files.delete(where, False)
    if not files.rename(draft, where):
        raise OSError(f"could not move a file to {path}")


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """A small file, whole, unless there is one of that name: of several writers exactly one succeeds."""
    where, files = _hadoop(spark, path)
    draft, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(data))
    stream.close()
    sc = spark.sparkContext
    kinds = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(kinds, 1)
    how[0] = kinds.NONE
    try:
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), sc._jsc.hadoopConfiguration()).rename(draft, where, how)
        return True
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a folder; none if there is no such folder."""
    where, files = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def content(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, files = _hadoop(spark, path)
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back; cuts the lineage and survives lost executors."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more. Only folders of this process are touched."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/seamline/{RUN}/" in folder:
                delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now. Its cleaner waits for the driver's garbage collector, which in long runs of jobs with
    little garbage comes too late for the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: the row's place in the order of ``keys``, from ``start``.

    Not a window over everything, which would be one task: rows are range-partitioned, numbered where they are sorted within
    their partition, and shifted by the sizes of the partitions before (one small row each). The numbered ranges are written
    first, because range bounds come from a sample and must be the same for both uses.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    # The id is the partition's number above 33 bits of the row's number in it.
    ranged = written(ranged.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + start).alias("__before"))
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage that is at least 1 for any non-zero share."""
    raw = F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
    return F.when((raw > 0) & (js_round(raw) == 0), F.lit(1).cast("long")).otherwise(js_round(raw))
