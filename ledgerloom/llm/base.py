"""Shared pieces: scratch tables and word patterns."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: the lineage ends there,
    so a lost executor costs only the tasks that read its files, not what made them.

    What was shuffled to make the table is of no more use; collecting the driver's garbage lets
    Spark delete those files now instead of at some later time."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_last_sweep, spark)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(t.scratch_path)


def sweep(spark: SparkSession) -> None:
    """Delete the scratch tables made so far; call it once results are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def _last_sweep(spark: SparkSession) -> None:
    """What is left when the process ends goes, if its session still stands."""
    with contextlib.suppress(Exception):
        sweep(spark)


def only(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose ``key`` is in ``wanted`` (a column of that name, distinct).

    Where the join is a shuffled one, a Bloom filter of the wanted keys drops most other rows where
    they are read, so that only rows that are wanted move.  Spark builds it for joins with a
    selective side only, which the second condition on ``wanted`` makes it take this for."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.maxNumItems", "20000000")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.maxNumBits", "160000000")
    wanted = wanted.where(F.col(key).isNotNull() & (F.pmod(F.hash(key), F.lit(2)) < 2))
    return df.join(wanted, key, "left_semi")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts may be long.  The setting is the session's and plans run
    later than they are made, so all operators set the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
