"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, all else stays; ASCII texts take the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where it is unset and all of Spark runs in this one process, as in
    tests, a temporary folder takes its place; a cluster has to name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="streamloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def release_memory() -> None:
    """Give freed memory of this worker process back, so that an idle worker is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, kind: str = "scratch") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files that all executors see."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_left_join(
    left: DataFrame, right: DataFrame, key: str, salt_by: Column, hot_rows: int = 20_000
) -> DataFrame:
    """Left join on ``key`` (unique in ``right``) where any key may hold a large part of ``left``.

    Keys with more than ``hot_rows`` rows are counted first; there are at most
    ``rows / hot_rows`` of them.  Their left rows are dealt over salts by
    ``salt_by`` and the partition they lie in, and their right row is repeated
    for each salt.
    """
    spark = left.sparkSession
    k, n, s = fresh(left, "_sk"), fresh(left, "_sn"), fresh(left, "_ss")
    hot = (
        left.groupBy(F.col(key).alias(k))
        .agg(F.count(F.lit(1)).alias(n))
        .where(F.col(n) > hot_rows)
        .select(k, F.ceil(F.col(n) / hot_rows).cast("int").alias(n))
    )
    hot = materialize(hot, "hot")
    n_hot = hot.count()
    if not n_hot:
        return left.join(right, key, "left")
    small = F.broadcast(hot) if n_hot <= 100_000 else hot
    dealt = (
        left.join(small, left[key] == hot[k], "left")
        .withColumn(s, F.pmod(F.xxhash64(salt_by, F.spark_partition_id()), F.coalesce(F.col(n), F.lit(1))).cast("int"))
        .drop(k, n)
    )
    copies = (
        right.join(small, right[key] == hot[k], "left")
        .withColumn(s, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)))
        .drop(k, n)
    )
    return dealt.join(copies, [key, s], "left").drop(s)
