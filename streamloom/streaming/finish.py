"""Live queries run to the end of what their source has now."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or, where all of Spark is one process, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/live-{uuid.uuid4().hex}"


def to_end(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A query of all that is there, appended to a table of files; it ends by itself."""
    writer = records.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def finished(records: DataFrame) -> DataFrame:
    """What a live query has emitted when it has read all that is there, as a batch."""
    spark = records.sparkSession
    folder = shared_folder(spark)
    to_end(records, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(records.schema).parquet(f"{folder}/out")
