"""The two demonstration maps: a numbered one and a stateless one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def foo(records: DataFrame, keys: list[str]) -> DataFrame:
    """``fooized: <data>, state: <n>``, n counting the records in time order from 1."""
    text = F.concat(F.lit("fooized: "), F.col("data"), F.lit(", state: "), F.col("_n").cast("string"))
    out = numbered(records, keys, "_n").withColumn("data", text).withColumn("num", F.lit(None).cast("double"))
    return out.withColumn("id", F.concat(F.lit("foo:"), "id")).drop("_n")


def bar(records: DataFrame) -> DataFrame:
    """``barized: <data>``; the record keeps its id."""
    return records.withColumn("data", F.concat(F.lit("barized: "), "data")).withColumn(
        "num", F.lit(None).cast("double")
    )
