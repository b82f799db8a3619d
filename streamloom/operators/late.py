"""Late records of a batch: those behind the newest low watermark seen before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SLICE, SLICE_ROWS, carried


def mark_late(records: DataFrame, arrival: str, keys: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``late``: True where the time is before the highest ``lwm_ns`` of earlier arrivals of the keys.

    ``arrival`` is a long that numbers the arrivals.
    """
    sliced = records.withColumn(SLICE, F.call_function("div", F.col(arrival), F.lit(slice_rows)))
    inside = Window.partitionBy(*keys, SLICE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    tops = sliced.groupBy(*keys, SLICE).agg(F.max("lwm_ns").alias("_top"))
    before = carried(tops, keys, {"_before": F.max("_top")})
    mark = F.greatest(F.max("lwm_ns").over(inside), F.col("_before"))
    joined = sliced.join(before, [*keys, SLICE])
    return joined.withColumn("late", F.coalesce(F.col("ts_ns") < mark, F.lit(False))).drop(SLICE, "_before")


def drop_late(records: DataFrame, arrival: str, keys: list[str], strict: bool = False) -> DataFrame:
    """Records that arrive in time; ``strict`` makes a late one an error."""
    marked = mark_late(records, arrival, keys)
    if strict:
        fail = F.raise_error(F.concat(F.lit("late record: "), F.col("id"))).cast("boolean")
        return marked.where(F.when(F.col("late"), fail).otherwise(F.lit(True))).drop("late")
    return marked.where(~F.col("late")).drop("late")
