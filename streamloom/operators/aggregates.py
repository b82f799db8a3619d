"""Time-bucket aggregates and the registry through which computations are added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_ns, bucket_window, window_label_ns
from ..functions.numbers import number_of
from ..functions.tags import printed
from ..model import micros


def _extreme(pick: Callable[[Column], Column], none: float) -> Callable[[Column], Column]:
    """A minimum or maximum that NaN never wins."""
    return lambda v: F.coalesce(pick(F.when(~F.isnan(v), v)), F.lit(none))


@dataclass(frozen=True)
class Bucketed:
    """An aggregate of the values of a bucket; ``build`` maps a number column to an aggregate column."""

    build: Callable[[Column], Column]


AGGREGATES: dict[str, Bucketed] = {
    "avg": Bucketed(F.avg),
    "sum": Bucketed(F.sum),
    "min": Bucketed(_extreme(F.min, float("inf"))),
    "max": Bucketed(_extreme(F.max, float("-inf"))),
    "count": Bucketed(lambda v: F.count(F.lit(1))),
}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Make ``name(stream, period)`` known; ``build`` may return a built-in or a grouped pandas UDF over the column."""
    if not name.isidentifier() or name in ("match", "alarm"):
        raise ValueError(f"not a name for a computation: {name!r}")
    AGGREGATES[name] = Bucketed(build)


def _records(grouped: DataFrame, keys: list[str], stream_id: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Aggregated rows as records: the label is the time, the id follows from stream, keys and label."""
    tags = (
        F.create_map(*[x for k in keys for x in (F.lit(k.removeprefix("by_")), F.col(k))])
        if keys
        else F.create_map().cast("map<string,string>")
    )
    sid = printed(F.lit(stream_id), tags)
    return grouped.select(
        F.concat_ws("@", sid, F.col("ts_ns").cast("string")).alias("id"),
        sid.alias("stream_id"),
        F.lit(stream_id).alias("topic"),
        tags.alias("tags"),
        "ts_ns",
        micros(F.col("ts_ns")).alias("ts"),
        F.col("ts_ns").alias("lwm_ns"),
        F.col("value").cast("string").alias("data"),
        F.col("value").cast("double").alias("num"),
        *keys,
        *also,
    )


def aggregate(
    records: DataFrame, name: str, period_ns: int, stream_id: str, keys: list[str], closed_only: bool = False
) -> DataFrame:
    """One record for each bucket and keys of a batch.

    ``closed_only`` leaves out the buckets that a live stream would still hold
    open: those not more than a period behind the newest low watermark.
    """
    built = AGGREGATES[name].build(F.col("_v"))
    with_bucket = records.select(
        bucket_ns(F.col("ts_ns"), period_ns).alias("_bucket"), number_of(F.col("data"), F.col("num")).alias("_v"), "lwm_ns", *keys
    )
    grouped = with_bucket.groupBy("_bucket", *keys).agg(built.alias("value"), F.max("lwm_ns").alias("_lwm"))
    if closed_only:
        newest = records.agg(F.max("lwm_ns").alias("_newest"))
        newest_ns = newest.first()[0]
        grouped = grouped.where(F.col("_bucket") + F.lit(period_ns) < F.lit(newest_ns).cast("long"))
    return _records(grouped.withColumnRenamed("_bucket", "ts_ns"), keys, stream_id)


def aggregate_stream(
    records: DataFrame, name: str, period_ns: int, stream_id: str, keys: list[str], event_time: str, shift_us: int
) -> tuple[DataFrame, str, int]:
    """The streaming form: (records, their event-time column, its distance from the label).

    The watermark column of the result is the window's own, so that a further
    aggregate can be put on top.
    """
    built = AGGREGATES[name].build(F.col("_v"))
    window = bucket_window(F.col(event_time), period_ns, shift_us)
    grouped = (
        records.withColumn("_v", number_of(F.col("data"), F.col("num")))
        .groupBy(window.alias("_window"), *keys)
        .agg(built.alias("value"))
        .withColumn("_event", F.window_time("_window"))
        .withColumn("ts_ns", window_label_ns(F.col("_window"), period_ns, shift_us))
    )
    return _records(grouped, keys, stream_id, ("_event",)), "_event", shift_us + period_ns // 2000 - 1
