"""The record: its schema, and columns for building and checking records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tags import printed, tags_of, topic_of

RECORD_SCHEMA = (
    "id string, stream_id string, topic string, tags map<string,string>, "
    "ts_ns bigint, ts timestamp, lwm_ns bigint, data string, num double"
)
RECORD_COLUMNS = ["id", "stream_id", "topic", "tags", "ts_ns", "ts", "lwm_ns", "data", "num"]
#: The topic of records that only move the watermark on.
HEARTBEAT = "_heartbeat"
#: The published form of a record.
JSON_SCHEMA = "id string, stream_id string, lwm bigint, timestamp bigint, data string"


def micros(ns: Column) -> Column:
    """Nanoseconds as a timestamp, cut to whole microseconds."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def with_time(df: DataFrame, ts_ns: Column, lwm_ns: Column | None = None) -> DataFrame:
    """Set ``ts_ns``, its microsecond timestamp ``ts`` and ``lwm_ns`` (the record's own time by default)."""
    out = df.withColumn("ts_ns", ts_ns).withColumn("ts", micros(F.col("ts_ns")))
    return out.withColumn("lwm_ns", F.col("ts_ns") if lwm_ns is None else lwm_ns)


def to_records(
    df: DataFrame,
    topic: str,
    id_col: Column,
    ts: Column,
    tags: dict[str, Column],
    num: Column | None = None,
    data: Column | None = None,
) -> DataFrame:
    """Records of ``topic`` from the rows of a table with a timestamp."""
    entries = [x for k, v in tags.items() for x in (F.lit(k), v.cast("string"))]
    tag_map = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    stamp = ts.cast("timestamp")
    value = F.lit(None).cast("double") if num is None else num.cast("double")
    return df.select(
        id_col.cast("string").alias("id"),
        printed(F.lit(topic), tag_map).alias("stream_id"),
        F.lit(topic).alias("topic"),
        tag_map.alias("tags"),
        (F.unix_micros(stamp) * 1000).alias("ts_ns"),
        stamp.alias("ts"),
        (F.unix_micros(stamp) * 1000).alias("lwm_ns"),
        (value.cast("string") if data is None else data.cast("string")).alias("data"),
        value.alias("num"),
    )


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def create_records(df: DataFrame, stream_id: str, data: Column) -> DataFrame:
    """Raw records of now, with fresh ids; the payload stays a string."""
    if not stream_id:
        raise ValueError("a record needs a stream id")
    sid = F.lit(stream_id)
    return df.select(
        F.uuid().alias("id"),
        sid.alias("stream_id"),
        topic_of(sid).alias("topic"),
        tags_of(sid).alias("tags"),
        now_ns().alias("ts_ns"),
        F.current_timestamp().alias("ts"),
        now_ns().alias("lwm_ns"),
        data.cast("string").alias("data"),
        F.lit(None).cast("double").alias("num"),
    )


def create_record(spark: SparkSession, stream_id: str, data: str) -> DataFrame:
    return create_records(spark.range(1), stream_id, F.lit(data))


def records_from_json(df: DataFrame, value: Column, fresh: bool = True) -> DataFrame:
    """Records from JSON texts; those without stream id, with parentheses in it or without time are dropped.

    ``fresh`` gives new ids and a low watermark of now, as a publisher's records
    get; without it the stored ones are kept.
    """
    parsed = df.select(F.from_json(value, JSON_SCHEMA).alias("r"), F.get_json_object(value, "$.data").alias("raw"))
    r = F.col("r")
    valid = (
        r.isNotNull()
        & (F.coalesce(r["stream_id"], F.lit("")) != "")
        & ~F.rlike(r["stream_id"], F.lit(r"[()]"))
        & (F.coalesce(r["timestamp"], F.lit(0)) != 0)
    )
    ns = r["timestamp"]
    return parsed.where(valid).select(
        (F.uuid() if fresh else r["id"]).alias("id"),
        r["stream_id"].alias("stream_id"),
        topic_of(r["stream_id"]).alias("topic"),
        tags_of(r["stream_id"]).alias("tags"),
        ns.alias("ts_ns"),
        micros(ns).alias("ts"),
        (now_ns() if fresh else r["lwm"]).alias("lwm_ns"),
        F.coalesce(r["data"], F.col("raw")).alias("data"),
        F.col("raw").try_cast("double").alias("num"),
    )


def as_json(df: DataFrame) -> Column:
    """The published form of each record of ``df``."""
    return F.to_json(
        F.struct("id", "stream_id", F.col("lwm_ns").alias("lwm"), F.col("ts_ns").alias("timestamp"), "data")
    )
