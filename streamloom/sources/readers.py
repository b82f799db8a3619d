"""Readers: tables, text lines, JSON lines, a rate source, and the replayable log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HEARTBEAT, RECORD_SCHEMA, create_records, records_from_json, to_records

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _as_events(rows: DataFrame) -> DataFrame:
    return to_records(
        rows,
        "value",
        F.col("event_id"),
        F.col("ts"),
        {"event_type": F.col("event_type"), "user_id": F.col("user_id")},
        num=F.col("value"),
    )


def events(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Records of topic ``value`` from an events table, as a batch or as a stream of its files."""
    if not streaming:
        return _as_events(spark.read.parquet(path))
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet"):  # a live source takes a folder or a pattern, which this is for that one name
        path = f"{path[:-1]}[t]"
    return _as_events(reader.parquet(path))


def order_prices(spark: SparkSession, path: str) -> DataFrame:
    """Records of topic ``price`` from an orders table."""
    rows = spark.read.parquet(path)
    return to_records(
        rows,
        "price",
        F.col("o_orderkey"),
        F.col("o_orderdate"),
        {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")},
        num=F.col("o_totalprice"),
    )


def _lines(rows: DataFrame, stream_id: str) -> DataFrame:
    return create_records(rows.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")), stream_id, F.col("value"))


def text_lines(spark: SparkSession, path: str, stream_id: str) -> DataFrame:
    """Each trimmed line of text files as the payload of a new record."""
    return _lines(spark.read.text(path), stream_id)


def text_line_stream(spark: SparkSession, path: str, stream_id: str) -> DataFrame:
    return _lines(spark.readStream.text(path), stream_id)


def socket_lines(spark: SparkSession, host: str, port: int, stream_id: str) -> DataFrame:
    """Lines of a TCP source, such as one that forwards a standard input."""
    return _lines(spark.readStream.format("socket").option("host", host).option("port", port).load(), stream_id)


def json_lines(spark: SparkSession, path: str, fresh: bool = True) -> DataFrame:
    """Published records, one JSON object per line."""
    return records_from_json(spark.read.text(path), F.col("value"), fresh)


def json_line_stream(spark: SparkSession, path: str, fresh: bool = True) -> DataFrame:
    return records_from_json(spark.readStream.text(path), F.col("value"), fresh)


def rate(spark: SparkSession, stream_id: str = "test", rows_per_second: int = 1) -> DataFrame:
    """A counter, one value per second by default."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return create_records(rows, stream_id, F.col("value"))


def with_heartbeat(records: DataFrame, behind: str = "10 seconds", per_second: int = 1) -> DataFrame:
    """Live records that move their watermark on when they are silent.

    Heartbeats of a time ``behind`` the clock join them; expressions never see
    those.  For records that come within ``behind`` of their own time.
    """
    beats = records.sparkSession.readStream.format("rate").option("rowsPerSecond", per_second).load()
    early = F.col("timestamp") - F.expr(f"INTERVAL {behind}")
    beats = to_records(beats, HEARTBEAT, F.col("value"), early, {}, num=F.lit(0.0))  # filters on numbers let them pass
    return records.unionByName(beats, allowMissingColumns=True)


def replay_log(
    spark: SparkSession,
    path: str,
    start_ns: int | None = None,
    stop_ns: int | None = None,
    inclusive: bool = False,
    streaming: bool = False,
) -> DataFrame:
    """Logged records from ``start_ns`` on and before ``stop_ns`` (up to it if ``inclusive``).

    The log is partitioned by topic and sorted by time, so topics prune folders
    and the range prunes row groups.
    """
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(RECORD_SCHEMA).parquet(path)
    return in_range(rows, start_ns, stop_ns, inclusive)


def in_range(
    records: DataFrame, start_ns: int | None = None, stop_ns: int | None = None, inclusive: bool = False
) -> DataFrame:
    """Records of a range; the same range on ``ts``, a microsecond wider, reaches scans that have only that."""

    def near(ns: int) -> Column:
        return F.timestamp_micros(F.lit(ns // 1000))

    if start_ns is not None:
        records = records.where((F.col("ts_ns") >= F.lit(start_ns)) & (F.col("ts") >= near(start_ns)))
    if stop_ns is not None:
        below = F.col("ts_ns") <= stop_ns if inclusive else F.col("ts_ns") < stop_ns
        records = records.where(below & (F.col("ts") <= near(stop_ns)))
    return records
