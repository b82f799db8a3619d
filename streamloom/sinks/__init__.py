"""Where records go: printing, JSON lines, the replayable log, and several of them from one query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import RECORD_COLUMNS, as_json
from ..streaming.stateful import linearize_stream


def render(records: DataFrame, data_only: bool = False) -> DataFrame:
    """One text per record: its JSON form, or only its payload."""
    return records.select((F.col("data") if data_only else as_json(records)).alias("value"))


def write_log(records: DataFrame, path: str) -> None:
    """Append a batch to the log, by topic and in time order inside files."""
    rows = records.select(*RECORD_COLUMNS)
    rows.sortWithinPartitions("topic", "ts_ns").write.mode("append").partitionBy("topic").parquet(path)


def write_json_lines(records: DataFrame, path: str) -> None:
    render(records).write.mode("append").text(path)


def log_stream(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A live query into the log; the file sink's commit log makes each batch count once."""
    writer = records.select(*RECORD_COLUMNS).writeStream.format("parquet").partitionBy("topic")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def fan_out(
    records: DataFrame, outputs: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger
) -> StreamingQuery:
    """One query, many listeners: each batch is computed once and given to all."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for out in outputs:
                out(batch, number)
        finally:
            batch.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def print_stream(
    records: DataFrame, checkpoint: str, data_only: bool = False, ordered: bool = False, **trigger
) -> StreamingQuery:
    """Print live records; ``ordered`` holds each stream's back to the watermark and prints them in time order."""
    rows = linearize_stream(records) if ordered else records
    writer = render(rows, data_only).writeStream.format("console").option("truncate", False)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
