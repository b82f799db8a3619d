"""Stateful operators of live streams, on ``transformWithState``.

They need the RocksDB state store.  State lies by key and is bounded: a counter,
the records not yet released, or the last values of each stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import micros
from ..operators.alarm import numbers_only
from ..plans.alarm_grammar import Alarm, Both, Leaf
from .ordering import in_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RECORD = {
    "id": "string",
    "stream_id": "string",
    "topic": "string",
    "tags": "map<string,string>",
    "ts_ns": "bigint",
    "ts": "timestamp",
    "lwm_ns": "bigint",
    "data": "string",
    "num": "double",
}
#: What an alarm needs of a record.
_JUDGED = pa.schema([("ts_ns", pa.int64()), ("id", pa.string()), ("which", pa.int64()), ("num", pa.float64())])
#: Records of one key and millisecond wait in at most so many values of the state.
HELD_SHARES = 64
#: Rows that a stateful operator hands on at a time.
FRAME_ROWS = 10_000


class _Watch(StatefulProcessor):
    """Judges an alarm at each released record on the last values of every stream."""

    def __init__(self, alarm: Alarm, names: list[str], stream_id: str, keys: list[str]) -> None:
        self.alarm, self.names, self.stream_id, self.keys = alarm, names, stream_id, keys
        self.far = max(1, *(leaf.periods for leaf in alarm.leaves()))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = json.loads(self.last.get()[0]) if self.last.exists() else {n: [] for n in self.names}
        for frame in _sorted_frames(rows, _JUDGED, ["ts_ns", "id", "which"]):
            fired = []
            for ns, i, k, num in zip(*(frame[c].tolist() for c in _JUDGED.names), strict=True):
                name = self.names[k]
                last[name] = [*last[name], num][-self.far :]
                if holds(self.alarm.tree, last):
                    fired.append((f"{self.stream_id}@{k}@{i}", ns, self._message(last)))
            if fired:
                made = pd.DataFrame(fired, columns=["id", "ts_ns", "data"])
                yield made.assign(**dict(zip(self.keys, key, strict=False)))
        self.last.update((json.dumps(last),))

    def _message(self, last: dict[str, list[float]]) -> str:
        told = []
        for stream, leaf in sorted(self.alarm.value_leaves().items()):
            n = leaf.periods
            values = last[stream][-n:] if n and len(last[stream]) >= n else [0.0] * n
            told.append(f"{stream}:[{' '.join(map(str, values))}]")
        return f"Alarm '{self.alarm.text or self.alarm}' fired with values map[{' '.join(told)}]"

    def close(self) -> None:
        pass


def _sorted_frames(rows: Iterator[pd.DataFrame], schema: pa.Schema, by: list[str], whole: str | None = None) -> Iterator[pd.DataFrame]:
    """The rows of a key in order, FRAME_ROWS at a time; ``whole`` names a text column that sorts as a number."""

    def table(frame: pd.DataFrame) -> pa.Table:
        made = pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False)
        return made if whole is None else made.append_column("_place", made.column(whole).cast(pa.int64()))

    for part in in_order(map(table, rows), by if whole is None else ["_place", *by]):
        for k in range(0, len(part), FRAME_ROWS):
            yield part.slice(k, FRAME_ROWS).select(schema.names).to_pandas()


class _Counter(StatefulProcessor):
    """Numbers records of texts; ``event_time``, if any, is that column's name and its texts are microseconds in ``us``."""

    def __init__(self, names: list[str], event_time: str | None) -> None:
        self.names, self.event_time = names, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0] if self.n.exists() else 0
        schema = pa.schema([(c, pa.string()) for c in self.names])
        for made in _sorted_frames(rows, schema, ["id"], "ts_ns"):
            told = [f"fooized: {v}, state: {k}" for k, v in enumerate(made["data"], n + 1)]
            n += len(made)
            made = made.assign(id=[f"foo:{i}" for i in made["id"]], data=told)
            if self.event_time:
                us = pd.to_numeric(made.pop("us")).astype("int64")
                made[self.event_time] = pd.to_datetime(us, unit="us", utc=True)
            yield made
        self.n.update((n,))

    def close(self) -> None:
        pass


def holds(node: Leaf | Both, last: dict[str, list[float]]) -> bool:
    """The condition on plain lists of last values."""
    if isinstance(node, Both):
        left, right = holds(node.left, last), holds(node.right, last)
        return left or right if node.op == "or" else left and right
    n, t = node.periods, node.threshold
    recent = last[node.stream][-n:] if n else []
    tests = {"<": lambda v: v < t, "<=": lambda v: v <= t, ">": lambda v: v > t, ">=": lambda v: v >= t}
    return n > 0 and len(recent) == n and all(map(tests[node.op], recent))


def _grouped(rows: DataFrame, keys: list[str]):
    return rows.groupBy(*keys) if keys else rows.withColumn("_all", F.lit("")).groupBy("_all")


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in columns.items())


def held_back(inputs: list[DataFrame], keys: list[str], columns: list[str], hold_ms: int = 0) -> DataFrame:
    """``keys`` and ``columns`` of each record when the watermark has passed its time by ``hold_ms``, in no order.

    Waiting records lie by key, millisecond and share of the ids, so the state is
    spread over all tasks and an equal time fills no single value.
    """
    ns, ms = F.col("ts_ns"), F.lit(1_000_000)
    due = F.timestamp_millis(F.call_function("div", ns - F.pmod(ns, ms), ms) + F.lit(1 + hold_ms))
    share = F.pmod(F.xxhash64("id"), F.lit(HELD_SHARES)).alias("_share")

    def waiting(records: DataFrame) -> DataFrame:
        found = records.schema["_event" if "_event" in records.columns else "ts"].metadata
        mark = {k: v for k, v in found.items() if k == "spark.watermarkDelayMs"}
        rows = records.where(ns.isNotNull())
        return rows.select(due.alias("_due", metadata=mark), share, *keys, F.struct(*columns).alias("_row"))

    rows = reduce(DataFrame.unionByName, map(waiting, inputs)).groupBy("_due", "_share", *keys).agg(F.collect_list("_row").alias("_rows"))
    return rows.select(*keys, F.explode("_rows").alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def linearize_stream(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records of each key in event-time order, released when the watermark has passed them.

    They wait spread over all tasks; what a batch releases of a key is one
    partition, sorted in bounded memory.
    """
    keys = keys or ["stream_id"]
    names = [*_RECORD, *[k for k in keys if k not in _RECORD]]
    free = held_back([records], keys, [c for c in names if c not in keys]).select(*names)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_order((pa.Table.from_batches([x]) for x in batches), ["ts_ns", "id"]):
            yield from rows.to_batches()

    return free.repartition(*keys).mapInArrow(ordered, free.schema)


def count_up(records: DataFrame, keys: list[str], event_time: str = "ts") -> DataFrame:
    """The numbered map over a live stream; the counter of each key survives restarts.

    Where ``event_time`` has a watermark the result keeps it, so that aggregates
    can be put on top.
    """
    columns = _RECORD | {k: "string" for k in keys}
    columns |= {"_event": "timestamp"} if event_time == "_event" else {}
    watermarked = "spark.watermarkDelayMs" in (records.schema[event_time].metadata or {})

    # columns pass as texts, which pandas leaves as they are: null integers would become floats
    def text(name: str) -> Column:
        if columns[name] == "timestamp":
            return F.unix_micros(name).cast("string")
        return F.to_json(name) if name == "tags" else F.col(name).cast("string")

    names = [c for c in columns if c != "num" and not (watermarked and c == event_time)]
    sent = [text(c).alias(c) for c in names]
    sent += [text(event_time).alias("us"), F.col(event_time)] if watermarked else []
    out = _grouped(records.select(*sent), keys).transformWithStateInPandas(
        statefulProcessor=_Counter([*names, "us"] if watermarked else names, event_time if watermarked else None),
        outputStructType=_schema(dict.fromkeys(names, "string") | ({event_time: "timestamp"} if watermarked else {})),
        outputMode="Append",
        timeMode="EventTime" if watermarked else "None",
        **({"eventTimeColumnName": event_time} if watermarked else {}),
    )

    def column(name: str) -> Column:
        if name == "tags":
            return F.from_json("tags", "map<string,string>").alias("tags")
        if name == "num" or columns[name] == "bigint":
            return (F.lit(None) if name == "num" else F.col(name)).cast(columns[name]).alias(name)
        if columns[name] == "timestamp" and name in names:
            return F.timestamp_micros(F.col(name).cast("long")).alias(name)
        return F.col(name)

    return out.select(*map(column, columns))


def watch(
    alarm: Alarm, inputs: dict[str, DataFrame], stream_id: str, keys: list[str], strict: bool = False, shift_us: int = 0
) -> DataFrame:
    """The alarm over live streams, judged in event-time order.

    ``shift_us`` is how far behind the watermark the records of any input can
    come; those of all inputs are held back so long.  Without keys all records
    are one state and one task, as each of them may decide.
    """
    names = sorted(inputs)

    def numbers(records: DataFrame) -> DataFrame:
        return numbers_only(records) if strict else records.where(F.col("num").isNotNull())

    rows = [numbers(inputs[n]).withColumn("which", F.lit(i).cast("long")) for i, n in enumerate(names)]
    free = held_back(rows, keys, _JUDGED.names, -(-shift_us // 1000))
    fired = _grouped(free, keys).transformWithStateInPandas(
        statefulProcessor=_Watch(alarm, names, stream_id, keys),
        outputStructType=_schema({"id": "string", "ts_ns": "bigint", "data": "string"} | dict.fromkeys(keys, "string")),
        outputMode="Append",
        timeMode="None",
    )
    return fired.select(
        "id",
        F.lit(stream_id).alias("stream_id"),
        F.lit(stream_id).alias("topic"),
        F.create_map().cast("map<string,string>").alias("tags"),
        "ts_ns",
        micros(F.col("ts_ns")).alias("ts"),
        F.col("ts_ns").alias("lwm_ns"),
        "data",
        F.lit(None).cast("double").alias("num"),
        *keys,
    )
