"""Expression trees to DataFrames, the same code for batch and streaming sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import format_duration, parse_duration
from ..model import HEARTBEAT
from ..operators import alarm as alarms
from ..operators import maps, routing
from ..operators.aggregates import AGGREGATES, aggregate, aggregate_stream
from ..streaming import stateful
from .expr import AlarmCall, Call, ExpressionError, Match, Node, Raw, fill_template, parse

#: Computations that users add: name -> function of (records, arguments, keys).
COMPUTATIONS: dict[str, Callable[[DataFrame, tuple[str, ...], list[str]], DataFrame]] = {}


def register_computation(name: str, builder: Callable[[DataFrame, tuple[str, ...], list[str]], DataFrame]) -> None:
    """Make ``name(stream, args...)`` known; ``builder`` maps records to records and may flat-map or keep state."""
    if not name.isidentifier() or name in ("match", "alarm"):
        raise ValueError(f"not a name for a computation: {name!r}")
    COMPUTATIONS[name] = builder


@dataclass
class _Made:
    """Records, their key columns and, in a stream, where their event time is."""

    records: DataFrame
    keys: list[str]
    event_time: str = "ts"
    shift_us: int = 0


class Compiler:
    """Compiles expressions over one table or stream of records."""

    def __init__(
        self, source: DataFrame, closed_only: bool = False, strict: bool = False, watermark: str | None = None
    ) -> None:
        self.streaming = source.isStreaming
        self.closed_only, self.strict = closed_only, strict
        self.source, self.watermark = source, watermark if self.streaming else None

    def compile(self, expression: str | Node) -> DataFrame:
        node = parse(expression) if isinstance(expression, str) else expression
        made = self._node(node, {}, [])
        return made.records.drop("_event")

    def _node(self, node: Node, bound: dict[str, Raw], keys: list[str]) -> _Made:
        if isinstance(node, Raw):
            return self._raw(node, bound, keys)
        if isinstance(node, Match):
            if keys:
                raise ExpressionError("match inside match")
            return self._match(node)
        if isinstance(node, AlarmCall):
            return self._alarm(node, bound, keys)
        return self._call(node, bound, keys)

    def _raw(self, raw: Raw, bound: dict[str, Raw], keys: list[str]) -> _Made:
        raw = bound.get(raw.topic, raw)
        if self.watermark:
            # heartbeats move the watermark on and end here; the test of ts keeps the filter above it
            rows = self.source.where(routing.heard_by(raw) | (F.col("topic") == HEARTBEAT)).withWatermark("ts", self.watermark)
            rows = rows.where((F.col("topic") != HEARTBEAT) | F.isnull("ts"))
        else:
            rows = routing.select_stream(self.source, raw)
        return _Made(_with_keys(rows, keys), keys)

    def _call(self, call: Call, bound: dict[str, Raw], keys: list[str]) -> _Made:
        made = self._node(call.stream, bound, keys)
        sid = _text(call, bound)
        if call.name in AGGREGATES:
            if len(call.args) != 1:
                raise ExpressionError(f"{call.name} takes a stream and a period: {call}")
            period = parse_duration(call.args[0])
            if self.streaming:
                records, event, shift = aggregate_stream(
                    made.records, call.name, period, sid, keys, made.event_time, made.shift_us
                )
                return _Made(records, keys, event, shift)
            return _Made(aggregate(made.records, call.name, period, sid, keys, self.closed_only), keys)
        if call.name == "foo":
            rows = made.records
            rows = stateful.count_up(rows, keys, made.event_time) if self.streaming else maps.foo(rows, keys)
        elif call.name == "bar":
            rows = maps.bar(made.records)
        elif call.name in COMPUTATIONS:
            rows = COMPUTATIONS[call.name](made.records, call.args, keys)
        else:
            raise ExpressionError(f"unknown computation: {call.name!r}")
        rows = rows.withColumn("stream_id", F.lit(sid)).withColumn("topic", F.lit(sid))
        return _Made(rows, keys, made.event_time, made.shift_us)

    def _alarm(self, node: AlarmCall, bound: dict[str, Raw], keys: list[str]) -> _Made:
        alarm, sid = node.alarm, _text(node, bound)
        if alarm.match_by and not keys:
            keys = [f"by_{t.strip()}" for t in alarm.match_by.split(",")]
        if self.streaming:
            made = {name: self._node(stream, bound, keys) for name, stream in node.streams.items()}
            inputs = {name: m.records for name, m in made.items()}
            return _Made(stateful.watch(alarm, inputs, sid, keys, self.strict, max(m.shift_us for m in made.values())), keys)
        names = sorted(node.streams)
        if all(isinstance(node.streams[n], Raw) for n in names):
            raws = [bound.get(node.streams[n].topic, node.streams[n]) for n in names]
            rows = _with_keys(routing.select_streams(self.source, raws), keys)
            inputs = rows.select(*keys, "ts_ns", "id", "num", "_stream")
        else:
            inputs = {name: self._node(stream, bound, keys).records for name, stream in node.streams.items()}
        return _Made(alarms.fire(alarm, inputs, sid, keys, self.strict), keys)

    def _match(self, node: Match) -> _Made:
        """One keyed plan: the topics stand for themselves and the ``by`` tags become key columns."""
        names = [f"topic_{i}_of_match" for i in range(len(node.topics))]
        inner = parse(fill_template(node.template, names))
        made = self._node(inner, dict(zip(names, node.topics, strict=True)), [f"by_{t}" for t in node.by])
        rows = made.records.withColumn("stream_id", F.lit(str(node))).withColumn("topic", F.lit(str(node)))
        return _Made(rows, made.keys, made.event_time, made.shift_us)


def _with_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumns({k: F.coalesce(F.col("tags")[k.removeprefix("by_")], F.lit("")) for k in keys}) if keys else rows


def _text(node: Node, bound: dict[str, Raw]) -> str:
    out = str(node)
    for name, raw in bound.items():
        out = out.replace(name, str(raw))
    return out


def canonical(expression: str) -> str:
    """One text for all spellings of an expression: spacing, tag order and duration units are settled."""

    def settle(node: Node) -> str:
        if isinstance(node, Call):
            args = list(node.args)
            if node.name in AGGREGATES and args:
                args[-1] = format_duration(parse_duration(args[-1]))
            return f"{node.name}({', '.join([settle(node.stream), *args])})"
        if isinstance(node, AlarmCall):
            text = str(node)
            for raw, stream in sorted(node.streams.items(), key=lambda x: -len(x[0])):
                text = text.replace(raw, settle(stream))
            return text
        return str(node)

    return settle(parse(expression))


__all__ = ["COMPUTATIONS", "Compiler", "canonical", "register_computation"]
