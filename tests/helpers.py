"""Tiny streams for tests: times are seconds after 2024-01-01."""

from streamloom.functions.tags import parse_tags, strip_tags
from streamloom.model import RECORD_SCHEMA

START = 1_704_067_200
NS = 1_000_000_000


def record(n, stream_id, second, data=None, num=None, lwm=None):
    from datetime import datetime, timezone

    ns = int((START + second) * NS)
    ts = datetime.fromtimestamp(START + second, timezone.utc)
    text = data if data is not None else None if num is None else str(float(num))
    value = None if num is None else float(num)
    low = ns if lwm is None else int((START + lwm) * NS)
    return (f"{n:04d}", stream_id, strip_tags(stream_id), parse_tags(stream_id), ns, ts, low, text, value)


def stream(spark, rows):
    """``rows`` of (stream id, second, value): strings are payloads, numbers are numbers."""
    made = [
        record(n, sid, second, data=v) if isinstance(v, str) else record(n, sid, second, num=v)
        for n, (sid, second, v) in enumerate(rows)
    ]
    return spark.createDataFrame(made, RECORD_SCHEMA)


def seconds(ns):
    return (ns - START * NS) / NS
