"""Centred time buckets: a label is the event time rounded half up to a multiple of the period since year 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds from 0001-01-01 to 1970-01-01.
ORIGIN_NS = 62_135_596_800 * 1_000_000_000


def bucket_of(ts_ns: int, period_ns: int) -> int:
    """The label of one time, in exact integers."""
    rest = (ts_ns + ORIGIN_NS) % period_ns
    return ts_ns - rest if rest + rest < period_ns else ts_ns + period_ns - rest


def bucket_ns(ts_ns: Column, period_ns: int) -> Column:
    """``bucket_of`` as a column; the origin is reduced first, as it exceeds 64 bits."""
    rest = F.pmod(F.pmod(ts_ns, F.lit(period_ns)) + F.lit(ORIGIN_NS % period_ns), F.lit(period_ns))
    return F.when(rest + rest < period_ns, ts_ns - rest).otherwise(ts_ns + period_ns - rest)


def bucket_window(event_time: Column, period_ns: int, shift_us: int = 0) -> Column:
    """The same buckets as a time window; ``event_time`` is the record time plus ``shift_us``.

    Windows are what a watermark closes.  Their unit is the microsecond, so the
    period must be an even number of them.
    """
    if period_ns % 2000:
        raise ValueError("streaming periods must be an even number of microseconds")
    period = period_ns // 1000
    start = (-(ORIGIN_NS // 1000) - period // 2 + shift_us) % period
    return F.window(event_time, f"{period} microseconds", f"{period} microseconds", f"{start} microseconds")


def window_label_ns(window: Column, period_ns: int, shift_us: int = 0) -> Column:
    return (F.unix_micros(window["start"]) - shift_us + period_ns // 2000) * 1000
