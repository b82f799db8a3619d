"""Payloads as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms that count as numbers; others, such as padded or suffixed ones, are zero.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def number_of(data: Column, num: Column | None = None) -> Column:
    """``num`` if given, else the parsed payload; a payload that is no number is 0."""
    parsed = F.when(F.rlike(data, F.lit(NUMBER)), data.try_cast("double"))
    return F.coalesce(parsed if num is None else F.coalesce(num, parsed), F.lit(0.0))
