"""Duration literals such as ``5s``, ``1h30m``, ``1.5h``, ``5min`` and ``10sec``."""

from __future__ import annotations

import re
from fractions import Fraction

#: Nanoseconds of each unit; the last rows are aliases.
UNITS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
    "d": 86_400_000_000_000,
    "sec": 1_000_000_000,
    "min": 60_000_000_000,
}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")")


def parse_duration(text: str) -> int:
    """Nanoseconds of a positive duration; ValueError for anything else."""
    rest, total = text.strip(), Fraction(0)
    if not rest:
        raise ValueError("empty duration")
    while rest:
        m = _PART.match(rest)
        if not m:
            raise ValueError(f"not a duration: {text!r}")
        total += Fraction(m[1] if m[1][-1] != "." else m[1][:-1]) * UNITS[m[2]]
        rest = rest[m.end() :]
    if int(total) <= 0:
        raise ValueError(f"a period must be positive: {text!r}")
    return int(total)


def format_duration(ns: int) -> str:
    """The shortest single-unit literal of a duration."""
    for unit in ("h", "m", "s", "ms", "us"):
        if ns % UNITS[unit] == 0:
            return f"{ns // UNITS[unit]}{unit}"
    return f"{ns}ns"
