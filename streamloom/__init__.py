"""Stream expressions on Spark: one expression, batch or streaming."""

from .api import Session

__all__ = ["Session"]
