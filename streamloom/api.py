"""The library's face: expressions over a table or stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.compiler import Compiler, canonical
from .sources.readers import in_range
from .streaming.manager import Manager
from .streaming.stateful import ROCKSDB


class Session:
    """Expressions over one source of records."""

    def __init__(self, source: DataFrame) -> None:
        self.source = source

    def query(
        self,
        expression: str,
        closed_only: bool = False,
        strict: bool = False,
        watermark: str | None = None,
        start_ns: int | None = None,
    ) -> DataFrame:
        """The records of ``expression``: a batch over a batch source, a stream over a live one.

        ``start_ns`` leaves out source records before that time.
        """
        return Compiler(in_range(self.source, start_ns), closed_only, strict, watermark).compile(expression)

    def publish(self, records: DataFrame) -> Session:
        """A session over these records too."""
        return Session(self.source.unionByName(records, allowMissingColumns=True))

    def manager(self, checkpoints: str, watermark: str = "0 seconds", strict: bool = False, **trigger) -> Manager:
        return Manager(self.source, checkpoints, watermark, strict, **trigger)

    @staticmethod
    def prepare(spark: SparkSession) -> None:
        """Session settings that live expressions need."""
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


__all__ = ["Session", "canonical"]
