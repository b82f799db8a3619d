"""Producers written in Python, as streaming data sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..model import records_from_json

#: ``produce(n)``: the JSON records from place ``n`` of the producer's output on, none if there are no more now.
Produce = Callable[[int], Iterable[str]]


def _reader_of(produce: Produce) -> type[SimpleDataSourceStreamReader]:
    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"n": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
            rows = [(x,) for x in produce(start["n"])]
            return iter(rows), {"n": start["n"] + len(rows)}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
            n, rows = end["n"] - start["n"], [(x,) for x in produce(start["n"])]
            if len(rows) < n:
                raise ValueError(f"the producer does not repeat its records from {start['n']} to {end['n']}")
            return iter(rows[:n])

    return Reader


def register_producer(spark: SparkSession, name: str, produce: Produce) -> None:
    """Make ``spark.readStream.format(name)`` read ``produce``, which gives the same records for the same place.

    A restarted query asks for the places that it had not finished.
    """
    reader = _reader_of(produce)

    class Producer(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string"

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return reader()

    spark.dataSource.register(Producer)


def produced(spark: SparkSession, name: str, fresh: bool = False) -> DataFrame:
    """The live records of a registered producer."""
    return records_from_json(spark.readStream.format(name).load(), F.col("value"), fresh)
