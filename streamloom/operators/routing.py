"""Which records reach a stream: exact topic, and tags of which the wanted ones are a subset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import has_tags, tags_of, topic_of
from ..plans.expr import Raw


def select_stream(records: DataFrame, raw: Raw) -> DataFrame:
    """Records of the publishers that a subscriber of ``raw`` hears."""
    return records.where(heard_by(raw))


def heard_by(raw: Raw) -> Column:
    return (F.col("topic") == raw.topic) & has_tags(F.col("tags"), dict(raw.tags))


def select_streams(records: DataFrame, raws: list[Raw]) -> DataFrame:
    """The records that any of ``raws`` hears, once for each, with its number as ``_stream``: one pass over the source."""
    heard = [F.coalesce(heard_by(raw), F.lit(False)) for raw in raws]
    wanted = reduce(Column.__or__, map(heard_by, raws))
    numbers = F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in enumerate(heard)]))
    return records.where(wanted).withColumn("_stream", F.explode(numbers))


def publishers(records: DataFrame, raw: Raw) -> DataFrame:
    """The distinct stream ids that ``raw`` hears."""
    return select_stream(records, raw).select("stream_id").distinct()


def subscribers_of(subscribers: DataFrame, publisher: Column, stream_col: str = "stream_id") -> DataFrame:
    """Subscribers (rows with a stream id) whose topic is the publisher's and whose tags it all has."""
    sub = F.col(stream_col)
    offered = tags_of(publisher)
    hears = F.forall(F.map_entries(tags_of(sub)), lambda e: F.coalesce(offered[e["key"]], F.lit("")) == e["value"])
    return subscribers.where((topic_of(sub) == topic_of(publisher)) & hears)


def combinations(records: DataFrame, topics: list[Raw], by: list[str]) -> DataFrame:
    """The distinct combinations of the ``by`` tags seen on any of the topics."""
    heard = None
    for raw in topics:
        rows = select_stream(records, raw).select(*[F.coalesce(F.col("tags")[t], F.lit("")).alias(f"by_{t}") for t in by])
        heard = rows if heard is None else heard.unionByName(rows)
    return heard.distinct()
