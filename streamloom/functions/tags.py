"""Stream identifiers ``topic{k=v,k2=v2}``: parse, print, strip and match, in Python and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(stream_id: str) -> dict[str, str]:
    """Tags between the first braces; a pair without exactly one ``=`` is skipped."""
    _, brace, rest = stream_id.partition("{")
    body, close, _ = rest.partition("}")
    if not brace or not close:
        return {}
    pairs = (p.split("=") for p in body.split(","))
    return {p[0]: p[1] for p in pairs if len(p) == 2}


def strip_tags(stream_id: str) -> str:
    """The topic: all before the first brace, unless that would be nothing."""
    at = stream_id.find("{")
    return stream_id[:at] if at > 0 else stream_id


def print_tags(topic: str, tags: dict[str, str]) -> str:
    return topic + "{" + ",".join(sorted(f"{k}={v}" for k, v in tags.items())) + "}" if tags else topic


def is_subset(wanted: dict[str, str], offered: dict[str, str]) -> bool:
    """True if every wanted tag is offered; an absent tag reads as the empty string."""
    return all(offered.get(k, "") == v for k, v in wanted.items())


def tags_of(stream_id: Column) -> Column:
    body = F.regexp_extract(stream_id, r"^[^{]*\{([^}]*)\}", 1)
    pairs = F.filter(F.transform(F.split(body, ","), lambda p: F.split(p, "=")), lambda p: F.size(p) == 2)
    # of repeated keys the last counts
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.filter(pairs, lambda q, j: j > i),
            lambda q: F.get(q, F.lit(0)) == F.get(p, F.lit(0)),
        ),
    )
    return F.map_from_entries(
        F.transform(last, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
    )


def topic_of(stream_id: Column) -> Column:
    return F.when(F.instr(stream_id, "{") > 1, F.substring_index(stream_id, "{", 1)).otherwise(stream_id)


def printed(topic: Column, tags: Column) -> Column:
    items = F.sort_array(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(items) > 0, F.concat(topic, F.lit("{"), F.array_join(items, ","), F.lit("}"))).otherwise(topic)


def has_tags(tags: Column, wanted: dict[str, str]) -> Column:
    """A plain conjunction over the map, so it can be pushed to the scan's source columns."""
    found = F.lit(True)
    for k, v in sorted(wanted.items()):
        found = found & (tags[k] == v if v else F.coalesce(tags[k], F.lit("")) == "")
    return found
