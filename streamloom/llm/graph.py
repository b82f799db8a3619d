"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _distinct_edges(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the smallest node of its component.

    Every round's edges are written to the shared folder, so no lineage grows.
    A node with very many edges is no group: minima combine before the shuffle
    and the joins are of kinds whose skewed side Spark splits.
    """
    now = materialize(_distinct_edges(edges), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = materialize(_distinct_edges(large), "edges")
        down = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(down, "a").select(F.explode(F.array("a", "b")).alias("x"), "m")
        now = materialize(_distinct_edges(small.select(F.col("x").alias("a"), F.col("m").alias("b"))), "edges")
        seen, mark = mark, _mark(now)
        if seen == mark:
            break
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
