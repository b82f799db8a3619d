"""Order-dependent operators that never put a whole stream into one task.

A stream is cut into slices of event time that hold about equal numbers of
records.  Work inside a slice is a window over that slice; what a slice must know
of those before it is one row for each slice, carried forward by a window over
that small table.  A stream that Catalyst's statistics call small is one slice,
and no job runs to find that out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a slice holds on average, while there are at most SLICES.
SLICE_ROWS = 100_000
SLICES = 1024
#: Estimated bytes up to which a stream is one slice.
SMALL_BYTES = 32 << 20
SLICE = "_slice"


def _small(records: DataFrame) -> bool:
    """True if the optimizer's own size estimate is low; it overstates filtered and joined inputs."""
    try:
        size = records._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except AttributeError:  # a remote session has no plan here
        return False
    return int(str(size)) <= SMALL_BYTES


def with_slices(records: DataFrame, rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """The records with their slice number, and how many slices there are.

    Slices are cut at quantiles of ``ts_ns``, so bursts get slices of their own;
    records of one nanosecond stay together.
    """
    one = records.withColumn(SLICE, F.lit(0).cast("long"))
    if rows == SLICE_ROWS and _small(records):
        return one, 1
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    n, cuts = records.agg(F.count(F.lit(1)), F.percentile_approx("ts_ns", shares, 20 * SLICES)).first()
    wanted = min(SLICES, -(-n // rows))
    if wanted < 2 or not cuts:
        return one, 1
    chosen = sorted({cuts[max(0, k * SLICES // wanted - 1)] for k in range(1, wanted)})
    return records.withColumn(SLICE, _cuts_below(F.col("ts_ns"), chosen)), len(chosen) + 1


def _cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by bisection."""
    steps = max(1, len(cuts).bit_length())
    padded = F.array(*[F.lit(c).cast("long") for c in [*cuts, *[(1 << 63) - 1] * ((1 << steps) - 1 - len(cuts))]])
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    found = F.aggregate(
        widths, F.lit(0), lambda low, w: F.when(F.get(padded, low + w - 1) <= value, low + w).otherwise(low)
    )
    return F.least(found, F.lit(len(cuts))).cast("long")


def carried(per_slice: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """For each row of ``per_slice`` the ``values`` over the slices before it of the same keys."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*keys, SLICE, *[v.over(before).alias(k) for k, v in values.items()])


def linearize(records: DataFrame) -> DataFrame:
    """Records in event-time order, ids breaking ties: a range partitioning, sorted inside."""
    return records.orderBy("ts_ns", "id")


def deduplicate(records: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One record for each id, none of those in ``seen``; exact, by a shuffle on the id."""
    once = records.dropDuplicates(["id"])
    return once if seen is None else once.join(seen.select("id").distinct(), "id", "left_anti")


def deduplicate_stream(records: DataFrame, within: str | None = None) -> DataFrame:
    """The same over a live stream: an id is remembered until the watermark has passed it.

    ``within`` sets the watermark of ``ts`` where the stream has none yet; copies
    further apart than that may both pass.
    """
    rows = records if within is None else records.withWatermark("ts", within)
    return rows.dropDuplicatesWithinWatermark(["id"])


def numbered(records: DataFrame, keys: list[str], name: str = "n", rows: int = SLICE_ROWS) -> DataFrame:
    """Add the place of each record in the time order of its keys, from 1."""
    sliced, n_slices = with_slices(records, rows)
    inside = Window.partitionBy(*keys, SLICE).orderBy("ts_ns", "id")
    ranked = sliced.withColumn("_rank", F.row_number().over(inside))
    if n_slices == 1:
        return ranked.withColumn(name, F.col("_rank").cast("long")).drop("_rank", SLICE)
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_count"))
    offsets = carried(counts, keys, {"_before": F.sum("_count")})
    return (
        ranked.join(offsets, [*keys, SLICE])
        .withColumn(name, F.col("_rank") + F.coalesce("_before", F.lit(0)))
        .drop("_rank", "_before", SLICE)
    )
