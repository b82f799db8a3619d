"""Threshold alarms over several streams of a batch.

Every input record is a moment at which the condition is judged on the last
values of every stream.  Streams are cut into time slices: a slice gets the last
values before it from a small table of slice ends, so no task reads a whole
stream, with or without keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros
from ..plans.alarm_grammar import Alarm, Both, Leaf
from .ordered import SLICE, SLICE_ROWS, with_slices


def leaf_holds(leaf: Leaf, last: Column) -> Column:
    """True if the last ``periods`` values exist and all compare true; never for zero periods."""
    if leaf.periods < 1:
        return F.lit(False)
    tests = {
        "<": lambda v: v < leaf.threshold,
        "<=": lambda v: v <= leaf.threshold,
        ">": lambda v: v > leaf.threshold,
        ">=": lambda v: v >= leaf.threshold,
    }
    recent = F.slice(last, -leaf.periods, leaf.periods)
    return (F.size(last) >= leaf.periods) & F.forall(
        F.when(F.size(last) >= leaf.periods, recent).otherwise(F.array().cast("array<double>")), tests[leaf.op]
    )


def condition(node: Leaf | Both, last_of: dict[str, Column]) -> Column:
    if isinstance(node, Leaf):
        return leaf_holds(node, last_of[node.stream])
    left, right = condition(node.left, last_of), condition(node.right, last_of)
    return left | right if node.op == "or" else left & right


def told_values(alarm: Alarm, last_of: dict[str, Column]) -> Column:
    """The values that the message tells for each stream: zeros where there are too few."""
    entries = []
    for stream, leaf in sorted(alarm.value_leaves().items()):
        last, n = last_of[stream], leaf.periods
        full = F.when(F.size(last) >= max(n, 1), F.slice(last, -max(n, 1), max(n, 1)))
        zeros = F.array_repeat(F.lit(0.0), n)
        entries += [F.lit(stream), zeros if n < 1 else F.coalesce(full, zeros)]
    return F.create_map(*entries)


def message(alarm: Alarm, values: Column) -> Column:
    def one(e: Column) -> Column:
        numbers = F.array_join(F.transform(e["value"], lambda v: v.cast("string")), " ")
        return F.concat(e["key"], F.lit(":["), numbers, F.lit("]"))

    listed = F.array_join(F.transform(F.array_sort(F.map_entries(values)), one), " ")
    return F.concat(F.lit(f"Alarm '{alarm.text or alarm}' fired with values map["), listed, F.lit("]"))


def _tail(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def numbers_only(records: DataFrame) -> DataFrame:
    """The records; one whose payload is no number is an error."""
    bad = F.raise_error(F.concat(F.lit("alarm input is no number: "), F.col("id"))).cast("double")
    return records.withColumn("num", F.when(F.col("num").isNull(), bad).otherwise(F.col("num")))


def merged(inputs: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The inputs as one table of (keys, ts_ns, id, num, _stream); streams are numbered in the order of their names."""
    rows = [inputs[name].select(*keys, "ts_ns", "id", "num").withColumn("_stream", F.lit(k)) for k, name in enumerate(sorted(inputs))]
    return reduce(DataFrame.unionByName, rows)


def fire(
    alarm: Alarm,
    inputs: dict[str, DataFrame] | DataFrame,
    stream_id: str,
    keys: list[str],
    strict: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """A record for each input record at which the alarm's condition holds.

    ``inputs`` are the records of each stream, or all of them as ``merged`` has
    them.  Records without a number are left out; ``strict`` makes them an error.
    """
    names = sorted({leaf.stream for leaf in alarm.leaves()})
    far = max(1, *(leaf.periods for leaf in alarm.leaves()))
    union = inputs if isinstance(inputs, DataFrame) else merged(inputs, keys)
    union = numbers_only(union) if strict else union
    rows, n_slices = with_slices(union.where(F.col("num").isNotNull()), slice_rows)
    at = F.struct("ts_ns", "id", "_stream")
    own_window = Window.partitionBy(*keys, SLICE, "_stream").orderBy("ts_ns", "id").rowsBetween(-(far - 1), 0)
    rows = rows.withColumn("_own", F.collect_list("num").over(own_window))
    none = F.array().cast("array<double>")
    if n_slices == 1:
        rows = rows.withColumns({f"_before{k}": none for k in range(len(names))})
    else:
        # the last values of every stream at the end of each slice, then those before each slice
        ends = rows.groupBy(*keys, SLICE, "_stream").agg(F.max_by("_own", at).alias("_own"))
        earlier = Window.partitionBy(*keys, "_stream").orderBy(SLICE).rowsBetween(-far, 0)
        ends = ends.withColumn("_end", _tail(F.flatten(F.collect_list("_own").over(earlier)), far))
        columns = [F.max(F.when(F.col("_stream") == k, F.col("_end"))).alias(f"_end{k}") for k in range(len(names))]
        by_slice = ends.groupBy(*keys, SLICE).agg(*columns)
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        by_slice = by_slice.select(
            *keys,
            SLICE,
            *[F.coalesce(F.last(f"_end{k}", True).over(before), none).alias(f"_before{k}") for k in range(len(names))],
        )
        rows = rows.join(by_slice, [*keys, SLICE])
    moment = Window.partitionBy(*keys, SLICE).orderBy("ts_ns", "id", "_stream")
    now = [F.when(F.col("_stream") == k, _tail(F.concat(F.col(f"_before{k}"), F.col("_own")), far)) for k in range(len(names))]
    rows = rows.withColumns({f"_last{k}": F.coalesce(F.last(v, True).over(moment), F.col(f"_before{k}")) for k, v in enumerate(now)})
    last_of = {name: F.col(f"_last{k}") for k, name in enumerate(names)}
    fired = rows.where(condition(alarm.tree, last_of)).withColumn("values", told_values(alarm, last_of))
    return fired.select(
        F.concat_ws("@", F.lit(stream_id), F.col("_stream").cast("string"), "id").alias("id"),
        F.lit(stream_id).alias("stream_id"),
        F.lit(stream_id).alias("topic"),
        F.create_map().cast("map<string,string>").alias("tags"),
        "ts_ns",
        micros(F.col("ts_ns")).alias("ts"),
        F.col("ts_ns").alias("lwm_ns"),
        message(alarm, F.col("values")).alias("data"),
        F.lit(None).cast("double").alias("num"),
        *keys,
        "values",
    )
