"""Uniform shuffle into shards of exact size, in DataFrame functions only.

Rows are dealt into buckets by a hash.  A random matrix says how many rows of
each bucket go to each shard: a draw from the multivariate hypergeometric law
whose margins are the bucket counts and the exact shard sizes, which is the law
of that matrix under a uniform permutation.  Rows are permuted inside their
bucket and the first runs go to the shards as the matrix says; inside the shard
they are permuted again, which gives the slot.  Every random choice is a
function of the seed, the row and its place in the input; these are written
before they are used, so lost tasks repeat the same rows.

Slots are ranks within small pieces of a shard plus the sizes of the pieces
before, so no task holds a shard.

Defined results: shard sizes differ by one at most (law ``rows``); a null text
has no bytes; a very long text counts with all its bytes; rows alike in every
used column, ties included, are dealt like others, each by its place; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

LAW = "rows"
#: Rows that one bucket or piece of a shard holds on average, while there are few enough of these.
PIECE_ROWS = 20_000
#: Buckets and pieces at most: bounds the matrix, which has a row of 16 numbers for each bucket and is drawn on the
#: driver and broadcast.  Beyond 320 million rows buckets grow, and their sort spills.
MAX_BUCKETS = 16_384


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (j < n_rows % n_shards) for j in range(n_shards)]


def draw_hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of ``draws`` rows taken from ``total`` are among its ``good`` ones.

    Inversion of the distribution outward from its mode, exact up to rounding of
    doubles; the work grows with the standard deviation only.
    """
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(total - good, draws - mode) - log_choose(total, draws))
    u = rng.random() - peak
    left, right, p_left, p_right = mode, mode, peak, peak
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (total - good - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (total - good - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-300 and p_right < 1e-300:
            break
    return mode


def communication_matrix(bucket_counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each bucket that go to each shard; margins are exactly the two arguments."""
    rng = random.Random(seed)
    room = list(sizes)
    matrix = []
    for count in bucket_counts:
        row, left, total = [], count, sum(room)
        for j, free in enumerate(room):
            take = draw_hypergeometric(rng, free, total, left) if left else 0
            row.append(take)
            total -= free
            left -= take
            room[j] -= take
        matrix.append(row)
    return matrix


def _matrix_frame(spark: SparkSession, buckets: list[int], matrix: list[list[int]]) -> DataFrame:
    """(bucket, upto): for each bucket the running totals of its matrix row."""
    rows = []
    for b, row in zip(buckets, matrix, strict=True):
        run, upto = 0, []
        for x in row:
            run += x
            upto.append(run)
        rows.append({"bucket": b, "upto": upto})
    kind = "array<struct<bucket:int,upto:array<bigint>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("x")).select("x.*")


def shard(
    docs: DataFrame, n_shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col(id_col), text, F.monotonically_increasing_id()).alias("h"),
        ),
        "shuffle",
    )
    n_rows = slim.count()
    n_buckets = max(n_shards, min(MAX_BUCKETS, math.ceil(n_rows / PIECE_ROWS)))
    dealt = slim.withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy("bucket").count().collect()}
    buckets = sorted(counts)
    matrix = communication_matrix([counts[b] for b in buckets], shard_sizes(n_rows, n_shards), seed)
    upto = F.broadcast(_matrix_frame(spark, buckets, matrix))
    n_pieces = max(1, min(MAX_BUCKETS // n_shards, math.ceil(n_rows / n_shards / PIECE_ROWS)))
    local = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "doc_id", "text_crc32")
    sent = (
        dealt.withColumn("rank", F.row_number().over(local))
        .join(upto, "bucket")
        .withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))))
        .withColumn("order", F.xxhash64(F.lit(seed + 2), "h", "rank"))
        .withColumn("piece", F.floor(F.pmod(F.shiftright("order", 16), F.lit(1 << 40)) * n_pieces / (1 << 40)))
        .select("doc_id", "size", "text_crc32", "shard", "piece", "order")
    )
    sent = materialize(sent, "shards")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        sent.groupBy("shard", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "piece").orderBy("order", "doc_id", "text_crc32")
    return (
        sent.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(pieces), ["shard", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
