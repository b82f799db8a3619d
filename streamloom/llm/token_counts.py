"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, count) in a
shared folder.  Contents are normalised (null to empty) and digested; digests
are joined to the cache; one text for each missing digest is encoded; the new
counts are appended in one committed job, and a second append of the same
digest changes nothing, so a repeated job is harmless.

Defined results: a null text is empty and has no tokens; a very long text is
encoded whole by one worker; of texts with one digest any is encoded, as they are
equal; repeated rows get one row each; a null id stays; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, salted_left_join, scratch_path
from .tokens import encoder, version_digest

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
TOKEN_LIMIT = 1024


def _counter(path: str, cut: str | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, cut)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": list(own.counts(batch["text"]))})
        release_memory()

    return count


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cut: str | None = None,
    cache_path: str | None = None,
    limit: int = TOKEN_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``cache_path`` is a folder that all executors share; without it the cache
    starts empty and lasts for this session.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = version_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    known = stored()
    todo = keyed.select("digest", "text")
    if not known.isEmpty():
        todo = todo.join(known, "digest", "left_anti")
    misses = todo.groupBy("digest").agg(F.first("text").alias("text"))
    (
        misses.mapInPandas(_counter(tokenizer_path, cut), "digest binary, n_tokens bigint")
        .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
        .write.mode("append")
        .parquet(cache_path)
    )
    slim = materialize(keyed.drop("text"), "digests")
    # so low that a group of copies is dealt out in small tables too, and at most 20,000 groups are
    hot_rows = max(500, slim.count() // 20_000)
    counted = salted_left_join(slim, stored(), "digest", F.col("doc_id"), hot_rows)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
