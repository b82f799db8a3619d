"""SimHash near-duplicates, linked through pivot distance tables.

A fingerprint has 64 bits; two link at 3 or fewer differing bits.  Fingerprints
are cut into five blocks.  Linked ones agree in at least two whole blocks, so
each is filed under its ten pairs of blocks and only files are searched.  In a
file the Hamming distances to fixed reference fingerprints are tabled first; by
the triangle inequality a pair whose distances to any reference differ by more
than 3 cannot link and is discarded, and the survivors are verified.  Files of
many fingerprints are dealt into chunks and searched by pairs of chunks.

A file yields a spanning forest of its links, never all pairs; components come
from an iterative join.  Exact copies share one fingerprint and are never paired.

Defined results: a null text has no words and fingerprint zero, which links
like any other; a very long text is one fingerprint of all its shingles; a bit
set in exactly half of the shingles is 0; repeated rows get one row each; a null
id is passed over when the smallest id of a component is taken; an empty table
gives an empty result; extra columns are ignored or, in
``drop_near_duplicates``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, salted_left_join
from .graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: (lowest bit, width) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
N_PIVOTS = 16
#: Fingerprints of one chunk of a file.
CHUNK = 8192
#: Files up to this size are searched together, in vectors.
SMALL = 48
#: Ids up to which those to drop are broadcast.
BROADCAST_IDS = 1_000_000
_SLICE = 65_536

PIVOTS = np.random.default_rng(7).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = stops[SHINGLE - 1 :] - 1
    starts = np.concatenate(([0], stops[: len(ends) - 1]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends)
    )
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        part = hashes[k : k + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _fingerprints, f"doc_id {kind}, fp bigint"
    )


def _file_keys(fp: Column) -> Column:
    def block(k: int) -> Column:
        low, width = BLOCKS[k]
        return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(
        *[
            F.shiftleft(F.lit(n).cast("long"), 26).bitwiseOR(F.shiftleft(block(i), 13)).bitwiseOR(block(j))
            for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )


def _distance_table(marks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def _near(table: np.ndarray, at: int, among: np.ndarray) -> np.ndarray:
    """Those of ``among`` whose table rows differ from that of ``at`` by MAX_BITS at most in every coordinate."""
    for k in range(0, N_PIVOTS, 4):
        if not len(among):
            break
        gap = np.abs(table[among, k : k + 4] - table[at, k : k + 4]).max(axis=1)
        among = among[gap <= MAX_BITS]
    return among


def forest_of_large(marks: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links of one file, growing from node to node: each node is taken once."""
    table, links = _distance_table(marks), []
    waiting = np.arange(len(marks))
    while len(waiting):
        todo, waiting = [waiting[0]], waiting[1:]
        while todo and len(waiting):
            at = todo.pop()
            near = _near(table, at, waiting)
            near = near[_verified(marks[near], marks[at])]
            if len(near):
                links += [(marks[at], marks[x]) for x in near]
                todo += near.tolist()
                waiting = np.setdiff1d(waiting, near, assume_unique=True)
    return links


def links_of_small(files: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The links inside each of many small files, searched in one pass over vectors."""
    sizes = np.fromiter(map(len, files), np.int64, len(files))
    marks = np.concatenate(files)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(marks)) - base
    first = np.repeat(np.arange(len(marks)), place)
    second = np.arange(len(first)) - np.repeat(np.cumsum(place) - place, place) + base[first]
    table = _distance_table(marks)
    for k in range(0, N_PIVOTS, 4):
        stay = np.abs(table[first, k : k + 4] - table[second, k : k + 4]).max(axis=1) <= MAX_BITS
        first, second = first[stay], second[stay]
    stay = _verified(marks[first], marks[second])
    return marks[first[stay]], marks[second[stay]]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        files = [np.asarray(x, np.int64).view(np.uint64) for x in batch["fps"]]
        small = [x for x in files if len(x) <= SMALL]
        links = _forest(*links_of_small(small)) if small else []
        for x in files:
            if len(x) > SMALL:
                links += forest_of_large(x)
        if links:
            pairs = np.array(links, np.uint64).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def link_fingerprints(marks: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that keep every connection."""
    filed = marks.select("fp", F.explode(_file_keys(F.col("fp"))).alias("key"))
    large = materialize(
        filed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > CHUNK)
        .select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")),
        "files",
    )
    filed = filed.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    n_large = large.count()
    if n_large:
        if n_large <= BROADCAST_IDS:
            large = F.broadcast(large)
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        filed = (
            filed.join(large, "key", "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        )
    files = filed.groupBy("key", "lo", "hi").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return files.select("fps").mapInPandas(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document; the smallest id of its component."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "groups")
    rooted = components(link_fingerprints(groups.select("fp")))
    linked = rooted.join(groups, rooted["node"] == groups["fp"]).select("node", "root", "least_id")
    linked = materialize(linked, "linked")
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_mark = salted_left_join(linked, named, "root", F.col("node")).select(
        F.col("node").alias("fp"), F.col("component_id").alias("linked_id")
    )
    of_mark = groups.join(by_mark, "fp", "left").select("fp", F.coalesce("linked_id", "least_id").alias("component_id"))
    return salted_left_join(marked, of_mark, "fp", F.col("doc_id")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component, in the columns of ``docs``.

    It is the row of the smallest id, nulls last; of rows that tie, that of the
    smallest number, which every row gets once.  So rows are told apart by their
    number and never by their id: unrelated texts under one id, or without id,
    all stay, and of two copies under one id one stays.
    """
    number, key = fresh(docs, "_number"), fresh(docs, "_row_key")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    own = F.struct(F.isnull(id_col).alias("void"), F.col(id_col).alias("id"), F.col(number).alias("number"))
    found = near_duplicates(rows.withColumn(key, own), key, text_col)
    at = F.col("doc_id.number")
    gone = materialize(found.where(at != F.col("component_id.number")).select(at.alias(number)), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(side, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
