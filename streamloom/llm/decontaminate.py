"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are cut into words (A-Z lower-cased).  Of the 4-word gram hashes in
every 8-word window the smallest is a fingerprint, so a document and an item
that share any 8 consecutive words share a fingerprint.  Fingerprints are
joined; each candidate is extended to its 8-word windows and kept where the
hash of a whole window agrees as well.  Both hashes are made from 64-bit hashes
of the words, so texts are told apart as far as those hashes of their words are.
Items of fewer than 8 words are one window, looked up at every position.

Items are joined to hit windows, not to fingerprints, so a passage that all items
share is one row of the index, and its items are listed for documents only.

Defined results: a null text has no words; a very long text is searched whole; of
equal least gram hashes in a window each is selected in the document and the
first in the item; a null ``item_id`` marks words as hit but is no item; repeated
rows of a document each get the row's result; an item given twice counts once;
an empty benchmark hits nothing; an empty table gives an empty result; extra
columns are ignored or, in ``drop_contaminated``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, let, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
GRAM = 4
SPAN = WINDOW - GRAM + 1
MIN_ITEMS = 2
#: Windows up to which the benchmark side is broadcast (about 20 MB); beyond, the join shuffles.
BROADCAST_ENTRIES = 400_000

_NO_LONGS = "array<bigint>"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _run(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(length)])


def _each(size: Column, length: int, body) -> Column:
    """``body(i)`` for each start of ``length`` words, none if there are fewer."""
    return F.when(size >= length, F.transform(F.sequence(F.lit(0), size - length), body)).otherwise(
        F.array().cast(_NO_LONGS)
    )


def _hashed(words: Column, body) -> Column:
    """``body(h, g, w, m)``: hashes of words, grams and windows, and the least gram hash of each window."""

    def on_words(h: Column) -> Column:
        n = F.size(h)
        grams = _each(n, GRAM, lambda i: _run(h, i, GRAM))
        windows = _each(n, WINDOW, lambda i: _run(h, i, WINDOW))

        def on_grams(g: Column) -> Column:
            least = _each(n, WINDOW, lambda i: F.least(*[F.get(g, i + k) for k in range(SPAN)]))
            return let(least, lambda m: let(windows, lambda w: body(h, g, w, m)))

        return let(grams, on_grams)

    return let(F.transform(words, lambda x: F.xxhash64(x)), on_words)


def _entry(length: Column, fp: Column, place: Column, windows: Column) -> Column:
    return F.struct(
        length.cast("int").alias("len"), fp.alias("fp"), place.cast("int").alias("pos"), windows.alias("ws")
    )


def _short_entries(h: Column, n: int) -> Column:
    """Every run of ``n`` words, which is fingerprint and window at once."""
    found = _each(F.size(h), n, lambda i: _run(h, i, n))
    return F.transform(found, lambda x, i: _entry(F.lit(n), x, i, F.array(x)))


def _doc_entries(words: Column, short: list[int], own: Column) -> Column:
    """The selected fingerprints of a document, each with the hashes of the windows that can hold it.

    ``ws[j]`` is the window that starts ``j`` words before the gram.  The first
    entry is a mark with position -1 and length 0, by which every document has a
    row; it matches nothing, and its key ``own`` deals marks evenly.
    """

    def body(h: Column, g: Column, w: Column, m: Column) -> Column:
        def is_least(p: Column) -> Column:
            found = F.get(g, p) == F.get(m, p)
            for j in range(1, SPAN):
                found = F.coalesce(found, F.lit(False)) | (F.get(g, p) == F.get(m, p - j))
            return found

        places = F.when(
            F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: F.coalesce(is_least(p), F.lit(False)))
        ).otherwise(F.array().cast("array<int>"))
        entries = [
            F.array(_entry(F.lit(0), own, F.lit(-1), F.array().cast(_NO_LONGS))),
            F.transform(
                places,
                lambda p: _entry(F.lit(WINDOW), F.get(g, p), p, F.array(*[F.get(w, p - j) for j in range(SPAN)])),
            ),
        ]
        return F.concat(*entries, *[_short_entries(h, n) for n in short])

    return _hashed(words, body)


def _item_windows(words: Column) -> Column:
    """Every window of an item as (len, fp, j, window hash)."""

    def row(length: Column, fp: Column, j: Column, window: Column) -> Column:
        return F.struct(
            length.cast("int").alias("len"), fp.alias("fp"), j.cast("int").alias("j"), window.alias("whash")
        )

    def body(h: Column, g: Column, w: Column, m: Column) -> Column:
        full = F.transform(
            w,
            lambda x, i: row(
                F.lit(WINDOW),
                F.get(m, i),
                F.coalesce(*[F.when(F.get(g, i + k) == F.get(m, i), F.lit(k)) for k in range(SPAN)]),
                x,
            ),
        )
        whole = F.lit(None).cast("bigint")
        for n in range(1, WINDOW):
            whole = F.when(F.size(h) == n, _run(h, F.lit(0), n)).otherwise(whole)
        return F.when(F.size(h) >= WINDOW, full).otherwise(F.array(row(F.size(h), whole, F.lit(0), whole)))

    return F.when(F.size(words) > 0, _hashed(words, body))


def index_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The benchmark's windows: (item, len, fp, j, whash), one row per window and item."""
    words = items.select(F.col(id_col).alias("item"), _words(F.col(text_col)).alias("w"))
    return words.select("item", F.explode(_item_windows(F.col("w"))).alias("x")).select("item", "x.*").distinct()


def _union_length(spans: Column) -> Column:
    """Words under the ascending (start, len) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        stop = x["start"] + x["len"]
        return F.struct(
            F.greatest(acc["end"], stop).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(x["start"], acc["end"]))).alias("n"),
        )

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: words, hit words, spans, items that occur in it and the verdict.

    ``text_hash`` and ``doc_id`` identify a row of ``docs``; rows alike in both share a group.
    """
    owned = materialize(index_items(items, item_id_col, item_text_col), "items")
    index = materialize(owned.select("len", "fp", "j", "whash").distinct(), "windows")
    small = index.count() <= BROADCAST_ENTRIES
    short = sorted(r[0] for r in index.where(F.col("len") < WINDOW).select("len").distinct().collect())
    side = index.select(F.col("len").alias("i_len"), F.col("fp").alias("i_fp"), "j", "whash")
    text_hash = F.xxhash64(F.col(text_col))
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        text_hash.alias("text_hash"),
        F.xxhash64(text_hash, F.col(id_col), F.monotonically_increasing_id()).alias("own"),
        _words(F.col(text_col)).alias("w"),
    )
    marked = words.select(
        "doc_id",
        "text_hash",
        F.size("w").alias("n_words"),
        F.explode(_doc_entries(F.col("w"), short, F.col("own"))).alias("x"),
    ).select("doc_id", "text_hash", "n_words", "x.*")
    joined = marked.join(
        F.broadcast(side) if small else side,
        (F.col("fp") == F.col("i_fp"))
        & (F.col("len") == F.col("i_len"))
        & (F.get(F.col("ws"), F.col("j")) == F.col("whash")),
        "left",
    ).where((F.col("pos") < 0) | F.col("whash").isNotNull())
    hit = F.col("whash").isNotNull()
    span = F.struct((F.col("pos") - F.col("j")).alias("start"), F.col("len").alias("len"))
    window = F.struct("len", "whash")
    per_doc = materialize(
        joined.groupBy("doc_id", "text_hash").agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count(F.when(F.col("pos") < 0, 1)).cast("int").alias("copies"),
            F.sort_array(F.collect_set(F.when(hit, span))).alias("spans"),
            F.collect_set(F.when(hit, window)).alias("windows"),
        ),
        "hits",
    )
    listed = owned.where(F.col("item").isNotNull()).select(
        F.struct("len", "whash").alias("window"), F.col("item").cast("string").alias("item")
    ).distinct()
    few = small and listed.count() <= BROADCAST_ENTRIES
    found = (
        per_doc.where(F.size("windows") > 0)
        .withColumn("window", F.explode("windows"))
        .drop("windows")
        .join(F.broadcast(listed) if few else listed, "window", "left")
        .groupBy("doc_id", "text_hash")
        .agg(
            *[F.first(c).alias(c) for c in ("n_words", "copies", "spans")],  # alike in all rows of a document
            F.sort_array(F.collect_set("item")).alias("items"),
        )
    )
    none = per_doc.where(F.size("windows") == 0).drop("windows").withColumn("items", F.array().cast("array<string>"))
    return found.unionByName(none).select(
        "doc_id",
        "text_hash",
        "n_words",
        _union_length(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        (F.size("items") >= MIN_ITEMS).alias("contaminated"),
        "items",
        "spans",
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, in the columns of ``docs``."""
    bad = materialize(
        find_hits(docs, items, id_col, text_col)
        .where("contaminated")
        .select("doc_id", "text_hash")
        .distinct(),
        "contaminated",
    )
    name, bad_id, bad_hash = (fresh(docs, x) for x in ("_text_hash", "_bad_id", "_bad_hash"))
    n_bad, bad = bad.count(), bad.toDF(bad_id, bad_hash)
    if n_bad <= BROADCAST_ENTRIES:
        bad = F.broadcast(bad)
    return (
        docs.withColumn(name, F.xxhash64(F.col(text_col)))
        .join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(name) == F.col(bad_hash)), "left_anti")
        .drop(name)
    )
