"""Lexical retrieval packing into training sequences.

Documents are tokenized once, each followed by an end id, and written to the
shared folder with their distinct terms (token ids) and term counts.  Document
frequencies are counted over the whole corpus (a vector as long as the
vocabulary).  The corpus is dealt by content into index shards of a bounded
number of tokens and documents, each with a BM25 inverted index of its own: a
tree of two-means splits, fitted on a bounded sample, routes every document to
a leaf, and the largest subtrees that fit are shards, so lexical neighbours meet
in one of them.  A leaf that is larger than a shard, such as a group of copies,
is dealt over several by a hash.

In a shard some windows are open at a time.  The seed of each asks the index for
the best unused documents, and pairs of seed and document are granted from the
highest score down, each document once, until the windows are full.  The last
document of a window is cut at its end, and its rest opens the next window and
is the next seed.  Windows that are open when the documents run out are laid end
to end, so only the last sequence of a shard has padding.

Every document of a shard is scored for every seed: nothing is capped, and the
work of a document is bounded by the shard's size, so the whole is linear in the
corpus.  What a seed can't reach is a neighbour in another shard; README.md has
the measured recall.

Defined results: a null or empty text is its end id alone; a very long text is
cut over as many windows as it needs and lies in one shard; ties in score are
broken differently for each seed, by a fixed rule; repeated rows are documents
of their own; a null id stays; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory
from .tokens import encoder, load

SEQUENCE = 4096
#: Tokens and documents of an index shard: bound the memory and the work of a task.
SHARD_TOKENS, SHARD_DOCS = 40_000_000, 32_000
#: Documents that the routing tree is fitted on, and its leaves at most.
SAMPLE, LEAVES = 4096, 512
#: Dimensions of the hashed term vectors that are routed.
DIMS = 1024
#: Windows of a shard that are open at a time at most, and rounds that a shard takes at least.
OPEN, ROUNDS = 192, 12
#: Seeds whose best documents are found at one time.
SEEDS = 24
#: Documents that are held as dense columns at one time.
COLUMNS = 2048
#: Neighbouring scores that are compared by their maximum first.
RUN = 64
#: Scores are rounded to this step, and ties inside it are broken differently for each seed.
STEP = 1e-3
K1, B = 1.2, 0.75
#: A term in one of so many documents of a shard counts as common.
COMMON = 16

CODED = "ids binary, n bigint, terms binary, counts binary"


def _tokenize(path: str, cut: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, cut)
        end = np.array([end_id], own.kind).tobytes()
        for batch in batches:
            coded = own.ids(t.as_py() or "" for t in batch.column("text"))
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                ids = list(islice(coded, part.num_rows))
                found = [np.unique(np.frombuffer(x, own.kind), return_counts=True) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([x + end for x in ids], pa.binary()),
                        pa.array([len(x) // own.kind.itemsize + 1 for x in ids], pa.int64()),
                        pa.array([t.tobytes() for t, _ in found], pa.binary()),
                        pa.array([np.minimum(c, 65_535).astype("<u2").tobytes() for _, c in found], pa.binary()),
                    ],
                    ["doc_id", "ids", "n", "terms", "counts"],
                )
        release_memory()

    return run


def _document_counts(width: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.int64)
        for batch in batches:
            seen += np.bincount(_flat(batch.column("terms"), kind)[0], minlength=width)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "df"])

    return run


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the number of values in each row."""
    rows = [x.as_py() for x in column]
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) // kind.itemsize for x in rows], np.int64)


class Weights:
    """BM25 weights of the terms of documents, from statistics of the whole corpus."""

    def __init__(self, kind: np.dtype, idf: np.ndarray, mean_length: float) -> None:
        self.kind, self.idf, self.mean_length = kind, idf, mean_length

    def of(self, terms: pa.Array, counts: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, weights) of all rows, one after the other, and the number of terms in each row."""
        term, size = _flat(terms, self.kind)
        tf = _flat(counts, np.dtype("<u2"))[0].astype(np.float32)
        norm = (K1 * (1 - B + B * (np.asarray(n, np.int64) - 1) / self.mean_length)).astype(np.float32)
        weight = self.idf[term] * tf
        tf += np.repeat(norm, size)
        weight *= np.float32(K1 + 1)
        weight /= tf
        return term, weight, size

    def vectors(self, batch: pa.RecordBatch) -> np.ndarray:
        """Hashed unit vectors of the rows of a batch."""
        term, weight, size = self.of(batch.column("terms"), batch.column("counts"), batch.column("n"))
        at = term.astype(np.int64) * 2_654_435_761 % (1 << 32) * DIMS >> 32
        at += np.repeat(np.arange(len(size)) * DIMS, size)
        x = np.bincount(at, weight, len(size) * DIMS).reshape(-1, DIMS).astype(np.float32)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


class Router:
    """A tree of two-means splits."""

    def __init__(self, x: np.ndarray, leaves: int) -> None:
        self.planes, self.shifts, self.below = [], [], []
        self.leaves = 0
        self.root = self._split(x, np.arange(len(x)), leaves)
        self.planes = np.array(self.planes, np.float32).reshape(-1, x.shape[1])
        self.shifts = np.array(self.shifts, np.float32)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves  # leaf k is the node -1 - k

    def _split(self, x: np.ndarray, rows: np.ndarray, leaves: int) -> int:
        own = x[rows]
        if leaves < 2 or len(rows) < 8:
            return self._leaf()
        mean = own.mean(axis=0)
        left = own[((own - mean) ** 2).sum(axis=1).argmax()]
        right = own[((own - left) ** 2).sum(axis=1).argmax()]
        for _ in range(12):
            plane, shift = left - right, (left @ left - right @ right) / 2
            side = own @ plane > shift
            if side.all() or not side.any():
                return self._leaf()
            left, right = own[side].mean(axis=0), own[~side].mean(axis=0)
        side = own @ plane > shift
        if side.all() or not side.any():
            return self._leaf()
        node = len(self.planes)
        self.planes.append(plane)
        self.shifts.append(shift)
        self.below.append((0, 0))
        share = min(leaves - 1, max(1, round(leaves * side.mean())))
        self.below[node] = (
            self._split(x, rows[side], share),
            self._split(x, rows[~side], leaves - share),
        )
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        if len(self.planes):
            side, below = x @ self.planes.T > self.shifts, np.array(self.below)
            inner = np.flatnonzero(at >= 0)
            while len(inner):
                node = at[inner]
                at[inner] = below[node, np.where(side[inner, node], 0, 1)]
                inner = inner[at[inner] >= 0]
        return -1 - at


def deal(router: Router, sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first shard, shards) of each leaf, from the (documents, tokens) of the leaves.

    The largest subtrees that fit are shards; a leaf that does not fit has several.
    """
    out: list[tuple[int, int]] = [(0, 1)] * router.leaves
    shards = 0

    def leaves(node: int) -> list[int]:
        return [-1 - node] if node < 0 else [x for n in router.below[node] for x in leaves(n)]

    def visit(node: int) -> None:
        nonlocal shards
        own = leaves(node)
        docs, tokens = (sum(sizes[k][i] for k in own) for i in (0, 1))
        parts = max(1, -(-tokens // SHARD_TOKENS), -(-docs // SHARD_DOCS))
        if parts > 1 and node >= 0:
            for n in router.below[node]:
                visit(n)
            return
        for k in own:
            out[k] = (shards, parts)
        shards += parts

    visit(router.root)
    return out


class ShardIndex:
    """Inverted index of the documents of one shard, with BM25 weights on its postings.

    Terms in at least one of COMMON documents are scored by matrix products, on
    dense columns of COLUMNS documents at a time.
    """

    def __init__(self, term: np.ndarray, weight: np.ndarray, size: np.ndarray, width: int) -> None:
        self.term, self.weight, self.size, self.width = term, weight, size, width
        self._build()

    def _build(self) -> None:
        term, self.n = self.term, len(self.size)
        count = np.bincount(term, minlength=self.width)
        common = np.flatnonzero(count * COMMON >= self.n) if self.n >= COMMON else np.empty(0, np.int64)
        self.n_common = len(common)
        self.row = np.full(self.width, -1, np.int32)
        self.row[common] = np.arange(self.n_common)
        start = np.append(0, np.cumsum(self.size))
        dense = np.zeros(self.width, bool)
        dense[common] = True
        dense = dense[term]
        before = np.append(0, np.cumsum(dense))
        self.d_start = before[start[np.minimum(np.arange(0, self.n + COLUMNS, COLUMNS), self.n)]]
        del before
        owner = np.repeat(np.arange(self.n, dtype=np.int32), self.size)
        small = np.uint16 if self.n_common <= 1 << 16 else np.int32
        self.d_row, self.d_weight = self.row.astype(small)[term[dense]], self.weight[dense]
        self.d_column = (owner[dense] % COLUMNS).astype(np.uint16)
        np.invert(dense, out=dense)
        term, owner, weight = term[dense], owner[dense], self.weight[dense]
        order = np.argsort(term, kind="stable")
        self.owner, self.rare = owner[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(self.width + 1))

    def drop(self, used: np.ndarray) -> None:
        """Leave out the documents that are used."""
        self.d_row = self.d_column = self.d_weight = self.owner = self.rare = None
        stay = np.repeat(~used, self.size)
        self.term, self.weight, self.size = self.term[stay], self.weight[stay], self.size[~used]
        del stay
        self._build()

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """BM25 of every document against each set of distinct terms, as rows."""
        asked = np.zeros((len(queries), self.n_common), np.float32)
        for q, own in enumerate(queries):
            rows = self.row[own]
            asked[q, rows[rows >= 0]] = 1
        found = np.zeros((len(queries), self.n), np.float32)
        for b, first in enumerate(range(0, self.n, COLUMNS)):
            last = min(self.n, first + COLUMNS)
            block = np.zeros((self.n_common, last - first), np.float32)
            i, j = self.d_start[b], self.d_start[b + 1]
            block[self.d_row[i:j], self.d_column[i:j]] = self.d_weight[i:j]
            found[:, first:last] = asked @ block
        for q, own in enumerate(queries):
            own = own.astype(np.int64)
            first, last = self.starts[own], self.starts[own + 1]
            size = last - first
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            found[q] += np.bincount(self.owner[at], self.rare[at], minlength=self.n)
        return found


_TIES = (np.tile(np.random.default_rng(5).permutation(1 << 16), 2) / (1 << 16) * STEP).astype(np.float32)


def best(score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and value of the ``top`` largest scores of each row; the best runs of columns are searched only."""
    rows, n = score.shape
    runs = -(-n // RUN)
    if runs <= 2 * top:
        top = min(top, n)
        at = np.argpartition(-score, top - 1, axis=1)[:, :top]
        return at, np.take_along_axis(score, at, axis=1)
    padded = np.full((rows, runs * RUN), -np.inf, np.float32)
    padded[:, :n] = score
    padded = padded.reshape(rows, runs, RUN)
    chosen = np.argpartition(-padded.max(axis=2), top - 1, axis=1)[:, :top]
    inside = np.take_along_axis(padded, chosen[:, :, None], axis=1).reshape(rows, top * RUN)
    at = np.argpartition(-inside, top - 1, axis=1)[:, :top]
    return np.take_along_axis(chosen, at // RUN, axis=1) * RUN + at % RUN, np.take_along_axis(inside, at, axis=1)


class _Window:
    """An open window: its seed, the terms it asks for, how full it is and its pieces."""

    def __init__(self) -> None:
        self.seed, self.terms, self.offset, self.pieces = None, None, 0, []


def pack_documents(lengths: np.ndarray, index: ShardIndex) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of the documents of a shard; uses up its index."""
    n, left = len(lengths), int(lengths.sum())
    windows = [_Window() for _ in range(max(1, min(OPEN, left // SEQUENCE // ROUNDS)))]
    top = int(min(256, max(16, 8 * SEQUENCE * n // left)))
    used, live = np.zeros(n, bool), np.arange(n)
    done: list[tuple[int, int, int, int, int]] = []
    full, tried = 0, 0
    term, bounds = index.term, np.append(0, np.cumsum(index.size))

    def terms_of(doc: int) -> np.ndarray:
        return term[bounds[doc] : bounds[doc + 1]]

    def place(window: _Window, doc: int) -> bool:
        """Lay a whole document; where the window ends, the rest is the next seed.  True if it ended."""
        nonlocal full, left
        used[doc] = True
        start, total, before = 0, int(lengths[doc]), full
        left -= total
        while start < total:
            length = min(total - start, SEQUENCE - window.offset)
            window.pieces.append((doc, start, length, window.offset))
            start, window.offset = start + length, window.offset + length
            if window.offset == SEQUENCE:
                done.extend((d, s, m, full, o) for d, s, m, o in window.pieces)
                full += 1
                window.pieces, window.offset = [], 0
                window.seed, window.terms = (doc if start < total else None), terms_of(doc)
        return full != before

    while left:
        wanted = sum(SEQUENCE - w.offset for w in windows if w.seed is not None)
        for window in windows:
            while window.seed is None and left and (wanted + SEQUENCE <= left or not wanted):
                while used[tried]:
                    tried += 1
                window.seed, window.terms = tried, terms_of(tried)
                place(window, tried)
                if window.seed is not None:
                    wanted += SEQUENCE - window.offset
        asking = {w.seed: w for w in windows if w.seed is not None}
        if not left or not asking:
            continue
        if used[live].mean() > 0.3:
            index.drop(used[live])
            live = live[~used[live]]
        seeds = list(asking)
        score = index.scores([asking[s].terms for s in seeds])
        gone, found = used[live], []
        for k in range(0, len(seeds), SEEDS):
            part = score[k : k + SEEDS]
            np.divide(part, np.float32(STEP), out=part)
            np.round(part, out=part)
            part *= np.float32(STEP)
            for row, seed in zip(part, seeds[k : k + SEEDS], strict=True):
                row += _TIES[live % (1 << 16) + seed * 40_503 % (1 << 16)]
            part[:, gone] = -np.inf
            found.append(best(part, top))
        at, value = (np.concatenate(x) for x in zip(*found, strict=True))
        del score, part
        order = np.lexsort((live[at].ravel(), np.repeat(seeds, at.shape[1]), -value.ravel()))
        order = order[value.ravel()[order] > -np.inf]
        who, docs = order // at.shape[1], live[at.ravel()[order]]
        for seed, doc in zip(who.tolist(), docs.tolist(), strict=True):
            window = asking.get(seeds[seed])
            if window is not None and not used[doc] and place(window, doc):
                del asking[seeds[seed]]
                if not asking:
                    break
    offset = 0
    for doc, start, length, _ in (piece for window in windows for piece in window.pieces):
        while length:
            if offset == SEQUENCE:
                full, offset = full + 1, 0
            part = min(length, SEQUENCE - offset)
            done.append((doc, start, part, full, offset))
            start, length, offset = start + part, length - part, offset + part
    return done


def _pack(weights: Weights):
    kind = weights.kind

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        order = pc.sort_indices(shard, [("number", "ascending")])
        ids, names = shard.column("ids"), shard.column("doc_id")
        lengths = shard.column("n").take(order).to_numpy()
        terms, counts = (shard.column(c).take(order) for c in ("terms", "counts"))
        del shard
        term, weight, size = weights.of(terms, counts, lengths)
        del terms, counts
        pieces = pack_documents(lengths, ShardIndex(term, weight, size, len(weights.idf)))
        del term, weight, size
        pieces = np.array(pieces, np.int64)
        pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
        who, start, length, sequence, offset = pieces.T
        at = order.to_numpy()[who]
        marks = np.empty(len(pieces), np.int64)
        for k, (doc, first, count) in enumerate(zip(at.tolist(), start.tolist(), length.tolist(), strict=True)):
            own = np.frombuffer(ids[doc].as_buffer(), kind)
            marks[k] = zlib.crc32(own[first : first + count].astype("<u4"))
        del ids
        release_memory()
        return pa.table(
            {
                "doc_id": names.take(pa.array(at)),
                "start": start,
                "length": length,
                "ids_crc32": marks,
                "doc_tokens": lengths[who],
                "shard": np.full(len(who), key[0].as_py()),
                "sequence": sequence,
                "offset": offset,
            }
        )

    return run


def _sample_vectors(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = weights.vectors(batch)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return run


def _leaves(weights: Weights, router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [router.leaf(weights.vectors(batch.slice(k, 512))) for k in range(0, batch.num_rows, 512)]
            leaf = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    return run


def fit_router(coded: DataFrame, weights: Weights, n_docs: int, shards: int) -> Router:
    """The routing tree, fitted on SAMPLE documents drawn by a hash of their number."""
    # somewhat more than the bound pass the filter, so that few rows are sorted for it
    share = min(1.0, 1.25 * SAMPLE / n_docs)
    passed = coded.where(F.pmod(F.xxhash64("number"), F.lit(1 << 30)) < share * (1 << 30))
    drawn = passed.select("terms", "counts", "n", "number").orderBy(F.xxhash64("number"), "number").limit(SAMPLE)
    rows = drawn.mapInArrow(_sample_vectors(weights), "x binary").collect()
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows]).reshape(-1, DIMS)
    return Router(x, min(LEAVES, 8 * shards))


def with_shards(coded: DataFrame, weights: Weights, n_docs: int, n_tokens: int) -> DataFrame:
    """``coded`` with the ``shard`` of each row."""
    shards = max(-(-n_tokens // SHARD_TOKENS), -(-n_docs // SHARD_DOCS))
    if shards < 2:
        return coded.withColumn("shard", F.lit(0))
    router = fit_router(coded, weights, n_docs, shards)
    run = _leaves(weights, router)
    slim = coded.select("terms", "counts", "n").mapInArrow(run, "terms binary, counts binary, n bigint, leaf bigint")
    found = slim.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).collect()
    sizes = {r["leaf"]: (r["docs"], r["tokens"]) for r in found}  # LEAVES rows at most
    dealt = deal(router, [sizes.get(k, (0, 0)) for k in range(router.leaves)])
    first, parts = (F.array(*[F.lit(x[i]) for x in dealt]) for i in (0, 1))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)

    def of(values: Column) -> Column:
        return F.get(values, F.col("leaf").cast("int"))

    shard = (of(first) + F.pmod(F.xxhash64("number"), of(parts))).cast("int")
    return coded.mapInArrow(run, f"{kinds}, leaf bigint").withColumn("shard", shard).drop("leaf")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    cut: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    tokenizer = load(tokenizer_path)
    width = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = encoder(tokenizer_path, cut).kind
    coded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _tokenize(tokenizer_path, cut, end_id), f"doc_id {kind_of_id}, {CODED}"
    )
    coded = materialize(coded.withColumn("number", F.monotonically_increasing_id()), "ids")
    n_docs, n_tokens = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = coded.select("terms").mapInArrow(_document_counts(width, kind), "id bigint, df bigint")
    df = np.zeros(width)
    for row in counted.groupBy("id").agg(F.sum("df").alias("df")).collect():  # as many rows as the vocabulary at most
        df[row["id"]] = row["df"]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    weights = Weights(kind, idf, max(1.0, (n_tokens - n_docs) / max(1, n_docs)))
    schema = (
        f"doc_id {kind_of_id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "shard bigint, sequence bigint, offset bigint"
    )
    pieces = with_shards(coded, weights, n_docs, n_tokens).groupBy("shard").applyInArrow(_pack(weights), schema)
    # a shard has fewer than 2^32 windows
    sequence = F.shiftleft(F.col("shard"), 32) + F.col("sequence")
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset"
    )
