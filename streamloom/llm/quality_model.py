"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins.  Shallow trees are boosted in turns
over the features, each on one feature only, so their sum is a lookup table for
each feature; then over the pairs with the strongest remaining interaction, each
a table of two features.  A score is the logistic of the sum of looked-up values.

The tables are fitted on the driver on a bounded sample of labelled documents
(``sample_rows`` at most, drawn by a hash of the id); only feature vectors are
gathered.

Defined results: a null text is an empty one and is scored; a very long text is
described whole; labels that average to a half count as 1; without usable
labels the score is 0.5, with one class only its smoothed share; repeated rows
get one row each; several labels of one id are averaged; a null id counts as
the empty text when rows are held out and has no label; extra columns are
ignored or, in ``keep_good``, kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out

THRESHOLD = 0.3
SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
N_PAIRS = 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 120, 40, 0.1, 2.0

FEATURES = (
    "log_words",
    "mean_word_length",
    "word_length_spread",
    "distinct_words",
    "top_word",
    "repeated_windows",
    "symbols",
    "bars",
    "punctuation",
    "digits",
    "upper_case",
    "log_lines",
    "repeated_lines",
    "closed_lines",
    "words_per_line",
)
_CLASSES = {
    "symbols": b"#*$%&|<>~^@{}[]=_\\",
    "bars": b"|",
    "punctuation": b".,;:!?",
    "digits": b"0123456789",
    "upper_case": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}
_PICK = {k: np.frombuffer(v, np.uint8) for k, v in _CLASSES.items()}


def describe(text: str | None) -> list[float]:
    """The features of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    n, size = max(1, len(words)), max(1, len(data))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    number = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {k: number[v].sum() / size for k, v in _PICK.items()}
    seen = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = sum(c for c in windows.values() if c > 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    closed = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines)
    n_lines = max(1, len(lines))
    return [
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        again / n,
        share["symbols"],
        share["bars"],
        share["punctuation"],
        share["digits"],
        share["upper_case"],
        np.log1p(len(lines)),
        1 - len(set(lines)) / n_lines,
        closed / n_lines,
        len(words) / n_lines,
    ]


def _describe_all(texts: list[str | None]) -> np.ndarray:
    return np.array([describe(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def _tree_values(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The leaf value of each bin under the best tree of ``depth`` on ordered bins (Newton steps)."""
    out = np.full(len(g), g.sum() / (h.sum() + SHRINK))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK)
    gain[(hl < 1) | (hr < 1)] = -np.inf
    cut = int(gain.argmax())
    if not gain[cut] > g.sum() ** 2 / (h.sum() + SHRINK):
        return out
    out[: cut + 1] = _tree_values(g[: cut + 1], h[: cut + 1], depth - 1)
    out[cut + 1 :] = _tree_values(g[cut + 1 :], h[cut + 1 :], depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best gain and cell values of a tree that cuts both axes of a table once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c: np.ndarray) -> np.ndarray:
        a = c[:-1, :-1]
        b = c[:-1, -1:] - a
        d = c[-1:, :-1] - a
        return np.stack([a, b, d, c[-1, -1] - a - b - d])

    qg, qh = corners(cg), corners(ch)
    gain = (qg**2 / (qh + SHRINK)).sum(axis=0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = qg[:, i, j] / (qh[:, i, j] + SHRINK)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, prior: float = 0.5) -> None:
        self.base = float(np.log(prior / (1 - prior)))
        self.edges: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    @staticmethod
    def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))

    def _bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
        return fine, coarse

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        n = x.shape[1]
        self.edges = [self._cuts(x[:, k], BINS) for k in range(n)]
        self.pair_edges = [self._cuts(x[:, k], PAIR_BINS) for k in range(n)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        fine, coarse = self._bins(x)
        total = np.full(len(y), self.base)

        def steps() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k in range(n):
                g, h = steps()
                size = len(self.tables[k])
                value = RATE * _tree_values(np.bincount(fine[k], g, size), np.bincount(fine[k], h, size), 2)
                self.tables[k] += value
                total += value[fine[k]]
        cells, gains = {}, {}
        g, h = steps()
        for i, j in combinations(range(n), 2):
            a, b = len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1
            if min(a, b) < 2:
                continue
            cells[i, j] = coarse[i] * b + coarse[j], (a, b)
            at, shape = cells[i, j]
            gains[i, j], _ = _quadrants(
                np.bincount(at, g, a * b).reshape(shape), np.bincount(at, h, a * b).reshape(shape)
            )
        self.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:N_PAIRS]
        self.pair_tables = [np.zeros(cells[p][1]) for p in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, p in enumerate(self.pairs):
                g, h = steps()
                at, shape = cells[p]
                area = shape[0] * shape[1]
                _, value = _quadrants(
                    np.bincount(at, g, area).reshape(shape), np.bincount(at, h, area).reshape(shape)
                )
                self.pair_tables[k] += RATE * value
                total += RATE * value.ravel()[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self._bins(x)
        total = np.full(len(x), self.base)
        for table, at in zip(self.tables, fine, strict=True):
            total += table[at]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _describe_all([t.as_py() for t in batch.column("text")])
        yield pa.RecordBatch.from_arrays(
            [batch.column("name"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["name", "y", "x"]
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> AdditiveModel:
    """A model fitted on labelled documents that are not held out."""
    usable = (
        labels.where(~held_out(label_id_col) & F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(label_id_col).alias("name"))
        .agg(F.avg(label_col).alias("y"))
    )
    n = usable.count()
    if not n:
        return AdditiveModel()
    # somewhat more than the bound pass the filter, so that few rows are sorted for it
    share = min(1.0, 1.1 * sample_rows / n)
    passed = usable.where(F.pmod(F.xxhash64("name"), F.lit(1 << 30)) < share * (1 << 30))
    drawn = passed.orderBy(F.xxhash64("name"), "name").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = rows.join(F.broadcast(drawn), F.col("id") == F.col("name")).select("name", "y", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    described = texts.mapInArrow(_sample_rows, f"name {kind}, y double, x array<double>")
    sample = described.groupBy("name").agg(F.min(F.struct("y", "x")).alias("r")).select("name", "r.*").toPandas()
    if sample.empty:
        return AdditiveModel()
    sample = sample.sort_values("name")
    y = (sample["y"] >= 0.5).to_numpy().astype(float)
    model = AdditiveModel((y.sum() + 1) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        model.fit(np.array(sample["x"].tolist(), float), y)
    return model


def _scorer(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(_describe_all([t.as_py() for t in batch.column("text")]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    ).mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, in the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.schema.get_field_index(text_col))]
            yield batch.filter(pa.array(model.scores(_describe_all(texts)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
