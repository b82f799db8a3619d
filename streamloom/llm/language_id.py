"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1 bits.  One linear classifier for each
bit, on hashed byte 2-grams and 3-grams of the whole lower-cased text, says
which side a text is on.  Decoding sums the logistic loss of all bits against
each codeword, every bit weighted by its reliability in training, and takes the
codeword of least loss; a small lead over the second marks the text ambiguous.

The classifiers are fitted on the driver on a bounded sample of different
texts: the least hashes of each language, up to an equal share of
``sample_rows`` and at least one text.

Defined results: a null text or one without a letter is ``und`` with score 0; a
very long text is counted whole, in blocks; of equal losses the first language
by name wins;
without any labelled text every prediction is ``und``; with a single language
that one is predicted; repeated rows get one row each; a null id counts as the
empty text when rows are held out; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMS = 4096
SAMPLE_ROWS = 2400
FOLDS = 5
#: Leads in loss per bit below this are ambiguous.
AMBIGUOUS_LEAD = 0.15
_BLOCK = 1 << 20


def held_out(id_col: str) -> Column:
    """True for the fold that no model is fitted on."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(FOLDS)) == 0


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram frequencies, as a unit vector."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(DIMS, np.int64)
    for k in range(0, len(data), _BLOCK):
        b = data[k : k + _BLOCK + 2].astype(np.uint32)
        two = b[:-1] | b[1:] << 8
        three = two[:-1] | b[2:] << 16
        for grams, odd in ((two, np.uint32(2654435761)), (three, np.uint32(2246822519))):
            counts += np.bincount((grams * odd) >> np.uint32(20), minlength=DIMS)
    root = np.sqrt(counts).astype(np.float32)
    return root / max(float(np.sqrt(counts.sum())), 1.0)


def codebook(n: int) -> np.ndarray:
    """Codewords of ``n`` classes as rows: every split of few classes, else the best of random codes."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    bits, best, found = max(15, int(np.ceil(10 * np.log2(n)))), -1, None
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (n, bits))
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if near > best and (np.abs(code.sum(axis=0)) < n).all():
            best, found = near, code
    return found


class CodeModel:
    """Bit classifiers and their decoding."""

    def __init__(self, languages: list[str]) -> None:
        self.languages, self.code = languages, codebook(len(languages))
        bits = self.code.shape[1]
        self.weights, self.bias, self.trust = np.zeros((DIMS, bits)), np.zeros(bits), np.ones(bits)

    def fit(self, x: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> None:
        """Logistic regression of all bits at once, by Adam over the whole sample."""
        y = self.code[labels].astype(np.float32)
        share = np.bincount(labels, minlength=len(self.languages))
        weight = (1.0 / share[labels] / (share > 0).sum()).astype(np.float32)[:, None]
        w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            pull = -y * weight / (1 + np.exp(np.clip(y * (x @ w[:-1] + w[-1]), -30, 30)))
            grad = np.vstack([x.T @ pull, pull.sum(axis=0)]) + ridge * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias = w[:-1], w[-1]
        wrong = ((y * (x @ self.weights + self.bias) <= 0) * weight).sum(axis=0)
        error = np.clip(wrong, 0.005, 0.495)
        self.trust = np.log((1 - error) / error)
        self.trust /= self.trust.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, score, ambiguous) of each row of features."""
        margin = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = np.stack([np.log1p(np.exp(-margin * word)) @ self.trust for word in self.code], axis=1)
        best = loss.argmin(axis=1)
        least = loss.min(axis=1)
        odds = np.exp(-self.code.shape[1] * (loss - least[:, None]))
        rest = np.sort(loss, axis=1)
        lead = rest[:, 1] - rest[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, 1 / odds.sum(axis=1), lead < AMBIGUOUS_LEAD


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x.as_py() or "").tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.binary())], ["lang", "x"])


def _least_marks(quota: int):
    """The ``quota`` least marks of each language in a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"lang": [], "mark": []})
        for batch in batches:
            best = pd.concat([best, batch]) if len(best) else batch
            best = best.sort_values(["lang", "mark"])
            best = best[best.groupby("lang").cumcount() < quota]
        if len(best):
            yield best

    return run


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> CodeModel:
    """A model of the languages in the rows of ``docs`` that are not held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    rows = rows.withColumn("mark", F.xxhash64("text"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    model = CodeModel(languages)
    if len(languages) < 2:
        return model
    quota = max(1, sample_rows // len(languages))
    marks = rows.select("lang", "mark").distinct()
    marks = marks.mapInPandas(_least_marks(quota), "lang string, mark bigint").collect()
    least = {}
    for lang, mark in marks:
        least.setdefault(lang, []).append(mark)
    chosen = [(lang, mark) for lang, found in least.items() for mark in sorted(found)[:quota]]
    side = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, mark bigint"))
    drawn = rows.join(side, ["lang", "mark"], "left_semi").groupBy("lang", "mark").agg(F.min("text").alias("text"))
    sample = drawn.mapInArrow(_sample_features, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if len(model.languages) > 1:
        x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), DIMS)
        model.fit(x, np.searchsorted(model.languages, sample["lang"].to_numpy()))
    return model


def _predictor(model: CodeModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [x.as_py() for x in part.column("text")]
                known = np.array([bool(model.languages and t and any(map(str.isalpha, t))) for t in texts])
                names = np.full(len(texts), UNKNOWN, object)
                score, unsure = np.zeros(len(texts)), np.ones(len(texts), bool)
                if known.any():
                    x = np.stack([features(t) for t, ok in zip(texts, known, strict=True) if ok])
                    best, score[known], unsure[known] = model.decode(x)
                    names[known] = np.array(model.languages, object)[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(names, pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                        pa.array(unsure),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return run


def predict(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    ).mapInArrow(
        _predictor(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )
