"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of their low-rank vectors; the sum over all pairs
is half the square of the summed vectors less the sum of their squares, so a score takes time linear in the
features present. The machine is fitted with Adam on logistic loss, over a bounded sample of labelled
documents whose features were made on the executors; scoring is one pass without a shuffle.

Null or empty text: no words, all statistics 0, a score like any other. Without any label the score is
0.5. Repeated rows are scored alike; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import fold, table
from tallyspark.llm.labelled import fit_sample
from tallyspark.llm.quality_rules import SYMBOLS, UPPER, repeated_words, surplus

#: Labelled documents that the machine is fitted on at most.
FIT_ROWS = 12_000
WORD_FEATURES = 1 << 12
STATISTICS = ("length", "words", "lines", "mean_word", "symbols", "upper", "digits", "marks", "repeats", "dup_lines", "doubled", "bare")
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 12, 128, 0.02, 1e-5
MARKS = np.zeros(256, np.int64)
MARKS[list(b".,;:!?\"'()-")] = 1
DIGITS = np.zeros(256, np.int64)
DIGITS[ord("0") : ord("9") + 1] = 1
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
FEATURES = WORD_FEATURES + len(STATISTICS)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, and each text's range of them. Word values have length 1 a text."""
    n = len(offsets) - 1
    words = tx.Words(raw, offsets)
    owner, hashes = words.owner(), words.hashes()
    keys, counts = np.unique(owner * WORD_FEATURES + (hashes % np.uint64(WORD_FEATURES)).astype(np.int64), return_counts=True)
    of, number = keys // WORD_FEATURES, keys % WORD_FEATURES
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(of, value**2, n))
    value = value / norm[of]
    lines = tx.Words(raw, offsets, NEWLINE)
    n_words, n_lines = np.diff(words.first), np.diff(lines.first)
    size = np.maximum(np.diff(offsets), 1)
    some = np.maximum(n_words, 1)
    cased = words.hashes(lower=False)
    dense = np.stack(
        [
            np.log1p(np.diff(offsets)) / 10,
            np.log1p(n_words) / 8,
            np.log1p(n_lines) / 5,
            np.minimum(tx.sums(words.inside.astype(np.int64), offsets) / some / 10, 3),
            np.minimum(tx.sums(SYMBOLS[raw], offsets) / some, 3),
            5 * tx.sums(UPPER[raw], offsets) / size,
            5 * tx.sums(DIGITS[raw], offsets) / size,
            5 * tx.sums(MARKS[raw], offsets) / size,
            repeated_words(cased, owner, n) / some,
            surplus(lines.hashes(lower=False), lines.owner(), n) / np.maximum(n_lines, 1),
            np.bincount(owner[1:][(cased[1:] == cased[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / some,
            (n_words == 0).astype(float),
        ],
        axis=1,
    )
    doc = np.concatenate([of, np.repeat(np.arange(n), len(STATISTICS))])
    number = np.concatenate([number, np.tile(WORD_FEATURES + np.arange(len(STATISTICS)), n)])
    value = np.concatenate([value, dense.ravel()])
    order = np.argsort(doc, kind="stable")
    return number[order], value[order], np.searchsorted(doc[order], np.arange(n + 1))


class Machine:
    """w0 + sum of w x + half of ((sum of v x)^2 - sum of (v x)^2), summed over the rank."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[number] * value[:, None]
        total = np.add.reduceat(vx, first[:-1], axis=0)
        squares = np.add.reduceat(vx**2, first[:-1], axis=0)
        line = np.add.reduceat(self.w[number] * value, first[:-1])
        return self.w0 + line + 0.5 * (total**2 - squares).sum(axis=1), total

    def score(self, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(number, value, first)[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
    if not len(y):
        model.v[:] = 0
        return model
    rate = np.clip(y.mean(), 0.01, 0.99)
    model.w0 = float(np.log(rate / (1 - rate)))
    state = [np.zeros((2, *p.shape)) for p in (model.w, model.v)]
    w0_state, t = np.zeros(2), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            number = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            first = np.append(0, np.cumsum([len(rows[i][0]) for i in some]))
            raw, total = model.raw(number, value, first)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some)
            each = np.repeat(error, np.diff(first)) * value
            dw = np.bincount(number, each, FEATURES) + DECAY * model.w
            dv = np.zeros((FEATURES, RANK))
            pull = each[:, None] * (np.repeat(total, np.diff(first), axis=0) - model.v[number] * value[:, None])
            for k in range(RANK):
                dv[:, k] = np.bincount(number, pull[:, k], FEATURES)
            dv += DECAY * model.v
            t += 1
            for p, g, s in ((model.w, dw, state[0]), (model.v, dv, state[1])):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                p -= RATE * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
            g = error.sum()
            w0_state = np.array([0.9, 0.999]) * w0_state + np.array([0.1 * g, 0.001 * g * g])
            model.w0 -= RATE * (w0_state[0] / (1 - 0.9**t)) / (np.sqrt(w0_state[1] / (1 - 0.999**t)) + 1e-8)
    return model


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts, as bytes."""
    for batch in tx.chunks(batches):
        number, value, first = features(*tx.text_bytes(batch.column("text")))
        each = list(zip(first[:-1], first[1:], strict=True))
        yield pa.RecordBatch.from_pydict(
            {
                "label": batch.column("label"),
                "numbers": pa.array([number[a:b].astype(np.uint16).tobytes() for a, b in each], pa.binary()),
                "values": pa.array([value[a:b].astype(np.float32).tobytes() for a, b in each], pa.binary()),
            }
        )


def scorer(shared: Callable[[], Machine]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in tx.chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": model.score(*features(*tx.text_bytes(batch.column("text"))))})

    return run


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and score of each document, fitted on labels outside the held-out fold."""
    rows = fit_sample(docs, labels, label, fit_rows).mapInArrow(describe, "label int, numbers binary, values binary").toArrow()
    each = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.float32).astype(np.float64)) for a, b in zip(rows.column("numbers").to_pylist(), rows.column("values").to_pylist(), strict=True)]
    model = docs.sparkSession.sparkContext.broadcast(fit(each, (rows.column("label").to_numpy() == 1).astype(float)))
    return docs.select("doc_id", "text").mapInArrow(scorer(lambda: model.value), "doc_id long, score double")


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
