"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import cut, held_out, label_sample, lean, slices

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Random features, and the weight of the ridge penalty for each labelled row.
FEATURES, RIDGE = 256, 1e-3
#: Documents below this score are rejected.
THRESHOLD = 0.3

_LETTER, _UPPER, _DIGIT, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH[128:] = True
_STOP, _COMMA, _BANG, _BAR = 46, 44, 33, 124
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _HIGH)
_SYMBOL[[_STOP, _COMMA]] = False
STATISTICS = 17


def statistics(text: str) -> list[float]:
    """Length, character shares, word and line statistics of a whole text; all are 0 for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * STATISTICS
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    w = text.split()
    lines = [x for x in text.split("\n") if x]
    k, m = max(1, len(w)), max(1, len(lines))
    lengths = list(map(len, w))
    distinct = len(set(w))
    letters = max(1, int(c[_LETTER].sum()))
    mean = sum(lengths) / k
    return [
        math.log1p(n),
        math.log1p(len(w)),
        math.log1p(len(lines)),
        mean,
        math.sqrt(max(0.0, sum(x * x for x in lengths) / k - mean * mean)),
        math.log1p(max(lengths, default=0)),
        distinct / k,
        distinct / math.sqrt(k),
        len(set(lines)) / m,
        int(c[_UPPER].sum()) / letters,
        int(c[_DIGIT].sum()) / n,
        int(c[_SYMBOL].sum()) / n,
        int(c[_HIGH].sum()) / n,
        int(c[_STOP] + c[_BANG]) / k,
        int(c[_COMMA]) / k,
        int(c[_BAR]) / k,
        int(c[_SPACE].sum()) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def random_features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        f = np.sqrt(2 / self.directions.shape[1]) * np.cos(z @ self.directions + self.phases)
        return np.hstack([f, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.random_features(x) @ self.weights
        return np.clip(np.interp(raw, self.steps, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y by x, by pooling adjacent violators: the pools' mean x, and levels smoothed by one pseudo-row."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    p = np.array(pools)
    base = y.mean() if len(y) else 0.5
    return p[:, 2] / p[:, 1], (p[:, 0] + base) / (p[:, 1] + 1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = [statistics(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])


def _normal_equations(model: Model, calibrating: int):
    """Sums over a partition: z'z and z'y of the rows that fit, in one row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        total, n = np.zeros((d, d + 1)), 0
        for b in batches:
            pick = np.array(b.column(1)) != calibrating
            if pick.any():
                z = model.random_features(np.array(b.column(2).to_pylist())[pick])
                y = np.array(b.column(0), float)[pick]
                total[:, :d] += z.T @ z
                total[:, d] += z.T @ y
                n += len(y)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    return sums


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS, seed: int = 7) -> Model | None:
    """Fit on at most `most` labelled rows that aren't held out; None if there are none.

    Rows of fold 1 calibrate, the others give the normal equations, summed partition by partition; if either share is
    empty, all rows serve for both. What reaches the driver is bounded by the sample, not by the corpus.
    """
    lean(docs.sparkSession)
    sample = F.broadcast(label_sample(labels, label, most))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("y", "text", "fold")
    measured = cut(joined.mapInArrow(_measured, "y int, fold int, x array<double>"))
    rows = measured.collect()
    if not rows:
        return None
    x = np.array([r["x"] for r in rows])
    y = np.array([r["y"] for r in rows], float)
    fold = np.array([r["fold"] for r in rows])
    calibrating = 1 if (fold == 1).any() and (fold != 1).any() else -1
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    model = Model(x.mean(0), np.maximum(x.std(0), 1e-3), rng.normal(0, 1 / math.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    # Only the sample is dealt to few tasks, for each returns a matrix; the scan of all documents keeps its own.
    parts = measured.coalesce(8).mapInArrow(_normal_equations(model, calibrating), "n long, sums binary").collect()
    total = sum(np.frombuffer(p["sums"]).reshape(FEATURES + 1, FEATURES + 2) for p in parts)
    n = sum(p["n"] for p in parts)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), total[:, -1])
    pick = fold == 1 if calibrating == 1 else np.ones(len(y), bool)
    raw = model.random_features(x[pick]) @ model.weights
    model.steps, model.levels = isotonic(raw, y[pick])
    return model


def _scored(model: Model | None, threshold: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), STATISTICS)
            s = model.score(x) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return scored


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text of docs(doc_id, text): doc_id, held_out, score, predicted.

    Only the text makes a score. Empty and null texts get the score of an empty text; without any usable label all scores
    are 0.5. Rows with equal texts get equal scores; an empty table gives an empty result; other columns play no part.
    """
    model = fit(docs, labels, most=most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _kept(model: Model | None, threshold: float, at: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), STATISTICS)
            s = model.score(x) if model else np.full(len(texts), 0.5)
            yield b.filter(pa.array(s >= threshold))

    return kept


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    model = fit(docs, labels, most=most)
    return docs.mapInArrow(_kept(model, threshold, docs.columns.index("text")), docs.schema)
