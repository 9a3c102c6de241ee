"""Toxicity by multiple-instance learning: a document is toxic if some sentence is, and only documents are labelled."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import cut, held_out, label_sample, lean, slices

#: Labelled rows that the model is fitted on, at most, and UTF-8 bytes up to which a text takes part in that: 256 MB at most,
#: which leave their tasks as numbers of features only.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 32_768
#: Features that the fit knows at most: those of the most documents.
FEATURES = 100_000
#: Letters of the beginnings of longer words that are features, beside the words, so that endings matter less.
BEGINNINGS = (4, 6)
#: Documents of the sample in which a feature must occur, steps of the fit, its rate, and the penalty on weights.
LEAST_DOCS, STEPS, RATE, PENALTY = 5, 300, 0.15, 2e-4
#: Weights nearer to 0 than this are left out of the model.
NEGLIGIBLE = 0.05
#: Documents from this score on are toxic.
THRESHOLD = 0.5

_sentence = re.compile(r"[^.!?\n]+[.!?]*").finditer
_word = re.compile(r"[^\W\d_]+").findall


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    return [m.span() for m in _sentence(text)]


def features(sentence: str) -> set[str]:
    """The words of a sentence in lower case, and the beginnings of longer ones, marked by a star."""
    words = set(_word(sentence.lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """Noisy-or of the sentence scores, and the sentences that alone reach the threshold, the worst first.

        A sentence whose weights don't outweigh half of the bias is no evidence and takes no part, so harmless sentences don't
        add up, however many a text has.
        """
        found, log_clean = [], 0.0
        known = self.weights.keys()
        for start, end in sentences(text):
            hit = known & features(text[start:end])
            z = self.bias + sum(self.weights[w] for w in sorted(hit))
            if z <= self.bias / 2:
                continue
            log_clean -= _softplus(z)
            if z >= 0:
                found.append((1 / (1 + math.exp(-z)), start, end))
        return -math.expm1(log_clean), sorted(found, key=lambda x: (-x[0], x[1]))


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


@dataclass
class Bags:
    """Labelled documents as numbers: the document of each sentence, and the feature and the sentence of each occurrence."""

    y: np.ndarray
    sent_doc: np.ndarray
    tokens: np.ndarray
    token_sent: np.ndarray


def bags(docs: list[tuple[list[list[int]], int]]) -> Bags:
    """Documents, each its sentences' feature numbers and its label."""
    sizes = [len(ids) for sents, _ in docs for ids in sents]
    sent_doc = np.repeat(np.arange(len(docs)), [len(sents) for sents, _ in docs])
    tokens = np.fromiter((t for sents, _ in docs for ids in sents for t in ids), np.int64, sum(sizes))
    return Bags(np.array([y for _, y in docs], float), sent_doc, tokens, np.repeat(np.arange(len(sizes)), sizes))


def loss_and_gradient(w: np.ndarray, x: Bags) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels under the noisy-or, and its gradient; the last weight is the bias.

    A document's gradient reaches its sentences in proportion to their share of the noisy-or, so the likeliest sentences
    of a toxic document take the blame and all sentences of a clean one are pushed down.
    """
    n, v, docs = len(x.sent_doc), len(w) - 1, max(1, len(x.y))
    z = np.bincount(x.token_sent, w[x.tokens], minlength=n) + w[v]
    log_clean = np.bincount(x.sent_doc, -np.logaddexp(0, z), minlength=len(x.y))
    toxic = np.maximum(-np.expm1(log_clean), 1e-12)
    blame = np.where(x.y == 1, -(1 - toxic) / toxic, 1.0)
    g = blame[x.sent_doc] / (1 + np.exp(-z))
    grad = np.append(np.bincount(x.tokens, g[x.token_sent], minlength=v), g.sum()) / docs
    return float(-np.where(x.y == 1, np.log(toxic), log_clean).sum() / docs), grad


def train(x: Bags, names: list[str], steps: int = STEPS) -> Model:
    """Fit the features' weights by full-batch Adam so that 1 - prod(1 - p(sentence)) follows the labels."""
    v = len(names)
    w = np.zeros(v + 1)
    w[v] = -6.0
    m1, m2 = np.zeros(v + 1), np.zeros(v + 1)
    for t in range(1, steps + 1):
        grad = loss_and_gradient(w, x)[1]
        grad[:v] += PENALTY * np.tanh(w[:v] * 10) / 10
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        w -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        w[v] = min(w[v], -4.0)
    return Model(float(w[v]), {name: float(w[i]) for i, name in enumerate(names) if abs(w[i]) >= NEGLIGIBLE})


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text."""
    for b in slices(batches):
        found = [sorted(set().union(*(features(t[s:e]) for s, e in sentences(t)))) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["features"])


def _numbered(names: list[str]):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: i for i, name in enumerate(names)}
        for b in slices(batches):
            rows = [[[at[f] for f in sorted(features(t[s:e])) if f in at] for s, e in sentences(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.list_(pa.int32())))], ["doc_id", "y", "sentences"])

    return numbered


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most `most` labelled rows that aren't held out, of up to SAMPLE_BYTES each; None without such rows.

    Texts become numbers of features where they are, partition by partition; features are counted by document in a shuffle.
    The driver gets at most FEATURES names and the numbers of the bounded sample, which are smaller than its text.
    """
    lean(docs.sparkSession)
    sample = F.broadcast(label_sample(labels, label, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = cut(rows.where(F.octet_length("text") <= SAMPLE_BYTES).join(sample, "doc_id").select("doc_id", "text", "y"))
    counted = joined.select("text").mapInArrow(_described, "features array<string>").select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    names = sorted(r["feature"] for r in counted.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "feature").limit(FEATURES).collect())
    found = sorted(tuple(r) for r in joined.mapInArrow(_numbered(names), "doc_id long, y int, sentences array<array<int>>").collect())
    return train(bags([(sents, y) for _, y, sents in found]), names) if found else None


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_offending", pa.int64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def _scored(model: Model | None, threshold: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc_id, held, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s, found = model.score(text or "") if model else (0.0, [])
                out.append({"doc_id": doc_id, "held_out": held, "score": s, "predicted": int(s >= threshold), "n_offending": len(found), "offending": [{"start": a, "end": e, "score": p} for p, a, e in found]})
            yield pa.RecordBatch.from_pylist(out, _OUT)

    return scored


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text of docs(doc_id, text): doc_id, held_out, score, predicted, n_offending, offending.

    offending has the spans, in code points, of the sentences whose own score reaches 0.5, the worst first. A null text is
    empty; an empty text has no sentence and scores 0, as all do without any usable label. Rows with equal texts get equal
    scores; a very long text is scored whole, sentence by sentence. Other columns play no part. An empty table gives an empty
    result.
    """
    model = fit(docs, labels, most=most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int, n_offending long, offending array<struct<start:long,end:long,score:double>>")
