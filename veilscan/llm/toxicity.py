"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (present or not): each word without signs, A-Z lowered; its first five bytes (endings vary in
many languages); two neighbouring words; and two words with one between. They are hashed to 2^bits coordinates.
Learning rates are per coordinate, and L1 keeps most weights at zero, so what is broadcast is a list of few numbers,
2^bits at most.

Training reads at most ``bound`` labelled texts (the smallest digests of their ids): that bounds the one task that fits
them in sequence. Every text is scored, whole, in the pass that reads it; nothing is shuffled.

Nulls: a null text is empty; labels that are null take no part; of repeated labels the largest holds, of the texts of a repeated id the smallest. With no
labelled text every score is 0. Rows that repeat an id give rows that repeat; an empty table none. Extra columns
are ignored, and labels, language, source and id are no features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import textvec as tv
from veilscan.llm.work import Work

U = np.uint64
#: Signs within and around words, which go before words are cut.
SIGN = np.zeros(256, bool)
SIGN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def features(column: pa.Array, bits: int):
    """For each block: (rows of the block, row of each feature, coordinate of each feature)."""
    for i, j, data, offs in tv.blocks(column):
        keep = ~SIGN[data]
        offs = np.concatenate([[0], np.cumsum(keep)])[offs]
        data = tv.LOWER[data[keep]]
        s, e, first = tv.word_spans(data, offs)
        w = tv.span_hash(data, s, e)
        row = np.repeat(np.arange(j - i), np.diff(first))
        stem = tv.span_hash(data, s, np.minimum(e, s + 5))
        rows, keys = [row, row], [w, tv.mix(stem ^ U(5))]
        for gap in (1, 2):
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            keys.append(tv.mix((w[:-gap] * U(3) ^ w[gap:] + U(gap)) * U(tv.P))[same])
        yield j - i, np.concatenate(rows), (np.concatenate(keys) >> U(64 - bits)).astype(np.int64)


class Ftrl:
    """Weights as FTRL-proximal keeps them: z and n for each coordinate, and for a bias that L1 spares."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _fit(bits: int, epochs: int, options: dict):
    def run(batches):
        texts = []
        for b in batches:
            label = b.column(1).to_pylist()
            at = 0
            for n, row, key in features(b.column(0), bits):
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(n + 1))
                texts += [(np.unique(key[order[cut[k] : cut[k + 1]]]).astype(np.int32), label[at + k]) for k in range(n)]
                at += n
        # more texts hold more words by chance: L1 grows with their root
        model = Ftrl(bits, **({"l1": max(1.0, 0.03 * len(texts) ** 0.5)} | options))
        for k in range(epochs):
            for x in np.random.default_rng(k).permutation(len(texts)):
                model.learn(*texts[x])
        w = model.weights() if texts else np.append(np.zeros(1 << bits), -50.0)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["at", "w"])

    return run


def _score(weights, bits: int):
    def run(batches):
        w = np.zeros((1 << bits) + 1)
        w[weights.value[0]] = weights.value[1]
        for b in batches:
            out = []
            for n, row, key in features(b.column(1), bits):
                some = np.flatnonzero(w[key])
                pair = np.unique(row[some] << bits | key[some])
                out.append(w[-1] + np.bincount(pair >> bits, w[pair & ((1 << bits) - 1)], n))
            total = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, bound: int = 20_000, epochs: int = 4, **options) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) from the labelled texts; those of ``labels`` with the ``bound`` smallest digests of ids."""
    Work(docs.sparkSession, "toxicity")  # small Arrow batches
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    some = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(some), "id")
    # one task, for at most ``bound`` texts, in an order that does not depend on the cluster
    one = texts.groupBy("id", "y").agg(F.min("text").alias("text")).coalesce(1).sortWithinPartitions(F.xxhash64("id")).select("text", "y")
    rows = one.mapInArrow(_fit(bits, epochs, options), "at long, w double").collect()
    if not rows:
        return np.array([1 << bits]), np.array([-50.0])
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = 20) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if the score is 0.5 or more)."""
    Work(docs.sparkSession, "toxicity")
    w = docs.sparkSession.sparkContext.broadcast(weights)
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_score(w, bits), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
