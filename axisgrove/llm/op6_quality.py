"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics come from the whole text and nothing else. Each class has a mean and a covariance, shrunk towards the
pooled diagonal; a score is the logistic of the difference of the classes' log densities (Mahalanobis distances by
cached Cholesky factors) and of their priors.

It is fitted on labelled rows outside the held-out fold, at most max_labelled of them (a bounded, hash-chosen sample,
so that what reaches the driver is bounded: max_labelled rows of 14 numbers). An id with two different labels has none;
of texts with one id the first in order is taken. Every row is scored, in one pass.

Defined results: null text counts as empty; an empty text has the statistics of no words and gets a score like any
other; with labels of one class only, or none, every score is the class's prior (1 without labels); repeated rows are
scored row by row; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens_np
from .common import fold, sampled, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = ("words", "word_bytes", "symbols", "exclamations", "pipes", "upper", "digits", "lines", "short", "distinct", "repeats", "stutter", "top", "stops")
THRESHOLD = 0.3


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics, one row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    hashes, first = tokens_np.words(data, offsets)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    size = np.diff(offsets).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    kinds = np.zeros(256, dtype=np.uint8)
    for k, chars in enumerate((b"#*$%&<>", b"!", b"|", bytes(range(65, 91)), b"0123456789", b"\n", b".,;:?"), 1):
        kinds[list(chars)] = k
    kind = kinds[data]
    by = [total(kind == k) for k in range(1, 8)]
    ink = size - total(tokens_np.SPACE[data])
    grams, starts = tokens_np.ngrams(hashes, first, 5)
    distinct, repeats, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for r in np.flatnonzero(words):
        w = hashes[first[r] : first[r + 1]]
        _, counts = np.unique(w, return_counts=True)
        distinct[r], top[r] = len(counts), counts.max()
        g = grams[starts[r] : starts[r + 1]]
        repeats[r] = len(g) - len(np.unique(g))
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    c = np.concatenate([[0], np.cumsum(again)])
    stutter = (c[first[1:]] - c[first[:-1]]).astype(float)
    log = lambda x, e=0.002: np.log(x + e)
    share = lambda x: log(x / some)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(ink / some)
    out[:, 2], out[:, 3], out[:, 4] = share(by[0]), share(by[1]), share(by[2])
    out[:, 5] = log(by[3] / np.maximum(ink, 1), 0.01)
    out[:, 6] = log(by[4] / np.maximum(ink, 1))
    out[:, 7] = log(by[5] / some, 0.01)
    out[:, 8] = log(by[6] / some, 0.01)
    out[:, 9] = np.log((distinct + 1) / (words + 1)) + 0.15 * np.log1p(words)
    out[:, 10], out[:, 11] = share(repeats), share(stutter)
    out[:, 12] = log(top / some, 0.02)
    out[:, 13] = np.log1p(ink / np.maximum(size, 1))
    return out


def measure(batches):
    """(doc_id, quality, statistics) of (doc_id, text, quality)."""
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, offsets in tokens_np.pieces(batch.column(1)):
            x = statistics(data, offsets)
            of = np.arange(0, (hi - lo + 1) * len(NAMES), len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(of), pa.array(x.reshape(-1)))], names=["doc_id", "quality", "x"])


class Discriminant:
    """Regularised QDA of two classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.3, floor: float = 0.05) -> None:
        self.prior = float(np.mean(y)) if len(y) else 1.0
        self.one_class = not 0 < self.prior < 1
        if self.one_class:
            return
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.center) / self.scale
        pooled = sum((y == c).mean() * np.diag(z[y == c].var(axis=0)) for c in (0, 1)) + floor * np.eye(x.shape[1])
        self.parts = []
        for c in (0, 1):
            own = z[y == c]
            k = min(0.95, shrink + x.shape[1] / max(len(own), 1) * 0.5)
            cov = (np.cov(own.T, bias=True) if len(own) > 1 else np.zeros_like(pooled)) * (1 - k) + pooled * k
            chol = np.linalg.cholesky(cov)
            self.parts.append((own.mean(axis=0), np.linalg.inv(chol), 2 * float(np.log(np.diag(chol)).sum()), float(np.log(max((y == c).mean(), 1e-9)))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.one_class:
            return np.full(len(x), self.prior)
        z = (x - self.center) / self.scale
        log = [p - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * det for m, inv, det, p in self.parts]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(fold(F.col("doc_id"), folds) != held)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(fold(F.col("doc_id"), folds) != held)
    known = sampled(known, "doc_id", max_labelled).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    d = d.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = d.select("doc_id", "text", "quality").mapInArrow(measure, "doc_id bigint, quality int, x array<double>").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten() if rows.num_rows else [], dtype=float).reshape(-1, len(NAMES))
    order = np.argsort(np.array(rows["doc_id"], dtype=np.int64), kind="stable")
    return Discriminant(x[order], np.array(rows["quality"], dtype=int)[order])


def scorer(model: Discriminant):
    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, offsets in tokens_np.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(statistics(data, offsets)))], names=["doc_id", "score"])

    return score


def classify(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, score (0 to 1, higher: better), predicted (1 from THRESHOLD)."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(scorer(model), "doc_id bigint, score double")
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filterer(model: Discriminant, at: int):
    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, offsets in tokens_np.pieces(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.scores(statistics(data, offsets)) >= THRESHOLD))

    return keep


def accepted(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model predicts to be good, with their columns; one pass, no shuffle."""
    return docs.mapInArrow(filterer(model, docs.columns.index(text_col)), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
