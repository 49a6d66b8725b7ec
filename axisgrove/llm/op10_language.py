"""Language identification by nearest centroid.

A text is a vector of its byte 1- to 3-grams, hashed to 4096 places, with log term frequency and inverse document
frequency, of length one. Each language has several centroids (spherical k-means over its training vectors). A text
gets the language of the centroid with the largest cosine; it is rejected if that is further off than almost all
training vectors of the language are from theirs.

It is fitted on at most per_lang texts a language outside the held-out fold (a bounded, hash-chosen sample, so that
what reaches the driver is bounded by languages * per_lang * 16 KB; of texts with one id and language the first in
order is taken). Every row is scored on its whole text, in one pass.

Defined results: null text or one without a letter is `und` with score 0; without training rows everything is `und`;
equal cosines go to the language first in order; repeated rows are judged row by row; an empty table gives an empty
result; columns other than id, text and (for training) lang are not read.
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

PLACES = 4096
NO_LANGUAGE = "und"


def counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of the hashed byte n-grams, one row a text. Runs of space and digits count as one space."""
    b = tokens_np.LOWER[data].astype(np.uint32)
    b[tokens_np.SPACE[data] | ((data >= 48) & (data <= 57))] = 32
    n = len(offsets) - 1
    out = np.zeros((n, PLACES), dtype=np.float32)
    h2 = b.copy()
    h2[:-1] = b[:-1] * 257 + b[1:] + 1009
    h3 = h2.copy()
    h3[:-2] = (b[:-2] * 257 + b[1:-1]) * 257 + b[2:] + 70001
    for h in (h2, h3):
        h *= np.uint32(2654435761)
        h >>= np.uint32(20)
    h1 = (b * np.uint32(40503) + np.uint32(7)) & np.uint32(PLACES - 1)
    for r in range(n):
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        if hi > lo:
            c = np.bincount(h1[lo:hi], minlength=PLACES)
            c += np.bincount(h2[lo : max(lo, hi - 1)], minlength=PLACES)
            c += np.bincount(h3[lo : max(lo, hi - 2)], minlength=PLACES)
            out[r] = c
    return np.log1p(out)


def vectorize(batches):
    """(lang, vector) of (text, lang)."""
    import pyarrow as pa

    for batch in batches:
        for lo, hi, data, offsets in tokens_np.pieces(batch.column(0), 400_000):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([v.tobytes() for v in counted(data, offsets)], pa.binary())], names=["lang", "vector"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = 8, seed: int = 10) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(k)]))
    return c


class Centroids:
    def __init__(self, langs: np.ndarray, x: np.ndarray, k: int = 4, rejected_share: float = 0.001, slack: float = 0.1) -> None:
        self.langs = sorted(set(langs.tolist()))
        if not self.langs:
            return
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        z = unit(x * self.idf)
        parts = [clustered(z[langs == l], k) for l in self.langs]
        self.centroids = np.concatenate(parts).astype(np.float32)
        self.of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        near = [(z[langs == l] @ p.T).max(axis=1) for l, p in zip(self.langs, parts)]
        self.least = np.array([np.quantile(s, rejected_share) - slack for s in near])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, cosine, rejected)."""
        cos = unit(x * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = cos[np.arange(len(x)), best].astype(float)
        lang = self.of[best]
        return lang, np.clip(score, 0, 1), score < self.least[lang]


def fit(docs: DataFrame, per_lang: int = 400, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    d = sampled(d, "doc_id", per_lang, "lang").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rows = d.select("text", "lang").mapInArrow(vectorize, "lang string, vector binary").orderBy("lang", "vector").toArrow()
    x = np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=np.float32).reshape(-1, PLACES)
    return Centroids(np.array(rows["lang"].to_pylist(), dtype=object), x)


def predictor(model: Centroids):
    def predict(batches):
        import pyarrow as pa

        names = np.array(model.langs, dtype=object)
        for batch in batches:
            letters = np.array(batch.column(2).to_pylist(), dtype=bool)
            for lo, hi, data, offsets in tokens_np.pieces(batch.column(1), 400_000):
                known = letters[lo:hi] & bool(model.langs)
                lang, score, far = np.full(hi - lo, NO_LANGUAGE, dtype=object), np.zeros(hi - lo), np.ones(hi - lo, dtype=bool)
                if known.any():
                    best, cos, out = model.predict(counted(data, offsets))
                    lang[known], score[known], far[known] = names[best][known], cos[known], out[known]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, lang_pred (nearest language), score (its cosine), rejected (too far from all)."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return d.mapInArrow(predictor(model), "doc_id bigint, lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
