"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import body, cut

_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Words hashed at a time; grams that straddle two runs are kept by an overlap.
_RUN = 1 << 18


def features(text: str, bits: int) -> np.ndarray:
    """Distinct buckets of the words, word pairs and pairs with one or two words between, over the whole text."""
    words = text.lower().encode().translate(_WORDS).split()
    found = []
    for at in range(0, len(words), _RUN):
        run = words[at : at + _RUN + 3]
        h = np.fromiter(map(zlib.crc32, run), dtype=np.uint32, count=len(run))
        grams = [h * np.uint32(0x9E3779B1)]
        for skip, odd in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (3, 0x27D4EB2F)):
            grams.append((h[:-skip] * np.uint32(odd) ^ h[skip:]) * np.uint32(0x165667B1) + np.uint32(skip))
        found.append(np.unique(np.concatenate(grams) >> np.uint32(32 - bits)))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, dtype=np.uint32)


class Ftrl:
    """Per-coordinate learning rates with L1 and L2: weights follow from (z, n) and are exactly zero below L1."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the intercept, without L1

    def weight(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weight(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class ToxicityModel:
    """The buckets whose weight L1 left above zero; what travels to the executors is no larger than that."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    bits: int

    @functools.cached_property
    def dense(self) -> np.ndarray:
        made = np.zeros(1 << self.bits, dtype=np.float32)
        made[self.buckets] = self.weights
        return made

    def score(self, text: str) -> float:
        total = self.intercept + float(self.dense[features(text, self.bits)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = 12_000, bits: int = 20, shard_rows: int = 4_000, epochs: int = 3, alpha: float = 1.0, beta: float = 0.1, l1: float = 5.0, l2: float = 1.0) -> ToxicityModel:
    """Fit on at most ``most`` labelled rows, by hash of the identifier and half of them positive where there are as many.

    The bounded list of identifiers is broadcast to the documents, so no text but the sample's moves. Of documents that
    share an identifier the text with the least hash is learnt from, so the bound holds and the fit doesn't depend on
    the order of rows. Shards of about ``shard_rows`` are fitted side by side and their weights averaged. As half of the
    sample is positive, scores are those of a balanced corpus, not chances at the true rate. Rows without a label, and
    repeated labels that disagree (the larger counts), do no harm; with no labels at all every score is one half.
    """
    each = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label is not null")
    each = each.groupBy("id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label"))
    drawn = [each.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most // 2) for k in (0, 1)]
    sample = cut(drawn[0].union(drawn[1]))
    shards = max(1, sample.count() // shard_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), body(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text", F.xxhash64("id", "text").alias("order"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(1 << bits, alpha, beta, l1, l2), []
        for batch in batches:
            for order, label, text in zip(batch.column("order").to_pylist(), batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.append((order, label, np.append(features(text, bits), np.uint32(1 << bits))))
        rows.sort(key=lambda r: r[0])
        for _ in range(epochs):
            for _, label, at in rows:
                model.learn(at, label)
        weights = model.weight(np.arange((1 << bits) + 1))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(weights[at])], ["bucket", "w"])

    fitted = rows.repartition(shards, "order").mapInArrow(fit, "bucket int, w double")
    found = fitted.groupBy("bucket").agg((F.sum("w") / shards).alias("w")).toPandas()
    at, weights = found["bucket"].to_numpy(dtype=np.int64), found["w"].to_numpy(dtype=np.float64)
    inner = at < 1 << bits
    return ToxicityModel(at[inner], weights[inner].astype(np.float32), float(weights[~inner].sum()), bits)


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """Score of each whole text in 0..1. A null or empty text has the score of the intercept alone."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return scored(text)
