"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import body, cut

UNDETERMINED = "und"
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: Bytes hashed at a time.
_BLOCK = 1 << 20


def ngrams(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams of a whole text, lower-cased, with everything but letters as one space."""
    raw = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    for at in range(0, max(len(raw) - 2, 0), _BLOCK):
        x = np.frombuffer(raw[at : at + _BLOCK + 2], dtype=np.uint8).astype(np.uint32)
        yield ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """+1/-1 rows, one per class: every split into two non-empty sides for up to 7 classes, else random columns."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 7:
        rest = range(1, classes)
        sides = [set(c) for n in range(1, classes) for c in combinations(rest, n)]
        return np.array([[1.0 if k in s else -1.0 for s in sides] for k in range(classes)])
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        made = rng.choice([-1.0, 1.0], (classes, 12 * int(np.ceil(np.log2(classes)))))
        made = made[:, np.abs(made.sum(axis=0)) < classes]
        apart = min((made[a] != made[b]).sum() for a, b in combinations(range(classes), 2))
        if best is None or apart > best[0]:
            best = apart, made
    return best[1]


@dataclass
class LanguageModel:
    """weights: a row per bucket and a column per bit of the codewords; trust: weight of each bit's loss."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    bits: int

    def score(self, text: str) -> tuple[str, float, float, bool]:
        """(language, probability-like score, lead over the runner-up, ambiguous)."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        total, n = np.zeros(self.weights.shape[1]), 0
        for grams in ngrams(text, self.bits):
            total += self.weights[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        # the sum grows with the text although its n-grams depend on one another; a root keeps short texts less sure
        margin = total / max(n, 1) ** 0.5
        loss = (np.logaddexp(0, -self.codes * margin) * self.trust).sum(axis=1)
        odds = np.exp(-(loss - loss.min()))
        odds /= odds.sum()
        order = np.argsort(loss, kind="stable")
        lead = float(odds[order[0]] - (odds[order[1]] if len(order) > 1 else 0.0))
        return self.languages[order[0]], float(odds[order[0]]), lead, lead < 0.05


def train(docs: DataFrame, text_col: str, lang_col: str, bits: int = 14, smoothing: float = 0.5, most_languages: int = 256) -> LanguageModel:
    """Fit one binary n-gram classifier per codeword bit on every row with a language; each is a log-odds table.

    N-grams are counted per language over all rows in one pass; each task sends at most 2**bits counts a language. The
    table that reaches the driver has (languages x 2**bits) rows whatever the corpus holds. A column with over
    ``most_languages`` values is no column of languages: an error says so before anything is sent. Repeated rows count
    each time; rows without a language are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                if len(sums) > most_languages:
                    raise ValueError(f"over {most_languages} languages in the column")
                for grams in ngrams(text, bits):
                    if len(grams) > 1 << bits:
                        own += np.bincount(grams, minlength=1 << bits)
                    else:
                        np.add.at(own, grams, 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), body(text_col).alias("text")).where("lang is not null")
    counted = cut(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    if (known := counted.select("lang").distinct().count()) > most_languages:
        raise ValueError(f"{known} languages in the column, over {most_languages}")
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), 1 << bits))
    counts[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy(dtype=np.int64)] = found["n"]
    share = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * (1 << bits))
    codes = codewords(len(languages))
    weights = np.zeros((1 << bits, codes.shape[1]), dtype=np.float32)
    trust = np.ones(codes.shape[1])
    for bit in range(codes.shape[1]):
        yes, no = codes[:, bit] > 0, codes[:, bit] < 0
        if yes.any() and no.any():
            p, q = share[yes].mean(axis=0), share[no].mean(axis=0)
            weights[:, bit] = np.log(p / q)
            # expected evidence of one n-gram, from either side
            trust[bit] = ((p - q) * weights[:, bit]).sum() / 2
    return LanguageModel(languages, codes, weights, trust / max(trust.mean(), 1e-12), bits)


def identify(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, lead, ambiguous): the nearest codeword under the loss-weighted distance.

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages. ``ambiguous`` where
    the two nearest codewords are within 0.05 of each other, as between languages of one model that a text mixes.
    """

    @F.pandas_udf("lang string, score double, lead double, ambiguous boolean")
    def scored(texts):
        import pandas as pd

        return pd.DataFrame([model.score(t or "") for t in texts], columns=["lang", "score", "lead", "ambiguous"])

    return scored(text)
