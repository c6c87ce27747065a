"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Texts are lower-cased, and all but letters become blanks. The features are the
hashed n-grams, by how often they come in RATE words, and each is scaled by the
log ratio of its smoothed counts of toxic and other texts. A logistic model with
a ridge penalty is fitted on the scaled features by Spark, whose executors sum
the gradients, so its weights and the ratios multiply into one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, durable, sample_by_hash, small_batches

GRAMS = (4, 5, 6)
BUCKETS = 1 << 20
#: N-grams that the model has at most: those that part the classes most.
FEATURES = 4096
#: Labelled rows of each class that the model is fitted on at most, in order of a hash of their ids.
TRAIN_ROWS = 10_000
#: Labelled texts that an n-gram of the model is in at least.
MIN_TEXTS = 3
SMOOTHING = 0.5
RIDGE = 0.02
#: Steps of the fit at most.
STEPS = 100
RATE = 60
_SEP = 8  # blanks between the texts of a batch
_SLICE_CHARS = 1 << 19  # of texts that are counted together
_P, _K = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)], dtype=bool)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, letters or blanks, and where each begins.

    Characters from U+3000 on count as letters.
    """
    joined = (" " * _SEP).join(["", *(t.lower() if t else "" for t in texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    small = np.minimum(codes, 0x2FFF)
    codes = np.where(_LETTERS[small] | (codes >= 0x3000), codes, np.uint32(32))
    sizes = np.array([len(t.lower()) if t else 0 for t in texts], dtype=np.int64)
    return codes, np.cumsum(np.r_[_SEP, sizes[:-1] + _SEP]) if len(texts) else np.zeros(0, np.int64)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about _SLICE_CHARS characters, one text at least."""
    held, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if held and size + n > _SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += n + _SEP
    if held:
        yield held


def buckets(texts: list[str | None], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) for each n-gram that a text has; sorted.

    ``value`` is log(1 + n) for n occurrences in RATE words. With ``table`` the
    buckets are looked up there, and those below 0 left out.
    """
    codes, first = _codes(texts)
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    gram, out = np.zeros(len(codes), dtype=np.uint32), []
    for n in range(1, max(GRAMS) + 1):
        last = codes[n - 1 :]
        gram = gram[: len(last)] * _P + last
        if n in GRAMS:
            mixed = (gram ^ (gram >> np.uint32(15))) * _K
            bucket = mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)
            if table is None:
                at = np.flatnonzero((last != 32) | (codes[: len(last)] != 32))
                found = bucket[at]
            else:
                found = table[bucket]
                at = np.flatnonzero(found >= 0)
                found = found[at]
            # An n-gram begins at most n - 1 blanks before its text.
            text = np.searchsorted(first, at + n - 1, side="right") - 1
            keep = text >= 0
            out.append(text[keep] * BUCKETS + found[keep])
    both, count = np.unique(np.concatenate(out), return_counts=True)
    begins = np.flatnonzero((codes[1:] != 32) & (codes[:-1] == 32)) + 1
    words = np.bincount(np.searchsorted(first, begins, side="right") - 1, minlength=len(texts))
    text = both // BUCKETS
    return text, both % BUCKETS, np.log1p(RATE * count / np.maximum(words, 1)[text])


class Model:
    """A slot for each bucket, -1 for those without a feature, and their weights."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = table, weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for part in _slices(texts):
            text, slot, value = buckets(part, self.table)
            z = self.bias + np.bincount(text, weights=self.weights[slot] * value, minlength=len(part))
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``labels(id_col, toxic)``, toxic being 0 or 1.

    It is fitted on TRAIN_ROWS rows of each class at most. Other values, null
    labels and null ids are left out; a repeated label counts as often. With one
    class alone the model has no features and always scores 0 (or 1).
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_label_id"), F.col("toxic").alias("_toxic"))
    chosen = chosen.where(F.col("_toxic").isin(0, 1))
    picked = durable(sample_by_hash(chosen, "_label_id", TRAIN_ROWS, "_toxic"))
    # The broadcast side has 2 * TRAIN_ROWS pairs of numbers at most.
    read = docs.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("_text"))
    rows = durable(read.join(F.broadcast(picked), F.col("_doc_id") == F.col("_label_id")).select("_doc_id", "_text", "_toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, BUCKETS), dtype=np.int64)
        for pdf in batches:
            for c in (0, 1):
                for part in _slices(list(pdf["_text"][pdf["_toxic"] == c])):
                    totals[c] += np.bincount(buckets(part)[1], minlength=BUCKETS)
        seen = np.flatnonzero(totals.any(axis=0))
        yield pd.DataFrame({"bucket": seen, "n0": totals[0, seen], "n1": totals[1, seen]})

    size = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if len(size) < 2:
        discard(rows, picked)
        return Model(np.full(BUCKETS, -1, dtype=np.int32), np.zeros(1), 500.0 if 1 in size else -500.0)
    counted = rows.mapInPandas(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p1, p0 = F.col("n1") / size[1], F.col("n0") / size[0]
    # The features that part the classes most, FEATURES of them at most.
    share = (F.col("n0") + F.col("n1")) / sum(size.values())
    parts = F.abs(p1 - p0) / F.sqrt(share * (1 - share) + 1e-9)
    best = counted.where(F.col("n0") + F.col("n1") >= MIN_TEXTS).orderBy(F.desc(parts), "bucket").limit(FEATURES).collect()
    bucket = np.array([r.bucket for r in best], dtype=np.int64)
    n0, n1 = (np.array([r[k] for r in best], dtype=float) + SMOOTHING for k in ("n0", "n1"))
    scale = np.log(n1 / (size[1] + 2 * SMOOTHING)) - np.log(n0 / (size[0] + 2 * SMOOTHING))
    table = np.full(BUCKETS, -1, dtype=np.int32)
    table[bucket] = np.arange(len(bucket))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slots, values = [], []
            for part in _slices(list(pdf["_text"])):
                text, slot, value = buckets(part, table)
                at = np.searchsorted(text, np.arange(1, len(part)))
                slots += np.split(slot.astype(np.int32), at)
                values += np.split(value * scale[slot], at)
            yield pd.DataFrame({"toxic": pdf["_toxic"], "slots": slots, "vals": values})

    found = durable(rows.mapInPandas(present, "toxic int, slots array<int>, vals array<double>"))
    weights, bias = _fit(found, len(scale), size)
    discard(found, rows, picked)
    return Model(table, weights * scale, bias)


def _fit(rows: DataFrame, n_features: int, size: dict[int, int]) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression in which both classes weigh alike."""
    if not n_features:
        return np.zeros(1), float(np.log(size[1] / size[0]))
    vector = F.udf(lambda slots, vals: Vectors.sparse(n_features, slots, vals), VectorUDT())
    share = F.when(F.col("toxic") == 1, 0.5 / size[1]).otherwise(0.5 / size[0])
    given = rows.select(F.col("toxic").cast("double").alias("label"), share.alias("weight"), vector("slots", "vals").alias("features"))
    fit = LogisticRegression(
        weightCol="weight", regParam=RIDGE / sum(size.values()), standardization=False, maxIter=STEPS, tol=1e-8
    ).fit(given)
    return fit.coefficients.toArray(), float(fit.intercept)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each whole text; a null text scores as an empty one.

    Repeated rows and null ids come back as they are; other columns are ignored.
    """
    return docs.select(F.col(id_col).alias("id"), score_column(model, text_col, docs).alias("score"))


def score_column(model: Model, text_col: str, docs: DataFrame):
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t if isinstance(t, str) else None for t in texts]))

    return score(F.col(text_col))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more.

    A null or empty text is scored as one without an n-gram. Repeated rows and
    null ids are scored alike and stay or go each by itself; columns and their
    names are left as they are; an empty table gives an empty one.
    """
    return docs.where(score_column(model, text_col, docs) < 0.5)
