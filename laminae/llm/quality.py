r"""Document quality by a regularised quadratic discriminant.

Thirteen statistics of a whole text are transformed to be roughly normal within a class. Each class
gets a mean and a covariance, shrunk towards the pooled covariance and its diagonal; the score is
the posterior of label 1 from the difference of the two Mahalanobis log-densities, computed through
Cholesky factors that are found once. Fitting needs sums and products of the statistics alone, added
up in the tasks over all labelled documents.

A null text is an empty text and has a score as any other. Labels that contradict each other for one
doc_id, or are null, are left out; documents without a label are only scored. With fewer than two
documents of a class every score is the smoothed share of label 1. Language, source and doc_id never
enter the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_map
from .kernels import SPACED, hash_spans, text_slices, word_spans

#: Classes of bytes that are counted.
OTHER, LETTER, UPPER, DIGIT, WIDE, STOP, SHOUT, MARK, BAR, LINE, SPACE = range(11)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = MARK
for _chars, _kind in ((range(97, 123), LETTER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (range(128, 256), WIDE), (b".,;:'\"()-?", STOP), (b"!", SHOUT), (b"|", BAR), (b"\n", LINE), (b" \t\x0b\x0c\r", SPACE)):
    _CLASS[list(_chars)] = _kind

N_STATISTICS = 13
#: Shares of the pooled covariance, and of its diagonal, in a class's covariance; least variance.
POOLED, DIAGONAL, FLOOR = 0.05, 0.05, 1e-3
#: A text counts as having so many further words of usual prose, so that few words say little.
PRIOR_WORDS, USUAL_LENGTH = 20.0, 6.0
#: What is added to a share before its logarithm.
_LEAST = 1e-3


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Transformed statistics of each row of a slice (rows x N_STATISTICS)."""
    rows = len(starts) - 1
    row = np.repeat(np.arange(rows), np.diff(starts))
    n = np.bincount(row * 16 + _CLASS[data], minlength=rows * 16).reshape(rows, 16).astype(np.float64)
    begin, end, before = word_spans(data, starts, SPACED)
    words = hash_spans(data, begin, end)
    owner = np.repeat(np.arange(rows), np.diff(before))
    size = end - begin
    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]) if len(words) else np.zeros(0, bool)
    of = lambda flag, whose: np.bincount(whose[flag], minlength=rows).astype(np.float64)
    count = np.diff(before).astype(np.float64)
    chars, letters = n[:, :LINE].sum(axis=1), n[:, LETTER] + n[:, UPPER] + n[:, WIDE]

    def share(x: np.ndarray, whole: np.ndarray, usual: float, unit: float = 1.0) -> np.ndarray:
        return np.log(_LEAST + (x + usual * unit * PRIOR_WORDS) / (whole + unit * PRIOR_WORDS))

    return np.stack(
        [
            np.log1p(count),
            share(chars, count, USUAL_LENGTH),
            share(n[:, MARK], count, 0),
            share(n[:, BAR], count, 0),
            share(n[:, SHOUT], count, 0),
            share(n[:, UPPER], letters, 0.03, USUAL_LENGTH),
            share(n[:, DIGIT], chars, 0, USUAL_LENGTH),
            share(n[:, STOP], count, 0.1),
            share(n[:, LINE], count, 0.02),
            share(n[:, WIDE], chars, 0, USUAL_LENGTH),
            share(of(again, owner[1:]), count, 0),
            share(of(size <= 3, owner), count, 0.35),
            share(of(size > 12, owner), count, 0.1),
        ],
        axis=1,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(data, starts) for _, _, data, starts in text_slices(batch.column(batch.num_columns - 1))]
        if parts:
            x = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATISTICS, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "x"])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the transformed statistics of every document."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _measured, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1, and the prior's log-odds."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.odds)))
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - o for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -700, 700)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``label, k, value``: the count, sums and products of each class in this task."""
    total = np.zeros((2, 1 + N_STATISTICS, 1 + N_STATISTICS))
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy().reshape(-1, N_STATISTICS)
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in (0, 1):
            total[k] += x[label == k].T @ x[label == k]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], total[0].size), pa.int32()), pa.array(np.tile(np.arange(total[0].size), 2), pa.int32()), pa.array(total.ravel())],
        names=["label", "k", "value"],
    )


def fit(labelled: DataFrame) -> Discriminant:
    """Fit to rows ``label`` (0 or 1) and ``x``; the driver receives 196 sums a class."""
    side = 1 + N_STATISTICS
    total = np.zeros((2, side * side))
    sums = arrow_map(labelled.select(F.col("label").cast("int"), "x"), _sums, "label int, k int, value double")
    for label, k, value in sums.groupBy("label", "k").agg(F.sum("value")).collect():
        total[label, k] = value
    total = total.reshape(2, side, side)
    n = total[:, 0, 0]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Discriminant(None, None, None, odds)
    means = total[:, 0, 1:] / n[:, None]
    scatter = total[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, offsets = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        shrunk = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
        lower = np.linalg.cholesky(np.round(shrunk, 9) + FLOOR * np.eye(N_STATISTICS))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(np.diag(lower)).sum())
    return Discriminant(np.round(means, 9), np.array(factors), np.array(offsets), odds)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the doc_id's text leaves 1 modulo 3 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def clear_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label`` where all of a document's labels agree and are 0 or 1."""
    per = labels.filter(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("__most"))
    return per.filter("label = __most and doc_id is not null").drop("__most")


def learn(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit to all rows ``doc_id, x`` that have a clear label and are not held out."""
    return fit(rows.filter(~held_out(F.col("doc_id"))).join(clear_labels(labels, "quality"), "doc_id").select("label", "x"))


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of rows ``doc_id, x``."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The documents, all columns, that the model does not reject."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in text_slices(batch.column(at)):
                yield batch.slice(first, last - first).filter(pa.array(model.scores(statistics(data, starts)) >= 0.5))

    return arrow_map(docs, keep, docs.schema)
