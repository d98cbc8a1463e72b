"""A regularised quadratic discriminant over document statistics.

Every document's whole text becomes a vector of transformed statistics.  Each class of labelled documents has a mean
and a covariance, which is shrunk towards the pooled one and its diagonal; a score is the logistic of the
difference of the classes' log densities, Mahalanobis distances being norms after the classes' inverse Cholesky
factors, which are computed once.  Means and covariances come from sums over all labelled rows, added up by key in
the cluster, so the driver gets ``2 * (d + 1) ** 2`` numbers at any size.  The sums are of whole multiples of
2 ** -``FRACTION_BITS``, so they are the same in whatever order tasks end.

Null texts count as empty and get a score like any other.  Null or foreign labels don't count, repeated labels count
once, ids with contradictory labels not at all, and rows that repeat id and vector count once.  If a class has fewer
than two labelled documents, all scores are the share of label 1 (0.5 without any).  Repeated rows score alike; null
ids stay null; texts are read whole; further columns, however named, aren't read, but for ``accepted``, which keeps
them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textstats as ts
from tesserae.llm.shared import clash_free, single_labels, small, utf8
from tesserae.llm.wordgrid import chunks, split_words

FEATURES = ("words", "word_length", "distinct", "upper", "digits", "symbols", "marks", "stops", "quotes", "rest", "line_length")
#: Words and characters that are added to a text when shares are taken, so that very short texts aren't outliers.
PRIOR_WORDS, PRIOR_CHARS = 20, 100
#: Binary places to which values are rounded where moments are taken.
FRACTION_BITS = 16


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    w = split_words(texts)
    c = ts.class_counts(texts).astype(float)
    words, chars = np.diff(w.first).astype(float), c.sum(axis=1) - c[:, ts.MORE] - c[:, ts.SPACE] - c[:, ts.LINE_FEED]
    distinct = ts.distinct_words(w)
    share = lambda kind: np.sqrt(c[:, kind] / (chars + PRIOR_CHARS))
    shares = [share(kind) for kind in (ts.UPPER, ts.DIGIT, ts.SYMBOL, ts.MARK, ts.STOP, ts.QUOTE, ts.REST)]
    return np.column_stack((np.log1p(words), np.log1p(chars / np.maximum(words, 1)), np.sqrt((distinct + PRIOR_WORDS) / (words + PRIOR_WORDS)), *shares, np.log1p(chars / (1 + c[:, ts.LINE_FEED]))))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``x array<double>`` per row."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                x = feature_matrix(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * d), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    return clash_free(docs, [id_column, text_column]).mapInArrow(run, f"id {kind}, x array<double>").withColumnRenamed("id", id_column)


class Model(NamedTuple):
    mean: np.ndarray  # class x d
    whiten: np.ndarray  # class x d x d, inverse Cholesky factors
    offset: np.ndarray  # log prior minus log determinant of the factor, per class
    constant: float | None  # the score of all, if a class is empty

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def moments(vectors: DataFrame, labels: DataFrame, id_column: str, label_column: str) -> np.ndarray:
    """Per class, the sum over labelled documents of the outer product of (1, x) with itself."""
    d = len(FEATURES) + 1
    joined = vectors.join(single_labels(labels, id_column, label_column), F.col(id_column) == F.col("label_id")).select("label_id", F.col("label").cast("int").alias("label"), "x").dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((2, d, d), np.int64)
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d - 1)
            one = np.rint(np.column_stack((np.ones(len(x)), x)) * 2.0**FRACTION_BITS).astype(np.int64)
            y = np.asarray(batch.column(0))
            for c in (0, 1):
                total[c] += one[y == c].T @ one[y == c]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    rows = joined.select("label", "x").mapInArrow(run, "k bigint, v bigint").groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()  # 2 * d * d rows
    out = np.zeros(2 * d * d)
    for row in rows:
        out[row["k"]] = int(row["v"]) / 4.0**FRACTION_BITS
    return out.reshape(2, d, d)


def fit(vectors: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02, id_column: str = "doc_id", label_column: str = "quality") -> Model:
    """``shrink`` is the weight of the pooled covariance, ``ridge`` that of the pooled diagonal."""
    total = moments(vectors, labels, id_column, label_column)
    n = total[:, 0, 0]
    if min(n) < 2:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = total[:, 0, 1:] / n[:, None]
    own = np.array([total[c, 1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
    whiten, offset = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink - ridge) * own[c] + shrink * pooled + ridge * diagonal)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(mean, np.array(whiten), np.array(offset), None)


def score(vectors: DataFrame, model: Model, cutoff: float = 0.7, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``score`` and ``predicted`` (1 from ``cutoff`` on) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], ["id", "score", "predicted"])

    kind = vectors.schema[id_column].dataType.simpleString()
    return vectors.select(id_column, "x").mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, model: Model, cutoff: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text scores ``cutoff`` or more."""

    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, place):
            texts = utf8(batch.column(place))
            for a, b in chunks(texts):
                yield batch.slice(a, b - a).filter(pa.array(model.scores(feature_matrix(texts[a:b])) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
