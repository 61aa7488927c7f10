"""Regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance of transformed statistics; the covariance is shrunk
towards the pooled one and then towards a scaled identity, as in regularised discriminant
analysis. The score is the posterior of class 1: the logistic of the difference of the two
log-densities, each from a Mahalanobis distance by its cached Cholesky factor.

Means and covariances come from sums over all labelled rows that aren't held out, added up
per task and then by one grouped aggregation, so nothing is sampled. The document
statistics are computed once, in one scan, and written as a narrow table.

Defined results: null and empty texts have the statistics of no words and are scored; rows
without a label are only scored; labels other than 0 and 1 are ignored; where a class has
too few rows its covariance is the pooled one, and without rows the score is the prior;
repeated rows are scored one by one, and learned from as often as they and their labels
repeat; a null doc_id isn't held out nor learned from; very long texts are read whole; only
the key and the text of a table are read, so other columns and their names have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestone.llm.common import Scratch, read
from gablestone.llm.textstats import text_stats

#: Weight of the pooled covariance in each class's own, and of the identity in both.
POOL, IDENTITY = 0.1, 0.02
CUT = 0.3
#: Words of plain prose that each text is taken with.
PSEUDO = 10.0
#: Folds of crc32 of the id; rows of fold 0 are held out.
FOLDS = 5


def features(s: str = "s") -> list[Column]:
    """Transformed statistics: logarithms of counts, square roots of shares.

    A share of a text with few words says little, so each is taken as if ``PSEUDO`` words of
    plain prose stood before the text.
    """
    c = lambda name: F.col(f"{s}.{name}")
    leaning = lambda a, b, usual, weight=PSEUDO: (a + usual * weight) / (b + weight)
    share = lambda *x: F.sqrt(leaning(*x))
    words, chars, lines = c("n_words"), c("word_chars"), c("n_lines")
    return [
        F.log1p(F.greatest(words, F.lit(PSEUDO))),
        leaning(chars, words, 5.0),
        F.least(share(c("n_symbols"), words, 0.0), F.lit(2.0)),
        share(c("n_dup_lines"), lines, 0.0, PSEUDO),
        share(c("n_repeat_words"), words, 0.0),
        share(c("n_upper"), c("n_upper") + c("n_lower"), 0.03, 5.0 * PSEUDO),
        share(c("n_digits"), chars, 0.0, 5.0 * PSEUDO),
        share(c("n_marks"), chars, 0.03, 5.0 * PSEUDO),
        share(c("n_distinct_words"), words, 0.8),
        share(c("n_capital_words"), words, 0.12),
        share(c("n_ends"), words, 0.1),
        F.log1p(leaning(words, lines, 30.0, 1.0)),
    ]


def fold(key: str) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


@dataclass(frozen=True)
class Gaussian:
    """A class: log of its prior, mean, and what its covariance's Cholesky factor gives once for all rows."""

    log_prior: float
    mean: np.ndarray
    whiten: np.ndarray  # inverse of the factor
    log_det: float

    @classmethod
    def of(cls, prior: float, mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return cls(float(np.log(prior)), mean, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = self.whiten @ (x - self.mean).T
        return self.log_prior - 0.5 * (self.log_det + (z * z).sum(0))


@dataclass(frozen=True)
class Model:
    scale: np.ndarray
    centre: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        x = (x - self.centre) / self.scale
        bad, good = (g.log_density(x) for g in self.classes)
        return 1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of each class in a task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.stack([np.ones(len(y)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])], 1)
        for k in (0, 1):
            part = x[y == k]
            if len(part):
                sums[k] = sums.get(k, 0) + part.T @ part
    y = [k for k, m in sums.items() for _ in range(m.size)]
    at = [i for m in sums.values() for i in range(m.size)]
    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array([v for m in sums.values() for v in m.ravel().tolist()], pa.float64())], names=["y", "at", "v"])


def fit(rows: DataFrame, label: str, columns: list[str], pool: float = POOL, identity: float = IDENTITY) -> Model:
    """Fit on all rows whose label is 0 or 1."""
    d = len(columns)
    got = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int"), *columns).mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, (d + 1) ** 2))
    for r in got:  # two classes of (d + 1)^2 sums
        m[r["y"], r["at"]] = r["v"]
    m = m.reshape(2, d + 1, d + 1)
    n = m[:, 0, 0]
    both = m.sum(0)
    if n.min() < 2:
        return Model(np.ones(d), np.zeros(d), None, float((n[1] + 1) / (n.sum() + 2)))
    centre = both[0, 1:] / both[0, 0]
    spread = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means = m[:, 0, 1:] / n[:, None]
    cov = np.stack([m[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]) / np.outer(scale, scale)
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    classes = []
    for k in (0, 1):
        own = 1 - pool if n[k] > d else 0.0
        s = own * cov[k] + (1 - own) * pooled
        s = (1 - identity) * s + identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
        classes.append(Gaussian.of(n[k] / n.sum(), (means[k] - centre) / scale, s))
    return Model(scale, centre, (classes[0], classes[1]), float(n[1] / n.sum()))


def scorer(model: Model):
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array(model.scores(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1)), pa.float64())

    return F.arrow_udf(score, T.DoubleType())


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs."""
    names = [f"f{i}" for i in range(len(features()))]
    stats = docs.select(F.col(key).alias("k"), text_stats(F.col(text)).alias("s")).select("k", *[f.cast("double").alias(n) for n, f in zip(names, features())])
    stats = Scratch(docs.sparkSession).write(stats, "stats")
    known = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"))
    model = fit(stats.where(fold("k") != 0).join(known, "k"), "y", names)
    held = F.coalesce(fold("k") == 0, F.lit(False))
    scored = stats.select(F.col("k").alias(key), held.alias("held_out"), scorer(model)(*names).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
