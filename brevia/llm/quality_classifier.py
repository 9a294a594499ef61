"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each document becomes a few transformed statistics (logarithms, square roots of shares), clipped to a
range around the training data. Every class has a Gaussian whose covariance is shrunk towards the
pooled one (SHRINK) and that towards a multiple of the identity (RIDGE). The score is the logistic
of the difference of the two log densities and log priors; Mahalanobis distances come from triangular
Cholesky factors, inverted once, with their log determinants beside them.

Training takes at most MAX_LABELLED rows: those labelled rows outside the held-out fold whose md5 of
the key is smallest. They alone reach the driver, as numbers. Every row of the table is scored, in one
scan and without a shuffle. Labels, language, source and key are no inputs of a score.

Null and empty texts are scored like others, from statistics that are all 0. Repeated rows get equal
scores. Of several labels of one key the smallest counts. Without labels of both classes every score
is the share of good labels, or 0.5 if there are none. An empty table gives an empty result; extra
columns are left out by score(), kept by filter_documents().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.llm.shared import map_arrow, tables
from brevia.llm.textkit import column_stats

MAX_LABELLED = 20_000
SHRINK = 0.1
RIDGE = 0.005
FOLDS, HELD_OUT = 3, 1
CLIP = 6.0


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """n x features, finite for any text."""
    s = {name: values.astype(float) for name, values in stats.items()}

    def share(top: str, bottom: str) -> np.ndarray:
        return s[top] / np.maximum(s[bottom], 1)

    return np.stack(
        [
            np.log1p(s["n_words"]),
            np.log1p(share("word_chars", "n_words")),
            np.log1p(share("n_words", "n_lines")),
            np.log(0.02 + share("n_symbols", "n_words")),
            np.log(0.02 + share("n_loud", "n_words")),
            np.sqrt(share("n_repeat_words", "n_words")),
            np.sqrt(share("n_dup_lines", "n_lines")),
            np.sqrt(share("n_stop", "n_words")),
            np.sqrt(share("n_distinct", "n_words")),
            np.log(0.02 + share("n_upper", "n_letters")),
            np.log(0.02 + share("n_digits", "n_chars")),
            share("n_letters", "n_chars"),
            share("n_final_lines", "n_lines"),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Discriminant:
    """center, scale: of all features. By class: mean, inverse Cholesky factor, offset (log prior less half the log determinant)."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        density = [self.offsets[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit_rows(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """The discriminant of features x and labels y (0 or 1)."""
    d = x.shape[1]
    if len(np.unique(y)) < 2:
        nothing = np.zeros((2, d))
        return Discriminant(np.zeros(d), np.ones(d), nothing, np.zeros((2, d, d)), np.zeros(2), float(y.mean()) if len(y) else 0.5)
    center, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - center) / scale, -CLIP, CLIP)
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    spread = np.stack([(z[y == c] - means[c]).T @ (z[y == c] - means[c]) / (y == c).sum() for c in (0, 1)])
    share = np.array([(y == c).mean() for c in (0, 1)])
    pooled = np.tensordot(share, spread, 1)
    factors, offsets = np.empty((2, d, d)), np.empty(2)
    for c in (0, 1):
        cov = (1 - shrink) * spread[c] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors[c] = np.linalg.inv(lower)
        offsets[c] = np.log(share[c]) - np.log(np.diag(lower)).sum()
    return Discriminant(center, scale, means, factors, offsets)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo FOLDS."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality", most: int = MAX_LABELLED) -> Discriminant:
    known = labels.select(F.col(key).alias("key"), F.col(target).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold(F.col("key")) != HELD_OUT))
    chosen = known.groupBy("key").agg(F.min("y").alias("y")).orderBy(F.md5(F.col("key").cast("string").cast("binary"))).limit(most)
    # at most `most` rows of two numbers: small enough for every executor
    matched = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key").select("key", "y", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = features(column_stats(batch.column(2)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["key", "y", "x"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    rows = map_arrow(matched, f"key {kind}, y int, x array<double>", make).groupBy("key", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.key)
    d = features({name: np.zeros(1, np.int64) for name in column_stats(pa.array([""]))}).shape[1]
    return fit_rows(np.array([r.x for r in rows]).reshape(-1, d), np.array([r.y for r in rows], int))


def score(docs: DataFrame, model: Discriminant, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(column_stats(batch.column(1)))))], [key, "score"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    scored = map_arrow(docs.select(F.col(key), F.col(text).cast("string").alias("text")), f"`{key}` {kind}, score double", make)
    return scored.select(key, F.coalesce(fold(F.col(key)) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_column(text: Column, model: Discriminant) -> Column:
    """The score as a column, for filters that keep all other columns in the JVM; evaluated once."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(features(column_stats(column))))

    return scored.asNondeterministic()(text)


def filter_documents(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that the model fitted to their labelled rows scores least or more."""
    model = fit(docs, labels, text=text)
    return docs.withColumn("__brevia_score", score_column(F.col(text).cast("string"), model)).filter(F.col("__brevia_score") >= least).drop("__brevia_score")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return score(docs, fit(docs, tables(spark, sf_dir, "labels")))
