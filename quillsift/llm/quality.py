"""Operator 5, quality classifier: regularised quadratic discriminant analysis over document statistics.

Everything runs as column expressions: the statistics, the class moments (one aggregation over the labelled rows) and
the scores. Only two small matrices reach the driver, whose Cholesky factors become constants of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import maybe_broadcast, written

#: Labelled rows that training uses at most, about.
TRAIN_ROWS = 50_000
FEATURES = ("log_words", "upper", "symbols", "variety", "word_chars", "stops")


def features(text: Column) -> Column:
    """Transformed statistics of a text, an array in the order of FEATURES; null counts as ''. Counts are smoothed, so
    that texts of a few words come out near the middle. Each transform() binds what several statistics use."""

    def of(t: Column, words: Column) -> Column:
        n, nw = F.length(t).cast("double"), F.size(words).cast("double")

        def left(cut: str) -> Column:
            return F.length(F.regexp_replace(t, cut, "")).cast("double")

        return F.array(
            F.log(5 + nw),
            F.asin(F.sqrt((1 + left(r"[^\p{Lu}]+")) / (40 + n))),
            F.asin(F.sqrt((1 + left(r"[\p{L}\p{N}\s.,;:!?'\"()\-]+")) / (80 + n))),
            F.log(10 + F.size(F.array_distinct(words)).cast("double")) / F.log(10 + nw),
            F.log((60 + n) / (10 + nw)),
            F.log((1 + left(r"[^.!?]+")) / (10 + nw)),
        )

    one = F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.element_at(F.transform(F.array(F.split(t, " ")), lambda w: of(t, w)), 1))
    return F.element_at(one, 1)


@dataclass(frozen=True)
class QDA:
    """For each class (0 bad, 1 good): mean, Cholesky factor of the covariance, its inverse, and the constant
    log prior - log |L|. None stands for a class without labelled rows."""

    means: np.ndarray
    chols: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray

    def score(self, x: list[Column]) -> Column:
        """log density and prior of good less those of bad."""
        logs = []
        for mean, inv, const in zip(self.means, self.inverses, self.constants):
            diff = [c - F.lit(float(m)) for c, m in zip(x, mean)]
            whitened = [sum((F.lit(float(inv[i, j])) * diff[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(x))]
            logs.append(F.lit(float(const)) - F.lit(0.5) * sum((z * z for z in whitened), F.lit(0.0)))
        return logs[1] - logs[0]


def train(docs: DataFrame, labels: DataFrame, shrink: float = 0.3, ridge: float = 0.1, train_rows: int = TRAIN_ROWS) -> QDA | None:
    """Fits on the labelled documents (labels: doc_id, quality 0/1; null qualities are left out, several labels of a
    document all count). If there are more than train_rows labels, about so many are used, those with the least hashes
    of their doc_id: the ids are then few enough to be sent to every executor, so no text is moved and statistics are
    worked out for those documents alone. A class covariance is (1 - shrink) of its own and shrink of the pooled one,
    then ridge of it is replaced by its mean variance, variable by variable scaled. None if a class has no row."""
    y, n = _sample(labels, train_rows)
    ids = y.select(F.col("doc_id").alias("_labelled")).distinct()
    some = docs.join(maybe_broadcast(ids, n, 32), docs["doc_id"] == F.col("_labelled"), "left_semi")
    return fit(some.select("doc_id", features(F.col("text")).alias("x")), y, shrink, ridge)


def _sample(labels: DataFrame, train_rows: int) -> tuple[DataFrame, int]:
    """(doc_id, quality) of the labels to train on, and how many there are or are expected to be."""
    y = labels.where("quality is not null").select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = y.count()
    if n <= train_rows:
        return y, n
    return y.where(F.xxhash64("doc_id") < F.lit(int(-(1 << 63) + train_rows / n * (1 << 64)))), train_rows


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x), worked out once and written: a few numbers a document, read by training and scoring."""
    return written(docs.select("doc_id", features(F.col("text")).alias("x")), "quality-statistics")


def fit(x: DataFrame, y: DataFrame, shrink: float, ridge: float) -> QDA | None:
    """train(), from statistics and the labels to use."""
    d = len(FEATURES)
    v = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(c) for c in v] + [F.sum(v[i] * v[j]) for i in range(d) for j in range(i + 1)]
    rows = {r[0]: list(r[1:]) for r in y.join(x, "doc_id").groupBy("quality").agg(F.count("*"), *sums).collect()}
    if not {0, 1} <= set(rows):
        return None
    n, means, covs = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        n[c], s1, s2 = rows[c][0], np.array(rows[c][1 : 1 + d]), np.zeros((d, d))
        s2[np.tril_indices(d)] = rows[c][1 + d :]
        s2 = s2 + np.tril(s2, -1).T
        means[c] = s1 / n[c]
        covs[c] = s2 / n[c] - np.outer(means[c], means[c])
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    scale = np.diag(pooled) + 1e-6
    chols = []
    for c in (0, 1):
        cov = (1 - shrink) * covs[c] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(scale)
        chols.append(np.linalg.cholesky(cov))
    inverses = [np.linalg.solve(L, np.eye(d)) for L in chols]
    constants = [np.log(n[c] / n.sum()) - np.log(np.diag(chols[c])).sum() for c in (0, 1)]
    return QDA(means, np.array(chols), np.array(inverses), np.array(constants))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, shrink: float = 0.3, ridge: float = 0.1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Operator 5: doc_id, score (to 4 digits), keep for every row of docs. keep is score >= threshold. Null and empty texts are
    scored as ''. If labels lack one of the classes nothing can be judged: score is null and keep true."""
    x = statistics(docs)
    y, n = _sample(labels, train_rows)
    model = fit(x, maybe_broadcast(y, n, 32), shrink, ridge)
    score = F.lit(None).cast("double") if model is None else model.score([F.col("x")[i] for i in range(len(FEATURES))])
    scored = x.select("doc_id", score.alias("score"))
    return scored.select("doc_id", F.round("score", 4).alias("score"), F.coalesce(F.col("score") >= threshold, F.lit(True)).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, shrink: float = 0.3, ridge: float = 0.1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs, all columns, without the rows that quality_scores() would not keep. A narrow filter: no shuffle of texts."""
    model = train(docs, labels, shrink, ridge, train_rows)
    if model is None:
        return docs
    # transform() binds the statistics, so that they are worked out once and not in each term of the score
    score = F.element_at(F.transform(F.array(features(F.col("text"))), lambda x: model.score([x[i] for i in range(len(FEATURES))])), 1)
    return docs.where(score >= threshold)
