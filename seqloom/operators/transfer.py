"""Linear classifiers for many training sets at once, and how they carry over to other sets.

A model is a ridge regression on standardised features with the classes as -1 and 1. All that it
needs is sums of products, so the models of all (training set, feature set) pairs come from one
grouped aggregation and one shuffle of a row of sums a set; each set's small system is solved
where its sums arrive. Scoring adds no join: a model is a column expression, and the counts of
all models are summed in one pass, grouped by evaluation set.

Missing or infinite features are 0 (see ``trace.sanitised``). A set whose rows share one class
gives the model that always tells this class; a set without rows gives none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.metrics import scores_of_counts
from seqloom.operators.trace import sanitised

#: Models of one matrix, at most: each adds four sums to the one aggregation.
MAX_MODELS = 200


@dataclass(frozen=True)
class Linear:
    """Predicts 1 where ``bias`` and the weighted sum of the standardised ``features`` exceed 0."""

    train_set: str
    feature_set: str
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def predicted(self) -> Column:
        score = F.lit(self.bias)
        for name, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True):
            score = score + F.lit(w) * ((sanitised(F.col(name)) - F.lit(m)) / F.lit(s))
        return F.when(score > 0, 1).otherwise(0)


def fitted(rows: DataFrame, members: Mapping[str, Column], feature_sets: Mapping[str, Sequence[str]], y: str = "y", alpha: float = 1.0) -> list[Linear]:
    """Models of each training set (name and condition; sets may overlap) with each feature set.

    The sums are of features less a common offset (the features' means over all rows), which
    keeps large values from cancelling. One row of sums a set reaches the driver.
    """
    if len(members) * len(feature_sets) > MAX_MODELS:
        raise ValueError(f"{len(members) * len(feature_sets)} models; at most {MAX_MODELS} fit into one aggregation")
    names = sorted({f for fs in feature_sets.values() for f in fs})
    clean = rows.where(F.col(y).isNotNull()).select(*[sanitised(F.col(n)).alias(n) for n in names], F.when(F.col(y) == 1, 1.0).otherwise(-1.0).alias("__y"), F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in members.items()]), lambda s: s.isNotNull()).alias("__sets"))
    offset = clean.agg(*[F.avg(n).alias(n) for n in names]).first()
    base = {n: offset[n] or 0.0 for n in names}
    moved = clean.select(F.explode("__sets").alias("train_set"), "__y", *[(F.col(n) - F.lit(base[n])).alias(n) for n in names])
    every = [*names, "__y"]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(every)] + [F.sum(F.col(every[i]) * F.col(every[j])).alias(f"p{i}_{j}") for i, j in combinations_with_replacement(range(len(every)), 2)]
    found = []
    for row in moved.groupBy("train_set").agg(F.count(F.lit(1)).alias("n"), *sums).orderBy("train_set").collect():
        n, first = row["n"], np.array([row[f"s{i}"] for i in range(len(every))])
        second = np.zeros((len(every), len(every)))
        for i, j in combinations_with_replacement(range(len(every)), 2):
            second[i, j] = second[j, i] = row[f"p{i}_{j}"]
        centred = second - np.outer(first, first) / n
        for title, features in feature_sets.items():
            at = [names.index(f) for f in features]
            spread = np.sqrt(np.maximum(np.diag(centred)[at] / n, 0))
            scale = np.where(spread > 1e-9, spread, 1.0)
            gram = centred[np.ix_(at, at)] / np.outer(scale, scale) + alpha * np.eye(len(at))
            weights = np.linalg.solve(gram, centred[at, -1] / scale)
            mean = [float(first[k] / n + base[names[k]]) for k in at]
            found.append(Linear(row["train_set"], title, tuple(features), tuple(mean), tuple(map(float, scale)), tuple(map(float, weights)), float(first[-1] / n)))
    return found


def matrix(rows: DataFrame, models: Sequence[Linear], eval_set: str, y: str = "y") -> DataFrame:
    """(train_set, feature_set, eval_set, counts and metrics): every model on every evaluation set, ``all`` included."""
    told = rows.where(F.col(y).isNotNull()).select(F.explode(F.array(F.col(eval_set), F.lit("all"))).alias("eval_set"), F.col(y).alias("__y"), *[m.predicted().alias(f"p{k}") for k, m in enumerate(models)])
    cells = [("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0)]
    if not models:
        return rows.sparkSession.createDataFrame([], "train_set string, feature_set string, eval_set string, n long, tp long, tn long, fp long, fn long, accuracy double, balanced_accuracy double, precision double, recall double, f1 double, mcc double")
    counts = told.groupBy("eval_set").agg(*[F.count_if((F.col("__y") == a) & (F.col(f"p{k}") == b)).alias(f"{c}{k}") for k in range(len(models)) for c, a, b in cells])
    lines = [F.struct(F.lit(m.train_set).alias("train_set"), F.lit(m.feature_set).alias("feature_set"), *[F.col(f"{c}{k}").alias(c) for c, _, _ in cells]) for k, m in enumerate(models)]
    out = counts.select("eval_set", F.explode(F.array(*lines)).alias("m")).select("m.train_set", "m.feature_set", "eval_set", "m.tp", "m.tn", "m.fp", "m.fn")
    return scores_of_counts(out.withColumn("n", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).select("train_set", "feature_set", "eval_set", "n", "tp", "tn", "fp", "fn", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc")
