"""Reductions and clusterings per group, and density clusters by joins.

Grouped functions hold one group (a region's beads) in memory; groups are independent, so
all groups of all experiments run in parallel. An error in one becomes its ``error`` text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import numeric
from seqloom.runtime import materialized


def _keys_schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in keys)


def spread(df: DataFrame, group: list[str]) -> DataFrame:
    """Groups dealt over all shuffle partitions: vectors are few bytes but long work, so adaptive execution must not merge them into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)


def reduced(df: DataFrame, group: list[str], id_col: str, method: str = "fpca", n_components: int = 10, v: str = "v", **options) -> DataFrame:
    """(group, id, v): feature vectors of each group in fewer dimensions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = numeric.reduce_dimensions(np.stack(pdf[v].to_numpy()), method, n_components, **options)
        return pdf[[*group, id_col]].assign(v=list(x))

    return df.groupBy(*group).applyInPandas(run, f"{_keys_schema(df, [*group, id_col])}v array<double>")


def clustered(df: DataFrame, group: list[str], id_col: str, method: str = "kmeans", v: str = "v", reduction: str = "none", n_components: int = 10, reduction_options: dict | None = None, measured: bool = False, **options) -> DataFrame:
    """(group, id, label, error): clusters of each group; -1 marks outliers, and all of a group that failed.

    ``measured`` adds the group's silhouette on the standardised reduced vectors (null if undefined).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        out, silhouette = pdf[[*group, id_col]].copy(), None
        try:
            x = numeric.reduce_dimensions(np.stack(pdf[v].to_numpy()), reduction, n_components, **(reduction_options or {}))
            labels = numeric.cluster(x, method, **options)
            if measured:
                s = numeric.silhouette_of(numeric.standardised(numeric.column_filled(np.asarray(x, float))), labels)
                silhouette = s if s == s else None
            out = out.assign(label=labels.astype("int32"), error=None)
        except Exception as e:  # errors of one group are data: the others go on
            out = out.assign(label=np.int32(-1), error=f"{type(e).__name__}: {e}")
        return out.assign(silhouette=silhouette) if measured else out

    return spread(df, group).groupBy(*group).applyInPandas(run, f"{_keys_schema(df, [*group, id_col])}label int, error string{', silhouette double' if measured else ''}")


def pair_distances(df: DataFrame, group: list[str], id_col: str, v: str = "v", metric: str = "euclid") -> DataFrame:
    """(group, a, b, distance) of all pairs a < b of one bounded group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = np.stack(pdf[v].to_numpy()).astype(float)
        d = numeric.dtw_distances(x) if metric == "dtw" else numeric.distances(x)
        i, j = np.triu_indices(len(x), 1)
        ids = pdf[id_col].to_numpy()
        out = pd.DataFrame({"a": ids[i], "b": ids[j], "distance": d[i, j]})
        for k in reversed(group):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return df.groupBy(*group).applyInPandas(run, f"{_keys_schema(df, group)}a {kind}, b {kind}, distance double")


def density_clusters(near: DataFrame, points: DataFrame, min_samples: int) -> DataFrame:
    """(id, label): clusters of ``points`` (id) from pairs ``near`` (a, b) within reach, both directions.

    Core points have ``min_samples`` points in reach, themselves included; clusters are the
    components of core points, named by their least id; border points take the least core
    label in reach; the rest are -1. Each round of the component search is stored.
    """
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("id"))
    core = materialized(core)
    inner = materialized(near.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    state = materialized(core.withColumn("label", F.col("id")))
    while True:
        told = inner.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        stepped = state.join(told, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = state.select(F.col("id").alias("label"), F.col("label").alias("to"))
        stepped = materialized(stepped.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("to", "label")).alias("label")))
        state = stepped.select("id", "label")
        if stepped.where("old <> label").limit(1).count() == 0:
            break
    border = near.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("edge"))
    out = points.select("id").join(state, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "edge", F.lit(-1)).alias("label"))


def within_reach(df: DataFrame, group: list[str], id_col: str, eps: float, v: str = "v") -> DataFrame:
    """(a, b) of points of one group at most ``eps`` apart, both directions."""
    pairs = pair_distances(df, group, id_col, v).where(F.col("distance") <= eps)
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def medoids(pairs: DataFrame, labels: DataFrame, group: list[str], id_col: str = "id") -> DataFrame:
    """(group, label, medoid, distance): of each cluster the member of least mean distance to the others."""
    both = pairs.select(*group, F.col("a").alias(id_col), F.col("b").alias("o"), "distance").unionByName(pairs.select(*group, F.col("b").alias(id_col), F.col("a").alias("o"), "distance"))
    own = both.join(labels, [*group, id_col]).join(labels.select(*group, F.col(id_col).alias("o"), F.col("label").alias("lo")), [*group, "o"]).where("label = lo")
    mean = own.groupBy(*group, "label", id_col).agg(F.avg("distance").alias("distance"))
    return mean.groupBy(*group, "label").agg(F.min_by(id_col, F.struct("distance", id_col)).alias("medoid"), F.min("distance").alias("distance"))


def kernel_features(df: DataFrame, keys: list[str], n_kernels: int = 100, seed: int = 42, z: str = "z") -> DataFrame:
    """(keys, features): maximum and share of positive responses of seeded random kernels, per trace, in Arrow batches."""
    kernels = numeric.random_kernels(n_kernels, seed=seed)
    sent = df.sparkSession.sparkContext.broadcast(kernels)
    schema = f"{_keys_schema(df, keys)}features array<double>"

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(features=[numeric.kernel_features(t, sent.value) for t in pdf[z]])

    return df.select(*keys, z).mapInPandas(run, schema)


def interval_features(df: DataFrame, keys: list[str], n_intervals: int = 32, seed: int = 42, z: str = "z") -> DataFrame:
    """(keys, features): mean, deviation and slope of each trace on seeded random intervals, drawn as shares of its length."""
    spans = np.sort(np.random.default_rng(seed).random((n_intervals, 2)), axis=1)
    schema = f"{_keys_schema(df, keys)}features array<double>"

    def one(trace) -> np.ndarray:
        t, out = numeric.clean(np.asarray(trace, float)), np.zeros((n_intervals, 3))
        for i, (a, b) in enumerate(spans):
            lo = min(int(a * len(t)), max(len(t) - 3, 0))
            part = t[lo : max(int(b * len(t)), lo + 3)]
            if len(part):
                x = np.arange(len(part)) - (len(part) - 1) / 2
                out[i] = part.mean(), part.std(), x @ part / max(x @ x, 1.0)
        return out.ravel()

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(features=[one(t) for t in pdf[z]])

    return df.select(*keys, z).mapInPandas(run, schema)
