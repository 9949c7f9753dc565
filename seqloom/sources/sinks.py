"""Sinks: result tables, manifests, splits, datasets, reports and model runs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.select import decimals3


def write_results(df: DataFrame, path: str, overwrite: bool = False, partition: str | None = None) -> None:
    """Result rows as CSV with a header, appended unless told otherwise; text values are quoted."""
    writer = df.write.mode("overwrite" if overwrite else "append").option("header", True).option("quoteAll", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition: str | None = None, overwrite: bool = True) -> None:
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, path: str, seed: int, train_frac: float) -> None:
    """A split as JSON lines: (fold, path, experiment_id, source) with its parameters in each line."""
    rows.select("fold", "path", "experiment_id", "source", F.lit(seed).alias("seed"), F.lit(train_frac).alias("train_frac")).write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str, fold: str = "train") -> DataFrame:
    return spark.read.schema("fold string, path string, experiment_id string, source string, seed int, train_frac double").json(path).where(F.col("fold") == fold)


def save_dataset(arrays: DataFrame, path: str) -> None:
    """Traces (id, label, z array, t array) with their padded forms beside them, by label."""
    from seqloom.functions.arrays import edge_padded, padded

    target = arrays.agg(F.floor(F.median(F.size("z"))).cast("int").alias("median_length"), F.max(F.size("z")).alias("max_length"))
    out = arrays.join(F.broadcast(target)).withColumn("z_median", edge_padded(F.col("z"), F.col("median_length"))).withColumn("z_padded", padded(F.col("z"), F.col("max_length"), F.lit(float("nan"))))
    write_table(out, path, "label")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report(results: DataFrame, gaps: DataFrame) -> str:
    """Markdown: the best test row and the five largest distribution gaps; only these few rows are read."""
    from seqloom.operators.select import best_row

    best = best_row(results.withColumn("balanced", decimals3(F.col("balanced_accuracy"))), "balanced_accuracy").collect()
    top = gaps.orderBy(F.col("ks_stat").desc_nulls_last(), "feature").limit(5).select("feature", decimals3(F.col("ks_stat")).alias("ks"), decimals3(F.col("wasserstein")).alias("w1")).collect()
    out = ["# Evaluation", ""]
    if best:
        out += [f"Best model: {best[0]['model']} on {best[0]['train_set']} (balanced accuracy {best[0]['balanced']})", ""]
    out += ["| feature | KS | W1 |", "|---|---|---|", *[f"| {r['feature']} | {r['ks']} | {r['w1']} |" for r in top]]
    return "\n".join(out) + "\n"


def run_config(path_free: dict) -> str:
    """A run's settings as stable JSON."""
    return json.dumps(path_free, sort_keys=True, indent=2)
