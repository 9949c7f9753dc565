"""Batch job: classifiers trained on one group of text traces, evaluated on every other.

    python jobs/transfer_matrix.py --config jobs/transfer_matrix.json --documents IN --labels IN --out OUT

Labelled documents become traces (their words' lengths) and these features. Each group (by
default, a language) and all groups together train a ridge classifier of the label on each
feature set; every model is evaluated on the held-out documents of every group. OUT/features is
partitioned by group, OUT/matrix by the training set. Held out are documents whose id's MD5
begins with a byte below ``held_out`` of 256. Both tables are replaced partition by partition from
the same input by the same rules, so a rerun gives the same result.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, config_of, log, replace_partitions  # noqa: E402
from seqloom.operators import trace, transfer  # noqa: E402

FEATURES = {"4": ["variance", "diff_std", "max_abs_diff", "median_abs_diff"], "8": ["variance", "diff_std", "max_abs_diff", "median_abs_diff", "ptp", "p25", "p75", "autocorr_lag1"]}
OPTIONS = {"group": "lang", "groups": ["en", "es", "fr", "de"], "label": "quality", "alpha": 1.0, "held_out": 51}
STORED = "doc_id long, y int, held_out boolean, variance double, diff_std double, max_abs_diff double, median_abs_diff double, ptp double, p25 double, p75 double, autocorr_lag1 double, grp string"
MATRIX = "feature_set string, eval_set string, n long, tp long, tn long, fp long, fn long, accuracy double, balanced_accuracy double, precision double, recall double, f1 double, mcc double, train_set string"


def features_of(docs: DataFrame, labels: DataFrame, options: dict) -> DataFrame:
    """(doc_id, y, held_out, features, grp) of labelled documents that have words; groups that aren't named are ``other``."""
    truth = labels.where(F.col(options["label"]).isNotNull()).groupBy("doc_id").agg(F.max(options["label"]).alias("y"))
    group = F.when(F.col(options["group"]).isin(*options["groups"]), F.col(options["group"])).otherwise("other")
    rows = docs.groupBy("doc_id").agg(F.min_by(F.struct(group.alias("grp"), "text"), F.struct(F.xxhash64("text"), "text")).alias("d")).select("doc_id", "d.*")
    labelled = rows.join(truth, "doc_id")
    found = trace.features8(trace.word_lengths(labelled, ["doc_id"]), ["doc_id"])
    held = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") < options["held_out"]
    return labelled.drop("text").join(found, "doc_id").withColumn("held_out", held).select(*[c.split()[0] for c in STORED.split(", ")])


def run(spark: SparkSession, config: str, documents: str, labels: str, out: str) -> DataFrame:
    """Features, models and their metrics; returns the matrix read back."""
    options = config_of(spark, config, OPTIONS)
    found = features_of(spark.read.parquet(documents), spark.read.parquet(labels), options)
    replace_partitions(found.hint("rebalance", "grp"), f"{out}/features", "grp")
    rows = spark.read.schema(STORED).parquet(f"{out}/features")
    members = {g: ~F.col("held_out") & (F.col("grp") == g) for g in (*options["groups"], "other")} | {"all": ~F.col("held_out")}
    models = transfer.fitted(rows, members, FEATURES, "y", options["alpha"])
    log.info("read %s and %s, wrote %d traces to %s/features; %d models", documents, labels, rows.count(), out, len(models))
    matrix = transfer.matrix(rows.where("held_out"), models, "grp")
    replace_partitions(matrix.select(*[c.split()[0] for c in MATRIX.split(", ")]).repartition("train_set"), f"{out}/matrix", "train_set")
    log.info("wrote %s/matrix", out)
    return spark.read.schema(MATRIX).parquet(f"{out}/matrix")


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], {"documents": "Parquet table of texts", "labels": "labels by doc_id", "out": "folder of the output"}, run)
