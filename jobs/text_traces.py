"""Incremental job: rule verdicts on text traces, scored against labels for each experiment.

    python jobs/text_traces.py --config jobs/text_traces.json --documents IN --labels IN --out OUT --checkpoint DIR

A document is a bead, its words' lengths are the trace, its source is the experiment, and
``quality`` of the labels says whether it is good. A file stream with a checkpoint takes only documents
of new files (``availableNow``); each micro-batch writes OUT/beads, partitioned by batch and
experiment. A batch that is run again replaces its own partitions, so a job that was cut off
and repeated gives the same table. Then OUT/results, partitioned by experiment, is computed anew for
those experiments whose newest batch differs from the one their results were made from; the rest
stays as it is. Both marks are partition and result columns; nothing else is kept.

A bead is one document id of one experiment; of its rows the newest batch's counts (in a batch,
the one with the least text hash). Texts without words are beads without samples and not usable.
Documents without a label are beads, but not scored. Labels that change later count when their
experiment next gets a document; ``rescore`` computes all results anew.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import as_listing, command_line, config_of, exists, log, replace_partitions  # noqa: E402
from seqloom.operators import metrics, trace  # noqa: E402

OPTIONS = {"variance_thresh": 40.0, "n_sigma": 9.0, "gap_len": 6, "flat_tol": 1e-6, "max_files_per_batch": 1000, "no_source": "none", "rescore": False}
BEADS = "doc_id long, samples long, flat boolean, dropout boolean, spike boolean, high_variance boolean, usable int, batch long, experiment string"
RESULTS = "method string, n_beads long, n_predicted_good long, n_predicted_bad long, n_labelled long, correct long, tp long, tn long, fp long, fn long, accuracy double, last_batch long, experiment string"
RULES = ("flat", "dropout", "spike", "high_variance")


def beads_of(docs: DataFrame, options: dict) -> DataFrame:
    """(experiment, doc_id, samples, rules, usable) of documents."""
    keys = ["experiment", "doc_id"]
    source = F.when(F.col("source") != "", F.col("source")).otherwise(F.lit(options["no_source"]))
    rules = {k: options[k] for k in ("variance_thresh", "n_sigma", "gap_len", "flat_tol")}
    # a text is judged where it is read; verdicts alone are shuffled
    lengths = docs.where("doc_id IS NOT NULL").select(source.alias("experiment"), "doc_id", F.xxhash64("text").alias("hash"), trace.length_array(F.col("text")).alias("z"))
    judged = lengths.select(*keys, "hash", F.struct(F.size("z").cast("long").alias("samples"), trace.array_rule_flags(F.col("z"), **rules).alias("f")).alias("r"))
    once = judged.groupBy(*keys).agg(F.min_by("r", F.struct("hash", "r")).alias("r"))
    return once.select(*keys, "r.samples", *[F.coalesce(f"r.f.{c}", F.lit(False)).alias(c) for c in RULES], F.coalesce("r.f.usable", F.lit(0)).alias("usable"))


def take_new(spark: SparkSession, documents: str, beads: str, checkpoint: str, options: dict) -> int:
    """Run the stream over files that it hasn't seen; the number of batches it made."""
    made = []

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.count()  # of the files' footers
        found = beads_of(batch, options)
        # files by experiment; a large experiment is split by adaptive execution
        replace_partitions(found.withColumn("batch", F.lit(number).cast("long")).hint("rebalance", "experiment"), beads, "batch", "experiment")
        made.append(number)
        log.info("batch %d: read %d documents, wrote %s", number, rows, beads)

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", options["max_files_per_batch"]).parquet(as_listing(spark, documents))
    query = stream.select("doc_id", "source", "text").writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(made)


def newest(beads: DataFrame) -> DataFrame:
    """Of a bead's rows that of the newest batch."""
    rest = F.struct(*[c for c in beads.columns if c not in ("experiment", "doc_id")])
    return beads.groupBy("experiment", "doc_id").agg(F.max_by(rest, "batch").alias("r")).select("experiment", "doc_id", "r.*")


def results_of(beads: DataFrame, labels: DataFrame) -> DataFrame:
    """One row an experiment: counts of verdicts, and their confusion with the labels."""
    truth = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    scored = metrics.confusion(beads.join(truth, "doc_id"), ["experiment"], "y", "usable").withColumnRenamed("n", "n_labelled")
    told = beads.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_beads"), F.sum("usable").alias("n_predicted_good"), F.sum(1 - F.col("usable")).alias("n_predicted_bad"), F.max("batch").alias("last_batch"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_labelled", "correct", "tp", "tn", "fp", "fn")]
    return told.join(scored, "experiment", "left").select("experiment", F.lit("rules").alias("method"), "n_beads", "n_predicted_good", "n_predicted_bad", *zero, F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "last_batch")


def run(spark: SparkSession, config: str, documents: str, labels: str, out: str, checkpoint: str) -> DataFrame:
    """Take new documents, bring the results up to date, and return them read back."""
    options = config_of(spark, config, OPTIONS)
    beads, results = f"{out}/beads", f"{out}/results"
    batches = take_new(spark, documents, beads, checkpoint, options)
    if not exists(spark, beads):
        log.info("no documents yet in %s", documents)
        return spark.createDataFrame([], RESULTS)
    stored = spark.read.schema(BEADS).parquet(beads)
    marks = stored.groupBy("experiment").agg(F.max("batch").alias("last_batch"))
    if exists(spark, results) and not options["rescore"]:
        marks = marks.join(spark.read.schema(RESULTS).parquet(results), ["experiment", "last_batch"], "left_anti")
    n = marks.count()
    log.info("%d new batches, %d experiments to score", batches, n)
    if n:
        found = results_of(newest(stored.join(marks, "experiment", "left_semi")), spark.read.parquet(labels))
        replace_partitions(found.repartition("experiment"), results, "experiment")
        log.info("read %s and %s, wrote %d experiments to %s", beads, labels, n, results)
    return spark.read.schema(RESULTS).parquet(results)


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], {"documents": "Parquet files to take from", "labels": "labels by doc_id", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint"}, run)
