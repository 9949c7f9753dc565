"""Training and evaluation on measured traces: from a path to result rows.

An experiment is a folder with samples and labels (``sources.experiments``). Traces are brought into
one of two forms: ``Scaled`` (each trace resampled to one length) or ``Segments`` (windows of one
length, each with its bead's label). Whole-trace models and the bundle of feature models are
fitted on the training experiments and stored as ML pipelines; every model and the rules then score
every test experiment in one plan: the loop is over models, never over experiments.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import metrics, select, trace, traceml
from seqloom.runtime import materialized
from seqloom.sources import experiments, labels
from seqloom.sources.experiments import Experiments

BEAD = ["exp_id", "bead"]


@dataclass(frozen=True)
class Scaled:
    """Every trace resampled to ``length`` samples."""

    length: int = 5000


@dataclass(frozen=True)
class Segments:
    """Windows of ``length`` samples every ``stride`` (the length by default); of all of them ``most``, drawn by hash."""

    length: int = 5000
    stride: int | None = None
    most: int | None = None


def _below(spark: SparkSession, root: str, pattern: str) -> bool:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return not found.isEmpty()


def load(spark: SparkSession, path: str) -> Experiments:
    """Experiments at a path: a block or sample file, or a folder of experiments in either form; labelled by label files where there are any.

    Samples and labels are read once and stored as tables of the shared folder.
    """
    root = path.rstrip("/").rsplit("/", 1)[0] if path.endswith((".npy", ".txt")) else path
    if path.endswith(".npy") or not path.endswith(".txt") and _below(spark, root, "*.npy"):
        found = experiments.load_blocks(spark, root)
    elif path.endswith(".txt") or _below(spark, root, "Experiment.txt"):
        found = experiments.load_text(spark, root)
    else:
        raise ValueError(f"{path} holds no traces")
    samples = materialized(found.samples)
    beads = found.beads
    if _below(spark, root, "*.pickle"):
        beads = labels.good_mask(spark, root, samples.select(*BEAD).distinct())
    return Experiments(samples, found.script, materialized(beads))


def counts(e: Experiments) -> DataFrame:
    """(exp_id, n_frames, n_beads, n_good, has_both_classes)."""
    frames = e.samples.groupBy("exp_id").agg((F.max("frame") + 1).alias("n_frames"))
    beads = e.beads.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_beads"), F.count_if("is_good").alias("n_good"), (F.bool_or("is_good") & F.bool_or(~F.col("is_good"))).alias("has_both_classes"))
    return frames.join(beads, "exp_id")


def split(e: Experiments, train_frac: float = 0.8, seed: int = 42, test_all: bool = False, both_classes: bool = False) -> DataFrame:
    """(exp_id, fold): experiments dealt to train and test; with ``test_all`` all are tested, with ``both_classes`` those of one class are left out."""
    rows = counts(e)
    rows = (rows.where("has_both_classes") if both_classes else rows).select("exp_id")
    return rows.withColumn("fold", F.lit("test")) if test_all else select.split_groups(rows, "exp_id", train_frac, seed)


def prepared(e: Experiments, form: Scaled | Segments, fold: DataFrame | None = None, stats: tuple[float, float] | None = None) -> DataFrame:
    """(exp_id, bead, segment, z, label) of the experiments of ``fold`` (exp_id), in a form.

    NaN samples become the trace's mean, infinite ones 0. ``stats`` (mean, deviation) are those to
    which all samples of an experiment are moved and scaled.
    """
    samples = e.samples if fold is None else e.samples.join(fold.select("exp_id"), "exp_id", "left_semi")
    rows = trace.filled(samples, BEAD, inf_in_mean=True)
    if isinstance(form, Scaled):
        out = trace.resampled_traces(rows, BEAD, form.length).withColumn("segment", F.lit(0))
    else:
        out = trace.segmented(rows, BEAD, form.length, form.stride).drop("start")
    if stats is not None:
        long = out.select("exp_id", F.explode("z").alias("v"))
        own = long.groupBy("exp_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        spread = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
        mean, std = stats[0], stats[1] if stats[1] > 0 else 1.0
        out = out.join(own, "exp_id").withColumn("z", F.transform("z", lambda v: (v - F.col("m")) / spread * F.lit(std) + F.lit(mean))).drop("m", "s")
    out = out.join(e.beads.select(*BEAD, F.col("is_good").cast("int").alias("label")), BEAD)
    if isinstance(form, Segments) and form.most is not None:
        out = select.least_drawn(out, form.most, *BEAD, "segment")
    return out.select("exp_id", "bead", "segment", "z", "label")


def training_stats(rows: DataFrame) -> tuple[float, float]:
    """Mean and deviation over all samples of prepared traces."""
    found = rows.select(F.explode("z").alias("v")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    return float(found["m"] or 0.0), float(found["s"] if found["s"] is not None else 1.0)


FEATURES4 = ["variance", "diff_std", "max_abs_diff", "median_abs_diff"]
FEATURES8 = [*FEATURES4, "ptp", "p25", "p75", "autocorr_lag1"]
#: The bundle's models: features, whether of traces matched to the training statistics, and the classifier.
BUNDLE = {
    "baseline_dt": (FEATURES4, False, lambda seed: DecisionTreeClassifier(maxDepth=3, seed=seed)),
    "baseline_rf": (FEATURES4, False, lambda seed: RandomForestClassifier(numTrees=100, maxDepth=5, seed=seed)),
    "baseline_lr": (FEATURES4, False, lambda seed: LogisticRegression(maxIter=500)),
    "baseline_dt_extra": (FEATURES8, False, lambda seed: DecisionTreeClassifier(maxDepth=5, seed=seed)),
    "baseline_rf_extra": (FEATURES8, False, lambda seed: RandomForestClassifier(numTrees=100, maxDepth=6, seed=seed)),
    "approach1_scaled_dt": (FEATURES4, True, lambda seed: DecisionTreeClassifier(maxDepth=3, seed=seed)),
}


def features(rows: DataFrame) -> DataFrame:
    """Prepared traces with the eight features; what isn't finite is NaN, to be imputed."""
    keys = [*BEAD, "segment"]
    long = rows.select(*keys, F.posexplode("z").alias("frame", "z"))
    found = trace.features8(long, keys)
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in FEATURES8]
    return found.select(*keys, *finite).join(rows.select(*keys, "label"), keys)


def fit_bundle(e: Experiments, fold: DataFrame, root: str, length: int = 5000, seed: int = 42) -> list[str]:
    """Fit and store the bundle below ``root``: medians and scales of the training features are part of each pipeline."""
    train = prepared(e, Scaled(length), fold).cache()
    try:
        stats = training_stats(train)
        plain, matched = features(train).cache(), features(prepared(e, Scaled(length), fold, stats)).cache()
        for name, (columns, scaled, make) in BUNDLE.items():
            own = [f"{c}_known" for c in columns]
            stages = [Imputer(inputCols=columns, outputCols=own, strategy="median"), VectorAssembler(inputCols=own, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), make(seed)]
            model = Pipeline(stages=stages).fit(matched if scaled else plain)
            _save(e.samples.sparkSession, model, f"{root}/{name}", {"form": {"length": length}, "kind": "features", "scaled": scaled, "stats": stats, "seed": seed})
        plain.unpersist()
        matched.unpersist()
    finally:
        train.unpersist()
    return list(BUNDLE)


def fit_model(e: Experiments, fold: DataFrame, root: str, name: str, form: Scaled | Segments, n_features: int | None = None, seed: int = 42) -> str:
    """Fit a whole-trace model of ``traceml`` on prepared traces and store it below ``root``/``name``; returns the run."""
    rows = prepared(e, form, fold).cache()
    try:
        if rows.isEmpty():
            raise ValueError("no traces to train on")
        model = traceml.trace_pipeline(name, n_features, seed=seed).fit(rows)
        config = {"form": asdict(form), "kind": "segments" if isinstance(form, Segments) else "scaled", "stats": training_stats(rows), "n_traces": rows.count(), "seed": seed}
        return _save(e.samples.sparkSession, model, f"{root}/{name}", config)
    finally:
        rows.unpersist()


def _save(spark: SparkSession, model: PipelineModel, root: str, config: dict) -> str:
    run = traceml.save_run(model, root)
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{run}-config")
    return run


def load_model(spark: SparkSession, root: str, run: str | None = None) -> tuple[PipelineModel, dict]:
    """A stored model (the latest run by default) and its configuration."""
    name = run or traceml.latest_run(spark, root)
    model = traceml.load_run(spark, root, name)
    return model, json.loads(spark.read.text(f"{root}/{name}-config").first()["value"])


def told_by(e: Experiments, fold: DataFrame, model: PipelineModel, config: dict) -> DataFrame:
    """(exp_id, bead, segment, label, p) of a stored model over the experiments of ``fold``, prepared as its training traces were."""
    stats = tuple(config["stats"])
    if config["kind"] == "features":
        rows = features(prepared(e, Scaled(**config["form"]), fold, stats if config["scaled"] else None))
        return model.transform(rows).select(*BEAD, "segment", "label", F.col("prediction").cast("int").alias("p"))
    form = Segments(**{**config["form"], "most": None}) if config["kind"] == "segments" else Scaled(**config["form"])
    return model.transform(prepared(e, form, fold, stats)).select(*BEAD, "segment", "label", "p")


def told_by_rules(e: Experiments, fold: DataFrame, length: int = 5000, **thresholds) -> DataFrame:
    """(exp_id, bead, segment, label, p) of the rules over resampled traces."""
    rows = prepared(e, Scaled(length), fold)
    flags = trace.rule_flags(rows.select(*BEAD, F.posexplode("z").alias("frame", "z")), BEAD, **thresholds)
    return rows.select(*BEAD, "segment", "label").join(flags.select(*BEAD, F.col("usable").alias("p")), BEAD)


def by_bead(told: DataFrame, e: Experiments, fold: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(exp_id, bead, label, majority, sum_vote) of all beads of ``fold``; beads without segments are told 0."""
    beads = e.beads.join(fold.select("exp_id"), "exp_id", "left_semi").select(*BEAD, F.col("is_good").cast("int").alias("label"))
    votes = metrics.majority(told, BEAD, beads.select(*BEAD)).withColumnRenamed("vote", "majority")
    sums = metrics.sum_vote(told, BEAD, beads.select(*BEAD), fraction=fraction).withColumnRenamed("vote", "sum_vote")
    return beads.join(votes, BEAD).join(sums, BEAD)


def bead_accuracy(told: DataFrame, e: Experiments, fold: DataFrame, fraction: float = 0.5) -> DataFrame:
    """One row: (n_test_beads, n_test_experiments, accuracy_majority_vote, accuracy_sum_threshold)."""
    rows = by_bead(told, e, fold, fraction)
    right = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("n_test_beads"), F.count_distinct("exp_id").alias("n_test_experiments"), right("majority").alias("accuracy_majority_vote"), right("sum_vote").alias("accuracy_sum_threshold"))


#: Columns of a result row, in order.
RESULT_COLUMNS = "path experiment_id source n_beads correct accuracy method n_predicted_good n_predicted_bad tp tn fp fn".split()


def result_rows(told: DataFrame, e: Experiments, fold: DataFrame, method: str, root: str = "") -> DataFrame:
    """A result row an experiment: segments vote by majority; the source is the first folder below ``root``."""
    rows = metrics.confusion(by_bead(told, e, fold), ["exp_id"], "label", "majority")
    below = F.regexp_replace("exp_id", f"^/*{root.strip('/')}/", "")
    named = rows.withColumns({"path": F.col("exp_id"), "experiment_id": F.element_at(F.split("exp_id", "/"), -1), "source": F.element_at(F.split(below, "/"), 1), "method": F.lit(method), "n_beads": F.col("n"), "n_predicted_good": F.col("tp") + F.col("fp"), "n_predicted_bad": F.col("tn") + F.col("fn")})
    return named.select(*RESULT_COLUMNS)


def evaluate(spark: SparkSession, e: Experiments, fold: DataFrame, root: str, names: list[str], length: int = 5000, data_root: str = "") -> DataFrame:
    """Result rows of stored models and of the rules over every experiment of ``fold``."""
    # verdicts are stored: votes and scores read them more than once
    parts = [result_rows(materialized(told_by(e, fold, *load_model(spark, f"{root}/{n}"))), e, fold, n, data_root) for n in names]
    parts.append(result_rows(materialized(told_by_rules(e, fold, length)), e, fold, "rules", data_root))
    return reduce(DataFrame.unionByName, parts)
