"""Whole experiments from a data root: samples, scripts, settings and labels as one set of tables.

An experiment is a folder; ``exp_id`` is its path. Every file kind is one scan over all
experiments, so a root with thousands of folders is a handful of Spark jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import align, curves
from seqloom.sources import npy, ranges, text


@dataclass(frozen=True)
class Experiments:
    """samples (exp_id, bead, frame, t, z), script (exp_id, seq, ...), beads (exp_id, bead, is_good)."""

    samples: DataFrame
    script: DataFrame
    beads: DataFrame


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", "/"), r"/[^/]*$", "")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("exp_id", folder_of(F.col("path"))).drop("path")


def scripts(spark: SparkSession, root: str) -> DataFrame:
    """Script rows of all experiments: five-column files, else command files."""
    rows = text.read_interval_lines(_keyed(text.lines(spark, root, name="magnet-script.txt")), ["exp_id"])
    table = align.parse_interval_script(rows, ["exp_id"])
    raw = _keyed(text.lines(spark, root, name="Experiment_script.txt"))
    joined = raw.groupBy("exp_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), ";").alias("text"))
    return align.preferred(table, align.parse_command_script(joined, ["exp_id"]).select(table.columns), ["exp_id"])


def good_beads(spark: SparkSession, root: str, beads: DataFrame, good_folder: str = "good") -> DataFrame:
    """``beads`` (exp_id, bead) with is_good: whether a bead's position is in the folder of good ones below; without one all are good."""
    lines = text.lines(spark, root, name="beadpos_xy.txt")
    at = text.read_positions(_keyed(lines).withColumn("line", F.col("line")), ["exp_id", "line"]).withColumn("bead", (F.row_number().over(W.partitionBy("exp_id").orderBy("line")) - 1).cast("int"))
    inside = F.col("exp_id").endswith(f"/{good_folder}")
    good = at.where(inside).withColumn("exp_id", F.regexp_replace("exp_id", f"/{good_folder}$", ""))
    marked = align.matched_positions(at.where(~inside).select("exp_id", "bead", "x", "y"), good, ["exp_id"]).select("exp_id", "bead", "is_good")
    has = good.select("exp_id").distinct().withColumn("has", F.lit(True))
    out = beads.join(marked, ["exp_id", "bead"], "left").join(has, "exp_id", "left")
    return out.select("exp_id", "bead", F.when(F.col("has"), F.coalesce("is_good", F.lit(False))).otherwise(True).alias("is_good"))


def load_blocks(spark: SparkSession, root: str, permissive: bool = True) -> Experiments:
    """Experiments stored as block files with settings beside them."""
    read = ranges.read_blocks if ranges.can_open(root) else npy.read_blocks
    raw = _keyed(read(spark, root, permissive=permissive))
    values = text.read_settings(_keyed(text.lines(spark, root, name="config.yaml")), ["exp_id"])
    known = raw.select("exp_id").distinct().join(values, "exp_id", "left").withColumn("values", F.coalesce("values", F.create_map().cast("map<string,string>")))
    samples = text.normalised_samples(raw, text.settings(known))
    return Experiments(samples, scripts(spark, root), good_beads(spark, root, samples.select("exp_id", "bead").distinct()))


def load_text(spark: SparkSession, root: str) -> Experiments:
    """Experiments stored as sample files; frames are numbered by time."""
    rows = text.read_samples(_keyed(text.lines(spark, root, numbered=False, name="Experiment.txt")), ["exp_id"])
    frame = F.row_number().over(W.partitionBy("exp_id", "bead").orderBy("t")) - 1
    samples = rows.select("exp_id", "bead", frame.alias("frame"), "t", F.coalesce("z", F.lit(float("nan"))).alias("z"))
    return Experiments(samples, scripts(spark, root), samples.select("exp_id", "bead").distinct().withColumn("is_good", F.lit(True)))


def region_curves(e: Experiments, kind: str = "force", **options) -> DataFrame:
    """(exp_id, region_id, bead, frame, x, f) of all regions: extension and force, or with ``kind`` rotation (rot, z) besides."""
    rows = align.extensions(e.samples, e.script, ["exp_id"], kind, within=["exp_id", "bead"], **options)
    return rows.select("exp_id", "region_id", "bead", "frame", F.col("z").alias("x"), F.col("force").alias("f"), F.col("mag_rot").alias("rot"), "z")


def region_energies(e: Experiments, **options) -> DataFrame:
    """Total energy of every bead in every region, with its label."""
    keys = ["exp_id", "region_id", "bead"]
    return curves.energy_totals(region_curves(e, **options).select(*keys, "frame", "x", "f"), keys).join(e.beads, ["exp_id", "bead"], "left")
