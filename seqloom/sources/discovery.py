"""Experiment catalogues from a listing of files: (path) relative to a data root, one row a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.select import excluded, experiment_of, folder_flags, is_test_path, source_of

#: File names of the layouts.
TRACES, POSITIONS, SCRIPTS, CONFIG = "traces.npy", "beadpos_xy.txt", ("magnet-script.txt", "Experiment_script.txt"), "config.yaml"
SAMPLES, CURATED = "Experiment.txt", ("Experiment_goodbeads.txt",)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below a root, by Spark's own file reader (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    base = root.rstrip("/").split("://")[-1]
    return files.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^/*{base.lstrip('/')}/", ""))


def folders(files: DataFrame) -> DataFrame:
    """``files`` with folder, name, depth and parent."""
    parts = F.split("path", "/")
    f = files.withColumn("name", F.element_at(parts, -1)).withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    up = F.split("folder", "/")
    return f.withColumn("depth", F.size(up)).withColumn("parent", F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - 1, F.lit(0))), "/"))


def experiment_folders(files: DataFrame, max_depth: int = 4) -> DataFrame:
    """Folders that hold traces, down to a depth, outside test folders: (folder, experiment_id, source), sorted."""
    f = folders(files).where((F.col("name") == TRACES) & (F.col("depth") <= max_depth) & ~is_test_path(F.col("folder")))
    return f.select("folder", experiment_of(F.col("folder")).alias("experiment_id"), source_of(F.col("folder")).alias("source")).distinct().orderBy("folder")


def best_label_files(files: DataFrame) -> DataFrame:
    """(folder, path, rank) of label files, the preferred first: original before filtered, then the shallower."""
    f = folders(files).where(F.col("name").rlike(r"\.(parquet|csv|pickle|pkl)$") & F.lower("name").contains("label"))
    order = [(~F.col("path").contains("original_prepost")).cast("int"), F.lower("name").contains("filtered").cast("int"), F.col("depth"), F.col("path")]
    return f.withColumn("rank", F.row_number().over(W.partitionBy("folder").orderBy(*order))).select("folder", "path", "rank")


def paired_folders(files: DataFrame, counts: DataFrame, pairs: int = 2) -> DataFrame:
    """Roots with exactly ``pairs`` children that hold traces and positions; the child of more beads is number 0.

    ``counts`` is (folder, n): positions in each folder.
    """
    flags = folder_flags(folders(files)).where("traces_positions").select("folder")
    parts = F.split("folder", "/")
    child = flags.withColumn("root", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).join(counts, "folder", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sized = child.withColumn("children", F.count(F.lit(1)).over(W.partitionBy("root"))).where(F.col("children") == pairs)
    return sized.select("root", "folder", (F.row_number().over(W.partitionBy("root").orderBy(F.col("n").desc(), "folder")) - 1).alias("number"), "n")


def layouts(files: DataFrame) -> DataFrame:
    """(folder, layout): which of the known layouts a folder has, the first that fits."""
    f = folders(files)
    own = folder_flags(f)
    children = own.withColumn("p", F.split("folder", "/")).withColumn("root", F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/"))
    kids = children.groupBy(F.col("root").alias("folder")).agg(F.count_if("traces_positions").alias("full"), F.count_if("traces").alias("with_traces"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("traces") | F.col("positions")).alias("some"))
    both = own.join(kids, "folder", "full_outer").na.fill(False, ["traces", "positions", "traces_positions", "positions_only"]).na.fill(0)
    text = f.where(F.col("name") == SAMPLES).select("folder", F.lit(True).alias("text")).distinct()
    both = both.join(text, "folder", "left")
    name = (
        F.when(F.col("full") == 2, "two_full_children")
        .when((F.col("all") == 2) & (F.col("with_traces") >= 1) & (F.col("some") == 2), "all_and_good_children")
        .when(F.col("traces_positions") & (F.col("full") == 1), "root_and_one_child")
        .when(F.col("positions_only") & (F.col("full") == 1), "positions_and_one_child")
        .when(F.col("traces_positions"), "single")
        .when(F.col("text"), "text")
    )
    return both.select("folder", name.alias("layout")).where("layout is not null")


def catalogue(files: DataFrame, max_depth: int = 6) -> DataFrame:
    """(folder, layout, experiment_id, source): roots of experiments; folders below one that fits are part of it."""
    found = layouts(files).withColumn("depth", F.size(F.split("folder", "/"))).where(F.col("depth") <= max_depth)
    # a folder's proper ancestors by name: one small array per folder, joined by equality
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inside = found.select("folder", F.explode(above).alias("up")).where("up <> folder").join(found.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    roots = found.join(inside, "folder", "left_anti")
    return roots.select("folder", "layout", experiment_of(F.col("folder")).alias("experiment_id"), source_of(F.col("folder")).alias("source")).orderBy("folder")


def manifest(files: DataFrame, shapes: DataFrame, labels: DataFrame, sources: list[str] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(path, experiment_id, source, size_mb, n_frames, n_beads, has_labels, has_both_classes) of all trace folders.

    ``shapes`` is (folder, frames, beads), ``labels`` (experiment_id, is_good) with one row a labelled bead.
    """
    f = folders(files).where(F.col("name") == TRACES)
    rows = f.select(F.col("folder").alias("path"), experiment_of(F.col("folder")).alias("experiment_id"), source_of(F.col("folder")).alias("source"), F.round(F.col("size") / 1048576.0, 2).alias("size_mb"))
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    if exclude is not None:
        rows = excluded(rows, exclude, "experiment_id")
    classes = labels.groupBy("experiment_id").agg((F.bool_or("is_good") & F.bool_or(~F.col("is_good"))).alias("both"), F.lit(True).alias("any"))
    out = rows.join(shapes.select(F.col("folder").alias("path"), F.col("frames").alias("n_frames"), F.col("beads").alias("n_beads")), "path", "left").join(classes, "experiment_id", "left")
    return out.withColumn("has_labels", F.coalesce("any", F.lit(False))).withColumn("has_both_classes", F.coalesce("both", F.lit(False))).drop("any", "both").orderBy("path")
