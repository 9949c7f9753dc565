"""Text sources: headerless sample files, curated bead files, positions, settings, label keys.

All read lines with Spark's text or CSV reader; tokens that aren't numbers become NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "-1.#IND000"


def lines(spark: SparkSession, path: str, numbered: bool = True, name: str | None = None) -> DataFrame:
    """(path, line, value) of text files, lines numbered in file order; with ``name``, of all files of that name below a folder.

    Numbering reads a file as one row. Large sample files are read with ``numbered=False``: they
    are split over tasks, ``line`` is null, and their time column gives the order.
    """
    below = {"recursiveFileLookup": True, "pathGlobFilter": name} if name else {}
    if numbered:
        raw = spark.read.text(path, wholetext=True, **below).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    else:
        raw = spark.read.text(path, **below).select(F.input_file_name().alias("path"), F.lit(None).cast("int").alias("line"), "value")
    return raw.where(F.length(F.trim("value")) > 0)


def tokens(df: DataFrame, value: str = "value"):
    return F.split(F.trim(F.col(value)), r"\s+")


def number(token):
    return F.when(token != MISSING, token).try_cast("double")


def read_samples(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, line, bead, t, x, y, z) of rows ``n time_ms x y z x y z ...``; the first column is dropped."""
    t = df.withColumn("tok", tokens(df, value))
    beads = F.floor((F.size("tok") - 2) / 3).cast("int")
    at = lambda i: number(F.get("tok", i))
    triplet = F.transform(
        F.when(beads > 0, F.sequence(F.lit(0), beads - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.struct(b.alias("bead"), at(2 + 3 * b).alias("x"), at(3 + 3 * b).alias("y"), at(4 + 3 * b).alias("z"))
    )
    rows = t.select(*keys, "line", (at(F.lit(1)) / 1000.0).alias("t"), F.explode(triplet).alias("b"))
    return rows.select(*keys, "line", "b.bead", "t", "b.x", "b.y", "b.z")


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """(t, name, bead, z) of a tab-separated file with a header: ``time(ms)`` and one column per bead."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    time, *beads = wide.columns
    wide = wide.select((number(F.col(f"`{time}`")) / 1000.0).alias("t"), *[number(F.col(f"`{c}`")).alias(c) for c in beads])
    out = wide.unpivot(["t"], beads, "name", "z")
    return out.withColumn("bead", F.regexp_extract("name", r"\d+", 0).try_cast("int") - 1)


def read_positions(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, x, y) of position lines; lines without two integers are skipped."""
    tok = tokens(df, value)
    return df.select(*keys, F.get(tok, F.lit(0)).try_cast("int").alias("x"), F.get(tok, F.lit(1)).try_cast("int").alias("y")).where("x is not null and y is not null")


def position_count(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Lines with two tokens or more."""
    return df.groupBy(*keys).agg(F.count_if(F.size(tokens(df, value)) >= 2).alias("n"))


def read_interval_lines(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, seq, dt, pos, speed, rot, rot_speed) of five-column script lines."""
    tok = tokens(df, value)
    names = ["dt", "pos", "speed", "rot", "rot_speed"]
    return df.where(F.size(tok) >= 5).select(*keys, F.col("line").alias("seq"), *[F.get(tok, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def settings(df: DataFrame, values: str = "values", framerate: float = 58.0, correction: float = 0.88, strict: bool = False) -> DataFrame:
    """``df`` with framerate, reference and correction from a map of strings; lists take their last element."""
    m = F.col(values)
    last = F.element_at(F.split(F.regexp_replace(F.element_at(m, "refIndices"), r"[\[\]\s]", ""), ","), -1)
    to = (lambda c, t: c.cast(t)) if strict else (lambda c, t: c.try_cast(t))
    return (
        df.withColumn("framerate", F.coalesce(to(F.element_at(m, "framerate"), "double"), F.lit(framerate)))
        .withColumn("reference", F.coalesce(to(last, "int"), F.lit(-1)))
        .withColumn("correction", F.coalesce(to(F.element_at(m, "zcorrection"), "double"), F.lit(correction)))
    )


def read_settings(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, values): flat ``key: value`` lines of settings files as a map of strings; nested levels and comments are left out."""
    m = df.select(*keys, "line", F.regexp_extract(value, r"^([A-Za-z_]\w*)\s*:", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z_]\w*\s*:", ""), r"\s+#.*$", "")).alias("v"))
    pairs = m.where("k <> ''").groupBy(*keys, "k").agg(F.max_by("v", "line").alias("v"))
    return pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))


def normalised_samples(samples: DataFrame, config: DataFrame, key: str = "exp_id", processed: bool = False, ref0_is_none: bool = True) -> DataFrame:
    """(key, bead, frame, t, z): block samples (key, frame, bead, axis, v) with nm to µm, the sign and factor of z, the reference bead and the frame rate applied.

    ``config`` has one row per key: framerate, reference (negative counts from the end), correction.
    """
    z = samples.where("axis = 2")
    # one narrow row an experiment: its settings and number of beads
    counts = z.groupBy(key).agg((F.max("bead") + 1).alias("n"))
    told = config.select(key, "framerate", "reference", "correction").join(counts, key)
    ref = F.when(F.col("reference") < 0, F.col("n") + F.col("reference")).otherwise(F.col("reference"))
    use = (~F.lit(ref0_is_none) | (F.col("reference") != 0)) & (ref < F.col("n"))
    z = z.join(told.select(key, "framerate", "correction", F.when(use, ref).alias("r")), key)
    z = z.withColumn("z", F.col("v") if processed else -F.col("correction") * F.col("v") / 1000.0)
    if not processed:
        # the reference bead is one trace an experiment, met frame by frame
        base = z.where("bead = r").groupBy(key, "frame").agg(F.max("z").alias("base"))
        z = z.join(base, [key, "frame"], "left").withColumn("z", F.col("z") - F.coalesce("base", F.lit(0.0)))
    return z.select(key, "bead", "frame", (F.col("frame") / F.col("framerate")).alias("t"), "z")
