"""Selection: filters by list and pattern, top-k, splits, samples, catalogues and text parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.runtime import materialized


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes")


def without_comments(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of a list file: what stands before ``#``, trimmed; empty lines go."""
    return lines.select(F.trim(F.substring_index(column, "#", 1)).alias(column)).where(F.length(column) > 0)


def excluded(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti")


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def bead_index(key: Column) -> Column:
    """0-based index of a label key like ``Bead_7_z``; null for other keys."""
    digits = F.regexp_extract(key, r"^Bead_(\d+)_z$", 1)
    return F.when(digits != "", digits.cast("int") - 1)


def is_test_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: (p == "test") | p.startswith("test_"))


def source_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def experiment_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/ ", "__")


def truth_of(name: Column, scheme: str) -> Column:
    """Class of a column name by its prefix, under a scheme."""
    if scheme == "coilable_uncoilable_bad":
        return F.when(name.startswith("gc_"), 1).when(name.startswith("uc_"), 0).otherwise(2)
    good = "gc_" if scheme == "coilable_uncoilable" else "gb_"
    return F.when(name.startswith(good), 1).otherwise(0)


def labelled(df: DataFrame, scheme: str, name: str = "name") -> DataFrame:
    prefixes = {"coilable_uncoilable_bad": ("gc_", "uc_", "bb_"), "coilable_uncoilable": ("gc_", "uc_")}.get(scheme, ("gb_", "bb_"))
    return df.where(F.col(name).rlike("^(" + "|".join(prefixes) + ")"))


def default_class(scheme: str) -> int:
    return 2 if scheme == "coilable_uncoilable_bad" else 0


def decimals3(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "").otherwise(F.format_string("%.3f", x))


def first_by(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("__rn = 1").drop("__rn")


def far_from_median(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k rows farthest from the median."""
    m = df.agg(F.median(value).alias("__m"))
    return df.join(F.broadcast(m)).withColumn("gap", F.abs(F.col(value) - F.col("__m"))).orderBy(F.col("gap").desc(), *ties).limit(k).drop("__m")


def best_row(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """The row of the greatest score; NaN and NULL count as -1."""
    s = F.coalesce(F.nanvl(F.col(score), F.lit(-1.0)), F.lit(-1.0))
    return df.orderBy(s.desc(), *ties).limit(1)


def hashed(*columns: str, seed: int = 42) -> Column:
    """A draw in 0..1 that depends on the row's columns and a seed only, not on its partition: 52 bits of an MD5."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def least_drawn(df: DataFrame, n: int, *ids: str, seed: int = 42, bins: int = 4096) -> DataFrame:
    """Exactly n rows (or all, if fewer): those of least draws, ties by id, so that draws of more rows hold those of fewer.

    Counts of equal ranges of draws tell in which one the n-th lies; only its rows are put in order.
    """
    drawn = df.withColumn("__u", hashed(*ids, seed=seed)).withColumn("__bin", F.floor(F.col("__u") * bins).cast("int"))
    taken = 0
    for r in sorted(drawn.groupBy("__bin").count().collect(), key=lambda r: r["__bin"]):
        if taken + r["count"] > n:
            edge = drawn.where(F.col("__bin") == r["__bin"]).orderBy("__u", *ids).limit(max(n - taken, 0))
            return drawn.where(F.col("__bin") < r["__bin"]).unionByName(edge).select(df.columns)
        taken += r["count"]
    return df


def numbered(df: DataFrame, *order: str, number: str = "__i") -> DataFrame:
    """``df`` with row numbers from 0 in ``order``: ranges are numbered on their own and offset by the rows before them."""
    columns = [F.col(c) for c in order]
    dealt = materialized(df.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id()))
    counts = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    starts, at = [], 0
    for k, n in counts:
        starts.append((k, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    within = F.row_number().over(W.partitionBy("__range").orderBy(*columns)) - 1
    return dealt.withColumn("__within", within).join(F.broadcast(offsets), "__range").withColumn(number, F.col("__start") + F.col("__within")).drop("__range", "__within", "__start")


def split_groups(df: DataFrame, group: str, train_frac: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: whole groups go to train or test; both get one if there are two. One narrow row a group is put in order."""
    groups = df.select(group).distinct()
    ranked = groups.withColumn("__k", F.row_number().over(W.orderBy(hashed(group, seed=seed), group))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy()))
    wanted = F.greatest(F.lit(1), F.least(F.round(train_frac * F.col("__n")).cast("int"), F.greatest(F.col("__n") - 1, F.lit(1))))
    folds = ranked.withColumn("fold", F.when(F.col("__k") <= wanted, "train").otherwise("test")).select(group, "fold")
    return df.join(folds, group)


def majority_source(df: DataFrame, source: str, order: str) -> DataFrame:
    """The commonest source, ties to the one seen first."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return per.agg(F.max_by(source, F.struct(F.col("n"), -F.col("first"))).alias(source))


def stratified(df: DataFrame, label: str, test_frac: float, *ids: str, seed: int = 42, bins: int = 4096) -> DataFrame:
    """``df`` with ``fold``: the same share of each class, exactly, is held out: its rows of least draws.

    Draws are dealt into bins. Counts a bin tell in which one a class's share ends; only the rows
    of that bin are put in order, so a class of any size never meets in one task.
    """
    drawn = df.withColumn("__u", hashed(*ids, seed=seed)).withColumn("__bin", F.floor(F.col("__u") * bins).cast("int"))
    counts = drawn.groupBy(F.col(label).alias("__class"), F.col("__bin").alias("__b")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(W.partitionBy("__class").orderBy("__b"))
    wanted = F.round(test_frac * F.sum("k").over(W.partitionBy("__class")))
    ends = counts.withColumn("upto", upto).withColumn("wanted", wanted).where("upto > wanted").groupBy("__class").agg(F.min_by(F.struct("__b", (F.col("wanted") - (F.col("upto") - F.col("k"))).alias("left")), "__b").alias("end"))
    met = drawn.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("__class")), "left")
    last = F.col("__bin") == F.col("end.__b")
    edge = met.where(last).withColumn("__k", F.row_number().over(W.partitionBy(label).orderBy("__u", *ids)))
    test = F.when(F.col("end").isNull() | (F.col("__bin") < F.col("end.__b")), "test").otherwise("train")
    out = [*df.columns, "fold"]
    rest = met.where(~F.coalesce(last, F.lit(False))).withColumn("fold", test).select(*out)
    return rest.unionByName(edge.withColumn("fold", F.when(F.col("__k") <= F.col("end.left"), "test").otherwise("train")).select(*out))


def capped(df: DataFrame, group: list[str], k: int, *ids: str, seed: int = 42) -> DataFrame:
    """At most k rows of each group, drawn by hash; tasks drop all but their k least before rows move."""
    w = W.partitionBy(*group).orderBy(hashed(*ids, seed=seed), *ids)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def bootstrapped(df: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """n rows drawn with replacement: (draw, ...)."""
    spark = df.sparkSession
    rows = numbered(df, order)
    size = rows.count()
    draws = spark.range(n).select(F.col("id").alias("draw"), F.floor(hashed("id", seed=seed) * size).cast("long").alias("__i"))
    return draws.join(rows, "__i").drop("__i")


def folder_flags(listing: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """What each folder holds, from a listing of its files."""
    has = lambda *names: F.bool_or(F.col(name).isin(*names))
    agg = listing.groupBy(folder).agg(
        has("traces.npy").alias("traces"), has("beadpos_xy.txt").alias("positions"), has("magnet-script.txt", "Experiment_script.txt", "config.yaml").alias("script_or_config")
    )
    return agg.withColumn("traces_positions", F.col("traces") & F.col("positions")).withColumn("positions_only", F.col("positions") & ~F.col("traces"))


def overlaid(base: Column, changes: Column) -> Column:
    """Map ``base`` with the entries of ``changes`` put over it."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(changes), k)), changes)


def unknown_keys(m: Column, known: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(F.array(*[F.lit(x) for x in known]), k))
