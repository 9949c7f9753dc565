"""Force curves: cumulative energy, percentile curves, outlier rules and feature representations.

Input rows are ``(keys..., frame, x, f)``: extension and force of one bead in one region. Window
steps run in the JVM; only ``interp`` on arbitrary abscissas is an Arrow function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.arrays import even_subsample, finite, fitted, missing_to_null, normalised, resampled, slopes

UP_TO_HERE = (W.unboundedPreceding, W.currentRow)


def known(df: DataFrame) -> DataFrame:
    return df.where(missing_to_null(F.col("x")).isNotNull() & missing_to_null(F.col("f")).isNotNull())


def energy_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``e``: the running trapezoid integral of force over extension, in order of extension, then frame."""
    w = W.partitionBy(*keys).orderBy("x", "frame")
    dx = F.col("x") - F.lag("x").over(w)
    area = F.when(dx != 0, 0.5 * (F.col("f") + F.lag("f").over(w)) * dx).otherwise(F.lit(0.0))
    stepped = known(df).withColumn("rn", F.row_number().over(w).cast("long") - 1).withColumn("area", F.coalesce(area, F.lit(0.0)))
    return stepped.withColumn("e", F.sum("area").over(w.rowsBetween(*UP_TO_HERE))).drop("area")


def energy_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total and greatest energy of each curve with at least two points."""
    return energy_curve(df, keys).groupBy(*keys).agg(F.max_by("e", "rn").alias("total_energy"), F.max("e").alias("max_energy"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def energy_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    """Curves as arrays (x, e, f) in order of extension; fewer than two points give no row."""
    packed = F.array_sort(F.collect_list(F.struct("rn", "x", "e", "f")))
    return energy_curve(df, keys).groupBy(*keys).agg(packed.alias("p")).where(F.size("p") >= 2).select(*keys, *[F.col(f"p.{c}").alias(c) for c in "xef"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def interp(grid: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Values at the grid's points; NaN outside the abscissas' range."""
    return pd.Series([np.interp(g, a, b, left=np.nan, right=np.nan) if len(a) else np.full(len(g), np.nan) for g, a, b in zip(grid, x, y, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def interp_clamped(grid: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Values at the grid's points; the end values outside the abscissas' range."""
    return pd.Series([np.interp(g, a, b) if len(a) else np.full(len(g), np.nan) for g, a, b in zip(grid, x, y, strict=True)])


def grid_between(low: Column, high: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(float(max(n - 1, 1))))


def range_outliers(df: DataFrame, group: list[str], bead: str, z_thresh: float = 3.0) -> DataFrame:
    """(group, bead, lo, hi, range, good): whether a bead's range lies within z sample deviations of the group's mean range."""
    x = missing_to_null(F.col("x"))
    ranges = df.groupBy(*group, bead).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("range", F.col("hi") - F.col("lo"))
    whole = W.partitionBy(*group)
    mean, spread = F.avg("range").over(whole), F.stddev_samp("range").over(whole)
    spread = F.when((spread == 0) | spread.isNull() | F.isnan(spread), F.lit(1.0)).otherwise(spread)
    good = F.coalesce(F.col("range").between(mean - z_thresh * spread, mean + z_thresh * spread), F.lit(False))
    return ranges.withColumn("good", good)


def energy_matrix(df: DataFrame, group: list[str], bead: str, n_grid: int = 200, z_thresh: float = 3.0, union: bool = False, drop_outliers: bool = True, mads: float = 2.5) -> DataFrame:
    """(group, bead, grid, e): energies on one grid per group, without beads of odd range or energy.

    The grid spans the common range of the beads' extensions (or the whole one with ``union``; the mean bounds if there is none).
    """
    keys = [*group, bead]
    ranges = range_outliers(df, group, bead, z_thresh)
    tried = ranges.where("good") if drop_outliers else ranges
    low, high = (F.min("lo"), F.max("hi")) if union else (F.max("lo"), F.min("hi"))
    bounds = tried.groupBy(*group).agg(low.alias("g0"), high.alias("g1"), F.avg("lo").alias("m0"), F.avg("hi").alias("m1"))
    none = ~(F.col("g0") < F.col("g1"))
    grids = bounds.select(*group, grid_between(F.when(none, F.col("m0")).otherwise(F.col("g0")), F.when(none, F.col("m1")).otherwise(F.col("g1")), n_grid).alias("grid"))
    curves = energy_arrays(df, keys).join(tried.select(*keys), keys, "left_semi").join(grids, group)
    rows = curves.withColumn("e", interp("grid", "x", "e")).select(*keys, "grid", "e").where(F.exists("e", lambda v: ~F.isnan(v)))
    return energy_filtered(rows, group, mads)


def energy_filtered(rows: DataFrame, group: list[str], mads: float = 2.5) -> DataFrame:
    """Curves whose greatest value and range lie within ``mads`` raw median deviations of the group's medians."""
    values = F.filter("e", lambda v: ~F.isnan(v))
    rows = rows.withColumn("top", F.array_max(values)).withColumn("span", F.array_max(values) - F.array_min(values))
    whole = W.partitionBy(*group)
    for c in ("top", "span"):
        rows = rows.withColumn(f"{c}_med", F.median(c).over(whole)).withColumn(f"{c}_dev", F.abs(F.col(c) - F.col(f"{c}_med")))
        mad, std = F.median(f"{c}_dev").over(whole), F.stddev_pop(c).over(whole)
        rows = rows.withColumn(f"{c}_mad", F.when(mad > 0, mad).when(std > 0, std).otherwise(F.lit(1.0)))
    ok = lambda c: F.col(c).between(F.col(f"{c}_med") - mads * F.col(f"{c}_mad"), F.col(f"{c}_med") + mads * F.col(f"{c}_mad"))
    kept = rows.where(ok("top") & ok("span"))
    return kept.drop(*[f"{c}{s}" for c in ("top", "span") for s in ("", "_med", "_dev", "_mad")])


def energy_percentiles(df: DataFrame, keys: list[str], n_grid: int = 200) -> DataFrame:
    """Energy at even percentiles of a curve's points."""
    return energy_arrays(df, keys).select(*keys, resampled(F.col("e"), n_grid).alias("v"))


def force_percentiles(df: DataFrame, keys: list[str], n_grid: int = 200) -> DataFrame:
    """Force at even percentiles of a curve's points, in order of extension; only finite points count."""
    ok = df.where(finite(F.col("x")) & finite(F.col("f")))
    packed = F.array_sort(F.collect_list(F.struct("x", "frame", "f")))
    return ok.groupBy(*keys).agg(packed.alias("p")).where(F.size("p") >= 2).select(*keys, resampled(F.col("p.f"), n_grid).alias("v"))


def sorted_by_force(df: DataFrame, keys: list[str]) -> DataFrame:
    """Extensions in order of force; a curve needs two finite points and half of its points finite."""
    packed = F.array_sort(F.collect_list(F.struct("f", "frame", F.coalesce("x", F.lit(float("nan"))).alias("x"))))
    rows = df.groupBy(*keys).agg(packed.alias("p"), F.count_if(finite(F.col("x"))).alias("good"), F.count(F.lit(1)).alias("n"))
    return rows.where((F.col("good") >= 2) & (F.col("good") >= 0.5 * F.col("n"))).select(*keys, F.col("p.x").alias("v"))


def arc_length_percentiles(df: DataFrame, keys: list[str], n_grid: int = 200, y: str = "e") -> DataFrame:
    """Values at even shares of the curve's length in its plane."""
    w = W.partitionBy(*keys).orderBy("rn")
    steps = energy_curve(df, keys)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col(y) - F.lag(y).over(w)
    steps = steps.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    steps = steps.withColumn("s", F.sum("step").over(w.rowsBetween(*UP_TO_HERE)))
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "s", F.col(y).alias("y")))).alias("p"), F.max("s").alias("whole")).where((F.size("p") >= 2) & (F.col("whole") > 0))
    share = F.transform(F.col("p.s"), lambda s: 100.0 * (s / F.col("whole")))
    return rows.select(*keys, share.alias("s"), F.col("p.y").alias("y"), grid_between(F.lit(0.0), F.lit(100.0), n_grid).alias("grid")).select(*keys, interp("grid", "s", "y").alias("v"))


def landmarks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Extension at quartiles of the energy range and force at quartiles of the extension range."""
    quartiles = lambda lo, hi: F.array(*[lo + q * (hi - lo) for q in (0.25, 0.5, 0.75)])
    rows = energy_arrays(df, keys).withColumn("e0", F.array_min("e")).withColumn("e1", F.array_max("e")).withColumn("x0", F.array_min("x")).withColumn("x1", F.array_max("x"))
    rows = rows.where((F.col("e1") > F.col("e0")) & (F.col("x1") > F.col("x0")))
    rows = rows.withColumn("a", interp_clamped(quartiles(F.col("e0"), F.col("e1")), "e", "x")).withColumn("b", interp_clamped(quartiles(F.col("x0"), F.col("x1")), "x", "f"))
    return rows.select(*keys, F.concat("a", "b").alias("v"))


def unpartitioned(df: DataFrame, keys: list[str], n_grid: int = 200) -> DataFrame:
    """Energies as they are, NaN-padded or resampled to the longest curve, at most ``n_grid``."""
    rows = energy_arrays(df, keys)
    longest = rows.agg(F.least(F.max(F.size("e")), F.lit(n_grid)).alias("m"))
    out = rows.join(F.broadcast(longest))
    m = F.col("m")
    short = F.concat("e", F.array_repeat(F.lit(float("nan")), F.greatest(m - F.size("e"), F.lit(0))))
    position = lambda i: i * (F.size("e") - 1).cast("double") / F.greatest(m - 1, F.lit(1)).cast("double")
    from seqloom.functions.arrays import at_position

    long = F.transform(F.sequence(F.lit(0), m - 1), lambda i: at_position(F.col("e"), position(i)))
    return out.select(*keys, F.when(F.size("e") <= m, short).otherwise(long).alias("v"))


def _with(v, fn):
    return v.withColumn("v", fn(F.col("v")))


#: Representations by name: (rows, keys, n_grid) to one array ``v`` per bead.
REPRESENTATIONS = {
    "percentile_grid": energy_percentiles,
    "percentile_grid_normalised": lambda d, k, n=200: _with(energy_percentiles(d, k, n), normalised),
    "energy_slope_percentile": lambda d, k, n=200: _with(energy_percentiles(d, k, n), lambda v: slopes(v, 100.0 / (n - 1))),
    "force_percentile_grid": force_percentiles,
    "force_percentile_normalised": lambda d, k, n=200: _with(force_percentiles(d, k, n), normalised),
    "force_slope_percentile": lambda d, k, n=200: _with(force_percentiles(d, k, n), lambda v: slopes(v, 100.0 / (n - 1))),
    "raw_extension_sorted_by_force": lambda d, k, n=200: sorted_by_force(d, k),
    "raw_extension_sorted_by_force_normalised": lambda d, k, n=200: _with(sorted_by_force(d, k), normalised),
    "raw_extension_sorted_by_force_subsampled": lambda d, k, n=200: _with(sorted_by_force(d, k), lambda v: even_subsample(v, n)),
    "arc_length_percentile": arc_length_percentiles,
    "landmark_quartiles": lambda d, k, n=200: landmarks(d, k),
    "no_partition": unpartitioned,
    "common_grid_intersection": lambda d, k, n=200, **o: energy_matrix(d, k[:-1], k[-1], n, **o).select(*k, F.col("e").alias("v")),
    "common_grid_union": lambda d, k, n=200, **o: energy_matrix(d, k[:-1], k[-1], n, **o).select(*k, F.col("e").alias("v")),
}
#: Those that leave out beads of odd range, and take ``z_thresh`` and ``union``.
ON_COMMON_GRID = ("common_grid_intersection", "common_grid_union")


def represented(df: DataFrame, keys: list[str], name: str, n_grid: int = 200, **options) -> DataFrame:
    """(keys, v) under a named representation; ``options`` are for those on a common grid."""
    if name not in REPRESENTATIONS:
        raise ValueError(f"unknown representation: {name}")
    return REPRESENTATIONS[name](df, keys, n_grid, **(options if name in ON_COMMON_GRID else {}))


# rotation: rows are (keys..., frame, rot, z)


def rotation_on_time(df: DataFrame, keys: list[str], n_grid: int = 200) -> DataFrame:
    """z at even positions in time; half of them must be finite."""
    packed = F.array_sort(F.collect_list(F.struct("frame", F.coalesce("z", F.lit(float("nan"))).alias("z"))))
    rows = df.groupBy(*keys).agg(packed.alias("p")).select(*keys, even_subsample(F.col("p.z"), n_grid).alias("v"))
    good = F.size(F.filter("v", finite))
    return rows.where((F.size("v") > 0) & (good >= 0.5 * F.size("v")))


def rotation_curves(df: DataFrame, keys: list[str], n_grid: int = 200, margin: float = 0.05) -> DataFrame:
    """z on an even grid of rotations, interpolated over the samples in their own order, with which a curve must vary."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys) + ", v array<double>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        rot, z = pdf["rot"].to_numpy(float), pdf["z"].to_numpy(float)
        ok = np.isfinite(rot) & np.isfinite(z)
        out = pdf.iloc[:1][keys].copy()
        none = out.iloc[:0].assign(v=pd.Series([], dtype=object))
        if ok.sum() < 2:
            return none
        lo, hi = float(np.nanmin(rot)), float(np.nanmax(rot))
        lo, hi = lo - margin * (hi - lo), hi + margin * (hi - lo)
        v = np.interp(np.linspace(lo, hi if hi > lo else lo + 1e-9, n_grid), rot[ok], z[ok])
        return out.assign(v=[v]) if np.nanstd(v) >= 1e-12 else none

    return df.groupBy(*keys).applyInPandas(one, schema)


def rotation_percentiles(df: DataFrame, keys: list[str], n_grid: int = 200) -> DataFrame:
    """z at even percentiles of its samples in order of rotation."""
    ok = df.where(finite(F.col("rot")) & finite(F.col("z")))
    packed = F.array_sort(F.collect_list(F.struct("rot", "frame", "z")))
    return ok.groupBy(*keys).agg(packed.alias("p")).where(F.size("p") >= 2).select(*keys, resampled(F.col("p.z"), n_grid).alias("v"))


def rotation_landmarks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rotation and z at the quartiles of the samples in order of rotation."""
    ok = df.where(finite(F.col("rot")) & finite(F.col("z")))
    packed = F.array_sort(F.collect_list(F.struct("rot", "frame", "z")))
    rows = ok.groupBy(*keys).agg(packed.alias("p")).where(F.size("p") >= 2)
    from seqloom.functions.arrays import at_position

    n = F.size("p") - 1
    pick = lambda c: F.array(*[at_position(F.col(f"p.{c}"), q * n) for q in (0.25, 0.5, 0.75)])
    return rows.select(*keys, F.concat(pick("rot"), pick("z")).alias("v"))


def rotation_arc_length(df: DataFrame, keys: list[str], n_grid: int = 200) -> DataFrame:
    """z at even shares of the curve's length in the plane of rotation and z."""
    w = W.partitionBy(*keys).orderBy("rot", "frame")
    ok = df.where(finite(F.col("rot")) & finite(F.col("z")))
    dx, dy = F.col("rot") - F.lag("rot").over(w), F.col("z") - F.lag("z").over(w)
    steps = ok.withColumn("rn", F.row_number().over(w)).withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    steps = steps.withColumn("s", F.sum("step").over(w.rowsBetween(*UP_TO_HERE)))
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "s", "z"))).alias("p"), F.max("s").alias("whole")).where((F.size("p") >= 2) & (F.col("whole") > 0))
    share = F.transform(F.col("p.s"), lambda s: 100.0 * (s / F.col("whole")))
    return rows.select(*keys, share.alias("s"), F.col("p.z").alias("y"), grid_between(F.lit(0.0), F.lit(100.0), n_grid).alias("grid")).select(*keys, interp("grid", "s", "y").alias("v"))


ROTATION_REPRESENTATIONS = {
    "rotation_grid": rotation_on_time,
    "common_grid_intersection": rotation_on_time,
    "common_grid_union": rotation_curves,
    "percentile_grid": rotation_percentiles,
    "arc_length_percentile": rotation_arc_length,
    "landmark_quartiles": lambda d, k, n=200: rotation_landmarks(d, k),
}


def rotation_represented(df: DataFrame, keys: list[str], name: str, n_grid: int = 200) -> DataFrame:
    """(keys, v); names that aren't known mean the rotation grid."""
    return ROTATION_REPRESENTATIONS.get(name, rotation_on_time)(df, keys, n_grid)


def gradient_activity(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, n, activity): deviation of dz/drot on each side of no rotation, by second-order differences."""
    w = W.partitionBy(*keys, "side").orderBy("frame")
    h1, h2 = F.col("rot") - F.lag("rot").over(w), F.lead("rot").over(w) - F.col("rot")
    d1, d2 = F.col("z") - F.lag("z").over(w), F.lead("z").over(w) - F.col("z")
    inner = F.try_divide(h1 * h1 * d2 + h2 * h2 * d1, h1 * h2 * (h1 + h2))
    grad = F.when(F.lag("rot").over(w).isNull(), F.try_divide(d2, h2)).when(F.lead("rot").over(w).isNull(), F.try_divide(d1, h1)).otherwise(inner)
    rows = df.withColumn("g", grad)
    return rows.groupBy(*keys, "side").agg(
        F.count(F.lit(1)).alias("n"), F.when((F.max("rot") - F.min("rot") >= 1e-12) & (F.count(F.lit(1)) >= 2), F.stddev_pop("g")).alias("activity")
    )


def rotation_labels(df: DataFrame, keys: list[str], thresh: float = 0.01, zero_tol: float = 1.0, least: int = 5) -> DataFrame:
    """(keys, label): 0 if neither side is active, 1 if one is, 2 if both are."""
    side = F.when(F.col("rot") > zero_tol, F.lit(1)).when(F.col("rot") < -zero_tol, F.lit(-1))
    sides = gradient_activity(df.withColumn("side", side).where("side is not null"), keys)
    active = (F.col("n") >= least) & (F.col("activity") >= thresh)
    counted = sides.groupBy(*keys).agg(F.count_if(F.coalesce(active, F.lit(False))).cast("int").alias("label"))
    return df.select(*keys).distinct().join(counted, keys, "left").withColumn("label", F.coalesce("label", F.lit(0)))


# column algebra on feature vectors (array column ``v``)


def positions(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(v).alias("pos", "x"))


def columns_filled(long: DataFrame, group: list[str], inf_in_mean: bool = False) -> DataFrame:
    """NaN (and infinite) entries of (group, pos, x) become the column's mean, 0 if it has none."""
    x = F.col("x")
    kept = F.when(~F.isnan(x), x) if inf_in_mean else F.when(finite(x), x)
    mean = F.coalesce(F.avg(kept).over(W.partitionBy(*group, "pos")), F.lit(0.0))
    return long.withColumn("x", F.when(finite(x), x).otherwise(mean))


def standardised(long: DataFrame, group: list[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1; constant ones are only centred."""
    w = W.partitionBy(*group, "pos")
    std = F.stddev_pop("x").over(w)
    return long.withColumn("x", (F.col("x") - F.avg("x").over(w)) / F.when(std > 0, std).otherwise(F.lit(1.0)))


def median_outliers(df: DataFrame, group: list[str], z: float | None, dist: str = "dist", label: str = "label") -> DataFrame:
    """Labels of rows beyond median + z * 1.4826 * MAD become -1; nothing changes if the MAD is 0 or ``z`` is None."""
    if z is None:
        return df
    w = W.partitionBy(*group)
    devs = df.withColumn("__m", F.median(dist).over(w)).withColumn("__d", F.abs(F.col(dist) - F.col("__m"))).withColumn("__mad", 1.4826 * F.median("__d").over(w))
    far = (F.col("__mad") > 0) & (F.col(dist) > F.col("__m") + z * F.col("__mad"))
    return devs.withColumn(label, F.when(far, F.lit(-1)).otherwise(F.col(label))).drop("__m", "__d", "__mad")


def small_clusters(df: DataFrame, group: list[str], least: int, label: str = "label") -> DataFrame:
    """Labels of clusters below ``least`` members become -1."""
    n = F.count(F.lit(1)).over(W.partitionBy(*group, label))
    return df.withColumn(label, F.when(n < least, F.lit(-1)).otherwise(F.col(label)))


def centroids(long: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """Mean of each column per label, outliers left out."""
    return long.where(F.col(label) >= 0).groupBy(*group, label, "pos").agg(F.avg("x").alias("x"))
