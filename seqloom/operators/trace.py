"""Operators on traces in long form: (keys..., frame, t, z), one row per sample.

``keys`` name the columns that identify a trace. Missing samples are NaN or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.arrays import edge_padded, finite, let, missing_to_null, padded, resampled, segments
from seqloom.runtime import materialized

UP_TO_HERE = (W.unboundedPreceding, W.currentRow)
FROM_HERE = (W.currentRow, W.unboundedFollowing)
#: Factor on the bounds of rules: deviations of long traces are rounded by less, whatever the order of their sums.
ABOVE = 1 + 1e-12


def _ordered(keys: list[str], order: str = "frame"):
    return W.partitionBy(*keys).orderBy(order)


def word_lengths(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, frame, z): the lengths of a text's words as a trace; words stand between ASCII blanks. Texts without words have no rows."""
    return docs.select(*keys, F.posexplode(length_array(F.col(text))).alias("frame", "z"))


def length_array(text: Column) -> Column:
    """The trace of ``word_lengths`` as an array."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.length(w).cast("double"))


def filled(df: DataFrame, keys: list[str], z: str = "z", inf_to_mean: bool = False, inf_in_mean: bool = False) -> DataFrame:
    """NaN to the trace's mean over finite samples (0 if none); infinities to 0 or to the mean.

    ``inf_in_mean`` takes the mean over all samples that aren't NaN, infinities included.
    """
    x = F.col(z)
    kept = F.when(~F.isnan(x), x) if inf_in_mean else F.when(finite(x), x)
    mean = F.coalesce(F.avg(kept).over(W.partitionBy(*keys)), F.lit(0.0))
    is_inf = F.abs(x) == float("inf")
    return df.withColumn(z, F.when(x.isNull() | F.isnan(x), mean).when(is_inf, mean if inf_to_mean else F.lit(0.0)).otherwise(x))


def sanitised(x: Column) -> Column:
    """Feature values that aren't finite become 0."""
    return F.when(finite(x), x).otherwise(F.lit(0.0))


def with_steps(df: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Adds ``d``, the difference to the previous sample, and ``prev``."""
    w = _ordered(keys)
    return df.withColumn("prev", F.lag(z).over(w)).withColumn("d", F.col(z) - F.col("prev"))


def features4(df: DataFrame, keys: list[str]) -> DataFrame:
    """Variance, and deviation, maximum and median of the steps."""
    return _features(df, keys, 4)


def features8(df: DataFrame, keys: list[str]) -> DataFrame:
    """The four features with range, quartiles and lag-1 autocorrelation."""
    return _features(df, keys, 8)


def autocorrelation(least: int = 2) -> Column:
    """Correlation of samples with their predecessors over (z, prev); 0 where it isn't defined."""
    has = F.col("prev").isNotNull()
    z, p = F.when(has, F.col("z")), F.when(has, F.col("prev"))
    r = F.try_divide(F.covar_pop(z, p), F.stddev_pop(z) * F.stddev_pop(p))
    return F.when((F.count("z") >= least) & (F.stddev_pop("z") > 1e-12), F.coalesce(F.when(finite(r), r), F.lit(0.0))).otherwise(F.lit(0.0))


def _features(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    steps = with_steps(filled(df, keys), keys)
    a = F.abs("d")
    zero = F.lit(0.0)
    own = [F.var_pop("z").alias("variance"), F.coalesce(F.stddev_pop("d"), zero).alias("diff_std"), F.coalesce(F.max(a), zero).alias("max_abs_diff"), F.coalesce(F.median(a), zero).alias("median_abs_diff")]
    if n == 8:
        own += [(F.max("z") - F.min("z")).alias("ptp"), F.percentile("z", 0.25).alias("p25"), F.percentile("z", 0.75).alias("p75"), autocorrelation().alias("autocorr_lag1")]
    return steps.groupBy(*keys).agg(*own)


FEATURES12 = ["mean", "std", "ptp", "diff_std", "max_abs_diff", "median_abs_diff", "q01", "q99", "autocorr_lag1", "flat_fraction", "large_jump_fraction", "slope"]


def features12(df: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve named features; the step deviation comes from a window, so one shuffle serves all."""
    steps = with_steps(filled(df, keys, inf_to_mean=True), keys)
    whole = W.partitionBy(*keys)
    a, zero = F.abs("d"), F.lit(0.0)
    steps = steps.withColumn("ds", F.coalesce(F.stddev_pop("d").over(whole), zero)).withColumn("n", F.count("z").over(whole))
    x = F.col("frame0") / (F.col("n") - 1) - 0.5
    steps = steps.withColumn("frame0", (F.row_number().over(_ordered(keys)) - 1).cast("double")).withColumn("x", F.when(F.col("n") > 1, x))
    share = lambda cond: F.coalesce(F.avg(F.when(F.col("d").isNotNull(), cond.cast("double"))), zero)
    return steps.groupBy(*keys).agg(
        F.avg("z").alias("mean"),
        F.stddev_pop("z").alias("std"),
        (F.max("z") - F.min("z")).alias("ptp"),
        F.max("ds").alias("diff_std"),
        F.coalesce(F.max(a), zero).alias("max_abs_diff"),
        F.coalesce(F.median(a), zero).alias("median_abs_diff"),
        F.percentile("z", 0.01).alias("q01"),
        F.percentile("z", 0.99).alias("q99"),
        autocorrelation(3).alias("autocorr_lag1"),
        share(a < F.greatest(F.col("ds") * 0.02, F.lit(1e-12))).alias("flat_fraction"),
        share(a > F.greatest(F.col("ds") * 6.0, F.lit(1e-12))).alias("large_jump_fraction"),
        F.coalesce(F.regr_slope("z", "x"), zero).alias("slope"),
    )


def summarised(features: DataFrame, names: list[str]) -> DataFrame:
    """Mean, deviation, median and two quantiles of each feature."""
    long = features.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "v")
    return long.groupBy("feature").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.median("v").alias("median"), F.percentile("v", 0.05).alias("q05"), F.percentile("v", 0.95).alias("q95")
    )


def distances(long: DataFrame, group: list[str], side: str, value: str, first: str, second: str) -> DataFrame:
    """Two-sample KS statistic, Wasserstein-1 distance and medians of ``value`` between two sides.

    Equal values are summed first. Distinct values are dealt out in ranges; what lies before a
    range, and the value that follows it, come from one row a range, so no task holds all
    values of a group.
    """
    a, b = (F.col(side) == first).cast("long"), (F.col(side) == second).cast("long")
    counts = long.where(F.col(side).isin(first, second)).groupBy(*group, value).agg(F.sum(a).alias("na"), F.sum(b).alias("nb"))
    dealt = materialized(counts.repartitionByRange(*group, value).withColumn("__r", F.spark_partition_id()))
    parts = dealt.groupBy(*group, "__r").agg(F.sum("na").alias("ra"), F.sum("nb").alias("rb"), F.min(value).alias("low"))
    own = W.partitionBy(*group).orderBy("__r")
    before, whole = own.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    parts = parts.select(*group, "__r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("ra", "rb")], *[F.sum(c).over(whole).alias(f"t{c}") for c in ("ra", "rb")], F.lead("low").over(own).alias("next"))
    w = W.partitionBy(*group, "__r").orderBy(value)
    rows = dealt.join(parts, [*group, "__r"])
    cdf = lambda c, r: (F.col(f"b{r}") + F.sum(c).over(w.rowsBetween(*UP_TO_HERE))) / F.col(f"t{r}")
    steps = rows.withColumn("gap", F.abs(cdf("na", "ra") - cdf("nb", "rb"))).withColumn("width", F.coalesce(F.lead(value).over(w), "next") - F.col(value))
    shape = steps.groupBy(*group).agg(F.max("gap").alias("ks_stat"), F.sum(F.col("gap") * F.col("width")).alias("wasserstein"))
    medians = long.groupBy(*group).agg(
        F.median(F.when(F.col(side) == first, F.col(value))).alias("real_median"), F.median(F.when(F.col(side) == second, F.col(value))).alias("synthetic_median")
    )
    return shape.join(medians, group).withColumn("median_delta", F.col("synthetic_median") - F.col("real_median"))


def as_arrays(df: DataFrame, keys: list[str], *columns: str, order: str = "frame") -> DataFrame:
    """One row per trace with each column as an array in frame order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in columns if c != order])))
    return df.groupBy(*keys).agg(packed.alias("p")).select(*keys, *[F.col(f"p.{c}").alias(c) for c in columns])


def exploded(arrays: DataFrame, keys: list[str], column: str = "z", name: str = "v") -> DataFrame:
    """(keys, pos, v): long form of an array column."""
    return arrays.select(*keys, F.posexplode(column).alias("pos", name))


def resampled_traces(df: DataFrame, keys: list[str], length: int) -> DataFrame:
    return as_arrays(df, keys, "z").withColumn("z", resampled(F.col("z"), length))


def segmented(df: DataFrame, keys: list[str], length: int, stride: int | None = None) -> DataFrame:
    """(keys, segment, start, z): whole windows of ``length`` samples, every ``stride``."""
    rows = as_arrays(df, keys, "z").select(*keys, F.posexplode(segments(F.col("z"), length, stride or length)).alias("segment", "s"))
    return rows.select(*keys, "segment", F.col("s.start").alias("start"), F.col("s.values").alias("z"))


def gaps_interpolated(df: DataFrame, keys: list[str]) -> DataFrame:
    """NaN samples on the line through the known neighbours in time; beyond the ends, through the two nearest known ones.

    A single known sample fills the whole trace; without any, samples are 0.
    """
    known = F.struct("t", missing_to_null(F.col("z")).alias("z"))
    df = df.withColumn("k", F.when(~F.isnan("z") & F.col("z").isNotNull(), known))
    back, ahead = _ordered(keys).rowsBetween(*UP_TO_HERE), _ordered(keys).rowsBetween(*FROM_HERE)
    df = df.withColumn("a", F.last("k", True).over(back)).withColumn("b", F.first("k", True).over(ahead))
    # the two first and the two last known samples serve beyond the ends
    whole = W.partitionBy(*keys)
    order = F.row_number().over(W.partitionBy(*keys, F.col("k").isNull()).orderBy("frame"))
    df = df.withColumn("o", F.when(F.col("k").isNotNull(), order)).withColumn("m", F.count("k").over(whole))
    nth = lambda i: F.max(F.when(F.col("o") == i, F.col("k"))).over(whole)
    df = df.withColumn("f1", nth(F.lit(1))).withColumn("f2", nth(F.lit(2))).withColumn("l1", nth(F.col("m") - 1)).withColumn("l2", nth(F.col("m")))
    line = lambda p, q: F.col(f"{p}.z") + (F.col("t") - F.col(f"{p}.t")) * F.try_divide(F.col(f"{q}.z") - F.col(f"{p}.z"), F.col(f"{q}.t") - F.col(f"{p}.t"))
    value = (
        F.when(F.col("m") == 0, F.lit(0.0))
        .when(F.col("k").isNotNull(), F.col("k.z"))
        .when(F.col("m") == 1, F.col("f1.z"))
        .when(F.col("a").isNull(), line("f1", "f2"))
        .when(F.col("b").isNull(), line("l1", "l2"))
        .otherwise(line("a", "b"))
    )
    return df.withColumn("z", value).drop("k", "a", "b", "o", "m", "f1", "f2", "l1", "l2")


def carried(df: DataFrame, keys: list[str]) -> DataFrame:
    """NaN samples take the last known one, leading ones the next."""
    z = missing_to_null(F.col("z"))
    w = _ordered(keys)
    return df.withColumn("z", F.coalesce(F.last(z, True).over(w.rowsBetween(*UP_TO_HERE)), F.first(z, True).over(w.rowsBetween(*FROM_HERE))))


def padded_to_median(df: DataFrame, keys: list[str]) -> DataFrame:
    """All traces cut or edge-padded to the median length."""
    arrays = as_arrays(df, keys, "z")
    target = arrays.agg(F.floor(F.median(F.size("z"))).cast("int").alias("m"))
    return arrays.join(F.broadcast(target)).select(*keys, edge_padded(F.col("z"), F.col("m")).alias("z"))


def padded_to_longest(df: DataFrame, keys: list[str]) -> DataFrame:
    """All traces NaN-padded to the longest."""
    arrays = as_arrays(df, keys, "z")
    target = arrays.agg(F.max(F.size("z")).alias("m"))
    return arrays.join(F.broadcast(target)).select(*keys, padded(F.col("z"), F.col("m"), F.lit(float("nan"))).alias("z"))


def trimmed(arrays: DataFrame, z: str = "z", t: str = "t") -> DataFrame:
    """Padded rows cut to the shorter of the known samples of trace and time."""
    n = F.least(F.size(F.filter(z, lambda x: ~F.isnan(x))), F.size(F.filter(t, lambda x: ~F.isnan(x))))
    return arrays.withColumn(z, F.slice(z, F.lit(1), n)).withColumn(t, F.slice(t, F.lit(1), n))


def time_split(df: DataFrame, keys: list[str], duration: float, overlap: float = 0.0) -> DataFrame:
    """(keys, piece, frame, t, z): half-open stretches of ``duration`` seconds, time from each one's first sample.

    A trace shorter than the duration is one piece, whole. The last sample is never in a piece.
    """
    whole = W.partitionBy(*keys)
    step = duration - overlap
    df = df.withColumn("t0", F.min("t").over(whole)).withColumn("t1", F.max("t").over(whole))
    span = F.col("t1") - F.col("t0")
    short = span < duration
    n = F.when(short, F.lit(1)).otherwise(F.ceil((span - duration) / step).cast("int") + 1)
    rel = F.col("t") - F.col("t0")
    # only the pieces that can hold a sample are tried
    low = F.greatest(F.floor((rel - duration) / step).cast("int"), F.lit(0))
    high = F.least(F.floor(rel / step).cast("int") + 1, n - 1)
    tried = F.when(short, F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    cut = df.withColumn("piece", F.explode(tried))
    start = F.col("t0") + F.col("piece") * step
    inside = (F.col("t") >= start) & (F.col("t") < F.least(start + duration, F.col("t1")))
    pieces = cut.where(short | inside)
    own = W.partitionBy(*keys, "piece")
    base = F.when(short, F.lit(0.0)).otherwise(F.min("t").over(own))
    return pieces.select(*keys, "piece", "frame", (F.col("t") - base).alias("t"), "z")


def split_cleaned(df: DataFrame, keys: list[str], duration: float, overlap: float = 0.0) -> DataFrame:
    """Time split, then gaps of each piece filled by interpolation."""
    return gaps_interpolated(time_split(df, keys, duration, overlap), [*keys, "piece"])


def rule_flags(
    df: DataFrame, keys: list[str], variance_thresh: float | None = None, n_sigma: float = 5.0, min_jump: float | None = None, gap_len: int = 5, dropout_tol: float = 1e-6, flat_tol: float = 1e-6
) -> DataFrame:
    """Rules on each trace: flat, dropout, spike, high variance, and their ladder ``usable`` (0 or 1).

    A step or variance that equals its bound but for rounding is not beyond it.
    """
    steps = with_steps(filled(df, keys, inf_in_mean=True), keys)
    quiet = F.coalesce(F.abs("d") <= dropout_tol, F.lit(False)).cast("long")
    # a run of gap_len quiet steps ends where the last gap_len rows are all quiet: one order of rows serves all rules
    runs = steps.withColumn("length", F.sum(quiet).over(_ordered(keys).rowsBetween(-max(gap_len - 1, 0), 0)))
    jump = F.when(F.coalesce(F.stddev_pop("d"), F.lit(0.0)) <= 0, F.lit(1e-10)).otherwise(F.stddev_pop("d")) * n_sigma
    if min_jump is not None:
        jump = F.greatest(jump, F.lit(float(min_jump)))
    flags = runs.groupBy(*keys).agg(
        (F.stddev_pop("z") <= flat_tol).alias("flat"),
        (F.max("length") >= gap_len).alias("dropout"),
        F.coalesce(F.max(F.abs("d")) > jump * ABOVE, F.lit(False)).alias("spike"),
        (F.var_pop("z") > variance_thresh * ABOVE if variance_thresh is not None else F.lit(False)).alias("high_variance"),
    )
    bad = F.col("flat") | F.col("dropout") | F.col("spike") | F.col("high_variance")
    return flags.withColumn("usable", F.when(bad, 0).otherwise(1))


def array_rule_flags(z: Column, variance_thresh: float | None = None, n_sigma: float = 5.0, gap_len: int = 5, dropout_tol: float = 1e-6, flat_tol: float = 1e-6) -> Column:
    """``rule_flags`` of one trace as an array of finite samples, as a struct; null if it has none. No rows move."""
    total = lambda v, of=lambda x: x: F.aggregate(v, F.lit(0.0), lambda s, x: s + of(x))
    mean = lambda v: total(v) / F.size(v)
    variance = lambda v: let(mean(v), lambda m: total(v, lambda x: (x - m) * (x - m)) / F.size(v))

    def run(s: Column, x: Column) -> Column:
        now = F.when(F.abs(x) <= dropout_tol, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    def flags(v: Column, d: Column) -> Column:
        spread = F.when(F.size(d) > 0, F.sqrt(variance(d)))
        jump = F.when(F.coalesce(spread, F.lit(0.0)) <= 0, F.lit(1e-10)).otherwise(spread) * n_sigma * ABOVE
        longest = F.aggregate(d, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), run, lambda s: s["most"])
        spike = F.coalesce(F.array_max(F.transform(d, F.abs)) > jump, F.lit(False))

        def told(var: Column) -> Column:
            high = var > variance_thresh * ABOVE if variance_thresh is not None else F.lit(False)
            return F.struct((F.sqrt(var) <= flat_tol).alias("flat"), (longest >= gap_len).alias("dropout"), spike.alias("spike"), high.alias("high_variance"))

        return let(variance(v), told)

    steps = lambda v: F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda b, a: b - a)
    whole = let(z, lambda v: F.when(F.size(v) > 0, let(steps(v), lambda d: flags(v, d))))
    bad = lambda f: f["flat"] | f["dropout"] | f["spike"] | f["high_variance"]
    return let(whole, lambda f: F.when(f.isNotNull(), F.struct(*[f[c].alias(c) for c in ("flat", "dropout", "spike", "high_variance")], F.when(bad(f), 0).otherwise(1).alias("usable"))))


def training_stats(df: DataFrame) -> DataFrame:
    """Mean and deviation over all known samples."""
    z = missing_to_null(F.col("z"))
    return df.agg(F.avg(z).alias("mean"), F.stddev_pop(z).alias("std"))


def matched_to(df: DataFrame, target: DataFrame) -> DataFrame:
    """Samples moved and scaled from their own mean and deviation to those of ``target`` (mean, std)."""
    own = training_stats(df).select(F.col("mean").alias("m0"), F.col("std").alias("s0"))
    both = df.join(F.broadcast(own)).join(F.broadcast(target.select(F.col("mean").alias("m1"), F.col("std").alias("s1"))))
    scaled = F.when(F.col("s0") > 0, (F.col("z") - F.col("m0")) / F.col("s0") * F.col("s1") + F.col("m1")).otherwise(F.col("z"))
    return both.withColumn("z", scaled).drop("m0", "s0", "m1", "s1")


def longest_steady_run(df: DataFrame, group: list[str], n_std: float = 2.0, min_fraction: float = 0.95) -> DataFrame:
    """Longest run of frames in which enough beads lie within n deviations of the overall mean: (start, end, length)."""
    z = missing_to_null(F.col("z"))
    spread = df.join(df.groupBy(*group).agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s")), group)
    frames = spread.groupBy(*group, "frame").agg(F.avg((F.abs(F.col("z") - F.col("m")) <= n_std * F.col("s")).cast("double")).alias("share"))
    w = W.partitionBy(*group).orderBy("frame")
    runs = frames.withColumn("ok", F.coalesce(F.col("share") >= min_fraction, F.lit(False))).withColumn("run", F.sum((~F.col("ok")).cast("long")).over(w.rowsBetween(*UP_TO_HERE)))
    sized = runs.where("ok").groupBy(*group, "run").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("length"))
    best = sized.groupBy(*group).agg(F.max_by(F.struct("start", "end", "length"), F.struct(F.col("length"), -F.col("start"))).alias("b"))
    return best.select(*group, "b.start", "b.end", "b.length")
