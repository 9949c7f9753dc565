"""Synthetic traces on long rows: a semi-Markov generator, corruptions, augmentation and bootstrap.

Everything is a column expression over (keys, frame, t, z): what a trace draws is a hash of its
keys and a seed, what a sample draws is a hash of keys and frame, so results depend neither on
partitions nor on the order of evaluation, and keys may be of any type. Kinds of
corruption are entries of two tables, each an expression of a trace's draws and statistics;
the statistics come from windows over the keys, which one shuffle serves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.select import bootstrapped, hashed
from seqloom.operators.trace import filled

#: The states of a usable trace. Rates are of exponential durations (per second), durations in seconds,
#: slopes per second, jumps and noise in the trace's unit; the weights are normalised when a state is chosen.
USABLE_STATES = {
    "pause_fast": ("pause", 0.30, {"rates": (1.5, 4.0)}),
    "pause_slow": ("pause", 0.22, {"rates": (0.5, 1.2)}),
    "pause_power": ("power", 0.06, {"alpha": 2.0, "least": 0.3, "most": 3.5}),
    "activity_up_fast": ("activity", 0.16, {"slopes": (40.0, 70.0), "durations": (0.3, 2.0), "direction": 1}),
    "activity_up_slow": ("activity", 0.13, {"slopes": (20.0, 40.0), "durations": (1.0, 4.0), "direction": 1}),
    "activity_up_medium": ("activity", 0.10, {"slopes": (30.0, 60.0), "durations": (0.5, 3.0), "direction": 1}),
    "jump_back": ("jump", 0.015, {"sizes": (50.0, 400.0), "direction": -1}),
    "jump_forward": ("jump", 0.010, {"sizes": (30.0, 200.0), "direction": 1}),
    "high_noise": ("pause", 0.010, {"rates": (0.5, 1.5), "noise": (15.0, 50.0)}),
}
#: Kinds of corruption and their shares (which a choice normalises).
BAD_FEATURES = {"lost_bead": 0.2, "missing_regions": 0.15, "high_noise": 0.2, "inconsistent_noise": 0.15, "unobservable_activity": 0.2, "multiple": 0.1}
#: Kinds that "multiple" takes one or two of.
TOGETHER = ("lost_bead", "high_noise", "inconsistent_noise", "unobservable_activity")
#: Ranges of the four drawn features.
FEATURE_RANGES = ((0.1, 50.0), (0.01, 5.0), (0.01, 20.0), (0.01, 10.0))
_NAN = float("nan")


def gaussian(*columns: str, seed: int = 42) -> Column:
    """A normal draw that depends on the row's columns and a seed only."""
    u = F.greatest(hashed(*columns, seed=seed), F.lit(1e-15))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * np.pi * hashed(*columns, seed=seed + 1))


class Draws:
    """Draws of a trace, by number: uniform ones of the trace, uniform and normal ones of a sample."""

    def __init__(self, keys: list[str], seed: int) -> None:
        self.keys, self.seed = keys, seed

    def trace(self, k: int, lo: float = 0.0, hi: float = 1.0) -> Column:
        return F.lit(lo) + F.lit(hi - lo) * hashed(*self.keys, seed=self.seed + k)

    def sample(self, k: int) -> Column:
        return hashed(*self.keys, "frame", seed=self.seed + k)

    def normal(self, k: int) -> Column:
        return gaussian(*self.keys, "frame", seed=self.seed + k)


def chosen(draw: Column, shares: dict[str, float]) -> Column:
    """The name whose part of 0..1 holds a draw; parts are in the order of the names."""
    total, below, out = sum(shares.values()), 0.0, None
    for name, share in list(shares.items())[:-1]:
        below += share / total
        out = F.when(draw < below, name) if out is None else out.when(draw < below, name)
    last = list(shares)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def usable_weights(include: list[str] | None = None, exclude: list[str] | None = None) -> dict[str, float]:
    """States that may be drawn, with their weights."""
    return {name: weight for name, (_, weight, _) in USABLE_STATES.items() if (include is None or name in include) and name not in (exclude or ())}


def _parameter(name: str, index: int | None = None) -> Column:
    """A parameter of the row's state, or one end of its range; null where the state has none."""
    values = {state: p[name] for state, (_, _, p) in USABLE_STATES.items() if name in p}
    pairs = [(F.lit(state), F.lit(float(v if index is None else v[index]))) for state, v in values.items()]
    return F.element_at(F.create_map(*[x for pair in pairs for x in pair]), F.col("state"))


def stretches(rows: DataFrame, keys: list[str], order: str, dt: float, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(keys, order, state, samples, at, level, rise, step, own): each row is one stretch of its trace.

    ``at`` counts the samples before it and ``level`` is where it starts: the sum of what the
    stretches before it rose. ``rise`` is by sample, ``step`` at once, ``own`` the noise of a noisy pause.
    """
    one = [*keys, order]
    u = [hashed(*one, seed=seed + k) for k in range(3)]
    within = lambda name, draw: _parameter(name, 0) + (_parameter(name, 1) - _parameter(name, 0)) * draw
    drawn = rows.select(*one).withColumn("state", chosen(u[0], weights or usable_weights()))
    power = F.least(_parameter("least") * F.pow(1.0 - u[1], -1.0 / _parameter("alpha")), _parameter("most"))
    seconds = F.coalesce(-F.log(1.0 - u[1]) / within("rates", u[2]), power, within("durations", u[1]), F.lit(0.0))
    sized = drawn.select(
        *one,
        "state",
        F.greatest(F.lit(1), F.floor(seconds / dt)).cast("long").alias("samples"),
        F.coalesce(_parameter("direction") * within("slopes", u[2]) * dt, F.lit(0.0)).alias("rise"),
        F.coalesce(_parameter("direction") * within("sizes", u[2]), F.lit(0.0)).alias("step"),
        F.coalesce(within("noise", u[1]), F.lit(0.0)).alias("own"),
    )
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    change = F.col("step") + F.col("rise") * (F.col("samples") - 1)
    return sized.withColumn("at", F.coalesce(F.sum("samples").over(before), F.lit(0))).withColumn("level", F.coalesce(F.sum(change).over(before), F.lit(0.0)))


def simulated(rows: DataFrame, keys: list[str], order: str, dt: float = 0.05, noise: float = 10.0, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(keys, frame, t, clean, z): traces whose stretches are the rows; noise of a noisy pause belongs to the clean values."""
    one = stretches(rows, keys, order, dt, weights, seed)
    long = one.select(*keys, "at", "level", "rise", "step", "own", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("i")).withColumn("frame", F.col("at") + F.col("i"))
    draw = Draws(keys, seed)
    clean = F.col("level") + F.col("step") + F.col("rise") * F.col("i") + F.col("own") * draw.normal(10)
    out = long.withColumn("clean", clean).select(*keys, "frame", (F.col("frame") * dt).alias("t"), "clean")
    return out.withColumn("z", F.col("clean") + noise * draw.normal(20))


# corruptions of (keys, frame, t, clean, z): draws and seconds of gaps to new (clean, z); lost samples are NaN in both or in the clean values


def _lost_bead(d: Draws, gaps: tuple[float, float]) -> tuple[Column, Column]:
    wide = F.greatest(4.0 * (F.col("__hi") - F.col("__lo")), F.lit(2000.0))
    anywhere = F.col("__lo") - wide + (F.col("__hi") - F.col("__lo") + 2.0 * wide) * d.sample(1)
    lost = F.col("t") >= F.col("__loss")
    return F.when(lost, _NAN).otherwise(F.col("clean")), F.when(lost, anywhere).otherwise(F.col("z"))


def _starting(d: Draws, k: int, seconds: tuple[float, float]) -> tuple[Column, Column]:
    """Begin and length of a stretch of time that starts in the middle eight tenths of a trace."""
    return F.col("__t0") + F.col("__span") * d.trace(k, 0.1, 0.9), d.trace(k + 1, *seconds)


def _missing_regions(d: Draws, gaps: tuple[float, float]) -> tuple[Column, Column]:
    count, gone = F.floor(d.trace(2, 1.0, 4.0)), F.lit(False)
    for k in range(3):
        begin, length = _starting(d, 30 + 2 * k, gaps)
        gone = gone | ((F.lit(k) < count) & (F.col("t") >= begin) & (F.col("t") < begin + length))
    return F.when(gone, _NAN).otherwise(F.col("clean")), F.when(gone, _NAN).otherwise(F.col("z"))


def _high_noise(d: Draws, gaps: tuple[float, float]) -> tuple[Column, Column]:
    return F.col("clean"), F.col("z") + d.normal(3) * F.col("__own") * (d.trace(5, 2.5, 5.0) - 1.0)


def _inconsistent_noise(d: Draws, gaps: tuple[float, float]) -> tuple[Column, Column]:
    level, count = F.col("__own"), F.floor(d.trace(6, 2.0, 5.0))
    for k in range(4):
        begin, length = _starting(d, 40 + 3 * k, (0.5, 2.0))
        way = (F.col("t") - begin) / length
        level = F.when((F.lit(k) < count) & (way >= 0) & (way < 1), F.col("__own") + (d.trace(42 + 3 * k, 5.0, 50.0) - F.col("__own")) * way).otherwise(level)
    return F.col("clean"), F.col("clean") + d.normal(7) * level


def _unobservable_activity(d: Draws, gaps: tuple[float, float]) -> tuple[Column, Column]:
    drifted = F.col("clean") + (d.trace(9, 0.3, 2.5) + d.trace(10, 0.0, 0.5)) * (F.col("t") - F.col("__t0"))
    return drifted, drifted + d.normal(11) * F.col("__own") * d.trace(13, 4.0, 7.0)


CORRUPTIONS: dict[str, Callable[[Draws, tuple[float, float]], tuple[Column, Column]]] = {
    "lost_bead": _lost_bead,
    "missing_regions": _missing_regions,
    "high_noise": _high_noise,
    "inconsistent_noise": _inconsistent_noise,
    "unobservable_activity": _unobservable_activity,
}


def corrupted(df: DataFrame, keys: list[str], kind: str = "kind", gaps: tuple[float, float] = (1.0, 8.0), seed: int = 42) -> DataFrame:
    """Long rows, each trace corrupted in the way its column ``kind`` names (null or unknown: left alone)."""
    whole, d = W.partitionBy(*keys), Draws(keys, seed)
    stats = df.withColumns({"__t0": F.min("t").over(whole), "__span": F.max("t").over(whole) - F.min("t").over(whole), "__own": F.stddev_pop(F.when(~F.isnan("clean") & ~F.isnan("z"), F.col("z") - F.col("clean"))).over(whole)})
    stats = stats.withColumn("__loss", F.col("__t0") + F.col("__span") * d.trace(0, 0.2, 0.8))
    before = F.when((F.col("t") < F.col("__loss")) & ~F.isnan("z"), F.col("z"))
    stats = stats.withColumns({"__lo": F.coalesce(F.min(before).over(whole), F.lit(0.0)), "__hi": F.coalesce(F.max(before).over(whole), F.lit(0.0)), "__own": F.coalesce("__own", F.lit(0.0))})
    made = {name: make(d, gaps) for name, make in CORRUPTIONS.items()}
    pick = lambda side: reduce(lambda out, name: F.when(F.col(kind) == name, made[name][side]).otherwise(out), made, F.col(("clean", "z")[side]))
    return stats.withColumn("__new", F.struct(pick(0).alias("clean"), pick(1).alias("z"))).select(*[F.col(f"__new.{c}").alias(c) if c in ("clean", "z") else F.col(c) for c in df.columns])


def corrupted_share(df: DataFrame, keys: list[str], group: list[str], usable_ratio: float = 0.5, gaps: tuple[float, float] = (1.0, 8.0), seed: int = 42) -> DataFrame:
    """Long rows with ``label`` and ``bad_feature``: of each group's traces the share that isn't usable (rounded down) is corrupted.

    Those with the least hashes are; "multiple" takes one or two kinds, one after the other.
    """
    names = df.select(*keys).distinct()
    ranked = names.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy(hashed(*keys, seed=seed + 90), *keys))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*group)))
    bad = F.col("__k") <= F.floor(F.col("__n") * F.lit(1.0 - usable_ratio))
    marked = ranked.select(*keys, F.when(bad, 0).otherwise(1).alias("label"), F.when(bad, chosen(hashed(*keys, seed=seed + 91), BAD_FEATURES)).alias("bad_feature"))
    even = dict.fromkeys(TOGETHER, 1.0)
    first, second = chosen(hashed(*keys, seed=seed + 92), even), chosen(hashed(*keys, seed=seed + 93), even)
    multiple = F.col("bad_feature") == "multiple"
    marked = marked.withColumn("__first", F.when(multiple, first).otherwise(F.col("bad_feature"))).withColumn("__second", F.when(multiple & (hashed(*keys, seed=seed + 94) < 0.5) & (first != second), second))
    joined = df.join(marked, keys)
    return corrupted(corrupted(joined, keys, "__first", gaps, seed), keys, "__second", gaps, seed + 1000).drop("__first", "__second")


def pieces(df: DataFrame, keys: list[str], duration: float) -> DataFrame:
    """Long rows cut into pieces of ``duration`` seconds: adds ``piece``; times start from 0 in each. Pieces of one sample go."""
    start = F.min("t").over(W.partitionBy(*keys))
    cut = df.withColumn("__t0", start).withColumn("piece", F.floor((F.col("t") - F.col("__t0")) / duration).cast("long")).drop("__t0")
    own = W.partitionBy(*keys, "piece")
    return cut.withColumn("__n", F.count(F.lit(1)).over(own)).withColumn("t", F.col("t") - F.min("t").over(own)).where("__n > 1").drop("__n")


# augmentation of (keys, label, frame, z)


def _within(d: Draws, k: int, starts: tuple[float, float], lengths: tuple[float, float]) -> tuple[Column, Column]:
    """First frame and end of a stretch, from shares of a trace's samples; two samples at least."""
    first = F.floor(F.col("__n") * d.trace(k, *starts))
    return first, first + F.greatest(F.lit(2), F.floor(F.col("__n") * d.trace(k + 1, *lengths)))


#: Where stretches of these kinds start and how long they are, as shares of the trace.
STRETCHES = {"high_noise": ((0.0, 0.5), (1 / 20, 1 / 3)), "dropout": ((0.0, 1.0), (1 / 50, 1 / 8)), "flat_region": ((0.0, 0.5), (1 / 10, 1 / 2))}
SPOILS: dict[str, Callable[[Draws], Column]] = {
    "high_noise": lambda d: F.when(F.col("__in"), F.col("z") + d.normal(50) * F.col("__s") * d.trace(52, 1.5, 5.0)),
    "dropout": lambda d: F.when(F.col("__in"), F.coalesce("__held", "__median")),
    "spike": lambda d: F.when(d.sample(53) < F.greatest(F.lit(1.0), F.floor(F.col("__n") / 100)) / F.col("__n"), F.col("z") + F.when(d.sample(54) < 0.5, -1.0).otherwise(1.0) * F.col("__s") * d.trace(55, 5.0, 20.0)),
    "lost_tail": lambda d: F.when(F.col("__i") >= F.floor(F.col("__n") * d.trace(56, 0.25, 1.0)), F.col("__min") - F.col("__s") * d.trace(57, 3.0, 8.0) + (F.col("__max") - F.col("__min") + F.col("__s") * (d.trace(57, 3.0, 8.0) + d.trace(58, 3.0, 8.0))) * d.sample(59)),
    "flat_region": lambda d: F.when(F.col("__in"), F.col("__flat")),
    "curved_drift": lambda d: F.col("z") + F.col("__s") * d.trace(60, 0.5, 2.0) * (F.pow(2.0 * F.col("__x") - 1.0, F.lit(2)) - F.avg(F.pow(2.0 * F.col("__x") - 1.0, F.lit(2))).over(W.partitionBy(*d.keys))),
}


def augmented(df: DataFrame, keys: list[str], seed: int = 42, corrupt_share: float = 0.35) -> DataFrame:
    """Long rows changed mildly, and a share of the traces spoiled (label 0): adds ``change``.

    Mildly: gain and centre within a tenth, noise of a twentieth to a quarter of the steps'
    deviation, a drift of up to a twentieth of the trace's. Spoiled: one of ``SPOILS`` on top. Gaps
    are filled with the finite mean first; traces below four samples are changed mildly only.
    """
    whole, d = W.partitionBy(*keys), Draws(keys, seed)
    order = whole.orderBy("frame")
    rows = filled(df, keys, inf_to_mean=True).withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count(F.lit(1)).over(whole), "__d": F.col("z") - F.lag("z").over(order)})
    rows = rows.withColumns({"__c": F.median("z").over(whole), "__sd": F.stddev_pop("z").over(whole), "__steps": F.stddev_pop("__d").over(whole), "__x": F.coalesce(F.try_divide(F.col("__i").cast("double"), F.col("__n") - 1), F.lit(0.0))})
    gain = d.trace(0, 0.9, 1.1)
    noise = F.when(F.col("__steps") > 0, F.col("__steps")).otherwise(F.greatest(0.02 * F.col("__sd"), F.lit(1e-6)))
    mild = gain * (F.col("z") + noise * d.trace(1, 0.05, 0.25) * d.normal(2) + F.col("__x") * F.col("__sd") * d.trace(4, -0.05, 0.05)) + F.col("__c") * (1.0 - d.trace(5, 0.9, 1.1))
    rows = rows.withColumn("z", mild).withColumn("__bad", d.trace(6) < corrupt_share)
    even = dict.fromkeys(SPOILS, 1.0)
    rows = rows.withColumn("change", F.when(F.col("__bad") & (F.col("__n") >= 4), chosen(d.trace(7), even)).otherwise("mild"))
    begin, end = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (name, shares) in enumerate(STRETCHES.items()):
        a, b = _within(d, 70 + 2 * k, *shares)
        begin, end = F.when(F.col("change") == name, a).otherwise(begin), F.when(F.col("change") == name, b).otherwise(end)
    rows = rows.withColumns({"__a": begin, "__b": end})
    rows = rows.withColumn("__in", F.coalesce((F.col("__i") >= F.col("__a")) & (F.col("__i") < F.col("__b")), F.lit(False)))
    steps = F.median(F.abs("__d")).over(whole)
    spread = F.stddev_pop("z").over(whole)
    rows = rows.withColumns({
        "__s": F.when(spread > 0, spread).otherwise(F.greatest(F.coalesce(steps, F.lit(0.0)), F.lit(1e-6))), "__min": F.min("z").over(whole), "__max": F.max("z").over(whole), "__median": F.median("z").over(whole),
        "__held": F.max(F.when(F.col("__i") == F.col("__a") - 1, F.col("z"))).over(whole), "__flat": F.median(F.when(F.col("__in"), F.col("z"))).over(whole),
    })
    spoiled = reduce(lambda out, name: F.when(F.col("change") == name, F.coalesce(SPOILS[name](d), F.col("z"))).otherwise(out), SPOILS, F.col("z"))
    label = F.when(F.col("__bad"), 0).otherwise(F.col("label")).cast("int")
    return rows.withColumn("__z", spoiled).withColumn("label", label).select(*[F.col("__z").alias("z") if c == "z" else F.col(c) for c in df.columns], "change")


def bootstrap(df: DataFrame, keys: list[str], n: int, seed: int = 42, corrupt_share: float = 0.35) -> DataFrame:
    """n traces drawn with replacement from long rows and changed: (draw, keys, source_label, label, frame, z, change)."""
    drawn = bootstrapped(df.groupBy(*keys).agg(F.first("label").alias("source_label")), n, keys[0], seed)
    return augmented(drawn.join(df, keys), ["draw"], seed, corrupt_share)


def drawn_features(rows: DataFrame, id_col: str, seed: int = 42, flip: float = 0.1) -> DataFrame:
    """Four uniform features a row; the label is 1 if the first two are above their medians, with a share flipped."""
    drawn = rows.select(F.col(id_col), *[(lo + (hi - lo) * hashed(id_col, seed=seed + k)).alias(f"f{k}") for k, (lo, hi) in enumerate(FEATURE_RANGES)])
    m = drawn.agg(F.median("f0").alias("m0"), F.median("f1").alias("m1"))
    y = ((F.col("f0") > F.col("m0")) & (F.col("f1") > F.col("m1"))).cast("int")
    return drawn.join(F.broadcast(m)).withColumn("label", F.when(hashed(id_col, seed=seed + 9) < flip, 1 - y).otherwise(y)).drop("m0", "m1")


# corruptors on long rows (keys, frame, t, z)


def with_lost_bead(df: DataFrame, keys: list[str], share: float = 0.5, seed: int = 42) -> DataFrame:
    """Values after a share of the time are uniform over the range before it, widened by four times its width, 2000 at least, on both sides."""
    whole = W.partitionBy(*keys)
    at = F.min("t").over(whole) + share * (F.max("t").over(whole) - F.min("t").over(whole))
    df = df.withColumn("__at", at)
    before = F.when(F.col("t") < F.col("__at"), F.col("z"))
    lo, hi = F.min(before).over(whole), F.max(before).over(whole)
    margin = F.greatest(4.0 * (hi - lo), F.lit(2000.0))
    return df.withColumn("z", F.when(F.col("t") >= F.col("__at"), lo - margin + (hi - lo + 2.0 * margin) * hashed(*keys, "frame", seed=seed)).otherwise(F.col("z"))).drop("__at")


def with_gaps(df: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Samples inside any gap (keys, g0, g1) become NaN."""
    hit = df.join(gaps, keys).where((F.col("t") >= F.col("g0")) & (F.col("t") < F.col("g1"))).select(*keys, "frame").distinct().withColumn("__gap", F.lit(True))
    return df.join(hit, [*keys, "frame"], "left").withColumn("z", F.when(F.col("__gap"), F.lit(float("nan"))).otherwise(F.col("z"))).drop("__gap")


def with_drift(df: DataFrame, keys: list[str], rate: float) -> DataFrame:
    return df.withColumn("z", F.col("z") + rate * (F.col("t") - F.min("t").over(W.partitionBy(*keys))))


def with_noise(df: DataFrame, keys: list[str], multiplier: float = 3.0, seed: int = 42, clean: str = "clean") -> DataFrame:
    """Noise of (multiplier - 1) times that already there: the deviation of ``z`` less ``clean``."""
    own = F.stddev_pop(F.col("z") - F.col(clean)).over(W.partitionBy(*keys))
    return df.withColumn("z", F.col("z") + gaussian(*keys, "frame", seed=seed) * own * (multiplier - 1.0))
