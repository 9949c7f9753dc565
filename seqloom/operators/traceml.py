"""Models of whole traces as ``pyspark.ml`` stages: features, scaling and ridge in one ``Pipeline``.

Every stage keeps what it learned in its parameters, so a fitted ``PipelineModel`` is saved and
loaded by ML persistence and needs no session state. Traces are array columns; features are
computed in Arrow batches and nothing but learned numbers reaches the driver:

* ``MiniRocket``: the 84 kernels of nine weights (-1, and 2 at three places) at exponential
  dilations; biases are quantiles of the convolutions of a bounded sample of training traces
  (the least hashes of their values), and a feature is the share of responses above its bias.
* ``SymbolicWords``: windows become words of binned Fourier coefficients. Bins are equally deep,
  by exact ranks over all training windows; word counts come from a shuffle by (trace, word),
  and words are chosen by chi-square against the class.
* ``Ridge``: least squares on targets of -1 and 1 from normal equations summed by tasks.

Defined results: null, NaN and infinite samples count as the trace's finite mean (0 if none); empty
traces have features of 0; rows without a label train nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.numeric import clean
from seqloom.operators.models import normal_equations, ridge_predict
from seqloom.runtime import in_batches, materialized

KERNELS = np.array(list(combinations(range(9), 3)))
GOLDEN = (np.sqrt(5) + 1) / 2


class _Columns(Params):
    """Input and output columns, label."""

    inputCol = Param(Params._dummy(), "inputCol", "array column of a trace", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array column of features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column of the class", TypeConverters.toString)

    def _columns(self, **given) -> None:
        self._setDefault(inputCol="z", outputCol="features", labelCol="label")
        self._set(**{k: v for k, v in given.items() if v is not None})


class _Features(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the output column, computed trace by trace in Arrow batches."""

    def one(self):
        """A function of one clean trace that gives its features."""
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        make, source, target = self.one(), self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        kept = [(c, c) for c in df.columns if c != target]
        return in_batches(df, [source], kept, f"`{target}` array<double>", lambda traces: [[make(clean(np.array(t if t is not None else [], float))) for t in traces]])


def shifts(z: np.ndarray, dilation: int) -> np.ndarray:
    """Row j is the trace moved by (j - 4) dilations, zeros beyond its ends."""
    out = np.zeros((9, len(z)))
    for j in range(9):
        by = (j - 4) * dilation
        if by < 0:
            out[j, -by:] = z[:by] if -by < len(z) else 0
        elif by < len(z):
            out[j, : len(z) - by] = z[by:]
    return out


def responses(z: np.ndarray, dilation: int, number: int) -> Iterator[np.ndarray]:
    """Convolutions with all kernels at a dilation; every other one (by kernel and ``number`` of the dilation) without its padded ends."""
    moved = shifts(z, dilation)
    rest, edge = -moved.sum(axis=0), 4 * dilation
    for k, places in enumerate(KERNELS):
        r = rest + 3 * moved[places].sum(axis=0)
        yield r if (k + number) % 2 == 0 or len(z) <= 2 * edge else r[edge:-edge]


def shares_above(z: np.ndarray, dilation: int, number: int, biases: np.ndarray, entries: int = 2_000_000) -> np.ndarray:
    """Shares of ``responses`` above the biases (kernel, bias), many kernels at a time."""
    moved = shifts(z, dilation)
    rest, edge = -moved.sum(axis=0), 4 * dilation
    trimmed = ((np.arange(84) + number) % 2 == 1) & (len(z) > 2 * edge)
    out, step = np.empty(biases.shape), max(1, entries // (len(z) * max(3, biases.shape[1])))
    for which, inner in ((np.flatnonzero(~trimmed), slice(None)), (np.flatnonzero(trimmed), slice(edge, -edge))):
        for at in range(0, len(which), step):
            own = which[at : at + step]
            r = rest[inner] + 3 * moved[:, inner][KERNELS[own]].sum(axis=1)
            out[own] = (r[:, :, None] > biases[own][:, None, :]).mean(axis=1)
    return out


def exponential_dilations(length: int, per_kernel: int, most: int = 32) -> tuple[list[int], list[int]]:
    """Dilations up to those whose kernel spans the trace, and the features that each gets of ``per_kernel``."""
    top = np.log2(max((length - 1) / 8, 1))
    made, counts = np.unique((2 ** np.linspace(0, top, min(per_kernel, most))).astype(int), return_counts=True)
    shares = counts * per_kernel // counts.sum()
    shares[: per_kernel - shares.sum()] += 1
    return made.tolist(), shares.tolist()


class MiniRocketModel(_Columns, _Features):
    dilations = Param(Params._dummy(), "dilations", "dilations", TypeConverters.toListInt)
    shares = Param(Params._dummy(), "shares", "biases of each kernel at each dilation", TypeConverters.toListInt)
    biases = Param(Params._dummy(), "biases", "biases by dilation, kernel and number", TypeConverters.toListFloat)

    def __init__(self, **given) -> None:
        super().__init__()
        self._columns(**given)

    def one(self):
        dilations, shares = self.getOrDefault("dilations"), self.getOrDefault("shares")
        biases, parts, at = np.array(self.getOrDefault("biases")), [], 0
        for n in shares:
            parts.append(biases[at : at + 84 * n].reshape(84, n))
            at += 84 * n

        def features(z: np.ndarray) -> list[float]:
            if not len(z):
                return [0.0] * len(biases)
            return [v for d, (dilation, own) in enumerate(zip(dilations, parts, strict=True)) for v in shares_above(z, dilation, d, own).ravel().tolist()]

        return features


class MiniRocket(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    numFeatures = Param(Params._dummy(), "numFeatures", "features, rounded down to a multiple of 84", TypeConverters.toInt)
    sampleRows = Param(Params._dummy(), "sampleRows", "training traces that biases are taken from, at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labelCol=None, numFeatures=None, sampleRows=None) -> None:
        super().__init__()
        self._setDefault(numFeatures=9996, sampleRows=256)
        self._columns(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MiniRocketModel:
        z = self.getOrDefault("inputCol")
        length = df.agg(F.percentile_approx(F.size(z), 0.5)).first()[0] or 0
        per_kernel = max(1, self.getOrDefault("numFeatures") // 84)
        dilations, shares = exponential_dilations(length, per_kernel)
        text = F.xxhash64(F.array_join(F.transform(z, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), " "))
        rows = df.where(F.size(z) > 0).select(F.col(z).alias("z")).orderBy(text, "z").limit(self.getOrDefault("sampleRows")).withColumn("place", F.monotonically_increasing_id())
        rows = [r["z"] for r in rows.orderBy("place").select("z").collect()]
        model = MiniRocketModel(inputCol=z, outputCol=self.getOrDefault("outputCol"))
        biases, number = [], 0
        for d, (dilation, n) in enumerate(zip(dilations, shares, strict=True)):
            for k in range(84):
                levels = np.arange(number + 1, number + n + 1) * GOLDEN % 1
                number += n
                if not rows:
                    biases += [0.0] * n
                    continue
                took = clean(np.array(rows[(84 * d + k) % len(rows)], float))
                biases += np.quantile(next(r for i, r in enumerate(responses(took, dilation, d)) if i == k), levels).tolist()
        return model._set(dilations=dilations, shares=shares, biases=biases)


def window_values(z: np.ndarray, size: int, values: int, normed: bool) -> np.ndarray:
    """First Fourier coefficients (real and imaginary parts in turn, without the constant) of every window of a trace.

    They are rounded, because bins end at values of windows.
    """
    if len(z) < size:
        return np.empty((0, values))
    windows = np.lib.stride_tricks.sliding_window_view(z, size)
    if normed:
        spread = windows.std(axis=1, keepdims=True)
        windows = (windows - windows.mean(axis=1, keepdims=True)) / np.where(spread > 1e-12, spread, 1)
    k = np.arange(1, values // 2 + 1)
    angle = 2 * np.pi * np.outer(np.arange(size), k) / size
    return np.round(np.stack([windows @ np.cos(angle), -(windows @ np.sin(angle))], axis=2).reshape(len(windows), values), 9)


def split_points(df: DataFrame, group: list[str], value: str, parts: int) -> DataFrame:
    """(group, q): of each group the values at ranks ceil(i * n / parts), i below ``parts``, exactly.

    Equal values are counted first. Distinct ones are dealt out in ranges, whose counts tell in which
    range a rank lies; only those ranges are put in order, so no task holds a group's values.
    """
    dealt = materialized(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c")).repartitionByRange(*group, value).withColumn("__r", F.spark_partition_id()))
    whole, before = W.partitionBy(*group), W.partitionBy(*group).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "__r").agg(F.sum("__c").alias("m"))
    ranges = ranges.withColumn("n", F.sum("m").over(whole)).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    wanted = ranges.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(1, parts)]))).withColumn("rank", F.expr(f"(i * n + {parts - 1}) div {parts}"))
    wanted = wanted.where("before < rank and rank <= before + m").select(*group, "__r", "i", "rank", "before")
    upto = F.col("before") + F.sum("__c").over(W.partitionBy(*group, "__r", "i").orderBy(value))
    near = dealt.join(F.broadcast(wanted), [*group, "__r"]).withColumn("upto", upto).where("upto >= rank")
    ends = near.groupBy(*group, "i").agg(F.min(value).alias("x"))
    return ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("q"))


class _Words(_Columns):
    windows = Param(Params._dummy(), "windows", "window sizes", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "Fourier values of a word, an even number", TypeConverters.toInt)
    letters = Param(Params._dummy(), "letters", "bins of a value", TypeConverters.toInt)
    normed = Param(Params._dummy(), "normed", "whether windows have mean 0 and deviation 1", TypeConverters.toBoolean)
    reduced = Param(Params._dummy(), "reduced", "whether a word that repeats the one before doesn't count", TypeConverters.toBoolean)
    pairs = Param(Params._dummy(), "pairs", "whether pairs of words a window apart count as well", TypeConverters.toBoolean)
    edges = Param(Params._dummy(), "edges", "inner bounds of the bins by window size and value", TypeConverters.toListFloat)

    def words(self):
        """A function of a clean trace that gives all its words as texts ``size:word`` or ``size:word+word``."""
        sizes, values, letters = (self.getOrDefault(p) for p in ("windows", "values", "letters"))
        normed, reduced, pairs = (self.getOrDefault(p) for p in ("normed", "reduced", "pairs"))
        edges = np.array(self.getOrDefault("edges")).reshape(len(sizes), values, letters - 1)

        def found(z: np.ndarray) -> list[str]:
            out = []
            for size, own in zip(sizes, edges, strict=True):
                v = window_values(z, size, values, normed)
                digits = (v[:, :, None] > own).sum(axis=2)
                names = ["".join(map(str, row)) for row in digits.tolist()]
                kept = [k for k in range(len(names)) if not reduced or k == 0 or names[k] != names[k - 1]]
                out += [f"{size}:{names[k]}" for k in kept]
                if pairs:
                    out += [f"{size}:{names[k - size]}+{names[k]}" for k in kept if k >= size]
            return out

        return found


class SymbolicWordsModel(_Words, _Features):
    chosen = Param(Params._dummy(), "chosen", "words that are features", TypeConverters.toListString)

    def __init__(self, **given) -> None:
        super().__init__()
        self._columns(**given)

    def one(self):
        place = {w: k for k, w in enumerate(self.getOrDefault("chosen"))}
        words = self.words()

        def features(z: np.ndarray) -> list[float]:
            out = [0.0] * len(place)
            for w in words(z):
                if (k := place.get(w)) is not None:
                    out[k] += 1
            return out

        return features


class SymbolicWords(_Words, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    mostWords = Param(Params._dummy(), "mostWords", "words that become features, at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labelCol=None, windows=None, values=None, letters=None, normed=None, reduced=None, pairs=None, mostWords=None) -> None:
        super().__init__()
        self._setDefault(windows=[8, 16, 32], values=4, letters=4, normed=False, reduced=False, pairs=True, mostWords=2000)
        self._columns(**self._input_kwargs)

    def learned_edges(self, df: DataFrame) -> list[float]:
        """Equally deep bins of every window size and value, by exact ranks over all windows."""
        sizes, values, letters, normed = (self.getOrDefault(p) for p in ("windows", "values", "letters", "normed"))

        def compute(traces: list) -> list[list]:
            each = [clean(np.array(t if t is not None else [], float)) for t in traces]
            return [[[window_values(z, size, values, normed).ravel().tolist() for size in sizes] for z in each]]

        rows = in_batches(df, [self.getOrDefault("inputCol")], [], "v array<array<double>>", compute)
        long = rows.select(F.posexplode("v").alias("size", "v")).select("size", F.posexplode("v").alias("k", "x")).withColumn("k", F.col("k") % values)
        found = {(r["size"], r["k"]): r["q"] for r in split_points(long, ["size", "k"], "x", letters).collect()}
        return [x for s in range(len(sizes)) for k in range(values) for x in found.get((s, k), [0.0] * (letters - 1))]

    def counts(self, df: DataFrame, keys: list[str], edges: list[float]) -> DataFrame:
        """(keys, word, n) of all words of all traces, by a shuffle with partial counts."""
        words = SymbolicWordsModel()._set(edges=edges, **{p: self.getOrDefault(p) for p in ("windows", "values", "letters", "normed", "reduced", "pairs")}).words()
        rows = in_batches(df, [self.getOrDefault("inputCol")], [(k, k) for k in keys], "words array<string>", lambda traces: [[words(clean(np.array(t if t is not None else [], float))) for t in traces]])
        return rows.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))

    def _fit(self, df: DataFrame) -> SymbolicWordsModel:
        z, y = self.getOrDefault("inputCol"), self.getOrDefault("labelCol")
        rows = df.where(F.col(y).isNotNull()).select(F.col(z).alias(z), F.col(y).alias("__y"))
        edges = self.learned_edges(rows)
        by_class = self.counts(rows, ["__y"], edges)
        # chi-square of a word's counts over the classes against the classes' shares of all words
        total = by_class.groupBy("__y").agg(F.sum("n").alias("m"))
        share = F.broadcast(total.crossJoin(total.agg(F.sum("m").alias("all"))).select("__y", (F.col("m") / F.col("all")).alias("share")))
        own = by_class.join(share, "__y")
        whole = by_class.groupBy("word").agg(F.sum("n").alias("w"))
        seen = own.join(whole, "word").groupBy("word", "w").agg(F.sum(F.pow(F.col("n") - F.col("w") * F.col("share"), F.lit(2)) / (F.col("w") * F.col("share"))).alias("seen"), F.sum(F.col("w") * F.col("share")).alias("expected"))
        # classes without the word add what was expected of them
        ranked = seen.select("word", F.round(F.col("seen") + F.col("w") - F.col("expected"), 9).alias("chi2")).orderBy(F.desc("chi2"), "word")
        chosen = [r["word"] for r in ranked.limit(self.getOrDefault("mostWords")).collect()]
        same = {p: self.getOrDefault(p) for p in ("windows", "values", "letters", "normed", "reduced", "pairs", "inputCol", "outputCol")}
        return SymbolicWordsModel()._set(edges=edges, chosen=chosen, **same)


class RidgeModel(_Columns, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``p``: 1 where the weighted sum of the scaled features exceeds 0."""

    weights = Param(Params._dummy(), "weights", "weight of each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def __init__(self, **given) -> None:
        super().__init__()
        self._columns(**given)

    def _transform(self, df: DataFrame) -> DataFrame:
        return ridge_predict(df, np.array(self.getOrDefault("weights")), self.getOrDefault("intercept"), self.getOrDefault("inputCol"))


class Ridge(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    alpha = Param(Params._dummy(), "alpha", "penalty of standardised weights", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol=None, alpha=None) -> None:
        super().__init__()
        self._setDefault(alpha=1.0)
        self._columns(**{"inputCol": "features", **self._input_kwargs})

    def _fit(self, df: DataFrame) -> RidgeModel:
        """Weights on standardised features, from one pass of sums, given back in the features' own scale."""
        x, y = self.getOrDefault("inputCol"), self.getOrDefault("labelCol")
        xx, xy, sx, sy, n = normal_equations(df.where(F.col(y).isNotNull()), x, y)
        mean = sx / n
        cov = xx - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov) / n, 0))
        scale = np.where(spread > 1e-9, spread, np.inf)  # a constant feature has no weight
        w = np.linalg.solve(cov / np.outer(scale, scale) + self.getOrDefault("alpha") * np.eye(len(mean)), (xy - mean * sy) / scale) / scale
        return RidgeModel(inputCol=x)._set(weights=w.tolist(), intercept=float(sy / n - mean @ w))


class _Grouped(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features of seeded draws, from ``group``."""

    number = Param(Params._dummy(), "number", "kernels or intervals", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, number=None, seed=None) -> None:
        super().__init__()
        self._setDefault(number=100, seed=42)
        self._columns(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from seqloom.operators import group

        make = {"RandomKernels": group.kernel_features, "RandomIntervals": group.interval_features}[type(self).__name__]
        target = self.getOrDefault("outputCol")
        keys = [c for c in df.columns if c != target]
        copied = df.withColumn("__trace", F.col(self.getOrDefault("inputCol")))
        return make(copied, keys, self.getOrDefault("number"), self.getOrDefault("seed"), "__trace").withColumnRenamed("features", target)


class RandomKernels(_Grouped):
    """Maxima and shares of positive responses of random kernels."""


class RandomIntervals(_Grouped):
    """Mean, deviation and slope on random intervals."""


#: Stages before the ridge classifier, by model name.
STAGES = {
    "minirocket": lambda n, seed: MiniRocket(numFeatures=n or 9996),
    "weasel": lambda n, seed: SymbolicWords(mostWords=n or 2000),
    "boss": lambda n, seed: SymbolicWords(normed=True, reduced=True, pairs=False, mostWords=n or 2000),
    "rocket_ridge": lambda n, seed: RandomKernels(number=n or 100, seed=seed),
    "interval_ridge": lambda n, seed: RandomIntervals(number=n or 32, seed=seed),
}


def trace_pipeline(name: str, n_features: int | None = None, alpha: float = 1.0, seed: int = 42) -> Pipeline:
    """An unfitted pipeline of a whole-trace model over (z array, label)."""
    if name not in STAGES:
        raise ValueError(f"model not available: {name}")
    return Pipeline(stages=[STAGES[name](n_features, seed), Ridge(alpha=alpha)])


# runs: a folder of saved models, one of which is the latest


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(conf), conf


def save_run(model: PipelineModel, root: str, run: str | None = None) -> str:
    """Save a fitted pipeline below ``root`` and point LATEST at it; returns the run's name.

    The model is complete before the pointer names it, and the pointer changes by one rename, so a
    reader finds either the run before or this one.
    """
    spark = SparkSession.active()
    run = run or f"run-{uuid.uuid4().hex}"
    model.write().overwrite().save(f"{root}/{run}")
    jvm, pointer, files, conf = _files(spark, f"{root}/LATEST")
    made = jvm.org.apache.hadoop.fs.Path(f"{root}/.LATEST-{uuid.uuid4().hex}")
    out = files.create(made, True)
    out.write(bytearray(run, "utf-8"))
    out.close()
    renames = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(renames, 1)
    overwrite[0] = renames.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(made), files.makeQualified(pointer), overwrite)
    return run


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The name that LATEST holds, or None."""
    _, pointer, files, _ = _files(spark, f"{root}/LATEST")
    if not files.exists(pointer):
        return None
    return spark.read.text(f"{root}/LATEST", wholetext=True).first()["value"].strip()


def load_run(spark: SparkSession, root: str, run: str | None = None) -> PipelineModel:
    """A run by name, by default the latest one."""
    name = run or latest_run(spark, root)
    if name is None:
        raise ValueError(f"{root} holds no run")
    return PipelineModel.load(f"{root}/{name}")


def beads_of(told: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, majority, sum_vote): a model's verdicts on segments as one for each bead, by both votes."""
    from seqloom.operators.metrics import majority, sum_vote

    return reduce(lambda a, b: a.join(b, keys), [majority(told, keys).withColumnRenamed("vote", "majority"), sum_vote(told, keys).withColumnRenamed("vote", "sum_vote")])
