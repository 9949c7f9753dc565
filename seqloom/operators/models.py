"""Supervised models on ``pyspark.ml``, ridge on kernel features, and their evaluation.

Feature tables are (id, features columns..., label); a trained model is a ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.numeric import ridge_classifier
from seqloom.operators.group import interval_features, kernel_features
from seqloom.operators.metrics import binary_metrics
from seqloom.operators.select import least_drawn, stratified
from seqloom.runtime import materialized

MODELS = {
    "tree": lambda seed: DecisionTreeClassifier(maxDepth=3, seed=seed),
    "forest_small": lambda seed: RandomForestClassifier(numTrees=100, maxDepth=5, seed=seed),
    "forest": lambda seed: RandomForestClassifier(numTrees=200, maxDepth=8, minInstancesPerNode=2, seed=seed),
    "logistic": lambda seed: LogisticRegression(maxIter=200, weightCol="weight"),
    "bagging": lambda seed: RandomForestClassifier(numTrees=50, featureSubsetStrategy="all", seed=seed),
    "boosting": lambda seed: GBTClassifier(maxIter=20, seed=seed),
}
#: Names of time-series ensembles without a counterpart here.
UNSUPPORTED = frozenset({"hivecotev1", "hivecotev2", "custom"})
#: Models of whole traces, for ``fit_traces``; the last three are pipelines of ``traceml``.
TRACE_MODELS = ("tsf", "rocket", "weighted_ensemble", "minirocket", "boss", "weasel")


def create_model(name: str, seed: int = 42):
    """An estimator by name; those of whole traces are made by ``fit_traces``."""
    if name in UNSUPPORTED or name not in MODELS:
        raise ValueError(f"model not available: {name}")
    return MODELS[name](seed)


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``: n / (2 * class size)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = n.agg(F.sum("__c").alias("__n"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("__n") / (2.0 * F.col("__c"))).drop("__c", "__n")


def fit(df: DataFrame, columns: list[str], name: str, label: str = "label", seed: int = 42) -> PipelineModel:
    rows = weighted(df, label).withColumnRenamed(label, "label") if label != "label" else weighted(df)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), create_model(name, seed)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def fit_evaluate(train: DataFrame, tests: dict[str, DataFrame], columns: list[str], names: list[str], seed: int = 42) -> DataFrame:
    """(model, test_set, metrics...) of every model on every set."""
    out = None
    for name in names:
        model = fit(train, columns, name, seed=seed)
        for test, rows in tests.items():
            row = binary_metrics(predict(model, rows).withColumnRenamed("label", "y"), []).select(F.lit(name).alias("model"), F.lit(test).alias("test_set"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def train_test(df: DataFrame, test_frac: float = 0.25, seed: int = 42, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows), stored: models read them many times over, and what they come from is computed once."""
    folds = materialized(stratified(materialized(df), label, test_frac, "id", seed=seed))
    return folds.where("fold = 'train'").drop("fold"), folds.where("fold = 'test'").drop("fold")


def discriminator(real: DataFrame, synthetic: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """Metrics of a forest that tells real from synthetic rows, on balanced draws; empty below eight rows."""
    real, synthetic = (materialized(df.select("id", *columns)) for df in (real, synthetic))
    n = min(real.count(), synthetic.count())
    spark = real.sparkSession
    if n < 8:
        return spark.createDataFrame([], "n long, accuracy double, balanced_accuracy double, f1 double, mcc double")
    draw = lambda df, y: least_drawn(df, n, "id", seed=seed).select("id", *columns, F.lit(y).alias("label"))
    train, test = train_test(draw(real, 1).unionByName(draw(synthetic, 0)), 0.3, seed)
    scored = binary_metrics(predict(fit(train, columns, "forest", seed=seed), test).withColumnRenamed("label", "y"), [])
    return scored.select("n", "accuracy", "balanced_accuracy", "f1", "mcc")


def normal_equations(df: DataFrame, features: str = "features", label: str = "label") -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Sums for least squares on targets of -1 and 1: one (p+2)-square matrix per task reaches the driver."""

    def run(batches):
        total = None
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy())
            z = np.column_stack([x, np.where(pdf["y"] > 0, 1.0, -1.0), np.ones(len(x))])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            import pandas as pd

            yield pd.DataFrame({"m": [total.ravel()]})

    parts = df.select(F.col(features).alias("x"), F.col(label).alias("y")).mapInPandas(run, "m array<double>").collect()
    total = sum(np.array(r["m"]) for r in parts)
    p = int(round(np.sqrt(len(total))))
    g = total.reshape(p, p)
    n = int(g[-1, -1])
    return g[: p - 2, : p - 2], g[: p - 2, p - 2], g[: p - 2, -1], float(g[p - 2, -1]), n


def ridge(df: DataFrame, alpha: float | None = None, features: str = "features", label: str = "label", sample: int = 20_000) -> tuple[np.ndarray, float, float]:
    """Ridge weights, intercept and alpha on an array column.

    ``alpha`` is chosen by leave-one-out error on at most ``sample`` rows (the least by a hash of their values) if it
    isn't given; weights come from all rows.
    """
    if alpha is None:
        rows = df.select(features, label).orderBy(F.xxhash64(features, label), features, label).limit(sample).toPandas()
        alpha = ridge_classifier(np.stack(rows[features].to_numpy()), rows[label].to_numpy())[2]
    xx, xy, sx, sy, n = normal_equations(df, features, label)
    mean = sx / n
    cov = xx - n * np.outer(mean, mean) + alpha * np.eye(len(mean))
    w = np.linalg.solve(cov, xy - mean * sy)
    return w, float(sy / n - mean @ w), float(alpha)


def ridge_predict(df: DataFrame, weights: np.ndarray, intercept: float, features: str = "features") -> DataFrame:
    w = F.array(*[F.lit(float(v)) for v in weights])
    score = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)
    return df.withColumn("p", (score > 0).cast("int"))


def fit_traces(df: DataFrame, keys: list[str], name: str, label: str = "label", seed: int = 42, n_features: int | None = None, members: tuple[str, ...] = ("tsf", "rocket"), weights: tuple[float, ...] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A model of whole traces (keys..., z, label) by name, as a function that adds ``p`` and ``share``, its probability of 1.

    ``tsf`` is a forest on interval features, ``rocket`` ridge on kernel features (share 0 or 1), and
    ``weighted_ensemble`` the weighted mean of its members' shares (equal weights by default); ``minirocket``,
    ``boss`` and ``weasel`` are ridge on the features of ``traceml`` (share 0 or 1).
    """
    if name not in TRACE_MODELS:
        raise ValueError(f"model not available: {name}")
    if name in TRACE_MODELS[3:]:
        from seqloom.operators.traceml import trace_pipeline

        pipeline = trace_pipeline(name, n_features, seed=seed).fit(df.select("z", F.col(label).alias("label")))
        return lambda rows: rows.join(pipeline.transform(rows.select(*keys, "z")).select(*keys, "p", F.col("p").cast("double").alias("share")), keys)
    if name == "weighted_ensemble":
        each = [(f"__{i}", fit_traces(df, keys, m, label, seed, n_features), w) for i, (m, w) in enumerate(zip(members, weights or (1.0,) * len(members), strict=True))]

        def vote(rows: DataFrame) -> DataFrame:
            out = rows
            for c, model, _ in each:
                out = out.join(model(rows).select(*keys, F.col("share").alias(c)), keys)
            out = out.withColumn("share", sum((F.col(c) * w for c, _, w in each), F.lit(0.0)) / sum(w for _, _, w in each))
            return out.drop(*[c for c, _, _ in each]).withColumn("p", (F.col("share") > 0.5).cast("int"))

        return vote
    if name == "tsf":
        features = lambda rows: interval_features(rows, keys, n_features or 32, seed)
    else:
        features = lambda rows: kernel_features(rows, keys, n_features or 100, seed)
    known = features(df).join(df.select(*keys, F.col(label).alias("label")), keys)
    if name == "rocket":
        w, b, _ = ridge(known)
        told = lambda rows: ridge_predict(features(rows), w, b).withColumn("share", F.col("p").cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array

        forest = create_model("forest", seed).fit(vectors(known, "features"))
        told = lambda rows: forest.transform(vectors(features(rows), "features")).select(*keys, F.col("prediction").cast("int").alias("p"), vector_to_array("probability")[1].alias("share"))
    return lambda rows: rows.join(told(rows).select(*keys, "p", "share"), keys)


def save_run(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_run(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def vectors(df: DataFrame, column: str = "v") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def pca(df: DataFrame, k: int, column: str = "v") -> DataFrame:
    """Scores on the first k components of centred vectors, over all rows."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    stages = [StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False), PCA(k=k, inputCol="centred", outputCol="scores")]
    return Pipeline(stages=stages).fit(v := vectors(df, column)).transform(v).withColumn("scores", vector_to_array("scores")).drop("features", "centred")


def kmeans(df: DataFrame, k: int | None = None, max_k: int = 5, column: str = "v", seed: int = 0) -> DataFrame:
    """``label`` by k-means over all rows; k by the silhouette of squared distances if it isn't given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows, best = vectors(df, column), None
    for n in [k] if k else range(2, max_k + 1):
        out = KMeans(k=n, seed=seed).fit(rows).transform(rows)
        score = 0.0 if k else ClusteringEvaluator().evaluate(out)
        if best is None or score > best[0]:
            best = (score, out)
    return best[1].withColumnRenamed("prediction", "label").drop("features")


def mixture(df: DataFrame, k: int | None = None, max_k: int = 4, column: str = "v", seed: int = 0) -> DataFrame:
    """``label`` and ``probability`` by a Gaussian mixture over all rows; k by BIC if it isn't given."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    rows, best = vectors(df, column), None
    n, p = rows.count(), len(rows.first()["features"])
    for c in [k] if k else range(1, max_k + 1):
        model = GaussianMixture(k=c, seed=seed).fit(rows)
        bic = -2 * model.summary.logLikelihood + (c * p + c * p * (p + 1) / 2 + c - 1) * np.log(n)
        if best is None or bic < best[0]:
            best = (bic, model)
    return best[1].transform(rows).withColumnRenamed("prediction", "label").withColumn("probability", vector_to_array("probability")).drop("features")


def learning_curve(train: DataFrame, test: DataFrame, columns: list[str], name: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """Metrics on nested shares of the training rows, in order of a hash."""
    n, out = train.count(), None
    for f in fractions:
        part = least_drawn(train, max(2, int(f * n)), "id", seed=seed)
        row = fit_evaluate(part, {"test": test}, columns, [name], seed).withColumn("fraction", F.lit(float(f)))
        out = row if out is None else out.unionByName(row)
    return out


def available(spark: SparkSession) -> DataFrame:
    """(name, available) of every model name."""
    return spark.createDataFrame([(n, True) for n in sorted([*MODELS, *TRACE_MODELS])] + [(n, False) for n in sorted(UNSUPPORTED)], "name string, available boolean")
