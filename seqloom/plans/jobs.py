"""End-to-end jobs: region evaluation by many pipelines, ensembles, and full-trace scoring.

All experiments of a job run as one DataFrame plan; a pipeline is a named choice of
representation, reduction and clustering. Failures of a group are rows with an ``error``.
"""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import curves, group, metrics
from seqloom.operators.trace import rule_flags
from seqloom.runtime import materialized

REPRESENTATIONS = tuple(curves.REPRESENTATIONS)
REDUCTIONS = ("none", "fpca", "umap", "tsne", "isomap", "lle", "laplacian", "dtw_mds")
CLUSTERINGS = ("kmeans", "gmm", "hierarchical", "dbscan", "hdbscan", "optics", "spectral")


@dataclass(frozen=True)
class Pipeline:
    """One way from curves to clusters, or (``members``) a vote of such ways; ``extra`` holds options that aren't fields, with which no pipeline runs."""

    name: str
    representation: str = "common_grid_intersection"
    reduction: str = "none"
    clustering: str = "kmeans"
    n_components: int = 10
    n_grid: int = 200
    z_thresh: float = 3.0
    use_full_extension_range: bool = False
    n_clusters: int | None = None
    max_k: int = 2
    n_init: int = 10
    outlier_z: float | None = 3.0
    min_cluster_size: int = 3
    min_samples: int = 5
    eps: float | None = None
    linkage: str = "ward"
    seed: int = 0
    n_neighbors: int | None = None
    members: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


#: Options by the names that registries use.
ALIASES = {
    "dim_reduction": "reduction", "dim_reduction_n_components": "n_components", "dbscan_min_samples": "min_samples", "dbscan_eps": "eps",
    "hierarchical_linkage": "linkage", "random_state": "seed", "ensemble_pipelines": "members",
}


def pipeline_from(options: dict) -> Pipeline:
    """A pipeline from a registry entry; keys that aren't fields go to ``extra``."""
    known = {f for f in Pipeline.__dataclass_fields__ if f != "extra"}
    named = {ALIASES.get(k, k): v for k, v in options.items()}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in named.items() if k in known}
    return Pipeline(**own, extra={k: v for k, v in named.items() if k not in known})


def registry() -> dict[str, Pipeline]:
    """All combinations of representation, reduction and clustering, by name."""
    return {f"{r}-{d}-{c}": Pipeline(f"{r}-{d}-{c}", r, d, c) for r, d, c in product(REPRESENTATIONS, REDUCTIONS, CLUSTERINGS)}


def read_registry(spark: SparkSession, path: str) -> dict[str, Pipeline]:
    """Pipelines of a JSON registry: a list of entries, or of names of the built-in ones."""
    rows = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    built = registry()
    found = [built[r] if isinstance(r, str) else pipeline_from(r) for r in rows]
    return {p.name: p for p in found}


PRESETS = {
    "manifold_kmeans": Pipeline("manifold_kmeans", "percentile_grid", "umap", "kmeans", 2),
    "manifold_dbscan": Pipeline("manifold_dbscan", "percentile_grid", "umap", "dbscan", 2),
    "partitioned_kmeans": Pipeline("partitioned_kmeans", "percentile_grid", "none", "kmeans"),
}


def overlaid(base: Pipeline, **params) -> Pipeline:
    return pipeline_from({**{k: v for k, v in asdict(base).items() if k != "extra"}, **base.extra, **params})


def features(rows: DataFrame, keys: list[str], pipeline: Pipeline) -> DataFrame:
    """(keys, v): the vectors that a pipeline clusters."""
    return curves.represented(rows, keys, pipeline.representation, pipeline.n_grid, z_thresh=pipeline.z_thresh, union=pipeline.use_full_extension_range)


def clustered(rows: DataFrame, keys: list[str], pipeline: Pipeline, vectors: DataFrame | None = None, measured: bool = True) -> DataFrame:
    """(keys, label, error, silhouette) of curves (keys..., frame, x, f) under a pipeline; the last key is the bead. Unmeasured silhouettes are null."""
    if pipeline.extra:
        raise ValueError(f"{pipeline.name}: unknown options {sorted(pipeline.extra)}")
    *outer, bead = keys
    options = {"n_neighbors": pipeline.n_neighbors} if pipeline.n_neighbors else {}
    out = group.clustered(
        features(rows, keys, pipeline) if vectors is None else vectors, outer, bead, pipeline.clustering, reduction=pipeline.reduction, n_components=pipeline.n_components,
        reduction_options=options, measured=measured, n_clusters=pipeline.n_clusters, max_k=pipeline.max_k, seed=pipeline.seed, outlier_z=pipeline.outlier_z,
        min_cluster_size=pipeline.min_cluster_size, min_samples=pipeline.min_samples, eps=pipeline.eps, linkage=pipeline.linkage, n_init=pipeline.n_init,
    )
    return out if measured else out.withColumn("silhouette", F.lit(None).cast("double"))


def good_by_group(labelled: DataFrame, outer: list[str], y: str = "y") -> DataFrame:
    """``labelled`` (outer, y, label) with ``p``: 1 in each group's best cluster, else 0; rows without a label get 0."""
    per = labelled.where("label >= 0").groupBy(*outer, "label").agg(F.count_if(F.col(y) == 1).alias("g"), F.count_if(F.col(y) != 1).alias("b"))
    # accuracy of a cluster as "good" differs from another's by its good less its bad members only
    best = per.groupBy(*outer).agg(F.max_by("label", F.struct(F.col("g") - F.col("b"), -F.col("label"))).alias("__best"))
    return labelled.join(best, outer, "left").withColumn("p", F.when(F.col("label") == F.col("__best"), 1).otherwise(0)).drop("__best")


def labelled(rows: DataFrame, keys: list[str], pipelines: list[Pipeline], measured: bool = True) -> DataFrame:
    """(pipeline, keys, label, error, silhouette) of every pipeline: curves of several forms and each set of vectors are made and stored once, as are the labels."""
    made: dict[tuple, DataFrame] = {}
    out = None

    def form_of(p: Pipeline) -> tuple:
        on_grid = (p.z_thresh, p.use_full_extension_range) if p.representation in curves.ON_COMMON_GRID else ()
        return ("common_grid" if on_grid else p.representation, p.n_grid, *on_grid)

    if len({form_of(p) for p in pipelines}) > 1:
        rows = materialized(rows)
    for p in pipelines:
        form = form_of(p)
        if form not in made:
            made[form] = materialized(features(rows, keys, p))
        part = clustered(rows, keys, p, made[form], measured).select(F.lit(p.name).alias("pipeline"), "*")
        out = part if out is None else out.unionByName(part)
    return materialized(out)


def with_members(pipelines: list[Pipeline], known: dict[str, Pipeline] | None = None) -> tuple[list[Pipeline], dict[str, list[str]]]:
    """The single pipelines that run, and the members of each ensemble; members are looked up among ``pipelines``, then ``known``."""
    named = (known or {}) | {p.name: p for p in pipelines}
    votes = {p.name: list(p.members) for p in pipelines if p.members}
    unknown = {m for members in votes.values() for m in members if m not in named or named[m].members}
    if unknown:
        raise ValueError(f"ensemble of unknown pipelines: {sorted(unknown)}")
    single = {p.name: p for p in pipelines if not p.members} | {m: named[m] for members in votes.values() for m in members}
    return list(single.values()), votes


def predicted(rows: DataFrame, truth: DataFrame, keys: list[str], pipelines: list[Pipeline], known: dict[str, Pipeline] | None = None, measured: bool = True) -> DataFrame:
    """(pipeline, keys, y, label, p, error, silhouette) of every bead in ``truth`` under every pipeline.

    Of an ensemble, ``p`` and ``label`` (0 good, 1 not) are its members' vote; a bead that a member left out is not good.
    A group in which a member failed has no vote: its beads have the failed members' errors instead.
    """
    single, votes = with_members(pipelines, known)
    labels = labelled(rows, keys, single, measured)
    spark = rows.sparkSession
    names = spark.createDataFrame([(p.name,) for p in single], "pipeline string")
    every = truth.crossJoin(F.broadcast(names)).join(labels, ["pipeline", *keys], "left")
    told = materialized(good_by_group(every, ["pipeline", *keys[:-1]]).select("pipeline", *keys, "y", "label", "p", "error", "silhouette"))
    asked = [p.name for p in pipelines if not p.members]
    out = told.where(F.col("pipeline").isin(asked))
    for name, members in votes.items():
        asked_of = told.where(F.col("pipeline").isin(members))
        voted = metrics.votes(asked_of.where("label IS NOT NULL AND error IS NULL"), keys, len(members)).withColumnRenamed("vote", "p")
        each = asked_of.where("error IS NOT NULL").groupBy(*keys[:-1], "pipeline").agg(F.min("error").alias("error"))
        failed = each.groupBy(*keys[:-1]).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "pipeline", "error"))), "; ").alias("error"))
        own = metrics.with_default(truth, voted, keys, failed=failed)
        out = out.unionByName(own.select(F.lit(name).alias("pipeline"), *keys, "y", (1 - F.col("p")).cast("int").alias("label"), "p", "error", F.lit(None).cast("double").alias("silhouette")))
    return out


def evaluate(rows: DataFrame, truth: DataFrame, keys: list[str], pipelines: list[Pipeline], known: dict[str, Pipeline] | None = None) -> DataFrame:
    """(pipeline, outer keys, counts, accuracy, n_failed): every pipeline and ensemble over every group; a group that failed has its size only."""
    told, by = predicted(rows, truth, keys, pipelines, known, measured=False), ["pipeline", *keys[:-1]]
    failed = told.groupBy(*by).agg(F.count("error").alias("n_failed"))
    scored = metrics.confusion(told, by).join(failed, by)
    return scored.withColumns({c: F.when(F.col("n_failed") == 0, F.col(c)) for c in ("tp", "tn", "fp", "fn", "correct", "accuracy")})


#: Columns of a result row, in order.
RESULT_COLUMNS = (
    "path rel_path experiment_id source representation dim_reduction clustering accuracy ari nmi silhouette n_beads n_extensions n_clusters cluster_counts n_outliers "
    "n_good_in_clustering n_bad_in_clustering tp tn fp fn chosen_cluster_size n_good_real n_bad_real n_coilable_real n_uncoilable_real n_bad_class_real error"
).split()


def extension_rows(told: DataFrame, by: list[str]) -> DataFrame:
    """Scores of each group of ``told`` (by, y, label, p, error, silhouette); groups of one bead or an error have none."""
    p, y = F.col("p"), F.col("y")
    sizes = told.where("label is not null").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("k"))
    clusters = sizes.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") >= 0, F.struct("label", "k")))), lambda x: x["k"].cast("string")), ",").alias("cluster_counts"),
        F.count_if(F.col("label") >= 0).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("k"))), F.lit(0)).alias("n_outliers"),
    )
    counts = metrics.confusion(told, by).withColumnRenamed("n", "n_beads").drop("correct")
    extra = told.groupBy(*by).agg(
        F.count_if(p == 1).alias("chosen_cluster_size"), F.count_if(y == 1).alias("n_good_real"), F.count_if(y != 1).alias("n_bad_real"), F.max("silhouette").alias("silhouette"), F.max("error").alias("error")
    )
    out = counts.join(extra, by).join(metrics.agreement(told, group=by), by).join(clusters, by, "left")
    scored = F.col("error").isNull() & (F.col("n_beads") >= 2)
    for c in ("accuracy", "ari", "nmi", "tp", "tn", "fp", "fn", "chosen_cluster_size"):
        out = out.withColumn(c, F.when(scored, F.col(c)))
    return out.withColumn("n_good_in_clustering", F.when(scored, F.col("n_good_real"))).withColumn("n_bad_in_clustering", F.when(scored, F.col("n_bad_real")))


def result_rows(told: DataFrame, experiment: list[str], extension: str, extension_index: int = -1) -> DataFrame:
    """One row (pipeline, experiment, n_extensions, scores) of ``told`` (see ``predicted``) for each pipeline and experiment.

    The extension of number ``extension_index`` (the last one beyond) gives the scores; a negative
    number gives the means of accuracy, agreement and silhouette, the sum of beads and all else
    of the first extension.
    """
    by = ["pipeline", *experiment]
    rows = extension_rows(told, [*by, extension])
    values = [c for c in rows.columns if c not in (*by, extension)]
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(extension).alias("at"), F.struct(*values).alias("row")))).alias("all"), *[F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "ari", "nmi", "silhouette")], F.sum("n_beads").alias("sum_beads"))
    at = F.lit(0) if extension_index < 0 else F.least(F.lit(extension_index), F.size("all") - 1)
    picked = packed.withColumn("row", F.get("all", at)["row"]).withColumn("n_extensions", F.size("all").cast("long"))
    if extension_index < 0:
        mean = {c: F.col(f"mean_{c}") for c in ("accuracy", "ari", "nmi", "silhouette")} | {"n_beads": F.col("sum_beads")}
        return picked.select(*by, "n_extensions", *[mean.get(c, F.col("row")[c]).alias(c) for c in values])
    return picked.select(*by, "n_extensions", *[F.col("row")[c].alias(c) for c in values])


def result_table(results: DataFrame, pipelines: list[Pipeline], experiments: DataFrame, experiment: list[str]) -> DataFrame:
    """``result_rows`` with all of ``RESULT_COLUMNS``; ``experiments`` has the experiment's keys, path, rel_path, experiment_id and source."""
    spark = results.sparkSession
    told = spark.createDataFrame([(p.name, p.representation, p.reduction, p.clustering) for p in pipelines], "pipeline string, representation string, dim_reduction string, clustering string")
    joined = results.join(F.broadcast(told), "pipeline").join(experiments, experiment)
    none = F.lit(None).cast("long")
    have = set(joined.columns)
    return joined.select("pipeline", *[F.col(c) if c in have else none.alias(c) for c in RESULT_COLUMNS])


def drawn(distributions: dict[str, list], n_iter: int = 20, seed: int = 42) -> list[dict]:
    """``n_iter`` seeded random combinations of options, one value of each."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in distributions.items()} for _ in range(n_iter)]


def tuned(rows: DataFrame, truth: DataFrame, keys: list[str], bases: list[tuple[Pipeline, list[dict]]]) -> tuple[DataFrame, DataFrame]:
    """Runs (base, pipeline, params, score) of every base under each of its options (a grid, or ``drawn``), and their summary.

    The score is the mean accuracy over groups; it is null where a run failed in every group.
    """
    runs = [(base.name, overlaid(base, **params, name=f"{base.name}#{i}"), json.dumps(params, sort_keys=True)) for base, grid in bases for i, params in enumerate(grid)]
    scored = evaluate(rows, truth, keys, [p for _, p, _ in runs])
    groups = truth.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("n_beads"))
    whole = scored.join(groups, keys[:-1]).groupBy("pipeline").agg(F.avg(F.when(F.coalesce("n_failed", F.lit(0)) < F.col("n_beads"), F.col("accuracy"))).alias("score"))
    names = rows.sparkSession.createDataFrame([(b, p.name, t) for b, p, t in runs], "base string, pipeline string, params string")
    found = names.join(whole, "pipeline", "left").select("base", "pipeline", "params", "score")
    return found, metrics.tuning_summary(found, ["base"], "params", "score")


def ensemble(rows: DataFrame, truth: DataFrame, keys: list[str], members: list[Pipeline]) -> DataFrame:
    """(keys, y, p, error): the members' vote on each bead; beads that a member dropped get 0, those of a group in which one failed get its error and no vote."""
    whole = Pipeline("vote", members=tuple(p.name for p in members))
    return predicted(rows, truth, keys, [whole], {p.name: p for p in members}, measured=False).select(*keys, "y", "p", "error")


def score_rules(traces: DataFrame, truth: DataFrame, keys: list[str], experiment: list[str], **thresholds) -> DataFrame:
    """Result rows of the rules per experiment."""
    flags = rule_flags(traces, keys, **thresholds).select(*keys, F.col("usable").alias("p"))
    return metrics.confusion(metrics.with_default(truth, flags, keys), experiment).withColumn("method", F.lit("rules"))
