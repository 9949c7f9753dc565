"""Scores of predictions and clusterings, votes and summaries.

Rows carry ``y`` (truth) and ``p`` (prediction or cluster label); ``group`` names what is
scored apart. Everything is built from counts, so a group's size doesn't matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ONE = F.lit


def share(a: Column, b: Column, none: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))


def confusion(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """tp, tn, fp, fn (1 is good), n and accuracy."""
    yes, told = F.col(y) == 1, F.col(p) == 1
    agg = df.groupBy(*group).agg(
        F.count_if(yes & told).alias("tp"), F.count_if(~yes & ~told).alias("tn"), F.count_if(~yes & told).alias("fp"), F.count_if(yes & ~told).alias("fn"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(p)).alias("correct")
    )
    return agg.withColumn("accuracy", share(F.col("correct"), F.col("n")))


def binary_metrics(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 and Matthews correlation; undefined ones are 0."""
    return scores_of_counts(confusion(df, group, y, p))


def scores_of_counts(c: DataFrame) -> DataFrame:
    """The metrics of ``binary_metrics`` from columns tp, tn, fp, fn and n."""
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    precision, recall, specificity = share(tp, tp + fp), share(tp, tp + fn), share(tn, tn + fp)
    balanced = F.when((tp + fn > 0) & (tn + fp > 0), (recall + specificity) / 2).when(tp + fn > 0, recall).otherwise(specificity)
    mcc = share(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return (
        c.withColumn("accuracy", share(tp + tn, F.col("n")))
        .withColumn("balanced_accuracy", balanced)
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", share(2 * precision * recall, precision + recall))
        .withColumn("mcc", mcc)
    )


def contingency(df: DataFrame, y: str = "y", p: str = "p", group: list[str] | None = None) -> DataFrame:
    """Cell, row, column and total counts by grouping sets: (group, y, p, gy, gp, n)."""
    own = [F.col(c) for c in group or []]
    sets = df.groupingSets([[*own, F.col(y), F.col(p)], [*own, F.col(y)], [*own, F.col(p)], own], *own, F.col(y), F.col(p))
    return sets.agg(F.grouping(y).alias("gy"), F.grouping(p).alias("gp"), F.count(F.lit(1)).cast("double").alias("n"))


def agreement(df: DataFrame, y: str = "y", p: str = "p", group: list[str] | None = None) -> DataFrame:
    """(group, ari, nmi): adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings; equal trivial ones score 1."""
    group = group or []
    t = contingency(df, y, p, group)
    cell, row, col, whole = ((F.col("gy") == a) & (F.col("gp") == b) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))
    n = F.col("n")
    pairs = n * (n - 1.0) / 2.0
    total = F.max(F.when(whole, n))
    sums = t.groupBy(*group).agg(
        F.sum(F.when(cell, pairs)).alias("s"), F.sum(F.when(row, pairs)).alias("a"), F.sum(F.when(col, pairs)).alias("b"), F.max(F.when(whole, pairs)).alias("t"),
        total.alias("n"), F.sum(F.when(cell, n * F.log(n))).alias("lc"), F.sum(F.when(row, n * F.log(n))).alias("lr"), F.sum(F.when(col, n * F.log(n))).alias("lk"),
    )
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("t"))
    most = (F.col("a") + F.col("b")) / 2.0
    ari = F.when(most == expected, F.lit(1.0)).otherwise(F.try_divide(F.col("s") - expected, most - expected))
    log_n = F.log("n")
    hy, hp, joint = log_n - F.col("lr") / F.col("n"), log_n - F.col("lk") / F.col("n"), log_n - F.col("lc") / F.col("n")
    nmi = F.when((hy < 1e-15) & (hp < 1e-15), F.lit(1.0)).otherwise(F.try_divide(2.0 * (hy + hp - joint), hy + hp))
    return sums.select(*group, F.coalesce(ari, F.lit(1.0)).alias("ari"), nmi.alias("nmi"))


def good_cluster(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(cluster, accuracy): the cluster that best serves as "good"; ties take the least id. Outliers (-1) are never it."""
    label = df.groupBy(p).agg(F.count_if(F.col(y) == 1).alias("good"), F.count(F.lit(1)).alias("size"))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("all_good"))
    scored = label.where(F.col(p) >= 0).join(F.broadcast(whole))
    right = F.col("good") + (F.col("n") - F.col("all_good")) - (F.col("size") - F.col("good"))
    scored = scored.withColumn("accuracy", share(right, F.col("n")))
    return scored.agg(F.max_by(F.struct(F.col(p).alias("cluster"), "accuracy"), F.struct(F.col("accuracy"), -F.col(p))).alias("b")).select("b.cluster", "b.accuracy")


def good_cluster_predictions(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``df`` with ``predicted``: 1 in the good cluster, else 0."""
    best = good_cluster(df, y, p).select(F.col("cluster").alias("__c"))
    return df.join(F.broadcast(best)).withColumn("predicted", F.when(F.col(p) == F.col("__c"), 1).otherwise(0)).drop("__c")


def three_class_map(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(cluster, class, accuracy): the best assignment of the three least cluster ids to classes; others are class 2."""
    ids = df.where(F.col(p) >= 0).select(F.col(p).alias("c")).distinct()
    ranked = ids.withColumn("k", F.row_number().over(W.orderBy("c")) - 1)
    n = ids.count()
    pool = {0: [()], 1: [(0,), (1,)], 2: [(0, 1), (1, 0)]}.get(n, list(permutations((0, 1, 2))))
    spark = df.sparkSession
    table = spark.createDataFrame([(i, k, c) for i, perm in enumerate(pool) for k, c in enumerate(perm)] or [(0, -1, 2)], "perm int, k int, cls int")
    perms = spark.createDataFrame([(i,) for i in range(len(pool))], "perm int")
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("c")).agg(F.count(F.lit(1)).alias("m")).join(ranked, "c", "left")
    mapped = cells.join(F.broadcast(perms)).join(F.broadcast(table), ["perm", "k"], "left").withColumn("cls", F.coalesce("cls", F.lit(2)))
    scored = mapped.groupBy("perm").agg((F.sum(F.when(F.col("y") == F.col("cls"), F.col("m")).otherwise(0)) / F.sum("m")).alias("accuracy"))
    best = scored.agg(F.max_by(F.struct("perm", "accuracy"), F.struct(F.col("accuracy"), -F.col("perm"))).alias("b")).select("b.perm", "b.accuracy")
    clusters = df.select(F.col(p).alias("c")).distinct().join(ranked, "c", "left")
    return clusters.join(F.broadcast(best)).join(F.broadcast(table), ["perm", "k"], "left").select(F.col("c").alias("cluster"), F.coalesce("cls", F.lit(2)).alias("class"), "accuracy")


def packed_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Counts, accuracy, agreement and chosen size in one row; none below two rows."""
    c = confusion(df, [], y, p).where("n >= 2")
    extra = df.agg(F.count_if(F.col(y) == 1).alias("n_good"), F.count_if(F.col(y) != 1).alias("n_bad"), F.count_if(F.col(p) == 1).alias("chosen_cluster_size"))
    return c.join(extra).join(agreement(df, y, p))


def silhouette(points: DataFrame, group: list[str], id_col: str = "id", v: str = "v", label: str = "label") -> DataFrame:
    """Mean silhouette of each group by Euclidean distance.

    It needs the distances between a group's points by definition; a group is one region's beads.
    """
    a = points.select(*group, F.col(id_col).alias("i"), F.col(v).alias("a"), F.col(label).alias("li"))
    b = points.select(*group, F.col(id_col).alias("j"), F.col(v).alias("b"), F.col(label).alias("lj"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    mean = a.join(b, group).where(F.col("i") != F.col("j")).groupBy(*group, "i", "li", "lj").agg(F.avg(F.sqrt(gap)).alias("m"))
    per = mean.groupBy(*group, "i", "li").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("m"))).alias("own"), F.min(F.when(F.col("li") != F.col("lj"), F.col("m"))).alias("other"))
    s = F.when(F.col("own").isNull(), F.lit(0.0)).otherwise(share(F.col("other") - F.col("own"), F.greatest("own", "other")))
    return per.groupBy(*group).agg(F.avg(s).alias("silhouette"))


def votes(df: DataFrame, keys: list[str], members: int, p: str = "p") -> DataFrame:
    """(keys, vote): all members must have voted; two classes by at least half, more by count, then the least class."""
    per = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("c"))
    agg = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.max(p).alias("top"), F.min(p).alias("low"), F.sum(F.col("c") * F.col(p)).alias("s"), F.max_by(p, F.struct(F.col("c"), -F.col(p))).alias("mode"))
    vote = F.when((F.col("low") >= 0) & (F.col("top") <= 1), F.when(F.col("s") >= (members + 1) // 2, 1).otherwise(0)).otherwise(F.col("mode"))
    return agg.where(F.col("n") == members).select(*keys, vote.cast("int").alias("vote"))


def majority(df: DataFrame, keys: list[str], everyone: DataFrame | None = None, p: str = "p") -> DataFrame:
    """(keys, vote): the commonest value, ties to the least; those of ``everyone`` without rows get 0."""
    per = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(*keys).agg(F.max_by(p, F.struct(F.col("c"), -F.col(p))).alias("vote"))
    return out if everyone is None else everyone.join(out, keys, "left").withColumn("vote", F.coalesce("vote", F.lit(0)))


def sum_vote(df: DataFrame, keys: list[str], everyone: DataFrame | None = None, p: str = "p", fraction: float = 0.5) -> DataFrame:
    """(keys, vote): 1 if the values' sum reaches ``fraction`` of their number."""
    out = df.groupBy(*keys).agg(F.when(F.sum(p) >= fraction * F.count(F.lit(1)), 1).otherwise(0).alias("vote"))
    return out if everyone is None else everyone.join(out, keys, "left").withColumn("vote", F.coalesce("vote", F.lit(0)))


def with_default(truth: DataFrame, predictions: DataFrame, keys: list[str], default: int = 0, p: str = "p", failed: DataFrame | None = None) -> DataFrame:
    """Every row of truth with its prediction, or the default class where it has none.

    ``failed`` (some of the keys, error) names what could not be predicted: its rows have that error and no prediction.
    """
    told = truth.join(predictions, keys, "left")
    value = F.coalesce(p, F.lit(default))
    if failed is None:
        return told.withColumn(p, value)
    return told.join(failed, [k for k in keys if k in failed.columns], "left").withColumn(p, F.when(F.col("error").isNull(), value))


def merged_replicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean accuracy (six decimals, as text) and half-even mean of correct per key; other columns of the first row.

    Accuracies are summed and divided as decimals, so that a mean halfway between two texts goes up whatever
    the order of its rows; a key with values that aren't decimals of that size (NaN, say) takes the mean of doubles.
    """
    rest = [c for c in df.columns if c not in (*keys, "accuracy", "correct", order)]
    first = [F.min_by(c, order).alias(c) for c in rest]
    exact = F.col("accuracy").try_cast("decimal(28,18)")
    mean = F.when(F.count(exact) == F.count("accuracy"), F.round(F.sum(exact) / F.count(exact), 6).cast("decimal(38,6)").cast("string")).otherwise(F.format_string("%.6f", F.avg("accuracy")))
    return df.groupBy(*keys).agg(mean.alias("accuracy"), F.bround(F.avg("correct")).cast("long").alias("correct"), *first)


def rolled_up(df: DataFrame, group: list[str], index: int, order: list[str], means: list[str], total: str, firsts: list[str]) -> DataFrame:
    """One row per group: the row at ``index`` (or the last), or with a negative index means, a sum, and the first row's counts."""
    w = W.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("__rn", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*group)))
    if index >= 0:
        return rows.where(F.col("__rn") == F.least(F.lit(index), F.col("__n") - 1)).select(*group, *means, total, *firsts)
    return rows.groupBy(*group).agg(*[F.avg(c).alias(c) for c in means], F.sum(total).alias(total), *[F.max(F.when(F.col("__rn") == 0, F.col(c))).alias(c) for c in firsts])


def tuning_summary(df: DataFrame, group: list[str], params: str, score: str) -> DataFrame:
    """Least, greatest and mean score, the best parameters, and runs that succeeded or failed."""
    ok = F.col(score).isNotNull()
    return df.groupBy(*group).agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.max_by(params, F.struct(F.col(score), F.col(params))).alias("best_params"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed")
    )


def label_counts(df: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """Cluster sizes as ``n0,n1,...`` in order of label, and the number of outliers."""
    per = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))
    packed = F.array_sort(F.collect_list(F.when(F.col(label) >= 0, F.struct(F.col(label).alias("l"), "n"))))
    return per.groupBy(*group).agg(F.concat_ws(",", F.transform(packed, lambda s: s["n"].cast("string"))).alias("counts"), F.sum(F.when(F.col(label) < 0, F.col("n")).otherwise(0)).alias("outliers"))


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL or NaN entries become the column's median, 0 if it has none."""
    clean = df.select(*[c for c in df.columns if c not in columns], *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    medians = clean.agg(*[F.median(c).alias(f"__{c}") for c in columns])
    out = clean.join(F.broadcast(medians))
    return out.select(*[c for c in clean.columns if c not in columns], *[F.coalesce(c, f"__{c}", F.lit(0.0)).alias(c) for c in columns])
