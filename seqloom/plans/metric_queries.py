"""Queries of the scores, votes and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import metrics as op
from seqloom.plans.fixtures import rounded
from seqloom.runtime import table


def labels(s, d):
    return table(s, d, "labels").select((F.col("doc_id") % 5).alias("grp"), F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("toxic").alias("p"))


L = "l AS (SELECT doc_id % 5 AS grp, doc_id AS id, quality AS y, toxic AS p FROM labels)"


def clusters(s, d):
    """Truth and cluster id (outliers are -1) of each vector."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("y"), (F.when(F.col("label") > 6, -1).otherwise(F.col("label") % 4)).alias("p"))


C = "c AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN label > 6 THEN -1 ELSE label % 4 END AS p FROM embeddings)"


def segments(s, d):
    """Predictions of many segments a bead."""
    return table(s, d, "events").select(F.col("user_id").alias("bead"), (F.col("event_id") % 3).cast("int").alias("p"))


S = "s AS (SELECT user_id AS bead, CAST(event_id % 3 AS INT) AS p FROM events)"


def replicates(s, d):
    li = table(s, d, "lineitem")
    order = F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    return li.select(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("experiment_id"), F.col("l_discount").alias("accuracy"), F.col("l_quantity").alias("correct"), F.col("l_linestatus").alias("source"), order.alias("row_order"))


LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"]


def beads(s, d):
    return table(s, d, "customer").select((F.col("c_custkey") % 200).alias("bead")).distinct()


_CONF = "CAST(count_if(y = 1 AND p = 1) AS BIGINT) AS tp, CAST(count_if(y <> 1 AND p <> 1) AS BIGINT) AS tn, CAST(count_if(y <> 1 AND p = 1) AS BIGINT) AS fp, CAST(count_if(y = 1 AND p <> 1) AS BIGINT) AS fn, count(*) AS n, CAST(count_if(y = p) AS BIGINT) AS correct"
_BIN = f"""k AS (SELECT grp, {_CONF} FROM l GROUP BY grp),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS sp FROM k)"""
_AGREE = """t AS (SELECT y, p, GROUPING(y) AS gy, GROUPING(p) AS gp, count(*)::DOUBLE AS n FROM {src} GROUP BY GROUPING SETS ((y, p), (y), (p), ())),
u AS (SELECT sum(CASE WHEN gy = 0 AND gp = 0 THEN n * (n - 1) / 2 END) AS s, sum(CASE WHEN gy = 0 AND gp = 1 THEN n * (n - 1) / 2 END) AS a, sum(CASE WHEN gy = 1 AND gp = 0 THEN n * (n - 1) / 2 END) AS b,
  max(CASE WHEN gy = 1 AND gp = 1 THEN n * (n - 1) / 2 END) AS t, max(n) AS n, sum(CASE WHEN gy = 0 AND gp = 0 THEN n * ln(n) END) AS lc, sum(CASE WHEN gy = 0 AND gp = 1 THEN n * ln(n) END) AS lr, sum(CASE WHEN gy = 1 AND gp = 0 THEN n * ln(n) END) AS lk FROM t),
ag AS (SELECT round((s - a * b / t) / ((a + b) / 2 - a * b / t), 8) AS ari, round(2 * ((ln(n) - lr / n) + (ln(n) - lk / n) - (ln(n) - lc / n)) / ((ln(n) - lr / n) + (ln(n) - lk / n)), 8) AS nmi FROM u)"""
_BEST = """g AS (SELECT p AS cluster, (count_if(y = 1) + (SELECT count_if(y <> 1) FROM c) - count_if(y <> 1)) / (SELECT count(*) FROM c)::DOUBLE AS accuracy FROM c WHERE p >= 0 GROUP BY p),
b AS (SELECT cluster, accuracy FROM g ORDER BY accuracy DESC, cluster LIMIT 1)"""


def _sil(s, d):
    pts = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") % 3).alias("label"))
    return rounded(op.silhouette(pts, ["grp"]))


def _member_votes(s, d, classes):
    """Three members' predictions of each order."""
    o = table(s, d, "orders")
    p = F.array(F.col("o_orderkey") % classes, F.col("o_custkey") % classes, F.floor(F.col("o_totalprice")) % classes)
    return o.select(F.col("o_orderkey").alias("bead"), F.explode(p).alias("p")).withColumn("p", F.col("p").cast("int"))


def _imputed(s, d):
    rows = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("a"), F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_size")).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    return rounded(op.imputed(rows, ["a", "b", "c"]))


QUERIES = {
    "confusion": (lambda s, d: rounded(op.confusion(labels(s, d), ["grp"])), f"WITH {L}, k AS (SELECT grp, {_CONF} FROM l GROUP BY grp) SELECT *, round(coalesce(correct / nullif(n, 0)::DOUBLE, 0), 6) AS accuracy FROM k"),
    "binary_metrics": (
        lambda s, d: rounded(op.binary_metrics(labels(s, d), ["grp"])),
        f"""WITH {L}, {_BIN} SELECT grp, tp, tn, fp, fn, n, correct, round(correct / n::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (re + sp) / 2 WHEN tp + fn > 0 THEN re ELSE sp END, 6) AS balanced_accuracy,
round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM r""",
    ),
    "agreement": (lambda s, d: rounded(op.agreement(labels(s, d)), digits=8), f"WITH {L}, " + _AGREE.format(src="l") + " SELECT * FROM ag"),
    "cluster_agreement": (lambda s, d: rounded(op.agreement(clusters(s, d)), digits=8), f"WITH {C}, " + _AGREE.format(src="c") + " SELECT * FROM ag"),
    "good_cluster": (lambda s, d: rounded(op.good_cluster(clusters(s, d))), f"WITH {C}, {_BEST} SELECT cluster, round(accuracy, 6) AS accuracy FROM b"),
    "good_cluster_predictions": (lambda s, d: op.good_cluster_predictions(clusters(s, d)), f"WITH {C}, {_BEST} SELECT id, y, p, CASE WHEN p = b.cluster THEN 1 ELSE 0 END AS predicted FROM c, b"),
    "three_class_map": (
        lambda s, d: rounded(op.three_class_map(clusters(s, d).withColumn("y", (F.col("id") % 3).cast("int")))),
        """WITH c AS (SELECT vec_id % 3 AS y, CASE WHEN label > 6 THEN -1 ELSE label % 4 END AS p FROM embeddings), k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k FROM (SELECT DISTINCT p FROM c WHERE p >= 0)),
t(perm, a, b, cc) AS (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)),
m AS (SELECT perm, c.y, c.p, CASE k.k WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN cc ELSE 2 END AS cls FROM c LEFT JOIN k ON k.p = c.p, t),
s AS (SELECT perm, count_if(y = cls) / count(*)::DOUBLE AS acc FROM m GROUP BY perm), b AS (SELECT perm, acc FROM s ORDER BY acc DESC, perm LIMIT 1)
SELECT DISTINCT m.p AS cluster, m.cls AS class, round(b.acc, 6) AS accuracy FROM m JOIN b USING (perm)""",
    ),
    "packed_metrics": (
        lambda s, d: rounded(op.packed_metrics(labels(s, d)), digits=6),
        f"WITH {L}, " + _AGREE.format(src="l") + f", k AS (SELECT {_CONF} FROM l) SELECT k.*, round(correct / n::DOUBLE, 6) AS accuracy, CAST((SELECT count_if(y = 1) FROM l) AS BIGINT) AS n_good, CAST((SELECT count_if(y <> 1) FROM l) AS BIGINT) AS n_bad, CAST((SELECT count_if(p = 1) FROM l) AS BIGINT) AS chosen_cluster_size, round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM k, ag",
    ),
    "silhouette": (
        _sil,
        """WITH e AS (SELECT vec_id // 50 AS grp, vec_id AS id, label % 3 AS label, embedding FROM embeddings), m AS (SELECT a.grp, a.id AS i, a.label AS li, b.label AS lj, avg(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))) AS m FROM e a JOIN e b ON a.grp = b.grp AND a.id <> b.id GROUP BY 1, 2, 3, 4),
p AS (SELECT grp, i, max(CASE WHEN li = lj THEN m END) AS own, min(CASE WHEN li <> lj THEN m END) AS oth FROM m GROUP BY grp, i) SELECT grp, round(avg(CASE WHEN own IS NULL THEN 0 ELSE (oth - own) / greatest(own, oth) END), 6) AS silhouette FROM p GROUP BY grp""",
    ),
    "ensemble_votes": (
        lambda s, d: op.votes(_member_votes(s, d, 2), ["bead"], 3),
        "SELECT o_orderkey AS bead, CASE WHEN o_orderkey % 2 + o_custkey % 2 + CAST(floor(o_totalprice) AS BIGINT) % 2 >= 2 THEN 1 ELSE 0 END AS vote FROM orders",
    ),
    "ensemble_votes_classes": (
        lambda s, d: op.votes(_member_votes(s, d, 3), ["bead"], 3),
        """WITH v AS (SELECT o_orderkey AS bead, unnest([o_orderkey % 3, o_custkey % 3, CAST(floor(o_totalprice) AS BIGINT) % 3]) AS p FROM orders), n AS (SELECT bead, p, count(*) AS c FROM v GROUP BY 1, 2),
r AS (SELECT bead, p, c, row_number() OVER (PARTITION BY bead ORDER BY c DESC, p) AS k, sum(c) OVER (PARTITION BY bead) AS m, max(p) OVER (PARTITION BY bead) AS top, sum(c * p) OVER (PARTITION BY bead) AS s FROM n)
SELECT bead, CAST(CASE WHEN top <= 1 THEN CASE WHEN s >= 2 THEN 1 ELSE 0 END ELSE p END AS INT) AS vote FROM r WHERE k = 1 AND m = 3""",
    ),
    "segment_majority": (
        lambda s, d: op.majority(segments(s, d), ["bead"], beads(s, d)),
        f"WITH {S}, n AS (SELECT bead, p, count(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT bead, p, row_number() OVER (PARTITION BY bead ORDER BY c DESC, p) AS k FROM n), e AS (SELECT DISTINCT c_custkey % 200 AS bead FROM customer) SELECT e.bead, coalesce(r.p, 0) AS vote FROM e LEFT JOIN r ON r.bead = e.bead AND r.k = 1",
    ),
    "segment_sum_vote": (
        lambda s, d: op.sum_vote(segments(s, d).withColumn("p", F.col("p") % 2), ["bead"], beads(s, d), fraction=0.33),
        f"WITH {S}, v AS (SELECT bead, CASE WHEN sum(p % 2) >= 0.33 * count(*) THEN 1 ELSE 0 END AS vote FROM s GROUP BY bead), e AS (SELECT DISTINCT c_custkey % 200 AS bead FROM customer) SELECT e.bead, coalesce(vote, 0) AS vote FROM e LEFT JOIN v USING (bead)",
    ),
    "defaulted_predictions": (
        lambda s, d: op.with_default(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", F.col("toxic").alias("p")), ["doc_id"], 2),
        "SELECT d.doc_id, coalesce(toxic, 2) AS p FROM documents d LEFT JOIN labels l USING (doc_id)",
    ),
    "merged_replicates": (
        lambda s, d: op.merged_replicates(replicates(s, d), ["method", "path", "experiment_id"], "row_order"),
        """SELECT l_returnflag AS method, l_suppkey AS path, l_linenumber AS experiment_id, format('{:.6f}', avg(l_discount)) AS accuracy, CAST(round_even(avg(l_quantity), 0) AS BIGINT) AS correct, min_by(l_linestatus, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS source FROM lineitem GROUP BY 1, 2, 3""",
    ),
    "rolled_up_index": (
        lambda s, d: rounded(op.rolled_up(table(s, d, "lineitem"), ["l_orderkey"], 2, LINES, ["l_discount"], "l_quantity", ["l_tax"])),
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) - 1 AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, round(l_discount, 6) AS l_discount, round(l_quantity, 6) AS l_quantity, round(l_tax, 6) AS l_tax FROM r WHERE rn = least(2, n - 1)",
    ),
    "rolled_up_all": (
        lambda s, d: rounded(op.rolled_up(table(s, d, "lineitem"), ["l_orderkey"], -1, LINES, ["l_discount"], "l_quantity", ["l_tax"])),
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) AS k FROM lineitem) SELECT l_orderkey, round(avg(l_discount), 6) AS l_discount, round(sum(l_quantity), 6) AS l_quantity, round(max(CASE WHEN k = 1 THEN l_tax END), 6) AS l_tax FROM r GROUP BY 1",
    ),
    "mean_scores": (
        lambda s, d: rounded(table(s, d, "lineitem").where("l_linestatus = 'O'").agg(F.avg("l_discount").alias("mean_accuracy"), F.avg("l_tax").alias("mean_ari"), F.count(F.lit(1)).alias("n"))),
        "SELECT round(avg(l_discount), 6) AS mean_accuracy, round(avg(l_tax), 6) AS mean_ari, count(*) AS n FROM lineitem WHERE l_linestatus = 'O'",
    ),
    "tuning_summary": (
        lambda s, d: rounded(op.tuning_summary(table(s, d, "orders").select(F.col("o_orderpriority").alias("pipeline"), F.col("o_orderkey").alias("params"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("score")), ["pipeline"], "params", "score")),
        """WITH t AS (SELECT o_orderpriority AS pipeline, o_orderkey AS params, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS score FROM orders)
SELECT pipeline, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, max_by(params, struct_pack(s := coalesce(score, -1), p := params)) AS best_params, CAST(count_if(score IS NOT NULL) AS BIGINT) AS n_ok, CAST(count_if(score IS NULL) AS BIGINT) AS n_failed FROM t GROUP BY pipeline""",
    ),
    "label_counts": (
        lambda s, d: op.label_counts(clusters(s, d).withColumn("grp", F.col("id") % 4).withColumnRenamed("p", "label"), ["grp"]),
        f"WITH {C}, n AS (SELECT id % 4 AS grp, p, count(*) AS n FROM c GROUP BY 1, 2) SELECT grp, string_agg(CAST(n AS VARCHAR), ',' ORDER BY p) FILTER (p >= 0) AS counts, CAST(sum(CASE WHEN p < 0 THEN n ELSE 0 END) AS BIGINT) AS outliers FROM n GROUP BY grp",
    ),
    "class_totals": (
        lambda s, d: table(s, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("usable"), F.count_if(F.col("quality") == 0).alias("unusable"), F.count(F.lit(1)).alias("total")),
        "SELECT CAST(count_if(quality = 1) AS BIGINT) AS usable, CAST(count_if(quality = 0) AS BIGINT) AS unusable, count(*) AS total FROM labels",
    ),
    "imputed_columns": (
        _imputed,
        """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS a, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS b FROM part)
SELECT p_partkey, round(coalesce(a, (SELECT median(a) FROM r)), 6) AS a, round(coalesce(b, (SELECT median(b) FROM r)), 6) AS b, 0.0::DOUBLE AS c FROM r""",
    ),
}
