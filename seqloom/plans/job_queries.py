"""The runnable jobs as queries: each runs twice into one new folder of the shared one."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import text_traces, transfer_matrix
from seqloom.plans.fixtures import rounded
from seqloom.runtime import shared_dir

CONFIGS = Path(text_traces.__file__).resolve().parent


def _config(spark: SparkSession, name: str, folder: str) -> str:
    """A copy of a config file of this repository where all executors can read it."""
    spark.createDataFrame([((CONFIGS / name).read_text(),)], "value string").coalesce(1).write.text(f"{folder}/config")
    return f"{folder}/config"


def job1_text_traces(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    config = _config(spark, "text_traces.json", folder)
    for _ in range(2):
        results = text_traces.run(spark, config, f"{d}/documents.parquet", f"{d}/labels.parquet", f"{folder}/out", f"{folder}/checkpoint")
    beads = text_traces.newest(spark.read.schema(text_traces.BEADS).parquet(f"{folder}/out/beads")).drop("batch")
    return rounded(beads.join(results.drop("last_batch"), "experiment"))


def job2_transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    config = _config(spark, "transfer_matrix.json", folder)
    for _ in range(2):
        found = transfer_matrix.run(spark, config, f"{d}/documents.parquet", f"{d}/labels.parquet", f"{folder}/out")
    return rounded(found)


_WORDS = r"""split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
filled AS (SELECT doc_id, unnest(list_transform(ws, lambda w: length(w)))::DOUBLE AS z, unnest(range(len(ws))) AS frame FROM split),
steps AS (SELECT *, lag(z) OVER w AS prev, z - lag(z) OVER w AS d FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY frame))"""

_JOB1 = "WITH " + _WORDS + """,
q AS (SELECT *, coalesce(abs(d) <= 1e-6, false) AS quiet FROM steps),
r AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM q),
l AS (SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) AS len FROM r),
f AS (SELECT doc_id, count(*) AS samples, stddev_pop(z) <= 1e-6 AS flat, max(len) >= 6 AS dropout,
  coalesce(max(abs(d)) > 9.0 * CASE WHEN coalesce(stddev_pop(d), 0) <= 0 THEN 1e-10 ELSE stddev_pop(d) END, false) AS spike, var_pop(z) > 40.0 AS high_variance FROM l GROUP BY doc_id),
beads AS (SELECT CASE WHEN source <> '' THEN source ELSE 'none' END AS experiment, doc_id, coalesce(samples, 0) AS samples, coalesce(flat, false) AS flat, coalesce(dropout, false) AS dropout, coalesce(spike, false) AS spike, coalesce(high_variance, false) AS high_variance,
  CASE WHEN f.doc_id IS NULL OR flat OR dropout OR spike OR high_variance THEN 0 ELSE 1 END AS usable FROM documents LEFT JOIN f USING (doc_id)),
truth AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
res AS (SELECT experiment, 'rules' AS method, count(*) AS n_beads, CAST(sum(usable) AS BIGINT) AS n_predicted_good, CAST(sum(1 - usable) AS BIGINT) AS n_predicted_bad, count(y) AS n_labelled, count(*) FILTER (usable = y) AS correct,
  count(*) FILTER (y = 1 AND usable = 1) AS tp, count(*) FILTER (y <> 1 AND usable <> 1) AS tn, count(*) FILTER (y <> 1 AND usable = 1) AS fp, count(*) FILTER (y = 1 AND usable <> 1) AS fn FROM beads LEFT JOIN truth USING (doc_id) GROUP BY experiment)
SELECT *, round(coalesce(correct / nullif(n_labelled, 0), 0), 6) AS accuracy FROM beads JOIN res USING (experiment)"""

#: Ridge by elimination on a list of rows; standardised values are formed directly, not from sums.
_JOB2 = "WITH RECURSIVE " + _WORDS + """,
f AS (SELECT doc_id, var_pop(z) AS variance, coalesce(stddev_pop(d), 0) AS diff_std, coalesce(max(abs(d)), 0) AS max_abs_diff, coalesce(median(abs(d)), 0) AS median_abs_diff, max(z) - min(z) AS ptp, quantile_cont(z, 0.25) AS p25, quantile_cont(z, 0.75) AS p75,
  CASE WHEN count(z) >= 2 AND stddev_pop(z) > 1e-12 THEN coalesce(CASE WHEN stddev_pop(CASE WHEN prev IS NOT NULL THEN z END) * stddev_pop(prev) > 0 THEN covar_pop(CASE WHEN prev IS NOT NULL THEN z END, prev) / (stddev_pop(CASE WHEN prev IS NOT NULL THEN z END) * stddev_pop(prev)) END, 0) ELSE 0 END AS autocorr_lag1 FROM steps GROUP BY doc_id),
lab AS (SELECT doc_id, CASE WHEN lang IN ('en', 'es', 'fr', 'de') THEN lang ELSE 'other' END AS grp, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS INT) < 51 AS held_out, y, [variance, diff_std, max_abs_diff, median_abs_diff, ptp, p25, p75, autocorr_lag1] AS v
  FROM documents JOIN (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) JOIN f USING (doc_id)),
sets AS (SELECT doc_id, unnest([grp, 'all']) AS s, y, v FROM lab WHERE NOT held_out),
long AS (SELECT s, doc_id, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, unnest(v) AS x, unnest(range(1, 9)) AS j FROM sets),
scale AS (SELECT s, j, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-9 THEN stddev_pop(x) ELSE 1 END AS sd, avg(y) AS b FROM long GROUP BY s, j),
std AS (SELECT s, j, doc_id, (x - m) / sd AS u, y - b AS w FROM long JOIN scale USING (s, j)),
gram AS (SELECT a.s, a.j AS i, c.j, sum(a.u * c.u) + CASE WHEN a.j = c.j THEN 1.0 ELSE 0 END AS g FROM std a JOIN std c ON a.s = c.s AND a.doc_id = c.doc_id GROUP BY 1, 2, 3),
rhs AS (SELECT s, j AS i, sum(u * w) AS g FROM std GROUP BY 1, 2),
kinds AS (SELECT unnest([4, 8]) AS k),
lines AS (SELECT s, k, i, list(g ORDER BY j) || [max(r)] AS line FROM (SELECT gram.s, k, gram.i, gram.j, gram.g, rhs.g AS r FROM gram JOIN rhs ON rhs.s = gram.s AND rhs.i = gram.i JOIN kinds ON gram.i <= k AND gram.j <= k) GROUP BY s, k, i),
solve(s, k, p, m) AS (
  SELECT s, k, 1, list(line ORDER BY i) FROM lines GROUP BY s, k
  UNION ALL
  SELECT s, k, p + 1, list_transform(range(1, k + 1), lambda i: CASE WHEN i = p THEN list_transform(m[p], lambda x: x / m[p][p]) ELSE list_transform(range(1, k + 2), lambda j: m[i][j] - m[i][p] * m[p][j] / m[p][p]) END) FROM solve WHERE p <= k),
models AS (SELECT s, k, (SELECT max(b) FROM scale WHERE scale.s = solve.s) AS b, list_transform(m, lambda line: line[k + 1]) AS w FROM solve WHERE p = k + 1),
moments AS (SELECT s, list(m ORDER BY j) AS m, list(sd ORDER BY j) AS sd FROM scale GROUP BY s),
told AS (SELECT models.s, models.k, unnest([grp, 'all']) AS eval_set, y, CASE WHEN b + list_sum(list_transform(range(1, models.k + 1), lambda j: w[j] * (v[j] - moments.m[j]) / moments.sd[j])) > 0 THEN 1 ELSE 0 END AS p FROM lab, models JOIN moments USING (s) WHERE held_out),
c AS (SELECT s AS train_set, CAST(k AS VARCHAR) AS feature_set, eval_set, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 0) AS tn, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM told GROUP BY 1, 2, 3),
d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM c)
SELECT train_set, feature_set, eval_set, n, tp, tn, fp, fn, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (re + sp) / 2 WHEN tp + fn > 0 THEN re ELSE sp END, 6) AS balanced_accuracy, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM d"""

QUERIES = {"job1_text_traces": (job1_text_traces, _JOB1), "job2_transfer_matrix": (job2_transfer_matrix, _JOB2)}
