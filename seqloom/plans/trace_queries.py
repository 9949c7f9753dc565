"""Queries of the trace operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import trace as op
from seqloom.plans.fixtures import GAPPY, HOLED, TRACE, gappy, holed, long, rounded, trace

B = ["bead"]

_FILLED = """,
m AS (SELECT bead, coalesce(avg(CASE WHEN isfinite(z) THEN z END), 0) AS m FROM gappy GROUP BY bead),
filled AS (SELECT g.bead, g.exp_id, g.frame, g.t, CASE WHEN isnan(g.z) THEN m.m WHEN isinf(g.z) THEN {inf} ELSE g.z END AS z FROM gappy g JOIN m USING (bead))"""
_STEPS = """,
steps AS (SELECT *, lag(z) OVER w AS prev, z - lag(z) OVER w AS d, row_number() OVER w - 1 AS f0, count(*) OVER (PARTITION BY bead) AS n FROM filled WINDOW w AS (PARTITION BY bead ORDER BY frame))"""
_AUTO = "CASE WHEN count(z) >= {least} AND stddev_pop(z) > 1e-12 THEN coalesce(CASE WHEN stddev_pop(CASE WHEN prev IS NOT NULL THEN z END) * stddev_pop(prev) > 0 THEN covar_pop(CASE WHEN prev IS NOT NULL THEN z END, prev) / (stddev_pop(CASE WHEN prev IS NOT NULL THEN z END) * stddev_pop(prev)) END, 0) ELSE 0 END"
_F4 = "round(var_pop(z), 6) AS variance, round(coalesce(stddev_pop(d), 0), 6) AS diff_std, round(coalesce(max(abs(d)), 0), 6) AS max_abs_diff, round(coalesce(median(abs(d)), 0), 6) AS median_abs_diff"
_F12 = f"""f12 AS (SELECT bead, avg(z) AS mean, stddev_pop(z) AS std, max(z) - min(z) AS ptp, coalesce(max(ds), 0) AS diff_std, coalesce(max(abs(d)), 0) AS max_abs_diff, coalesce(median(abs(d)), 0) AS median_abs_diff,
  quantile_cont(z, 0.01) AS q01, quantile_cont(z, 0.99) AS q99, {_AUTO.format(least=3)} AS autocorr_lag1,
  coalesce(avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) < greatest(ds * 0.02::DOUBLE, 1e-12::DOUBLE) AS INT) END), 0) AS flat_fraction,
  coalesce(avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) > greatest(ds * 6.0::DOUBLE, 1e-12::DOUBLE) AS INT) END), 0) AS large_jump_fraction,
  coalesce(regr_slope(z, CASE WHEN n > 1 THEN f0 / (n - 1.0::DOUBLE) - 0.5::DOUBLE END), 0) AS slope
  FROM (SELECT *, coalesce(stddev_pop(d) OVER (PARTITION BY bead), 0) AS ds FROM steps) GROUP BY bead)"""
_S12 = "WITH " + GAPPY + _FILLED.format(inf="m.m") + _STEPS + ", " + _F12


def features_12(s, d):
    return rounded(op.features12(gappy(s, d), B))


def feature_summary(s, d):
    return rounded(op.summarised(op.features12(gappy(s, d), B), op.FEATURES12), digits=5)


def rules(s, d):
    # values rounded to tens, so that runs of equal samples occur
    z = F.floor(F.col("z") / 100.0) * 100.0
    return op.rule_flags(trace(s, d).withColumn("z", z), B, variance_thresh=9000.0, n_sigma=2.5, gap_len=3)


_RULES = "WITH " + TRACE + """,
filled AS (SELECT bead, frame, floor(z / 100.0) * 100.0::DOUBLE AS z FROM trace)""" + _STEPS + """,
q AS (SELECT *, coalesce(abs(d) <= 1e-6, false) AS quiet FROM steps),
r AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY bead ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM q),
l AS (SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY bead, run) AS len FROM r),
f AS (SELECT bead, stddev_pop(z) <= 1e-6 AS flat, max(len) >= 3 AS dropout,
  coalesce(max(abs(d)) > 2.5 * CASE WHEN coalesce(stddev_pop(d), 0) <= 0 THEN 1e-10 ELSE stddev_pop(d) END, false) AS spike, var_pop(z) > 9000.0 AS high_variance FROM l GROUP BY bead)
SELECT *, CASE WHEN flat OR dropout OR spike OR high_variance THEN 0 ELSE 1 END AS usable FROM f"""

_KNOWN = """,
k AS (SELECT bead, frame, t, z, row_number() OVER (PARTITION BY bead ORDER BY frame) AS o, count(*) OVER (PARTITION BY bead) AS m FROM holed WHERE z IS NOT NULL),
ends AS (SELECT bead, max(m) AS m, max(CASE WHEN o = 1 THEN t END) AS t1, max(CASE WHEN o = 1 THEN z END) AS z1, max(CASE WHEN o = 2 THEN t END) AS t2, max(CASE WHEN o = 2 THEN z END) AS z2,
  max(CASE WHEN o = m - 1 THEN t END) AS t3, max(CASE WHEN o = m - 1 THEN z END) AS z3, max(CASE WHEN o = m THEN t END) AS t4, max(CASE WHEN o = m THEN z END) AS z4 FROM k GROUP BY bead),
near AS (SELECT h.bead, h.frame, h.t, h.z,
  last_value(CASE WHEN z IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(z IGNORE NULLS) OVER b AS za,
  first_value(CASE WHEN z IS NOT NULL THEN t END IGNORE NULLS) OVER a AS tb, first_value(z IGNORE NULLS) OVER a AS zb
  FROM holed h WINDOW b AS (PARTITION BY bead ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY bead ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT bead, frame, round(CASE WHEN coalesce(m, 0) = 0 THEN 0 WHEN z IS NOT NULL THEN z WHEN m = 1 THEN z1
  WHEN ta IS NULL THEN z1 + (t - t1) * ((z2 - z1) / nullif(t2 - t1, 0)) WHEN tb IS NULL THEN z3 + (t - t3) * ((z4 - z3) / nullif(t4 - t3, 0))
  ELSE za + (t - ta) * ((zb - za) / nullif(tb - ta, 0)) END, 4) AS z
FROM near LEFT JOIN ends USING (bead)"""

_ARR = "arr AS (SELECT bead, list(z ORDER BY frame) AS z, count(*) AS n FROM trace GROUP BY bead)"


def _dist(s, d):
    rows = trace(s, d).select((F.col("exp_id") % 3).alias("feature"), "event_type", "z")
    return rounded(op.distances(rows, ["feature"], "event_type", "z", "click", "view"))


QUERIES = {
    "trace_features_4": (
        lambda s, d: rounded(op.features4(gappy(s, d), B)),
        "WITH " + GAPPY + _FILLED.format(inf="0") + _STEPS + f" SELECT bead, {_F4} FROM steps GROUP BY bead",
    ),
    "trace_features_8": (
        lambda s, d: rounded(op.features8(gappy(s, d), B)),
        "WITH " + GAPPY + _FILLED.format(inf="0") + _STEPS + f" SELECT bead, {_F4}, round(max(z) - min(z), 6) AS ptp, round(quantile_cont(z, 0.25), 6) AS p25, round(quantile_cont(z, 0.75), 6) AS p75, round({_AUTO.format(least=2)}, 6) AS autocorr_lag1 FROM steps GROUP BY bead",
    ),
    "trace_features_12": (features_12, _S12 + " SELECT bead, " + ", ".join(f"round({c}, 6) AS {c}" for c in op.FEATURES12) + " FROM f12"),
    "feature_summary": (
        feature_summary,
        _S12 + f", u AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in op.FEATURES12)} FROM f12) ON {', '.join(op.FEATURES12)} INTO NAME feature VALUE v) SELECT feature, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(median(v), 5) AS median, round(quantile_cont(v, 0.05), 5) AS q05, round(quantile_cont(v, 0.95), 5) AS q95 FROM u GROUP BY feature",
    ),
    "distribution_distances": (
        _dist,
        "WITH " + TRACE + """, c AS (SELECT exp_id % 3 AS feature, z, sum(CAST(event_type = 'click' AS INT)) AS na, sum(CAST(event_type = 'view' AS INT)) AS nb FROM trace WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
g AS (SELECT feature, abs(sum(na) OVER w / sum(na) OVER (PARTITION BY feature) - sum(nb) OVER w / sum(nb) OVER (PARTITION BY feature)) AS gap, lead(z) OVER (PARTITION BY feature ORDER BY z) - z AS width FROM c WINDOW w AS (PARTITION BY feature ORDER BY z ROWS UNBOUNDED PRECEDING)),
h AS (SELECT feature, max(gap) AS ks_stat, sum(gap * width) AS wasserstein FROM g GROUP BY feature),
m AS (SELECT exp_id % 3 AS feature, median(CASE WHEN event_type = 'click' THEN z END) AS real_median, median(CASE WHEN event_type = 'view' THEN z END) AS synthetic_median FROM trace GROUP BY 1)
SELECT feature, round(ks_stat, 6) AS ks_stat, round(wasserstein, 6) AS wasserstein, round(real_median, 6) AS real_median, round(synthetic_median, 6) AS synthetic_median, round(synthetic_median - real_median, 6) AS median_delta FROM h JOIN m USING (feature)""",
    ),
    "trace_filled": (
        lambda s, d: rounded(op.filled(gappy(s, d), B).select("bead", "frame", "z")),
        "WITH " + GAPPY + _FILLED.format(inf="0") + " SELECT bead, frame, round(z, 6) AS z FROM filled",
    ),
    "trace_filled_mean": (
        lambda s, d: rounded(op.filled(gappy(s, d), B, inf_to_mean=True).select("bead", "frame", "z")),
        "WITH " + GAPPY + _FILLED.format(inf="m.m") + " SELECT bead, frame, round(z, 6) AS z FROM filled",
    ),
    "features_sanitised": (
        lambda s, d: rounded(gappy(s, d).select("event_id", op.sanitised(F.col("z")).alias("z"))),
        "WITH " + GAPPY + " SELECT event_id, round(CASE WHEN isfinite(z) THEN z ELSE 0 END, 6) AS z FROM gappy",
    ),
    "resampled_traces": (
        lambda s, d: long(op.resampled_traces(trace(s, d), B, 32), B, "z"),
        "WITH " + TRACE + ", " + _ARR + """, p AS (SELECT bead, z, n, CAST(i AS INT) AS pos, i * (n - 1) / 31.0::DOUBLE AS p FROM arr, range(32) r(i))
SELECT bead, pos, round(z[CAST(least(floor(p), n - 1) AS INT) + 1] + (z[CAST(least(floor(p) + 1, n - 1) AS INT) + 1] - z[CAST(least(floor(p), n - 1) AS INT) + 1]) * (p - floor(p)), 6) AS v FROM p""",
    ),
    "trace_segments": (
        lambda s, d: rounded(op.segmented(trace(s, d), B, 16, 8).select("bead", F.col("segment").cast("long").alias("segment"), F.col("start").cast("long").alias("start"), F.aggregate("z", F.lit(0.0), lambda a, x: a + x).alias("total"))),
        "WITH " + TRACE + ", " + _ARR + " SELECT bead, CAST(i AS BIGINT) AS segment, 8 * i AS start, round(list_sum(z[8 * i + 1: 8 * i + 16]), 6) AS total FROM arr, range(2000) r(i) WHERE 8 * i + 16 <= n",
    ),
    "trace_gaps_interpolated": (lambda s, d: rounded(op.gaps_interpolated(holed(s, d), B).select("bead", "frame", "z"), digits=4), "WITH " + HOLED + _KNOWN),
    "trace_carried": (
        lambda s, d: rounded(op.carried(holed(s, d), B).select("bead", "frame", "z")),
        "WITH " + HOLED + " SELECT bead, frame, round(coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY bead ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(z IGNORE NULLS) OVER (PARTITION BY bead ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS z FROM holed",
    ),
    "padded_to_median": (
        lambda s, d: long(op.padded_to_median(trace(s, d), B), B, "z"),
        "WITH " + TRACE + ", " + _ARR + ", m AS (SELECT CAST(floor(median(n)) AS INT) AS m FROM arr) SELECT bead, CAST(i AS INT) AS pos, round(z[least(i + 1, n)], 6) AS v FROM arr, m, range(5000) r(i) WHERE i < m",
    ),
    "padded_to_longest": (
        lambda s, d: long(op.padded_to_longest(trace(s, d), B), B, "z"),
        "WITH " + TRACE + ", " + _ARR + ", m AS (SELECT max(n) AS m FROM arr) SELECT bead, CAST(i AS INT) AS pos, round(CASE WHEN i < n THEN z[i + 1] END, 6) AS v FROM arr, m, range(5000) r(i) WHERE i < m",
    ),
    "time_split": (
        lambda s, d: rounded(op.time_split(trace(s, d), B, 400000.0, 100000.0).select("bead", "piece", "frame", "t", "z"), digits=4),
        "WITH " + TRACE + """, s AS (SELECT *, min(t) OVER (PARTITION BY bead) AS t0, max(t) OVER (PARTITION BY bead) AS t9 FROM trace),
p AS (SELECT *, CASE WHEN t9 - t0 < 400000.0 THEN 1 ELSE CAST(ceil((t9 - t0 - 400000.0::DOUBLE) / 300000.0::DOUBLE) AS INT) + 1 END AS k FROM s),
c AS (SELECT bead, frame, t, z, t0, t9, CAST(i AS INT) AS piece FROM p, range(100) r(i) WHERE i < k AND (t9 - t0 < 400000.0 OR (t >= t0 + i * 300000.0::DOUBLE AND t < least(t0 + i * 300000.0::DOUBLE + 400000.0::DOUBLE, t9))))
SELECT bead, piece, frame, round(t - CASE WHEN t9 - t0 < 400000.0 THEN 0 ELSE min(t) OVER (PARTITION BY bead, piece) END, 4) AS t, round(z, 4) AS z FROM c""",
    ),
    "rule_flags": (rules, _RULES),
    "training_stats": (
        lambda s, d: rounded(op.training_stats(holed(s, d))),
        "WITH " + HOLED + " SELECT round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std FROM holed",
    ),
    "stat_matched": (
        lambda s, d: rounded(op.matched_to(trace(s, d), op.training_stats(trace(s, d).where("event_type = 'view'"))).select("bead", "frame", "z")),
        "WITH " + TRACE + ", a AS (SELECT avg(z) AS m0, stddev_pop(z) AS s0 FROM trace), b AS (SELECT avg(z) AS m1, stddev_pop(z) AS s1 FROM trace WHERE event_type = 'view') SELECT bead, frame, round((z - m0) / s0 * s1 + m1, 6) AS z FROM trace, a, b",
    ),
    "long_panel": (
        lambda s, d: rounded(op.exploded(op.as_arrays(trace(s, d), B, "z"), B)),
        "WITH " + TRACE + " SELECT bead, CAST(frame AS INT) AS pos, round(z, 6) AS v FROM trace",
    ),
    "longest_steady_run": (
        lambda s, d: op.longest_steady_run(trace(s, d), ["exp_id"], n_std=1.5, min_fraction=0.9),
        "WITH " + TRACE + """, s AS (SELECT *, avg(z) OVER (PARTITION BY exp_id) AS m, stddev_pop(z) OVER (PARTITION BY exp_id) AS sd FROM trace),
f AS (SELECT exp_id, frame, avg(CAST(abs(z - m) <= 1.5 * sd AS INT)) >= 0.9 AS ok FROM s GROUP BY 1, 2),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY exp_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT exp_id, run, min(frame) AS s0, max(frame) AS s1, count(*) AS n FROM r WHERE ok GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY n DESC, s0) AS k FROM g)
SELECT exp_id, s0 AS start, s1 AS "end", n AS length FROM b WHERE k = 1""",
    ),
}
