"""Queries of the curve, representation and feature-column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.arrays import normalised
from seqloom.operators import curves as op
from seqloom.plans.fixtures import CURVES, PLACED, TURNS, curves, long, rounded, turns
from seqloom.runtime import table

K = ["exp_id", "bead"]
N = 21
_C = "WITH " + CURVES


def _at(values: str, p: str, n: str) -> str:
    low, high = f"CAST(least(floor({p}), {n} - 1) AS INT) + 1", f"CAST(least(floor({p}) + 1, {n} - 1) AS INT) + 1"
    return f"({values}[{low}] + ({values}[{high}] - {values}[{low}]) * ({p} - floor({p})))"


_GRID = f"grid AS (SELECT CAST(i AS INT) AS pos, i / {N - 1}.0::DOUBLE AS g FROM range({N}) r(i))"
_PCT = f"{_GRID}, pct AS (SELECT exp_id, bead, pos, {_at('es', '(g * (n - 1))', 'n')} AS ev, {_at('fs', '(g * (n - 1))', 'n')} AS fv FROM ne, grid)"
_NORM = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE {c} END"
_STEP = 100.0 / (N - 1)
_SLOPE = "CASE WHEN pos < {last} THEN (lead({c}) OVER o - {c}) / {step}::DOUBLE ELSE ({c} - lag({c}) OVER o) / {step}::DOUBLE END"
_WIN = " WINDOW w AS (PARTITION BY bead), o AS (PARTITION BY bead ORDER BY pos)"
#: Linear interpolation of (s, y) by row at a value; NULL outside the range.
_INTERP = """i AS (SELECT q.exp_id, q.bead, q.pos, q.g, max(CASE WHEN p.s <= q.g THEN p.k END) AS k, min(p.s) AS s0, max(p.s) AS s1 FROM want q JOIN pts p ON p.bead = q.bead GROUP BY 1, 2, 3, 4),
v AS (SELECT i.exp_id, i.bead, i.pos, CASE WHEN i.g < i.s0 OR i.g > i.s1 THEN NULL WHEN b.s IS NULL OR b.s = a.s THEN a.y ELSE a.y + (b.y - a.y) / (b.s - a.s) * (i.g - a.s) END AS v
  FROM i LEFT JOIN pts a ON a.bead = i.bead AND a.k = i.k LEFT JOIN pts b ON b.bead = i.bead AND b.k = i.k + 1)"""


def _rep(name):
    return lambda s, d: long(op.represented(curves(s, d), K, name, N), K)


def _pct(expr: str) -> str:
    return _C + ", " + _PCT + f" SELECT exp_id, bead, pos, round({expr}, 6) + 0.0::DOUBLE AS v FROM pct" + _WIN


def _matrix(s, d):
    m = op.energy_matrix(curves(s, d), ["exp_id"], "bead", N, union=True)
    return long(m, K, "e", digits=4)


_OUT = """rg AS (SELECT exp_id, bead, min(x) AS lo, max(x) AS hi, max(x) - min(x) AS r FROM curves GROUP BY 1, 2),
rs AS (SELECT *, avg(r) OVER (PARTITION BY exp_id) AS m, coalesce(nullif(stddev_samp(r) OVER (PARTITION BY exp_id), 0), 1) AS sd FROM rg),
og AS (SELECT exp_id, bead, lo, hi, r, coalesce(r BETWEEN m - 3.0 * sd AND m + 3.0 * sd, false) AS good FROM rs)"""


def _emb(s, d):
    """Features as (group, id, pos, x): every 10th entry missing or infinite, one column constant."""
    e = table(s, d, "embeddings").select((F.col("vec_id") % 5).alias("grp"), F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "x"))
    k = F.col("id") + F.col("pos")
    x = F.when(F.col("pos") == 3, 1.0).when(k % 10 == 0, F.lit(float("nan"))).when(k % 23 == 0, F.lit(float("inf"))).otherwise(F.col("x").cast("double"))
    return e.withColumn("x", x)


_EMB = """e0 AS (SELECT vec_id % 5 AS grp, vec_id AS id, CAST(unnest(range(64)) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
emb AS (SELECT grp, id, pos, CASE WHEN pos = 3 THEN 1.0::DOUBLE WHEN (id + pos) % 10 = 0 THEN 'NaN'::DOUBLE WHEN (id + pos) % 23 = 0 THEN 'Infinity'::DOUBLE ELSE x END AS x FROM e0),
fil AS (SELECT grp, id, pos, CASE WHEN isfinite(x) THEN x ELSE coalesce(avg(CASE WHEN isfinite(x) THEN x END) OVER (PARTITION BY grp, pos), 0) END AS x FROM emb)"""


def _dist(s, d):
    e = table(s, d, "embeddings")
    x = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return e.select((F.col("vec_id") % 5).alias("grp"), "vec_id", F.col("label"), F.pow(x, 3.0).alias("dist"))


_DIST = "de AS (SELECT vec_id % 5 AS grp, vec_id, label, pow(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 3.0) AS dist FROM embeddings)"

_ROTP = "rp AS (SELECT exp_id, bead, list(z ORDER BY rot, frame) AS zs, list(rot ORDER BY rot, frame) AS rs, count(*) AS n FROM turns GROUP BY 1, 2 HAVING count(*) >= 2)"

def _grid_sql(bounds: str, digits: int) -> str:
    return _C + ", " + _OUT + f""", bd AS (SELECT exp_id, {bounds} FROM og WHERE good GROUP BY 1),
want AS (SELECT o.exp_id, o.bead, CAST(i AS INT) AS pos, g0 + (g1 - g0) * i / {N - 1}.0::DOUBLE AS g FROM og o JOIN bd USING (exp_id), range({N}) r(i) WHERE good),
pts AS (SELECT bead, rn AS k, x AS s, e AS y FROM energy), {_INTERP},
mx AS (SELECT exp_id, bead, max(v) AS top, max(v) - min(v) AS span FROM v GROUP BY 1, 2 HAVING max(v) IS NOT NULL),
md AS (SELECT *, median(top) OVER (PARTITION BY exp_id) AS tm, median(span) OVER (PARTITION BY exp_id) AS sm FROM mx),
mm AS (SELECT *, abs(top - tm) AS td, abs(span - sm) AS sd FROM md),
mk AS (SELECT *, median(td) OVER (PARTITION BY exp_id) AS t1, median(sd) OVER (PARTITION BY exp_id) AS s1, stddev_pop(top) OVER (PARTITION BY exp_id) AS t2, stddev_pop(span) OVER (PARTITION BY exp_id) AS s2 FROM mm),
kept AS (SELECT bead FROM mk WHERE td <= 2.5 * CASE WHEN t1 > 0 THEN t1 WHEN t2 > 0 THEN t2 ELSE 1 END AND sd <= 2.5 * CASE WHEN s1 > 0 THEN s1 WHEN s2 > 0 THEN s2 ELSE 1 END)
SELECT exp_id, bead, pos, round(v, {digits}) AS v FROM v WHERE bead IN (SELECT bead FROM kept)"""


_COMMON = "CASE WHEN max(lo) < min(hi) THEN max(lo) ELSE avg(lo) END AS g0, CASE WHEN max(lo) < min(hi) THEN min(hi) ELSE avg(hi) END AS g1"

QUERIES = {
    "energy_curve": (lambda s, d: rounded(op.energy_curve(curves(s, d), K).select("exp_id", "bead", "rn", "x", "e")), _C + " SELECT exp_id, bead, rn, round(x, 6) AS x, round(e, 6) AS e FROM energy"),
    "energy_totals": (lambda s, d: rounded(op.energy_totals(curves(s, d), K)), _C + " SELECT exp_id, bead, round(max_by(e, rn), 6) AS total_energy, round(max(e), 6) AS max_energy, count(*) AS n FROM energy GROUP BY 1, 2 HAVING count(*) >= 2"),
    "range_outliers": (lambda s, d: rounded(op.range_outliers(curves(s, d), ["exp_id"], "bead")), _C + ", " + _OUT + " SELECT exp_id, bead, round(lo, 6) AS lo, round(hi, 6) AS hi, round(r, 6) AS range, good FROM og"),
    "energy_matrix": (
        _matrix,
        _grid_sql("min(lo) AS g0, max(hi) AS g1", 4),
    ),
    "representation_common_grid_intersection": (lambda s, d: long(op.represented(curves(s, d), K, "common_grid_intersection", N), K, digits=4), _grid_sql(_COMMON, 4)),
    "representation_common_grid_union": (lambda s, d: long(op.represented(curves(s, d), K, "common_grid_union", N), K, digits=4), _grid_sql(_COMMON, 4)),
    "representation_percentile_grid": (_rep("percentile_grid"), _pct("ev")),
    "representation_percentile_grid_normalised": (_rep("percentile_grid_normalised"), _pct(_NORM.format(c="ev"))),
    "representation_energy_slope_percentile": (_rep("energy_slope_percentile"), _pct(_SLOPE.format(c="ev", last=N - 1, step=_STEP))),
    "representation_force_percentile_grid": (_rep("force_percentile_grid"), _pct("fv")),
    "representation_force_percentile_normalised": (_rep("force_percentile_normalised"), _pct(_NORM.format(c="fv"))),
    "representation_force_slope_percentile": (_rep("force_slope_percentile"), _pct(_SLOPE.format(c="fv", last=N - 1, step=_STEP))),
    "representation_raw_extension_sorted_by_force": (_rep("raw_extension_sorted_by_force"), _C + " SELECT exp_id, bead, CAST(row_number() OVER (PARTITION BY bead ORDER BY f, frame) - 1 AS INT) AS pos, round(x, 6) AS v FROM curves QUALIFY count(*) OVER (PARTITION BY bead) >= 2"),
    "representation_raw_extension_sorted_by_force_normalised": (
        _rep("raw_extension_sorted_by_force_normalised"),
        _C + " SELECT exp_id, bead, CAST(row_number() OVER (PARTITION BY bead ORDER BY f, frame) - 1 AS INT) AS pos, round((x - min(x) OVER (PARTITION BY bead)) / (max(x) OVER (PARTITION BY bead) - min(x) OVER (PARTITION BY bead)), 6) AS v FROM curves QUALIFY count(*) OVER (PARTITION BY bead) >= 2",
    ),
    "representation_raw_extension_sorted_by_force_subsampled": (
        _rep("raw_extension_sorted_by_force_subsampled"),
        _C + f""", so AS (SELECT exp_id, bead, list(x ORDER BY f, frame) AS xs, count(*) AS n FROM curves GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT exp_id, bead, CAST(i AS INT) AS pos, round(xs[CASE WHEN n <= {N} THEN i + 1 ELSE CAST(floor(i * (n - 1) / {N - 1}.0::DOUBLE) AS INT) + 1 END], 6) AS v FROM so, range({N}) r(i) WHERE i < least(n, {N})""",
    ),
    "representation_arc_length_percentile": (
        lambda s, d: long(op.represented(curves(s, d), K, "arc_length_percentile", N), K, digits=4),
        _C + f""", al AS (SELECT exp_id, bead, rn, e, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(e - lag(e) OVER w, 2)), 0) AS st FROM energy WINDOW w AS (PARTITION BY bead ORDER BY rn)),
ac AS (SELECT *, sum(st) OVER (PARTITION BY bead ORDER BY rn ROWS UNBOUNDED PRECEDING) AS s FROM al),
pts AS (SELECT bead, rn AS k, 100.0::DOUBLE * (s / max(s) OVER (PARTITION BY bead)) AS s, e AS y FROM ac QUALIFY max(s) OVER (PARTITION BY bead) > 0),
want AS (SELECT DISTINCT exp_id, bead, CAST(i AS INT) AS pos, 0 + 100.0::DOUBLE * i / {N - 1}.0::DOUBLE AS g FROM ne, range({N}) r(i) WHERE bead IN (SELECT bead FROM pts)), {_INTERP}
SELECT exp_id, bead, pos, round(v, 4) AS v FROM v""",
    ),
    "representation_landmark_quartiles": (
        _rep("landmark_quartiles"),
        _C + """, g AS (SELECT exp_id, bead, xs, es, fs, n, CAST(i AS INT) AS pos, ((i % 3) + 1) * 0.25::DOUBLE AS q FROM ne, range(6) r(i) WHERE list_max(es) > list_min(es) AND list_max(xs) > list_min(xs)),
t AS (SELECT *, CASE WHEN pos < 3 THEN es ELSE xs END AS k, CASE WHEN pos < 3 THEN xs ELSE fs END AS v FROM g),
u AS (SELECT *, list_min(k) + q * (list_max(k) - list_min(k)) AS goal FROM t), w AS (SELECT *, len(list_filter(k, lambda e: e <= u.goal)) AS i FROM u)
SELECT exp_id, bead, pos, round(CASE WHEN i >= n THEN v[n] ELSE v[i] + (v[i + 1] - v[i]) * (w.goal - k[i]) / (k[i + 1] - k[i]) END, 6) AS v FROM w""",
    ),
    "representation_no_partition": (
        _rep("no_partition"),
        _C + f", m AS (SELECT least(max(n), {N}) AS m FROM ne), q AS (SELECT exp_id, bead, es, n, m, CAST(i AS INT) AS pos, i * (n - 1) / greatest(m - 1, 1)::DOUBLE AS p FROM ne, m, range({N}) r(i) WHERE i < m) SELECT exp_id, bead, pos, round(CASE WHEN n <= m THEN CASE WHEN pos < n THEN es[pos + 1] END ELSE {_at('es', 'p', 'n')} END, 6) AS v FROM q",
    ),
    "rotation_time_grid": (
        lambda s, d: long(op.rotation_represented(turns(s, d), K, "rotation_grid", N), K),
        "WITH " + TURNS + f", so AS (SELECT exp_id, bead, list(z ORDER BY frame) AS zs, count(*) AS n FROM turns GROUP BY 1, 2) SELECT exp_id, bead, CAST(i AS INT) AS pos, round(zs[CASE WHEN n <= {N} THEN i + 1 ELSE CAST(floor(i * (n - 1) / {N - 1}.0::DOUBLE) AS INT) + 1 END], 6) AS v FROM so, range({N}) r(i) WHERE i < least(n, {N})",
    ),
    "rotation_percentile_grid": (
        lambda s, d: long(op.rotation_represented(turns(s, d), K, "percentile_grid", N), K),
        "WITH " + TURNS + ", " + _ROTP + ", " + _GRID + f" SELECT exp_id, bead, pos, round({_at('zs', '(g * (n - 1))', 'n')}, 6) AS v FROM rp, grid",
    ),
    "rotation_landmarks": (
        lambda s, d: long(op.rotation_represented(turns(s, d), K, "landmark_quartiles"), K),
        "WITH " + TURNS + ", " + _ROTP + f", q AS (SELECT exp_id, bead, zs, rs, n, i, ((i % 3) + 1) * 0.25::DOUBLE * (n - 1) AS p FROM rp, range(6) r(i)) SELECT exp_id, bead, CAST(i AS INT) AS pos, round(CASE WHEN i < 3 THEN {_at('rs', 'p', 'n')} ELSE {_at('zs', 'p', 'n')} END, 6) AS v FROM q",
    ),
    "rotation_common_grid_union": (lambda s, d: long(op.rotation_represented(turns(s, d), K, "common_grid_union", N), K), None),
    "rotation_arc_length": (
        lambda s, d: long(op.rotation_represented(turns(s, d), K, "arc_length_percentile", N), K, digits=4),
        "WITH " + TURNS + f""", al AS (SELECT exp_id, bead, row_number() OVER w AS k, z, coalesce(sqrt(pow(rot - lag(rot) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS st FROM turns WINDOW w AS (PARTITION BY bead ORDER BY rot, frame)),
ac AS (SELECT *, sum(st) OVER (PARTITION BY bead ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM al),
pts AS (SELECT exp_id, bead, k, 100.0::DOUBLE * (s / max(s) OVER (PARTITION BY bead)) AS s, z AS y FROM ac QUALIFY max(s) OVER (PARTITION BY bead) > 0),
want AS (SELECT DISTINCT exp_id, bead, CAST(i AS INT) AS pos, 100.0::DOUBLE * i / {N - 1}.0::DOUBLE AS g FROM pts, range({N}) r(i)), {_INTERP}
SELECT exp_id, bead, pos, round(v, 4) AS v FROM v""",
    ),
    "rotation_activity": (
        lambda s, d: rounded(op.gradient_activity(turns(s, d).withColumn("side", F.when(F.col("rot") > 1, 1).when(F.col("rot") < -1, -1)).where("side is not null"), K)),
        "WITH " + TURNS + """, sd AS (SELECT *, CASE WHEN rot > 1 THEN 1 ELSE -1 END AS side FROM turns WHERE abs(rot) > 1),
h AS (SELECT *, rot - lag(rot) OVER w AS h1, lead(rot) OVER w - rot AS h2, z - lag(z) OVER w AS d1, lead(z) OVER w - z AS d2 FROM sd WINDOW w AS (PARTITION BY exp_id, bead, side ORDER BY frame)),
g AS (SELECT *, CASE WHEN h1 IS NULL THEN d2 / nullif(h2, 0) WHEN h2 IS NULL THEN d1 / nullif(h1, 0) ELSE (h1 * h1 * d2 + h2 * h2 * d1) / nullif(h1 * h2 * (h1 + h2), 0) END AS g FROM h)
SELECT exp_id, bead, side, count(*) AS n, round(CASE WHEN max(rot) - min(rot) >= 1e-12 AND count(*) >= 2 THEN stddev_pop(g) END, 6) AS activity FROM g GROUP BY 1, 2, 3""",
    ),
    "rotation_labels": (
        lambda s, d: op.rotation_labels(turns(s, d), K, thresh=20.0, least=5),
        "WITH " + TURNS + """, sd AS (SELECT *, CASE WHEN rot > 1 THEN 1 ELSE -1 END AS side FROM turns WHERE abs(rot) > 1),
h AS (SELECT *, rot - lag(rot) OVER w AS h1, lead(rot) OVER w - rot AS h2, z - lag(z) OVER w AS d1, lead(z) OVER w - z AS d2 FROM sd WINDOW w AS (PARTITION BY exp_id, bead, side ORDER BY frame)),
g AS (SELECT *, CASE WHEN h1 IS NULL THEN d2 / nullif(h2, 0) WHEN h2 IS NULL THEN d1 / nullif(h1, 0) ELSE (h1 * h1 * d2 + h2 * h2 * d1) / nullif(h1 * h2 * (h1 + h2), 0) END AS g FROM h),
a AS (SELECT exp_id, bead, side, count(*) AS n, CASE WHEN max(rot) - min(rot) >= 1e-12 AND count(*) >= 2 THEN stddev_pop(g) END AS v FROM g GROUP BY 1, 2, 3),
c AS (SELECT exp_id, bead, sum(CASE WHEN n >= 5 AND v >= 20.0 THEN 1 ELSE 0 END) AS label FROM a GROUP BY 1, 2)
SELECT t.exp_id, t.bead, CAST(coalesce(c.label, 0) AS INT) AS label FROM (SELECT DISTINCT exp_id, bead FROM turns) t LEFT JOIN c ON c.exp_id = t.exp_id AND c.bead = t.bead""",
    ),
    "columns_filled": (lambda s, d: rounded(op.columns_filled(_emb(s, d), ["grp"])), "WITH " + _EMB + " SELECT grp, id, pos, round(x, 6) AS x FROM fil"),
    "columns_standardised": (
        lambda s, d: rounded(op.standardised(op.columns_filled(_emb(s, d), ["grp"]), ["grp"])),
        "WITH " + _EMB + " SELECT grp, id, pos, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 6) + 0.0::DOUBLE AS x FROM fil WINDOW w AS (PARTITION BY grp, pos)",
    ),
    "median_outliers": (
        lambda s, d: op.median_outliers(_dist(s, d), ["grp"], 1.5).select("grp", "vec_id", "label"),
        "WITH " + _DIST + """, m AS (SELECT *, median(dist) OVER (PARTITION BY grp) AS m FROM de), v AS (SELECT *, 1.4826::DOUBLE * median(abs(dist - m)) OVER (PARTITION BY grp) AS mad FROM m)
SELECT grp, vec_id, CASE WHEN mad > 0 AND dist > m + 1.5 * mad THEN -1 ELSE label END AS label FROM v""",
    ),
    "small_clusters": (lambda s, d: op.small_clusters(_dist(s, d), ["grp"], 10).select("grp", "vec_id", "label"), "WITH " + _DIST + " SELECT grp, vec_id, CASE WHEN count(*) OVER (PARTITION BY grp, label) < 10 THEN -1 ELSE label END AS label FROM de"),
    "centroids": (
        lambda s, d: rounded(op.centroids(table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x0")).withColumn("x", F.col("x0").cast("double")), [])),
        "WITH e AS (SELECT label, CAST(unnest(range(64)) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, pos, round(avg(x), 6) AS x FROM e GROUP BY 1, 2",
    ),
}
