"""Queries of the alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import align as op
from seqloom.operators import curves
from seqloom.plans.fixtures import CURVES, FRAMES, PLACED, SCRIPT, TRACE, frames, rounded, script, trace
from seqloom.runtime import table

B = ["bead"]
_SCR = "WITH " + SCRIPT


def _interval_rows(s, d):
    """Orders of a customer as interval rows: hours since 1 January of the year as dt, price as position."""
    o = table(s, d, "orders")
    seq = F.row_number().over(op.W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1
    return o.select(
        F.col("o_custkey").alias("bead"), seq.alias("seq"), (F.when(seq == 0, F.col("o_custkey") % 2) .otherwise(F.col("o_orderkey") % 11)).cast("double").alias("dt"), (F.col("o_orderkey") % 97 / 10.0).alias("pos"),
        F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(0.7).alias("speed"), F.lit(0.0).alias("rot"), F.lit(1.0).alias("rot_speed"),
    )


def _rotation_script(s, d):
    return script(s, d)


def _commands(s, d):
    """Command scripts written from a customer's orders."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    verb = F.when(k % 3 == 0, F.concat(F.lit("move magpos "), (k % 7).cast("string"), F.lit(" speed 0.5"))).when(k % 3 == 1, F.concat(F.lit("idle "), (k % 13).cast("string"))).otherwise(F.concat(F.lit(" move  magrot "), (k % 50).cast("string"), F.lit(" speed 4 ")))
    packed = F.array_sort(F.collect_list(F.struct(k.alias("k"), verb.alias("v"))))
    return o.groupBy(F.col("o_custkey").alias("bead")).agg(F.array_join(F.transform(packed, lambda x: x["v"]), ";").alias("text"))


def _regions_joined(s, d):
    return op.clipped(frames(s, d), op.force_regions(script(s, d), B), B)


_FORCE = """,
f AS (SELECT *, lag(mag_pos, 1, 0.0::DOUBLE) OVER (PARTITION BY bead ORDER BY seq) AS prev, lead(t0) OVER (PARTITION BY bead ORDER BY seq) AS nxt FROM script)"""
_ROT = """,
z AS (SELECT *, abs(mag_rot) <= 1e-6 AS zero FROM script),
y AS (SELECT *, NOT zero AND coalesce(lag(zero) OVER w, true) AS starts, lead(zero) OVER w AS az, lead(t1) OVER w AS ae FROM z WINDOW w AS (PARTITION BY bead ORDER BY seq)),
x AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY bead ORDER BY seq) AS run FROM y WHERE NOT zero),
rot AS (SELECT bead, CAST(run - 1 AS BIGINT) AS region_id, min(t0) AS t0, max_by(CASE WHEN az THEN ae ELSE t1 END, seq) AS t1 FROM x GROUP BY bead, run)"""
_SPEED = "fr AS (SELECT bead, row_number() OVER (PARTITION BY bead ORDER BY seq) - 1 AS region_id, t0, t1 FROM script WHERE mag_speed = 0.3::DOUBLE)"


def _slice(s, d):
    """Energy of each force region: as-of position, force, interval clip, trapezoid, totals."""
    placed = op.actuator_at(frames(s, d), script(s, d), B)
    rows = op.clipped(placed.withColumn("f", op.force_of(F.col("mag_pos"))), op.force_regions(script(s, d), B, use_move_duration=False), B)
    return rounded(curves.energy_totals(rows.select("bead", "region_id", "frame", F.col("z").alias("x"), "f"), ["bead", "region_id"]))


#: The same as a machine that reads one move after another: (start, end, gap) and the run that a move closes.
_RELATIVE = "WITH RECURSIVE " + _SCR.removeprefix("WITH ") + """, m AS (SELECT bead, seq, t0, mag_speed = 0.3::DOUBLE AS hit, max(seq) OVER (PARTITION BY bead) AS last FROM script),
run AS (
  SELECT bead, CAST(-1 AS BIGINT) AS seq, NULL::DOUBLE AS a, NULL::DOUBLE AS b, 0 AS gap, NULL::DOUBLE AS ca, NULL::DOUBLE AS cb FROM m WHERE seq = 0
  UNION ALL
  SELECT m.bead, m.seq, CASE WHEN hit THEN coalesce(a, t0) WHEN gap < 1 THEN a END, CASE WHEN hit THEN b WHEN a IS NOT NULL AND gap < 1 THEN t0 END, CASE WHEN hit OR a IS NULL THEN 0 WHEN gap < 1 THEN gap + 1 ELSE 0 END,
    CASE WHEN NOT hit AND a IS NOT NULL AND gap >= 1 THEN a END, CASE WHEN NOT hit AND a IS NOT NULL AND gap >= 1 THEN coalesce(b, -1.0) END
  FROM run JOIN m ON m.bead = run.bead AND m.seq = run.seq + 1),
ends AS (SELECT bead, ca AS t0, cb AS t1 FROM run WHERE ca IS NOT NULL UNION ALL SELECT run.bead, a, coalesce(b, m.t0) FROM run JOIN m ON m.bead = run.bead AND m.seq = run.seq AND m.seq = m.last WHERE a IS NOT NULL)
SELECT bead, CAST(row_number() OVER (PARTITION BY bead ORDER BY t0) - 1 AS INT) AS region_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM ends"""

#: The same as a machine that reads one command after another.
_COMMANDS = """WITH RECURSIVE c AS (SELECT o_custkey AS bead, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey % 3 AS kind,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 7 WHEN 1 THEN o_orderkey % 13 ELSE o_orderkey % 50 END AS DOUBLE) AS v FROM orders),
run(bead, seq, kind, began, clock, last, pos, speed, rot, rspeed) AS (
  SELECT DISTINCT bead, CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c
  UNION ALL
  SELECT c.bead, c.seq, c.kind, clock,
    CASE c.kind WHEN 0 THEN clock + abs(v - pos) / 0.5::DOUBLE WHEN 2 THEN clock + abs(v - rot) / 4.0::DOUBLE ELSE clock + greatest(0.0::DOUBLE, v - last) END,
    CASE c.kind WHEN 0 THEN abs(v - pos) / 0.5::DOUBLE WHEN 2 THEN abs(v - rot) / 4.0::DOUBLE ELSE 0.0::DOUBLE END,
    CASE WHEN c.kind = 0 THEN v ELSE pos END, CASE WHEN c.kind = 0 THEN 0.5::DOUBLE ELSE speed END, CASE WHEN c.kind = 2 THEN v ELSE rot END, CASE WHEN c.kind = 2 THEN 4.0::DOUBLE ELSE rspeed END
  FROM run JOIN c ON c.bead = run.bead AND c.seq = run.seq + 1)
SELECT bead, CAST(seq AS INT) AS seq, round(began, 6) AS t0, round(clock, 6) AS t1, pos AS mag_pos, speed AS mag_speed, rot AS mag_rot, rspeed AS rot_speed FROM run WHERE kind <> 1"""


QUERIES = {
    "script_events": (lambda s, d: rounded(script(s, d)), _SCR + " SELECT bead, seq, round(t0, 6) AS t0, round(t1, 6) AS t1, round(mag_pos, 6) AS mag_pos, round(mag_speed, 6) AS mag_speed, round(mag_rot, 6) AS mag_rot, round(rot_speed, 6) AS rot_speed FROM script"),
    "interval_script": (
        lambda s, d: rounded(op.parse_interval_script(_interval_rows(s, d), B)),
        """WITH r AS (SELECT o_custkey AS bead, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders),
i AS (SELECT bead, seq, CAST(CASE WHEN seq = 0 THEN bead % 2 ELSE k % 11 END AS DOUBLE) AS dt, (k % 97) / 10.0::DOUBLE AS pos, CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS speed FROM r),
p AS (SELECT *, abs(first_value(dt) OVER w) <= 1e-8 AS abso, greatest(dt, 0) AS len, lag(pos, 1, 0.0::DOUBLE) OVER w AS was, coalesce(sum(greatest(dt, 0)) OVER (PARTITION BY bead ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM i WINDOW w AS (PARTITION BY bead ORDER BY seq)),
t AS (SELECT *, CASE WHEN abso THEN dt ELSE cur END AS t0, CASE WHEN speed > 0 THEN abs(pos - was) / speed ELSE 0 END AS tr FROM p)
SELECT bead, seq, round(t0, 6) AS t0, round(t0 + CASE WHEN NOT abso AND len > 0 THEN least(tr, len) ELSE tr END, 6) AS t1, round(pos, 6) AS mag_pos, round(speed, 6) AS mag_speed, 0.0::DOUBLE AS mag_rot, 1.0::DOUBLE AS rot_speed FROM t""",
    ),
    "command_script": (lambda s, d: rounded(op.parse_command_script(_commands(s, d), B)), _COMMANDS),
    "actuator_positions": (lambda s, d: rounded(op.actuator_at(frames(s, d), script(s, d), B).select("bead", "frame", "mag_pos")), "WITH " + PLACED + " SELECT bead, frame, round(pos, 6) AS mag_pos FROM placed"),
    "actuator_rotations": (lambda s, d: rounded(op.actuator_at(frames(s, d), script(s, d), B, "mag_rot").select("bead", "frame", "mag_rot")), "WITH " + PLACED + " SELECT bead, frame, round(rot, 6) AS mag_rot FROM placed"),
    "actuator_forces": (
        lambda s, d: rounded(op.actuator_at(frames(s, d), script(s, d), B).select("bead", "frame", op.force_of(F.col("mag_pos")).alias("force"))),
        "WITH " + PLACED + " SELECT bead, frame, round(5.7061::DOUBLE * exp(-1.0203::DOUBLE * pos) + 3.1215::DOUBLE * exp(-0.5843::DOUBLE * pos), 6) AS force FROM placed",
    ),
    "force_regions_by_speed": (
        lambda s, d: rounded(op.force_regions(script(s, d), B, speed=0.3, min_distance=1.0)),
        _SCR + _FORCE + " SELECT bead, row_number() OVER (PARTITION BY bead ORDER BY seq) - 1 AS region_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM f WHERE mag_speed = 0.3::DOUBLE AND abs(mag_pos - prev) >= 1.0",
    ),
    "force_regions_increasing": (
        lambda s, d: rounded(op.force_regions(script(s, d), B, extension_only=True, use_move_duration=False)),
        _SCR + _FORCE + " SELECT bead, row_number() OVER (PARTITION BY bead ORDER BY seq) - 1 AS region_id, round(t0, 6) AS t0, round(coalesce(nxt, t1), 6) AS t1 FROM f WHERE mag_pos > prev AND prev <> 0",
    ),
    "force_regions_decreasing": (
        lambda s, d: rounded(op.force_regions(script(s, d), B, extension_only=True, increasing=False)),
        _SCR + _FORCE + " SELECT bead, row_number() OVER (PARTITION BY bead ORDER BY seq) - 1 AS region_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM f WHERE mag_pos < prev",
    ),
    "rotation_regions": (lambda s, d: rounded(op.rotation_regions(_rotation_script(s, d), B)), _SCR + _ROT + " SELECT bead, region_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM rot"),
    "relative_regions": (lambda s, d: rounded(op.relative_regions(script(s, d), B)), _RELATIVE),
    "clipped_to_regions": (
        lambda s, d: rounded(_regions_joined(s, d).select("bead", "region_id", "rn", "frame", "z")),
        "WITH " + FRAMES + ", " + SCRIPT + ", " + _SPEED + " SELECT f.bead, region_id, row_number() OVER (PARTITION BY f.bead, region_id ORDER BY f.t, f.frame) - 1 AS rn, frame, round(z, 6) AS z FROM frames f JOIN fr ON fr.bead = f.bead AND f.t BETWEEN fr.t0 AND fr.t1",
    ),
    "clipped_by_bucket": (
        lambda s, d: rounded(op.clipped(frames(s, d), op.force_regions(script(s, d), B), B, bucket=86400.0).select("bead", "region_id", "rn", "frame", "z")),
        "WITH " + FRAMES + ", " + SCRIPT + ", " + _SPEED + " SELECT f.bead, region_id, row_number() OVER (PARTITION BY f.bead, region_id ORDER BY f.t, f.frame) - 1 AS rn, frame, round(z, 6) AS z FROM frames f JOIN fr ON fr.bead = f.bead AND f.t BETWEEN fr.t0 AND fr.t1",
    ),
    "region_report": (
        lambda s, d: rounded(op.regions_in_range(frames(s, d), op.force_regions(script(s, d), B), B).select("bead", "region_id", "t0", "t1", "in_range", "n_frames")),
        "WITH " + FRAMES + ", " + SCRIPT + ", " + _SPEED + """, sp AS (SELECT bead, min(t) AS a, max(t) AS b FROM frames GROUP BY bead),
n AS (SELECT f.bead, region_id, count(*) AS n FROM frames f JOIN fr ON fr.bead = f.bead AND f.t BETWEEN fr.t0 AND fr.t1 GROUP BY 1, 2)
SELECT fr.bead, fr.region_id, round(t0, 6) AS t0, round(t1, 6) AS t1, coalesce(a <= t0 AND t1 <= b, false) AS in_range, coalesce(n, 0) AS n_frames FROM fr LEFT JOIN sp USING (bead) LEFT JOIN n ON n.bead = fr.bead AND n.region_id = fr.region_id""",
    ),
    "rotation_region_report": (
        lambda s, d: rounded(op.regions_in_range(frames(s, d), op.rotation_regions(script(s, d), B), B).select("bead", "region_id", "t0", "t1", "in_range", "n_frames")),
        "WITH " + FRAMES + ", " + SCRIPT + _ROT + """, sp AS (SELECT bead, min(t) AS a, max(t) AS b FROM frames GROUP BY bead),
n AS (SELECT f.bead, region_id, count(*) AS n FROM frames f JOIN rot fr ON fr.bead = f.bead AND f.t BETWEEN fr.t0 AND fr.t1 GROUP BY 1, 2)
SELECT fr.bead, fr.region_id, round(t0, 6) AS t0, round(t1, 6) AS t1, coalesce(a <= t0 AND t1 <= b, false) AS in_range, coalesce(n, 0) AS n_frames FROM rot fr LEFT JOIN sp USING (bead) LEFT JOIN n ON n.bead = fr.bead AND n.region_id = fr.region_id""",
    ),
    "extensions": (
        lambda s, d: rounded(op.extensions(frames(s, d), script(s, d), B).groupBy("bead", "region_id").agg(F.count(F.lit(1)).alias("n"), F.sum("force").alias("force"), F.sum("mag_rot").alias("rot")), digits=5),
        "WITH " + PLACED + ", " + _SPEED + """, whole AS (SELECT bead, CAST(0 AS BIGINT) AS region_id, min(t) AS t0, max(t) AS t1 FROM frames WHERE bead NOT IN (SELECT bead FROM fr) GROUP BY bead),
r AS (SELECT * FROM fr UNION ALL SELECT * FROM whole)
SELECT p.bead, region_id, count(*) AS n, round(sum(5.7061::DOUBLE * exp(-1.0203::DOUBLE * coalesce(pos, 0)) + 3.1215::DOUBLE * exp(-0.5843::DOUBLE * coalesce(pos, 0))), 5) AS force, round(sum(rot), 5) AS rot
FROM placed p JOIN r ON r.bead = p.bead AND p.t BETWEEN r.t0 AND r.t1 GROUP BY 1, 2""",
    ),
    "less_reference": (
        lambda s, d: rounded(op.less_reference(trace(s, d), ["exp_id"], "bead", -1).select("bead", "frame", "z")),
        "WITH " + TRACE + ", x AS (SELECT *, max(bead) OVER (PARTITION BY exp_id) AS rb FROM trace) SELECT bead, frame, round(z - coalesce(max(CASE WHEN bead = rb THEN z END) OVER (PARTITION BY exp_id, frame), 0), 6) AS z FROM x",
    ),
    "matched_positions": (
        lambda s, d: op.matched_positions(
            table(s, d, "customer").select((F.col("c_custkey") % 7).alias("exp_id"), "c_custkey", (F.col("c_custkey") % 40).cast("int").alias("x"), F.col("c_nationkey").alias("y")),
            table(s, d, "supplier").select((F.col("s_suppkey") % 7).alias("exp_id"), (F.col("s_suppkey") % 40).cast("int").alias("x"), F.col("s_nationkey").alias("y")),
            ["exp_id"],
        ).select("c_custkey", "is_good"),
        "SELECT c_custkey, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 7 = c_custkey % 7 AND s_suppkey % 40 = c_custkey % 40 AND s_nationkey = c_nationkey) AS is_good FROM customer",
    ),
    "labelled_mask": (
        lambda s, d: op.labelled_mask(
            trace(s, d).select("exp_id", "bead").distinct(),
            table(s, d, "labels").select((F.col("doc_id") % 7).alias("exp_id"), (F.col("doc_id") % 150).alias("bead"), F.col("quality").alias("rank")),
        ).select("exp_id", "bead", "is_good"),
        "WITH " + TRACE + """, l AS (SELECT doc_id % 7 AS exp_id, doc_id % 150 AS bead, quality AS rnk FROM labels), f AS (SELECT exp_id, min(rnk) AS rnk FROM l GROUP BY 1),
g AS (SELECT DISTINCT l.exp_id, l.bead FROM l JOIN f USING (exp_id, rnk))
SELECT DISTINCT t.exp_id, t.bead, g.bead IS NOT NULL OR f.exp_id IS NULL AS is_good FROM trace t LEFT JOIN g ON g.exp_id = t.exp_id AND g.bead = t.bead LEFT JOIN f ON f.exp_id = t.exp_id""",
    ),
    "labelled_columns": (
        lambda s, d: op.split_by_label(
            trace(s, d).select("exp_id", "bead").distinct(),
            table(s, d, "labels").select((F.col("doc_id") % 10).alias("exp_id"), F.col("doc_id").alias("bead"), F.when(F.col("toxic") == 1, "uc").otherwise("gc").alias("label_class")),
            ["exp_id", "bead"],
        ).select("exp_id", "bead", "name"),
        "WITH " + TRACE + " SELECT DISTINCT t.exp_id, t.bead, CASE WHEN doc_id IS NULL THEN 'bb' WHEN toxic = 1 THEN 'uc' ELSE 'gc' END || '_' || CAST(t.bead AS VARCHAR) AS name FROM trace t LEFT JOIN labels l ON l.doc_id = t.bead",
    ),
    "path_overlap": (
        lambda s, d: op.overlap(table(s, d, "customer").select(F.col("c_nationkey").alias("path")), table(s, d, "supplier").select(F.col("s_nationkey").alias("path")), "path"),
        "SELECT c_nationkey AS path FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "region_energy": (
        _slice,
        "WITH " + PLACED + """, fr AS (SELECT bead, row_number() OVER (PARTITION BY bead ORDER BY seq) - 1 AS region_id, t0, coalesce(nxt, t1) AS t1 FROM (SELECT *, lead(t0) OVER (PARTITION BY bead ORDER BY seq) AS nxt FROM script) WHERE mag_speed = 0.3::DOUBLE),
c AS (SELECT p.bead, region_id, frame, z AS x, 5.7061::DOUBLE * exp(-1.0203::DOUBLE * pos) + 3.1215::DOUBLE * exp(-0.5843::DOUBLE * pos) AS f FROM placed p JOIN fr ON fr.bead = p.bead AND p.t BETWEEN fr.t0 AND fr.t1),
s AS (SELECT *, row_number() OVER w - 1 AS rn, coalesce(CASE WHEN x - lag(x) OVER w <> 0 THEN 0.5::DOUBLE * (f + lag(f) OVER w) * (x - lag(x) OVER w) ELSE 0 END, 0) AS a FROM c WHERE f IS NOT NULL WINDOW w AS (PARTITION BY bead, region_id ORDER BY x, frame)),
e AS (SELECT *, sum(a) OVER (PARTITION BY bead, region_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS e FROM s)
SELECT bead, region_id, round(max_by(e, rn), 6) AS total_energy, round(max(e), 6) AS max_energy, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) >= 2""",
    ),
}
