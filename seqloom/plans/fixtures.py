"""Engine tables built from the driver's tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.runtime import table

NAN = float("nan")


def trace(spark: SparkSession, d: str) -> DataFrame:
    """(exp_id, bead, frame, t, z, event_type, event_id): one bead a user, in order of time."""
    e = table(spark, d, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select((F.col("user_id") % 10).alias("exp_id"), F.col("user_id").alias("bead"), frame.cast("long").alias("frame"), t.alias("t"), F.col("value").alias("z"), "event_type", "event_id")


TRACE = """trace AS (SELECT user_id % 10 AS exp_id, user_id AS bead, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  epoch_us(ts) / 1e6 AS t, value AS z, event_type, event_id FROM events)"""


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """The trace with every 7th event missing (NaN) and every 31st infinite."""
    x = F.when(F.col("event_id") % 7 == 0, F.lit(NAN)).when(F.col("event_id") % 31 == 0, F.lit(float("inf"))).otherwise(F.col("z"))
    return trace(spark, d).withColumn("z", x)


GAPPY = TRACE + """,
gappy AS (SELECT exp_id, bead, frame, t, event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 31 = 0 THEN 'Infinity'::DOUBLE ELSE z END AS z FROM trace)"""


def holed(spark: SparkSession, d: str) -> DataFrame:
    """The trace with every 7th event missing (NaN)."""
    return trace(spark, d).withColumn("z", F.when(F.col("event_id") % 7 == 0, F.lit(NAN)).otherwise(F.col("z")))


HOLED = TRACE + """,
holed AS (SELECT exp_id, bead, frame, t, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE z END AS z FROM trace)"""


def script(spark: SparkSession, d: str) -> DataFrame:
    """(bead, seq, t0, t1, mag_pos, mag_speed, mag_rot, rot_speed): a user's sign-ups as moves."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    k = F.get_json_object("props", "$.k").cast("int")
    w = W.partitionBy("bead").orderBy("t0", "event_id")
    moves = e.select(
        F.col("user_id").alias("bead"), "event_id", t.alias("t0"), (k / 10.0).alias("mag_pos"), F.when(k % 2 == 0, 0.3).otherwise(0.5).alias("mag_speed"), F.greatest(k - 60, F.lit(0)).cast("double").alias("mag_rot"), F.lit(1.0).alias("rot_speed")
    )
    moves = moves.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    travel = 3600.0 * F.abs(F.col("mag_pos") - F.lag("mag_pos", 1, 0.0).over(w)) / F.col("mag_speed")
    return moves.withColumn("t1", F.col("t0") + travel).select("bead", "seq", "t0", "t1", "mag_pos", "mag_speed", "mag_rot", "rot_speed")


SCRIPT = """moves AS (SELECT user_id AS bead, event_id, epoch_us(ts) / 1e6 AS t0, CAST(json_extract(props, '$.k') AS INTEGER) / 10.0::DOUBLE AS mag_pos,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS mag_speed,
  CAST(greatest(CAST(json_extract(props, '$.k') AS INTEGER) - 60, 0) AS DOUBLE) AS mag_rot, 1.0::DOUBLE AS rot_speed FROM events WHERE event_type = 'signup'),
script AS (SELECT bead, row_number() OVER w - 1 AS seq, t0, t0 + 3600.0::DOUBLE * abs(mag_pos - lag(mag_pos, 1, 0.0::DOUBLE) OVER w) / mag_speed AS t1, mag_pos, mag_speed, mag_rot, rot_speed
  FROM moves WINDOW w AS (PARTITION BY bead ORDER BY t0, event_id))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the trace between the moves."""
    return trace(spark, d).where("event_type <> 'signup'").select("bead", "frame", "t", "z")


FRAMES = TRACE + """,
frames AS (SELECT bead, frame, t, z FROM trace WHERE event_type <> 'signup')"""

#: Position and rotation at each frame: the move that holds, interpolated.
PLACED = FRAMES + ", " + SCRIPT + """,
spans AS (SELECT *, lag(mag_pos, 1, 0.0::DOUBLE) OVER w AS was_pos, lag(mag_rot, 1, 0.0::DOUBLE) OVER w AS was_rot, lead(t0) OVER w AS until, row_number() OVER w AS k
  FROM script WINDOW w AS (PARTITION BY bead ORDER BY t0, seq)),
placed AS (SELECT f.*,
  CASE WHEN f.t < s.t0 THEN was_pos WHEN s.t1 > s.t0 AND f.t <= s.t1 THEN was_pos + (mag_pos - was_pos) * ((f.t - s.t0) / (s.t1 - s.t0)) ELSE mag_pos END AS pos,
  CASE WHEN f.t < s.t0 THEN was_rot WHEN s.t1 > s.t0 AND f.t <= s.t1 THEN was_rot + (mag_rot - was_rot) * ((f.t - s.t0) / (s.t1 - s.t0)) ELSE mag_rot END AS rot
  FROM frames f LEFT JOIN spans s ON s.bead = f.bead AND (s.k = 1 OR f.t >= s.t0) AND (s.until IS NULL OR f.t < s.until))"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    """(exp_id, bead, frame, x, f): extension and force at each frame."""
    from seqloom.operators.align import actuator_at, force_of

    placed = actuator_at(frames(spark, d), script(spark, d), ["bead"])
    return placed.select((F.col("bead") % 10).alias("exp_id"), "bead", "frame", F.col("z").alias("x"), force_of(F.col("mag_pos")).alias("f")).where("f is not null")


CURVES = PLACED + """,
curves AS (SELECT bead % 10 AS exp_id, bead, frame, z AS x, 5.7061::DOUBLE * exp(-1.0203::DOUBLE * pos) + 3.1215::DOUBLE * exp(-0.5843::DOUBLE * pos) AS f FROM placed WHERE pos IS NOT NULL),
steps AS (SELECT *, row_number() OVER w - 1 AS rn, coalesce(CASE WHEN x - lag(x) OVER w <> 0 THEN 0.5::DOUBLE * (f + lag(f) OVER w) * (x - lag(x) OVER w) ELSE 0 END, 0) AS area
  FROM curves WINDOW w AS (PARTITION BY bead ORDER BY x, frame)),
energy AS (SELECT exp_id, bead, frame, x, f, rn, sum(area) OVER (PARTITION BY bead ORDER BY rn ROWS UNBOUNDED PRECEDING) AS e FROM steps),
ne AS (SELECT exp_id, bead, list(x ORDER BY rn) AS xs, list(e ORDER BY rn) AS es, list(f ORDER BY rn) AS fs, count(*) AS n FROM energy GROUP BY exp_id, bead HAVING count(*) >= 2)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(exp_id, bead, frame, rot, z): rotation and z at each frame, rotation centred on 15."""
    from seqloom.operators.align import actuator_at

    placed = actuator_at(frames(spark, d), script(spark, d), ["bead"], "mag_rot", "rot")
    return placed.where("rot is not null").select((F.col("bead") % 10).alias("exp_id"), "bead", "frame", (F.col("rot") - 15.0).alias("rot"), "z")


TURNS = PLACED + """,
turns AS (SELECT bead % 10 AS exp_id, bead, frame, rot - 15.0::DOUBLE AS rot, z FROM placed WHERE rot IS NOT NULL)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))  # no negative zero
    return df


def long(df: DataFrame, keys: list[str], v: str = "v", digits: int = 6) -> DataFrame:
    """An array column as (keys, pos, v), rounded; NaN as NULL."""
    return df.select(*keys, F.posexplode(v).alias("pos", "v")).withColumn("v", F.round(F.nanvl("v", F.lit(None).cast("double")), digits) + F.lit(0.0))
