"""Actuator scripts, intervals and alignment in time.

A script is a DataFrame ``(keys..., seq, t0, t1, mag_pos, mag_speed, mag_rot, rot_speed)``, one
row per move. Joins over time always carry the trace's own keys as an equi condition; ranges
are residual conditions or, for traces without a selective key, run through time buckets.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCRIPT_FIELDS = "t0 double, t1 double, mag_pos double, mag_speed double, mag_rot double, rot_speed double"


def commands(scripts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, seq, verb, what, value, speed) of ``;``-separated move and idle commands."""
    cmd = scripts.select(*keys, F.posexplode(F.split(text, ";")).alias("seq", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    cmd = cmd.where(F.col("raw").startswith("move") | F.col("raw").startswith("idle")).withColumn("p", F.split("raw", " "))
    part = lambda i: F.get("p", F.lit(i))
    move = part(0) == "move"
    return cmd.select(
        *keys,
        "seq",
        part(0).alias("verb"),
        F.when(move, part(1)).alias("what"),
        F.when(move, part(2)).otherwise(part(1)).try_cast("double").alias("value"),
        F.when(move & (part(3) == "speed"), part(4).try_cast("double")).when(move, F.lit(1.0)).alias("speed"),
    )


def parse_command_script(scripts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Script rows of ``;``-separated commands; the clock runs through an array fold, one script a row."""
    cmds = commands(scripts, keys, text).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "verb", "what", "value", "speed"))).alias("c"))
    zero, one = F.lit(0.0), F.lit(1.0)
    empty = F.array().cast("array<struct<seq:int,t0:double,t1:double,mag_pos:double,mag_speed:double,mag_rot:double,rot_speed:double>>")
    start = F.struct(
        zero.alias("clock"), zero.alias("last"), zero.alias("pos"), one.alias("speed"), zero.alias("rot"), zero.alias("rspeed"), empty.alias("events")
    )

    def step(s: Column, c: Column) -> Column:
        idle = c["verb"] == "idle"
        is_pos, is_rot = c["what"] == "magpos", c["what"] == "magrot"
        pos = F.when(is_pos, c["value"]).otherwise(s["pos"])
        rot = F.when(is_rot, c["value"]).otherwise(s["rot"])
        speed = F.when(is_pos, c["speed"]).otherwise(s["speed"])
        rspeed = F.when(is_rot, c["speed"]).otherwise(s["rspeed"])
        taken = F.when(is_pos & (c["speed"] > 0), F.try_divide(F.abs(c["value"] - s["pos"]), c["speed"])).when(is_rot & (c["speed"] > 0), F.try_divide(F.abs(c["value"] - s["rot"]), c["speed"])).otherwise(zero)
        end = s["clock"] + taken
        event = F.struct(c["seq"].alias("seq"), s["clock"].alias("t0"), end.alias("t1"), pos.alias("mag_pos"), speed.alias("mag_speed"), rot.alias("mag_rot"), rspeed.alias("rot_speed"))
        moved = F.struct(end.alias("clock"), taken.alias("last"), pos.alias("pos"), speed.alias("speed"), rot.alias("rot"), rspeed.alias("rspeed"), F.concat(s["events"], F.array(event)).alias("events"))
        waited = F.struct(
            (s["clock"] + F.greatest(zero, c["value"] - s["last"])).alias("clock"), zero.alias("last"), s["pos"].alias("pos"), s["speed"].alias("speed"), s["rot"].alias("rot"), s["rspeed"].alias("rspeed"), s["events"].alias("events")
        )
        return F.when(idle, waited).when(c["value"].isNotNull(), moved).otherwise(s)

    events = cmds.select(*keys, F.explode(F.aggregate("c", start, step)["events"]).alias("e"))
    return events.select(*keys, "e.*")


def parse_interval_script(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Script rows from (keys, seq, dt, pos, speed, rot, rot_speed).

    Times are absolute if the first interval is about 0; else each row starts where the one before ends, and its move is cut at its own interval.
    """
    w = W.partitionBy(*keys).orderBy("seq")
    absolute = F.abs(F.first("dt").over(w)) <= 1e-8
    length = F.greatest(F.col("dt"), F.lit(0.0))
    start = F.when(absolute, F.col("dt")).otherwise(F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    travel = F.when(F.col("speed") > 0, F.try_divide(F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(w)), F.col("speed"))).otherwise(F.lit(0.0))
    travel = F.when(~absolute & (length > 0), F.least(travel, length)).otherwise(travel)
    out = rows.withColumn("t0", start).withColumn("t1", start + travel)
    return out.select(*keys, "seq", "t0", "t1", F.col("pos").alias("mag_pos"), F.col("speed").alias("mag_speed"), F.col("rot").alias("mag_rot"), "rot_speed")


def actuator_at(frames: DataFrame, script: DataFrame, keys: list[str], what: str = "mag_pos", out: str | None = None) -> DataFrame:
    """``frames`` (keys, t, ...) with the actuator's position at each time: an as-of join with interpolation.

    Each move holds until the next one starts; the position before a move is the target of the
    one before it (0 at first). Frames before the first move have 0; frames without a script are kept with null.
    """
    out = out or what
    w = W.partitionBy(*keys).orderBy("t0", "seq")
    moves = script.select(
        *keys, F.col("t0").alias("m0"), F.col("t1").alias("m1"), F.col(what).alias("to"), F.lag(what, 1, 0.0).over(w).alias("was"), F.lead("t0").over(w).alias("until"), F.row_number().over(w).alias("k")
    )
    on = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in keys]
    begins = (F.col("k") == 1) | (F.col("t") >= F.col("m0"))
    holds = begins & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    joined = frames.alias("f").join(moves.alias("s"), [*on, holds], "left")
    share = F.try_divide(F.col("t") - F.col("m0"), F.col("m1") - F.col("m0"))
    inside = (F.col("m1") > F.col("m0")) & (F.col("t") <= F.col("m1"))
    value = F.when(F.col("t") < F.col("m0"), F.col("was")).when(inside, F.col("was") + (F.col("to") - F.col("was")) * share).otherwise(F.col("to"))
    return joined.select("f.*", value.alias(out))


def force_of(position: Column, equation: str = "default") -> Column:
    """Force from the actuator's position, a sum of two fixed exponentials."""
    if equation != "default":
        raise ValueError(f"unknown force equation: {equation}")
    return 5.7061 * F.exp(-1.0203 * position) + 3.1215 * F.exp(-0.5843 * position)


def force_regions(
    script: DataFrame, keys: list[str], speed: float = 0.3, min_distance: float = 0.0, use_move_duration: bool = True, extension_only: bool = False, increasing: bool = True
) -> DataFrame:
    """(keys, region_id, t0, t1): moves at the given speed, or all moves in one direction."""
    w = W.partitionBy(*keys).orderBy("seq")
    prev = F.lag("mag_pos", 1, 0.0).over(w)
    rows = script.withColumn("prev", prev).withColumn("next", F.lead("t0").over(w))
    if not extension_only:
        rows = rows.where(F.col("mag_speed") == F.lit(float(speed)))
    elif increasing:
        rows = rows.where((F.col("mag_pos") > F.col("prev")) & (F.col("prev") != 0.0))
    else:
        rows = rows.where(F.col("mag_pos") < F.col("prev"))
    if min_distance > 0:
        rows = rows.where(F.abs(F.col("mag_pos") - F.col("prev")) >= min_distance)
    end = F.col("t1") if use_move_duration else F.coalesce("next", "t1")
    number = F.row_number().over(w).cast("long") - 1
    return rows.select(*keys, number.alias("region_id"), "t0", end.alias("t1"))


def rotation_regions(script: DataFrame, keys: list[str], zero_tol: float = 1e-6) -> DataFrame:
    """(keys, region_id, t0, t1): runs of turned moves, closed by the end of the first unturned one after them."""
    w = W.partitionBy(*keys).orderBy("seq")
    rows = script.withColumn("zero", F.abs("mag_rot") <= zero_tol)
    rows = rows.withColumn("starts", ~F.col("zero") & F.coalesce(F.lag("zero").over(w), F.lit(True)))
    rows = rows.withColumn("after_zero", F.lead("zero").over(w)).withColumn("after_end", F.lead("t1").over(w))
    runs = rows.where(~F.col("zero")).withColumn("run", F.sum(F.col("starts").cast("long")).over(w))
    ended = F.when(F.col("after_zero"), F.col("after_end")).otherwise(F.col("t1"))
    return runs.groupBy(*keys, F.col("run").alias("region_id")).agg(F.min("t0").alias("t0"), F.max_by(ended, "seq").alias("t1")).withColumn("region_id", F.col("region_id") - 1)


def relative_regions(script: DataFrame, keys: list[str], speed: float = 0.3, allowance: int = 1) -> DataFrame:
    """(keys, region_id, t0, t1): runs of moves at a speed that bridge up to ``allowance`` others.

    The end is the start of the last bridged move; an open run ends so, or at the last move if it bridged none.
    """
    w = W.partitionBy(*keys).orderBy("seq")
    hit = F.col("mag_speed") == speed
    rows = script.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("hits", F.sum(F.col("hit").cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # moves since the last one at the speed; the first that can't be bridged closes the run
    rows = rows.withColumn("since", F.row_number().over(W.partitionBy(*keys, "hits").orderBy("seq")) - 1).where("hits > 0")
    rows = rows.withColumn("closes", (~F.col("hit") & (F.col("since") == allowance + 1)).cast("long"))
    rows = rows.withColumn("region_id", F.sum("closes").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("closes"))
    bridged = F.when(~F.col("hit") & (F.col("since") <= allowance), F.col("seq"))
    last = script.groupBy(*keys).agg(F.max_by("t0", "seq").alias("last"))
    runs = rows.groupBy(*keys, "region_id").agg(F.min_by("t0", F.when(F.col("hit"), F.col("seq"))).alias("start"), F.max_by("t0", bridged).alias("end"), F.max("closes").alias("closed"), F.bool_or("hit").alias("any"))
    found = runs.where("any").join(last, keys)
    end = F.coalesce("end", F.when(F.col("closed") == 1, F.lit(-1.0)).otherwise(F.col("last")))
    return found.select(*keys, F.col("region_id").cast("int").alias("region_id"), F.col("start").alias("t0"), end.alias("t1"))


def clipped(frames: DataFrame, regions: DataFrame, keys: list[str], bucket: float | None = None, within: list[str] | None = None) -> DataFrame:
    """(keys, region_id, rn, ...): samples of each closed interval, numbered from 0 within ``within`` (the keys by default).

    With ``bucket`` seconds, both sides meet by time bucket first: for long traces under few keys.
    """
    r = regions.select(*keys, "region_id", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    on = [F.col(f"f.{k}") == F.col(f"r.{k}") for k in keys]
    f = frames
    if bucket is not None:
        slot = lambda c: F.floor(F.col(c) / bucket)
        f = f.withColumn("__slot", slot("t"))
        r = r.where("r0 <= r1").withColumn("__slot", F.explode(F.sequence(slot("r0"), slot("r1"))))
        on.append(F.col("f.__slot") == F.col("r.__slot"))
    joined = f.alias("f").join(r.alias("r"), [*on, F.col("t").between(F.col("r0"), F.col("r1"))])
    rn = F.row_number().over(W.partitionBy(*[F.col(f"f.{k}") for k in (within or keys)], "region_id").orderBy("t", "frame")).cast("long") - 1
    return joined.select("f.*", "region_id", rn.alias("rn")).drop("__slot")


def extensions(frames: DataFrame, script: DataFrame, keys: list[str], kind: str = "force", equation: str = "default", within: list[str] | None = None, **options) -> DataFrame:
    """Samples of each region with position, rotation and force; a trace without regions is one whole region."""
    placed = actuator_at(actuator_at(frames, script, keys, "mag_pos"), script, keys, "mag_rot")
    placed = placed.withColumn("force", force_of(F.coalesce("mag_pos", F.lit(0.0)), equation))
    regions = force_regions(script, keys, **options) if kind == "force" else rotation_regions(script, keys, **options)
    spans = frames.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    whole = spans.join(regions.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).cast("bigint").alias("region_id"), F.col("a").alias("t0"), F.col("b").alias("t1"))
    return clipped(placed, regions.withColumn("region_id", F.col("region_id").cast("bigint")).unionByName(whole), keys, within=within)


def common_length(df: DataFrame, keys: list[str], columns: list[str], order: str = "frame") -> DataFrame:
    """Rows up to the shortest of the columns: the least count of known values among them."""
    w = W.partitionBy(*keys)
    shortest = F.least(*[F.count(c).over(w) for c in columns]) if len(columns) > 1 else F.count(columns[0]).over(w)
    rows = df.withColumn("__n", shortest).withColumn("__rn", F.row_number().over(w.orderBy(order)))
    return rows.where(F.col("__rn") <= F.col("__n")).drop("__n", "__rn")


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``; where a key has none there, those of ``second``."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def regions_in_range(frames: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Each region with its samples and whether it lies inside its trace's times."""
    spans = frames.groupBy(*keys).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    held = regions.join(spans, keys, "left").withColumn("in_range", F.coalesce((F.col("t_min") <= F.col("t0")) & (F.col("t1") <= F.col("t_max")), F.lit(False)))
    n = clipped(frames, regions, keys).groupBy(*keys, "region_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return held.join(n, [*keys, "region_id"], "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))


def less_reference(frames: DataFrame, group: list[str], bead: str, reference: int | None, ref0_is_none: bool = False) -> DataFrame:
    """z less the reference bead's z of the same frame; -1 is the last bead; unknown beads change nothing."""
    if reference is None or (ref0_is_none and reference == 0):
        return frames
    whole = W.partitionBy(*group)
    target = F.max(bead).over(whole) if reference < 0 else F.lit(reference)
    ref = F.max(F.when(F.col(bead) == target, F.col("z"))).over(W.partitionBy(*group, "frame"))
    return frames.withColumn("z", F.col("z") - F.coalesce(ref, F.lit(0.0)))


def matched_positions(all_beads: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """Beads with ``is_good``: whether their integer position is among the good ones."""
    marks = good.select(*keys, "x", "y").distinct().withColumn("is_good", F.lit(True))
    return all_beads.join(marks, [*keys, "x", "y"], "left").withColumn("is_good", F.coalesce("is_good", F.lit(False)))


def labelled_mask(beads: DataFrame, labels: DataFrame, key: str = "exp_id", bead: str = "bead") -> DataFrame:
    """``beads`` with is_good from the first label file (by ``rank``) that names a bead; an experiment without labels is all good."""
    first = labels.groupBy(key).agg(F.min("rank").alias("rank"))
    good = labels.join(first, [key, "rank"]).select(key, bead).distinct().withColumn("named", F.lit(True))
    has = first.select(key).withColumn("has", F.lit(True))
    joined = beads.join(good, [key, bead], "left").join(has, key, "left")
    return joined.withColumn("is_good", F.coalesce("named", F.col("has").isNull())).drop("named", "has")


def split_by_label(z: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Columns named by label class: listed beads take their class as a prefix, the others ``bb_``."""
    marked = z.join(labels.select(*keys, "label_class").distinct(), keys, "left")
    return marked.withColumn("name", F.concat_ws("_", F.coalesce("label_class", F.lit("bb")), F.col(keys[-1]).cast("string")))


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of a column on both sides, once each."""
    return left.select(column).intersect(right.select(column))


def check_disjoint(left: DataFrame, right: DataFrame, column: str) -> None:
    """Raises if a value of the column is on both sides."""
    if (found := overlap(left, right, column).limit(5).collect()):
        raise ValueError(f"shared {column}: {[r[0] for r in found]}")
