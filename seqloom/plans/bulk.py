"""Bulk evaluation that resumes, and what it will take.

Results are stored by (pipeline, run, part): ``run`` is a hash of the pipeline's options, so a
changed pipeline is another run, and ``part`` a hash of the group. A repeated call lists the groups
that have no result yet (a left-anti join with the stored results) and computes only the parts that
hold them. Each part is one write that replaces that part alone, so a run that was cut off
keeps what it had finished. A pipeline that can't run gives rows with an ``error``.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans import jobs
from seqloom.plans.jobs import Pipeline

VALUES = "tp long, tn long, fp long, fn long, n long, correct long, accuracy double, n_failed long, error string"


def run_of(pipeline: Pipeline, known: dict[str, Pipeline] | None = None) -> str:
    """A hash of a pipeline's options, and of its members'."""
    parts = [asdict(pipeline), *[asdict(known[m]) for m in pipeline.members if known and m in known]]
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


def _exists(df: DataFrame, path: str) -> bool:
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def stored(truth: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys but the last, values, pipeline, run, part) of the results stored so far."""
    outer = ", ".join(f"`{k}` {truth.schema[k].dataType.simpleString()}" for k in keys[:-1])
    schema = f"{outer}, {VALUES}, pipeline string, run string, part int"
    spark = truth.sparkSession
    return spark.read.schema(schema).parquet(path) if _exists(truth, path) else spark.createDataFrame([], schema)


def missing(truth: DataFrame, keys: list[str], pipelines: list[Pipeline], path: str, parts: int, known: dict[str, Pipeline] | None = None) -> DataFrame:
    """(pipeline, run, part, keys but the last) without a result: what is still to do."""
    outer = keys[:-1]
    runs = [(p.name, run_of(p, known)) for p in pipelines]
    # pipelines are a short list, so each group carries it; no join is needed
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pipeline"), F.lit(r).alias("run")) for n, r in runs])) if runs else F.explode(F.array().cast("array<struct<pipeline:string,run:string>>"))
    groups = truth.select(*outer).distinct().withColumn("part", F.pmod(F.xxhash64(*outer), F.lit(parts)).cast("int"))
    wanted = groups.select(*outer, "part", each.alias("p")).select("p.pipeline", "p.run", "part", *outer)
    return wanted.join(stored(truth, keys, path), ["pipeline", "run", *outer], "left_anti")


def resumed(rows: DataFrame, truth: DataFrame, keys: list[str], pipelines: list[Pipeline], path: str, parts: int = 16, known: dict[str, Pipeline] | None = None) -> list[tuple[str, int]]:
    """Compute and store what is missing; returns the (pipeline, part) pairs that were computed."""
    outer = keys[:-1]
    left = sorted({(r["pipeline"], r["part"]) for r in missing(truth, keys, pipelines, path, parts, known).select("pipeline", "part").distinct().collect()})
    by_name = {p.name: p for p in pipelines}
    for name, part in left:
        mine = truth.where(F.pmod(F.xxhash64(*outer), F.lit(parts)) == part)
        groups = mine.select(*outer).distinct()
        try:
            found = jobs.evaluate(rows.join(groups, outer, "left_semi"), mine, keys, [by_name[name]], (known or {}) | by_name).withColumn("error", F.lit(None).cast("string"))
        except ValueError as e:
            counts = mine.groupBy(*outer).agg(F.count(F.lit(1)).alias("n"))
            none = [F.lit(None).cast("long").alias(c) for c in ("tp", "tn", "fp", "fn", "correct")]
            found = counts.select(*outer, *none, "n", F.lit(None).cast("double").alias("accuracy"), F.col("n").alias("n_failed"), F.lit(str(e)).alias("error"))
        columns = [c.split()[0] for c in VALUES.split(", ")]
        out = found.select(*outer, *columns, F.lit(name).alias("pipeline"), F.lit(run_of(by_name[name], known)).alias("run"), F.lit(part).alias("part"))
        out.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pipeline", "run", "part").parquet(path)
    return left


def results(truth: DataFrame, keys: list[str], pipelines: list[Pipeline], path: str, known: dict[str, Pipeline] | None = None) -> DataFrame:
    """The stored rows of these pipelines as they are now; rows of other options are left out."""
    now = F.lit(False)
    for p in pipelines:
        now = now | ((F.col("pipeline") == p.name) & (F.col("run") == run_of(p, known)))
    return stored(truth, keys, path).where(now).drop("run", "part")


def estimated(rows: DataFrame, truth: DataFrame, keys: list[str], pipelines: list[Pipeline], n_sample: int = 3) -> DataFrame:
    """(pipeline, n_groups, n_sample, rows, seconds, estimate): each pipeline is run over a few groups, and their time scaled to all.

    The groups are those with the least hashes; ``rows`` are their samples.
    """
    outer, spark = keys[:-1], rows.sparkSession
    groups = truth.select(*outer).distinct()
    total = groups.count()
    few = groups.orderBy(F.xxhash64(*outer), *outer).limit(n_sample)
    mine, own = truth.join(few, outer, "left_semi"), rows.join(few, outer, "left_semi")
    n, size, out = min(n_sample, total), own.count(), []
    for p in pipelines:
        began = time.perf_counter()
        if n:
            jobs.evaluate(own, mine, keys, [p]).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        out.append((p.name, total, n, size, seconds, seconds / n * total if n else 0.0))
    return spark.createDataFrame(out, "pipeline string, n_groups long, n_sample long, rows long, seconds double, estimate double")
