"""What the jobs share: their command line, config files and log."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("seqloom.jobs")


def config_of(spark: SparkSession, path: str, known: dict) -> dict:
    """``known`` with the values of a JSON file; a name that isn't known is an error."""
    rows = spark.read.option("multiLine", True).json(path).first()
    given = {k: v for k, v in (rows.asDict(recursive=True) if rows else {}).items() if v is not None}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{path}: unknown names {', '.join(unknown)}")
    return known | given


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Write ``df``; partitions that it holds are replaced, others stay, so a rerun gives the same table."""
    df.write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at a path of any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def as_listing(spark: SparkSession, path: str) -> str:
    """A path that a file stream can list: a single file becomes a pattern that only it matches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    single = not set(path) & set("*?[{") and files.exists(where) and files.getFileStatus(where).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def command_line(about: str, paths: dict[str, str], run: Callable[..., DataFrame]) -> None:
    """Parse plain path arguments, create a session, run the job, show its result and stop the session."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in {"config": "JSON file of the job's options", **paths}.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from seqloom.runtime import ship

    spark = SparkSession.builder.appName(parser.prog).getOrCreate()
    try:
        ship(spark)
        run(spark, **given).show(50, truncate=False)
    finally:
        spark.stop()
