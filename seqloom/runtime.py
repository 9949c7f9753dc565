"""Session helpers shared by every part of the library."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was started elsewhere.

    Two bounds on Arrow batches are set as well, unless the session has its own: long texts
    and sets travel in them, so they are bounded by bytes as well as by rows.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if name not in spark.conf.getAll:
            spark.conf.set(name, bound)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a temporary folder
    takes its place; on a cluster without the setting this is an error, because
    no machine-local folder can be read by the other executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and (held := sc.getCheckpointDir()):
        named = held
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seqloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame) -> str:
    """The path of a table of the shared folder that holds ``df``; zstd keeps it small."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return path


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: compact, columnar, free of lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(_stored(df))


class Scratch:
    """Tables of the shared folder that go when a job no longer needs them.

    ``keep`` stores a table; ``drop`` deletes some that no later plan reads. What a query
    returns is lazy, so the tables that it still reads stay for the session's owner to clear.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = _stored(df)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            where = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            where.getFileSystem(conf).delete(where, True)


def in_batches(df: DataFrame, inputs: list[str], keep: list[tuple[str, str]], outputs: str, compute: Callable[..., list[list]]) -> DataFrame:
    """Columns ``keep`` (name, new name) as they are, then ``outputs`` (DDL) of ``compute(*inputs)``.

    ``compute`` gets a list of values for each input and returns a list for each output. Kept
    columns never leave Arrow, so ids of any type come through unchanged, nulls beside them
    or not; columns go by position, so no name can clash with another.
    """
    added = StructType.fromDDL(outputs)
    fields = [StructField(new, df.schema[old].dataType) for old, new in keep]
    n, names = len(keep), [new for _, new in keep] + added.names
    picked = df.select(*[F.col(f"`{old}`") for old, _ in keep], *[F.col(f"`{c}`") for c in inputs])
    placed = picked.toDF(*[f"c{k}" for k in range(n + len(inputs))])

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added.fields]
        for batch in batches:
            found = compute(*[batch.column(n + k).to_pylist() for k in range(len(inputs))])
            made = [pa.array(values, t) for values, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=names)

    return placed.mapInArrow(run, StructType([*fields, *added.fields]))


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that hands its task's memory back at the end: Python workers live on between stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return wrapped
