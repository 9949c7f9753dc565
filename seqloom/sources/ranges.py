"""Block files and ``.npz`` datasets by byte ranges: an index of headers, then slices read by many tasks.

Spark lists the files (names and sizes only). Tasks read nothing but headers: each array's
place, shape and type become one index row (``block_index``, ``npz_index``). Slices of at most
``SLICE_BYTES`` are cut from these rows in the plan, so a condition on frames or rows is
applied to the index before any value is read, a file may be of any size, and one file is
read by as many tasks as it has slices. Slices are dealt out evenly and read by seeking; an array in
column-major order is read run by run.

Files are opened by their URI in the tasks: plain paths and those of stores that Arrow
knows (s3, gs, hdfs, abfs). Other stores are read whole by ``npy.read_blocks``. Members of an ``.npz``
that are compressed can't be entered in the middle: one task inflates such a member, in
pieces of bounded size, and skips what isn't asked for.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.runtime import frugal
from seqloom.sources.npy import Truncated, header, layout

SLICE_BYTES = 32 << 20
#: Values of one Arrow batch, at most.
BATCH_VALUES = 1 << 18
INDEX = "path string, name string, part long, first long, rows long, width long, beads long, axes long, offset long, kind string, fortran boolean, packed long, scale array<double>"


@contextmanager
def opened(uri: str) -> Iterator[io.BufferedReader]:
    """A file that can be sought, by path or URI."""
    if uri.startswith("file:") or "://" not in uri:
        with open("/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri, "rb") as f:
            yield f
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)

    class Raw(io.RawIOBase):
        def __init__(self) -> None:
            self.file = store.open_input_file(path)

        def readable(self) -> bool:
            return True

        def seekable(self) -> bool:
            return True

        def seek(self, at: int, whence: int = 0) -> int:
            self.file.seek(at, whence)
            return self.file.tell()

        def tell(self) -> int:
            return self.file.tell()

        def readinto(self, into) -> int:
            data = self.file.read(len(into))
            into[: len(data)] = data
            return len(data)

    with io.BufferedReader(Raw(), 1 << 16) as f:
        yield f


def can_open(path: str) -> bool:
    """Whether tasks can open a path themselves: plain paths and URIs of stores that Arrow knows."""
    return "://" not in path or path.split("://")[0] in ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def scanned(file, size: int, permissive: bool = False) -> tuple[list[float], list[dict]]:
    """Axis scale and index rows of a block file; values are passed over by seeking."""
    scale, at = header(file)
    out, frames = [], 0
    while at < size:
        try:
            file.seek(at)
            shape, kind, fortran, begin = layout(file)
            end = begin + int(np.prod(shape, dtype=np.int64)) * kind.itemsize
            if end > size:
                raise Truncated("the file ends inside a block")
        except Truncated:
            if permissive and out:
                break
            raise
        if kind.hasobject or len(shape) != 3:
            raise ValueError("blocks are three-dimensional arrays of numbers")
        out.append({"part": len(out), "first": frames, "rows": shape[0], "beads": shape[1], "axes": shape[2], "width": shape[1] * shape[2], "offset": begin, "kind": kind.str, "fortran": fortran})
        frames, at = frames + shape[0], end
    if not out:
        raise ValueError("the file holds no block")
    return np.ravel(scale).astype(float).tolist(), out


def _listed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length); a listing, contents aren't read."""
    reader = spark.read.format("binaryFile")
    if not path.endswith(suffix):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return reader.load(path).select("path", "length")


def _indexed(files: DataFrame, scan: Callable[[str, int], Iterator[dict]]) -> DataFrame:
    schema = StructType.fromDDL(INDEX)

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = [{"path": path, "name": "", "packed": None, "scale": None, **row} for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in scan(path, size)]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return files.mapInArrow(run, schema)


def block_index(spark: SparkSession, path: str, *, permissive: bool = False) -> DataFrame:
    """One row a block of a file, or of all block files below a folder, from headers only."""

    def scan(uri: str, size: int) -> Iterator[dict]:
        with opened(uri) as file:
            scale, rows = scanned(file, size, permissive)
        for row in rows:
            yield {**row, "scale": scale}

    return _indexed(_listed(spark, path, ".npy"), scan)


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, frames, first_block_frames, beads, blocks) from headers only; a cut-off last block doesn't count."""
    index = block_index(spark, path, permissive=True)
    first = lambda c: F.min_by(c, "part")
    return index.groupBy("path").agg(F.sum("rows").alias("frames"), first("rows").alias("first_block_frames"), first("beads").alias("beads"), F.count(F.lit(1)).alias("blocks"))


def slices(index: DataFrame, lo: int | None = None, hi: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Index rows cut into slices: adds ``a`` and ``b``, rows of the array from and to, of those numbered ``lo`` to ``hi`` (exclusive)."""
    itemsize = F.regexp_extract("kind", r"(\d+)$", 1).cast("long")
    each = F.greatest(F.lit(1), F.floor(F.lit(slice_bytes) / F.greatest(F.col("width") * itemsize, F.lit(1)))).cast("long")
    start = F.greatest(F.lit(0), F.lit(lo or 0) - F.col("first"))
    stop = F.col("rows") if hi is None else F.least(F.col("rows"), F.lit(hi) - F.col("first"))
    kept = index.withColumns({"__a": start, "__b": stop}).where("__b > __a")
    # a compressed member is one slice: it is inflated from its beginning
    step = F.when(F.col("packed").isNull(), each).otherwise(F.col("__b") - F.col("__a"))
    cut = kept.withColumn("__step", step).withColumn("a", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1, F.col("__step"))))
    return cut.withColumn("b", F.least(F.col("a") + F.col("__step"), F.col("__b"))).drop("__a", "__b", "__step")


def dealt(cut: DataFrame) -> DataFrame:
    """Slices spread evenly over tasks, one task a core at least and no more slices than needed."""
    n = cut.count()
    return cut.repartition(max(1, min(n, 20_000)), F.xxhash64("path", "name", "part", "a"))


def _pieces(row: dict, file) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, values by row) of a slice, in pieces of at most ``BATCH_VALUES`` values where rows allow."""
    kind, width, a, b = np.dtype(row["kind"]), row["width"], row["a"], row["b"]
    each = max(1, BATCH_VALUES // max(width, 1))
    if row["packed"] is not None:
        yield from _inflated(row, file, kind, width, each)
    elif row["fortran"]:
        runs = np.empty((b - a, width), kind)
        for j in range(width):
            # the runs of a three-dimensional array are its (axis, bead) columns
            bead, axis = (j // row["axes"], j % row["axes"]) if row["axes"] else (j, 0)
            file.seek(row["offset"] + ((axis * row["beads"] + bead) * row["rows"] + a) * kind.itemsize)
            runs[:, j] = np.frombuffer(file.read((b - a) * kind.itemsize), kind)
        for k in range(0, b - a, each):
            yield a + k, runs[k : k + each]
    else:
        file.seek(row["offset"] + a * width * kind.itemsize)
        for k in range(a, b, each):
            n = min(each, b - k)
            yield k, np.frombuffer(file.read(n * width * kind.itemsize), kind).reshape(n, width)


def _inflated(row: dict, file, kind: np.dtype, width: int, each: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a deflated member; ``offset`` counts inflated bytes from the member's start, ``packed`` is where that begins."""
    file.seek(row["packed"])
    engine, held, skip, at = zlib.decompressobj(-15), bytearray(), row["offset"] + row["a"] * width * kind.itemsize, row["a"]
    while at < row["b"]:
        data = engine.unconsumed_tail or file.read(1 << 16)
        if not data and not held:
            raise Truncated("the file ends inside a member")
        out = engine.decompress(data, 1 << 20) if data else b""
        gone = min(skip, len(out))
        skip -= gone
        held += out[gone:]
        n = min(len(held) // max(width * kind.itemsize, 1), row["b"] - at, each) if width else row["b"] - at
        if n and (n == each or n == row["b"] - at):
            size = n * width * kind.itemsize
            yield at, np.frombuffer(bytes(held[:size]), kind).reshape(n, width)
            del held[:size]
            at += n
        elif not data:
            raise Truncated("the file ends inside a member")


def _read(cut: DataFrame, outputs: str, columns: Callable[[dict, int, np.ndarray], list]) -> DataFrame:
    schema = StructType.fromDDL(outputs)
    names = cut.columns

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                with opened(row["path"]) as file:
                    for first, piece in _pieces(row, file):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns(row, first, piece), arrow.types, strict=True)], schema=arrow)

    return dealt(cut).mapInArrow(run, schema)


def read_blocks(spark: SparkSession, path: str, *, pixel_units: bool = False, permissive: bool = False, frames: tuple[int | None, int | None] = (None, None), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(path, frame, bead, axis, v) of the samples of ``frames`` (from, to); values times the axis scale unless in pixel units."""

    def columns(row: dict, first: int, piece: np.ndarray) -> list:
        n, beads, axes, scale = len(piece), row["beads"], row["axes"], row["scale"]
        by_axis = np.ones(axes) if pixel_units else np.array(scale[:axes]) if len(scale) >= axes else np.full(axes, scale[0])
        v = piece.reshape(n, beads, axes).astype(float) * by_axis
        frame, bead, axis = np.indices(v.shape)
        return [[row["path"]] * v.size, (frame + first + row["first"]).ravel(), bead.ravel().astype(np.int32), axis.ravel().astype(np.int32), v.ravel()]

    cut = slices(block_index(spark, path, permissive=permissive), *frames, slice_bytes)
    return _read(cut, "path string, frame long, bead int, axis int, v double", columns)


def members(file, size: int) -> list[tuple[str, int, int, int]]:
    """(name, place of the local header, packed bytes, method) from a ZIP's central directory, large ones included."""
    tail = min(size, 66_000)
    file.seek(size - tail)
    data = file.read(tail)
    at = data.rfind(b"PK\x05\x06")
    if at < 0:
        raise Truncated("no directory at the end of the file")
    count, length, place = struct.unpack_from("<HII", data, at + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, place):
        locator = data.rfind(b"PK\x06\x07", 0, at)
        file.seek(struct.unpack_from("<Q", data, locator + 8)[0])
        count, length, place = struct.unpack_from("<QQQ", file.read(56), 32)
    file.seek(place)
    data, at, out = file.read(length), 0, []
    for _ in range(count):
        method, packed, whole, n, extra, comment, start = (struct.unpack_from(f, data, at + k)[0] for f, k in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        name = data[at + 46 : at + 46 + n].decode()
        more, k = data[at + 46 + n : at + 46 + n + extra], 0
        while k + 4 <= len(more):
            tag, m = struct.unpack_from("<HH", more, k)
            if tag == 1:  # 64-bit values of those that don't fit, in this order
                wide = list(struct.unpack_from(f"<{m // 8}Q", more, k + 4))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                start = wide.pop(0) if start == 0xFFFFFFFF else start
            k += 4 + m
        out.append((name, start, packed, method))
        at += 46 + n + extra + comment
    return out


def npz_index(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """One row an array of ``.npz`` files, from their directories and headers; arrays of objects are left out."""

    def scan(uri: str, size: int) -> Iterator[dict]:
        with opened(uri) as file:
            for part, (member, start, _, method) in enumerate(members(file, size)):
                name = member.removesuffix(".npy")
                if names is not None and name not in names:
                    continue
                file.seek(start + 26)
                data = start + 30 + sum(struct.unpack("<HH", file.read(4)))
                file.seek(data)
                head = file if method == 0 else io.BytesIO(zlib.decompressobj(-15).decompress(file.read(1 << 16), 1 << 16))
                shape, kind, fortran, begin = layout(head)
                if kind.hasobject:
                    continue
                width = int(np.prod(shape[1:], dtype=np.int64))
                if fortran and (len(shape) != 2 or method):
                    raise ValueError(f"{member}: column-major arrays are read if they are plain matrices")
                yield {"name": name, "part": part, "first": 0, "rows": shape[0] if shape else 1, "beads": width, "axes": 1, "width": width, "offset": begin, "kind": kind.str, "fortran": fortran, "packed": None if method == 0 else data}

    return _indexed(_listed(spark, path, ".npz"), scan)


def read_npz(spark: SparkSession, path: str, name: str, *, rows: tuple[int | None, int | None] = (None, None), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(path, row, v array) of one array of ``.npz`` files; further axes are flattened."""

    def columns(row: dict, first: int, piece: np.ndarray) -> list:
        import pyarrow as pa

        flat = pa.array(piece.astype(float).ravel())
        return [[row["path"]] * len(piece), np.arange(first, first + len(piece)), pa.ListArray.from_arrays(pa.array(np.arange(0, piece.size + 1, max(row["width"], 1))[: len(piece) + 1] if row["width"] else np.zeros(len(piece) + 1), pa.int32()), flat)]

    cut = slices(npz_index(spark, path, [name]), *rows, slice_bytes)
    return _read(cut, "path string, row long, v array<double>", columns)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, label, t, z) of trace datasets: padding is trimmed off.

    A padded row ends where neither its values nor its times go on (the lesser of the two
    numbers that aren't NaN counts); files that only hold traces of one length are read from those.
    """
    index = npz_index(spark, path).select("name").distinct()
    held = {r["name"] for r in index.where(F.col("name").isin("traces", "times", "labels", "traces_sktime_2d", "traces_2d", "X")).collect()}
    fixed = next((n for n in ("traces", "traces_sktime_2d", "traces_2d", "X") if n in held), None)
    if fixed is None:
        raise ValueError(f"{path} holds no traces")
    one = lambda n, as_: read_npz(spark, path, n).select("path", F.col("row").alias("id"), F.col("v").alias(as_))
    out = one(fixed, "z").join(one("labels", "y"), ["path", "id"], "left").withColumn("label", F.col("y")[0].cast("int")) if "labels" in held else one(fixed, "z").withColumn("label", F.lit(None).cast("int"))
    real = lambda c: F.size(F.filter(c, lambda x: ~F.isnan(x)))
    if "times" in held:
        out = out.join(one("times", "t"), ["path", "id"], "left").withColumn("__n", F.least(real(F.col("z")), F.coalesce(real(F.col("t")), F.lit(0))))
        return out.select("path", "id", "label", F.slice("t", 1, F.col("__n")).alias("t"), F.slice("z", 1, F.col("__n")).alias("z"))
    return out.select("path", "id", "label", F.lit(None).cast("array<double>").alias("t"), "z")
