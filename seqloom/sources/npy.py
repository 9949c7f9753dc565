"""Block files: a header record, then appended three-dimensional arrays, in the NPY format.

The header is a plain numeric array (the scale of each axis), or a pickled dictionary that
holds it as ``axisScale``. Such a dictionary is never unpickled: its opcodes are read one by one
into dictionaries, lists, texts, numbers and numeric arrays, and anything else is refused, so
no code of a file can run. Blocks of Python objects are refused. ``ranges`` reads the same files by
byte ranges, whatever their size; here files are read whole by Spark (``binaryFile``), each by one
task, for stores that only Spark can open. That reader's limit is 2 GB a file, beyond which
``read_blocks`` fails rather than leaves samples out.
"""

from __future__ import annotations

import ast
import io
import pickletools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"


class Truncated(ValueError):
    """The file ends inside a block."""


class _Named(tuple):
    """A global's name, or what a call of it stands for; nothing is ever imported or called."""


#: Names that arrays and their element types are stored under; those that make arrays and scalars.
_ARRAY, _TYPE = ("numpy", "ndarray"), ("numpy", "dtype")
_MAKERS = {(f"numpy.{core}.multiarray", name) for core in ("core", "_core") for name in ("_reconstruct", "scalar")}
_CONSTANTS = {"NONE": None, "NEWTRUE": True, "NEWFALSE": False, "EMPTY_TUPLE": ()}
_VALUES = {"INT", "BININT", "BININT1", "BININT2", "LONG", "LONG1", "LONG4", "FLOAT", "BINFLOAT", "UNICODE", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "BINBYTES", "SHORT_BINBYTES", "BINBYTES8", "BINSTRING", "SHORT_BINSTRING", "STRING"}


class _Array(dict):
    """An array that is being described: its shape, type and values."""


def _numeric(x):
    """Arrays and scalars from their descriptions, all through nested values."""
    if isinstance(x, _Array):
        if "values" not in x:
            raise ValueError("an array without values")
        shape, kind, fortran, raw = x["values"]
        if kind.hasobject:
            items = [_numeric(v) for v in raw]
            return items[0] if shape == () else items
        raw = raw.encode("latin-1") if isinstance(raw, str) else raw
        return np.frombuffer(raw, kind).reshape(shape, order="F" if fortran else "C")
    if isinstance(x, dict):
        return {_numeric(k): _numeric(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_numeric(v) for v in x]
    return tuple(_numeric(v) for v in x) if type(x) is tuple else x


def plain_value(stream: io.BytesIO):
    """The value of a pickle that holds nothing but dictionaries, lists, texts, numbers and numeric arrays; else ``ValueError``."""
    stack: list = []
    marks: list[int] = []
    memo: dict[int, object] = {}
    refuse = lambda what: ValueError(f"refused in a header: {what}")

    def since_mark() -> list:
        at = marks.pop()
        items = stack[at:]
        del stack[at:]
        return items

    def pairs(items: list) -> dict:
        return dict(zip(items[::2], items[1::2], strict=True))

    def made(function, args):
        if function in _MAKERS and function[1] == "_reconstruct" and args and args[0] == _ARRAY:
            return _Array()
        if function in _MAKERS and function[1] == "scalar" and len(args) == 2 and isinstance(args[0], np.dtype) and not args[0].hasobject:
            return np.frombuffer(args[1].encode("latin-1") if isinstance(args[1], str) else args[1], args[0])[0].item()
        if function == _TYPE and args and isinstance(args[0], str):
            return np.dtype(args[0])
        raise refuse(function)

    for op, arg, _ in pickletools.genops(stream):
        name = op.name
        if name in ("PROTO", "FRAME"):
            continue
        if name == "STOP":
            return _numeric(stack.pop())
        if name in _VALUES:
            stack.append(arg)
        elif name in _CONSTANTS:
            stack.append(_CONSTANTS[name])
        elif name in ("MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT"):
            memo[len(memo) if arg is None else arg] = stack[-1]
        elif name in ("GET", "BINGET", "LONG_BINGET"):
            stack.append(memo[int(arg)])
        elif name == "MARK":
            marks.append(len(stack))
        elif name in ("EMPTY_DICT", "EMPTY_LIST"):
            stack.append({} if name == "EMPTY_DICT" else [])
        elif name in ("DICT", "LIST", "TUPLE"):
            items = since_mark()
            stack.append(pairs(items) if name == "DICT" else items if name == "LIST" else tuple(items))
        elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
            n = int(name[-1])
            stack[-n:] = [tuple(stack[-n:])]
        elif name in ("APPEND", "APPENDS"):
            items = [stack.pop()] if name == "APPEND" else since_mark()
            stack[-1].extend(items)
        elif name in ("SETITEM", "SETITEMS"):
            items = since_mark() if name == "SETITEMS" else [stack.pop(-2), stack.pop()]
            stack[-1].update(pairs(items))
        elif name in ("GLOBAL", "STACK_GLOBAL"):
            named = _Named(arg.split(" ", 1)) if name == "GLOBAL" else _Named([stack.pop(-2), stack.pop()])
            if named not in _MAKERS and named not in (_ARRAY, _TYPE) and named != ("_codecs", "encode"):
                raise refuse(named)
            stack.append(named)
        elif name == "REDUCE":
            args, function = stack.pop(), stack.pop()
            # older writers store bytes as text with its encoding
            stack.append(args[0].encode("latin-1") if function == ("_codecs", "encode") and args[1:] == ("latin1",) else made(function, args))
        elif name == "BUILD":
            state, what = stack.pop(), stack[-1]
            if isinstance(what, _Array) and isinstance(state, tuple) and len(state) == 5:
                what["values"] = state[1:]
            elif isinstance(what, np.dtype):
                stack[-1] = what if state[1] == "|" else what.newbyteorder(state[1])
                memo = {k: stack[-1] if v is what else v for k, v in memo.items()}
            else:
                raise refuse("a built object")
        else:
            raise refuse(name)
    raise ValueError("the header ends early")


def header(source) -> tuple[np.ndarray, int]:
    """Axis scale and the byte after the first record, of bytes or of a file at its start."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    stream.seek(0)
    shape, kind, fortran, begin = layout(stream)
    if not kind.hasobject:
        raw = stream.read(int(np.prod(shape, dtype=np.int64)) * kind.itemsize)
        return np.frombuffer(raw, kind).reshape(shape, order="F" if fortran else "C"), stream.tell()
    found = plain_value(stream)
    if isinstance(found, list) and len(found) == 1:
        found = found[0]
    if not isinstance(found, dict) or "axisScale" not in found:
        raise ValueError("the header holds no axisScale")
    return np.atleast_1d(np.asarray(found["axisScale"], float)), stream.tell()


def layout(file) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, order and the byte where the values begin, of the record at a file's position."""
    at = file.tell()
    start = file.read(12)
    if len(start) < 10:
        raise Truncated("the file ends inside a header")
    if start[:6] != MAGIC:
        raise ValueError("not an NPY record")
    size, begin = (struct.unpack_from("<H", start, 8)[0], 10) if start[6] == 1 else (struct.unpack_from("<I", start, 8)[0], 12)
    file.seek(at + begin)
    text = file.read(size)
    if len(text) < size:
        raise Truncated("the file ends inside a header")
    head = ast.literal_eval(text.decode("latin-1").strip())
    return tuple(head["shape"]), np.dtype(head["descr"]), bool(head["fortran_order"]), at + begin + size


def record(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The array at byte ``at`` and the byte after it."""
    stream = io.BytesIO(data)
    stream.seek(at)
    shape, kind, fortran, begin = layout(stream)
    if kind.hasobject:
        raise ValueError("records of Python objects are refused; store numbers")
    count = int(np.prod(shape, dtype=np.int64))
    end = begin + count * kind.itemsize
    if end > len(data):
        raise Truncated("the file ends inside a block")
    return np.frombuffer(data, kind, count, begin).reshape(shape, order="F" if fortran else "C"), end


def blocks(data: bytes, permissive: bool = False) -> Iterator[np.ndarray]:
    """Scale, then every block. A cut-off last block ends a permissive read that has seen one block."""
    scale, at = header(data)
    yield np.atleast_1d(np.asarray(scale, float)).ravel()
    seen = 0
    while at < len(data):
        try:
            block, at = record(data, at)
        except Truncated:
            if permissive and seen:
                return
            raise
        seen += 1
        yield block


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file, or of all block files below a folder."""
    reader = spark.read.format("binaryFile")
    if not path.endswith(".npy"):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy")
    return reader.load(path).select("path", "content")


def read_blocks(spark: SparkSession, path: str, *, pixel_units: bool = False, permissive: bool = False) -> DataFrame:
    """(path, frame, bead, axis, v) of every sample; values times the axis scale unless in pixel units."""
    files = _files(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                parts = blocks(bytes(content), permissive)
                scale, start, seen = next(parts), 0, False
                for block in parts:
                    seen = True
                    frames, beads, axes = block.shape
                    v = block.astype(float) * (1.0 if pixel_units else scale[:axes] if len(scale) >= axes else scale[0])
                    f, b, a = np.indices(block.shape)
                    yield pd.DataFrame({"path": name, "frame": (f + start).ravel(), "bead": b.ravel().astype("int32"), "axis": a.ravel().astype("int32"), "v": v.ravel()})
                    start += frames
                if not seen:
                    raise ValueError(f"{name} holds no block")

    return files.mapInPandas(run, "path string, frame long, bead int, axis int, v double")


def split_axes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, bead, x, y, z): one row per bead and frame; axes that a file lacks are NaN."""
    pick = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("v"))), F.lit(float("nan")))
    return samples.groupBy(*keys, "frame", "bead").agg(pick(0).alias("x"), pick(1).alias("y"), pick(2).alias("z"))
