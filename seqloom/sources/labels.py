"""Label files: pickled dictionaries whose keys name the good beads (``Bead_7_z``).

Only keys are read, from the pickle's opcodes: nothing is imported, called or built, and the
arrays under the keys are passed over, so no code of a file can run. Below an experiment's folder the
preferred file that names a bead counts: those of ``original_prepost`` first, then filtered before
selected ones, then the shallower.
"""

from __future__ import annotations

import pickletools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.operators.align import labelled_mask
from seqloom.operators.select import bead_index
from seqloom.runtime import frugal
from seqloom.sources.ranges import opened

#: Names of label files, the preferred first.
LABEL_FILES = ("traces_filtered.pickle", "traces_selected.pickle")
_TEXTS = frozenset("STRING BINSTRING SHORT_BINSTRING UNICODE BINUNICODE SHORT_BINUNICODE BINUNICODE8".split())
_MARK = object()


class _Thing:
    """Whatever stands on the stack that is no text; if items are set on it, their keys."""

    def __init__(self) -> None:
        self.keys: list[str] = []


def pickle_keys(file) -> list[str]:
    """The text keys of the dictionary that a pickle holds, in order; another value is an error."""
    stack: list = []
    memo: dict[int, object] = {}

    def since_mark() -> list:
        at = len(stack) - 1 - stack[::-1].index(_MARK)
        items = stack[at + 1 :]
        del stack[at:]
        return items

    def set_on(what, items: list) -> None:
        if isinstance(what, _Thing):
            what.keys += [k for k in items[::2] if isinstance(k, str)]

    for op, arg, _ in pickletools.genops(file):
        name = op.name
        if name == "STOP":
            found = stack.pop()
            if not isinstance(found, _Thing):
                raise ValueError("the pickle holds no dictionary")
            return list(dict.fromkeys(found.keys))
        if name in _TEXTS:
            stack.append(arg)
        elif name == "MARK":
            stack.append(_MARK)
        elif name in ("MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT"):
            memo[len(memo) if arg is None else int(arg)] = stack[-1]
        elif name in ("GET", "BINGET", "LONG_BINGET"):
            stack.append(memo[int(arg)])
        elif name in ("SETITEM", "SETITEMS"):
            items = since_mark() if name == "SETITEMS" else [stack.pop(-2), stack.pop()]
            set_on(stack[-1], items)
        elif name == "DICT":
            items = since_mark()
            stack.append(_Thing())
            set_on(stack[-1], items)
        elif name == "BUILD":
            stack.pop()  # the object keeps what was set on it
        elif name in ("APPEND", "APPENDS", "ADDITEMS"):
            if name == "APPEND":
                stack.pop()
            else:
                since_mark()
        elif name == "DUP":
            stack.append(stack[-1])
        else:
            # any other opcode by what it takes and leaves
            if any(x is pickletools.markobject for x in op.stack_before):
                below = op.stack_before.index(pickletools.markobject)
                since_mark()
                for _ in range(below):
                    stack.pop()
            else:
                del stack[len(stack) - len(op.stack_before) :]
            stack += [_Thing() for _ in op.stack_after]
    raise ValueError("the pickle ends early")


def label_keys(spark: SparkSession, root: str) -> DataFrame:
    """(path, key) of all label files below a folder; files that hold no dictionary have no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pickle").load(root).select("path")
    named = files.where(F.element_at(F.split("path", "/"), -1).isin(*LABEL_FILES))

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as file:
                        rows += [{"path": path, "key": k} for k in pickle_keys(file)]
                except (ValueError, EOFError, IndexError, KeyError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("key", pa.string())]))

    return named.repartition(F.xxhash64("path")).mapInArrow(run, StructType.fromDDL("path string, key string"))


def ranked(keys: DataFrame, experiments: DataFrame, folder: str = "exp_id") -> DataFrame:
    """(folder, rank, bead) of the label files below each experiment's folder; a file's ancestors meet folders by equality."""
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "//+", "/")
    parts = F.split("file", "/")
    files = keys.withColumn("file", path).withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    own = experiments.select(F.col(folder), F.col(folder).alias("up")).distinct()
    depth = F.size(F.split("file", "/")) - F.size(F.split("up", "/"))
    order = F.struct((~F.col("file").contains("original_prepost")).cast("int").alias("a"), (F.element_at(parts, -1) != LABEL_FILES[0]).cast("int").alias("b"), depth.alias("c"), F.col("file").alias("d"))
    bead = bead_index(F.col("key"))
    return files.join(own, "up").select(folder, order.alias("rank"), bead.alias("bead")).where("bead is not null")


def good_mask(spark: SparkSession, root: str, beads: DataFrame) -> DataFrame:
    """``beads`` (exp_id, bead) with is_good by the label files below each experiment's folder; without any all are good."""
    return labelled_mask(beads, ranked(label_keys(spark, root), beads))
