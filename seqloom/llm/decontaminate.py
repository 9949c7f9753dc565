"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents may be long, so a MinHash of a whole document says
nothing about an item inside it. Items are therefore partitioned by set size into classes
(1, 2-3, 4-7, ... shingles). For a class with at most ``u`` shingles an item, a document is
read in windows of ``2u`` shingles that start every ``u``: an occurrence of an item lies
whole in some window, whose Jaccard similarity to the item is then about a quarter or more.
Item and window meet if any of ``bins`` one-permutation MinHash values agree.

Windows are evaluated lazily: a value can only agree if a shingle of the window is a value
of some item's signature, so windows without such a shingle are passed over. That gives
what evaluating all of them would give.

Each candidate is verified on exact sets of the whole texts: an item is found if at least
``percent`` of its distinct shingles occur in the document.

Tasks make the items' sets and signatures once; these are indexed (a window finds the items that
agree with it in a bin by binary search, whatever their number) and handed to all executors in
blocks of at most about ``block_bytes`` bytes of index (estimated beforehand); a larger benchmark
takes several passes over the documents.

Defined results: null, empty and short texts follow the shingle rules (a text of fewer than
five words has its whole sequence as its one shingle, so such an item is found only in a
document of just that sequence); items without words are never found; a null item id stays
null; rows that repeat a doc_id give one row per item with the most shingles found; items that
repeat an id are told apart by their sizes only; texts are read whole, whatever their length;
ids of any type come through unchanged; other columns, whatever their names, are ignored by the
search and pass through ``decontaminate``; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqloom.llm.near_dedup import signature
from seqloom.llm.shingles import WIDTH, common, mixed, shingle_hashes, words
from seqloom.runtime import frugal, in_batches

BINS, PERCENT = 128, 75
#: Bytes of one block's index, by the estimate ``_indexes`` makes.
BLOCK_BYTES = 128 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class ItemIndex:
    """Sets of one block of items, and postings of their signatures' values by size class and bin."""

    def __init__(self, ids: list, sets: list[np.ndarray], signatures: list[np.ndarray], bins: int = BINS, percent: int = PERCENT, width: int = WIDTH) -> None:
        self.ids, self.sets, self.bins, self.percent, self.width = ids, sets, bins, percent, width
        classes: dict[int, list[int]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            if len(s):
                classes[len(s).bit_length()].append(k)
        self.classes = []
        for c, at in sorted(classes.items()):
            keys = np.concatenate([self._keys(signatures[k]) for k in at])
            order = np.argsort(keys, kind="stable")
            #: most shingles of an item, keys of (bin, value), and the item of each
            self.classes.append((2**c - 1, keys[order], np.repeat(np.array(at, np.int32), bins)[order]))
        values = [signatures[k] for at in classes.values() for k in at]
        self.values = np.unique(np.concatenate(values)) if values else np.empty(0, np.uint64)
        size = max(16, int(len(self.values) * 16).bit_length())
        self.mask = np.uint64(2**size - 1)
        self.seen = np.zeros(2**size, bool)
        self.seen[(self.values & self.mask).astype(np.int64)] = True

    @classmethod
    def of_texts(cls, ids: list, texts: list[str | None], bins: int = BINS, percent: int = PERCENT, width: int = WIDTH) -> ItemIndex:
        sets = [np.unique(shingle_hashes(words(t), width)) for t in texts]
        return cls(ids, sets, [signature(s, bins) if len(s) else s for s in sets], bins, percent, width)

    def _keys(self, sig: np.ndarray) -> np.ndarray:
        return mixed(sig ^ (np.arange(1, self.bins + 1, dtype=np.uint64) * _GOLD))

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of their size class."""
        if len(hashes) == 0 or len(self.values) == 0:
            return set()
        maybe = np.flatnonzero(self.seen[(hashes & self.mask).astype(np.int64)])
        if len(maybe) == 0:
            return set()
        at = np.searchsorted(self.values, hashes[maybe])
        at[at == len(self.values)] = 0
        hits = maybe[self.values[at] == hashes[maybe]]
        found: set[int] = set()
        if len(hits) == 0:
            return found
        for most, keys, items in self.classes:
            # windows of 2 * most shingles start at multiples of most; a hit lies in at most two
            starts = np.unique(np.concatenate([hits // most, np.maximum(hits // most - 1, 0)])) * most
            for start in starts:
                own = self._keys(signature(np.unique(hashes[start : start + 2 * most]), self.bins))
                lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.update(items[a:b].tolist())
        return found

    def match(self, text: str | None) -> list[tuple[int, int]]:
        """(item number, shingles found) of every item that the text contains."""
        hashes = shingle_hashes(words(text), self.width)
        tried = self.candidates(hashes)
        if not tried:
            return []
        whole = np.unique(hashes)
        shared = [(k, common(self.sets[k], whole)) for k in sorted(tried)]
        return [(k, c) for k, c in shared if 100 * c >= self.percent * len(self.sets[k])]


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, percent: int, bins: int, width: int, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes of the benchmark's blocks, one after another; sets and signatures are made by the tasks.

    An item takes a posting of 12 bytes a bin, and for each shingle, of which a text has
    at most one for two characters, 8 bytes of its set and, up to the number of bins, 40 of the
    tables of values.
    """
    shingles = F.length(f"`{text_col}`") / 2 + 1
    total = benchmark.agg(F.sum(12 * bins + 8 * shingles + 40 * F.least(shingles, F.lit(bins)))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))

    def compute(texts: list) -> list[list]:
        sets = [np.unique(shingle_hashes(words(t), width)) for t in texts]
        return [[s.tobytes() for s in sets], [signature(s, bins).tobytes() if len(s) else b"" for s in sets]]

    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(f"`{item_col}`", f"`{text_col}`"), F.lit(n)) == k)
        rows = in_batches(part, [text_col], [(item_col, "item")], "s binary, sig binary", compute).collect()
        if rows:
            yield ItemIndex([r["item"] for r in rows], [np.frombuffer(r["s"], np.uint64) for r in rows], [np.frombuffer(r["sig"], np.uint64) for r in rows], bins, percent, width)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
    bins: int = BINS,
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item, n_shared, n_item): every item that a document contains."""
    spark = docs.sparkSession
    kinds = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField(item_col, benchmark.schema[item_col].dataType), *StructType.fromDDL("n_shared long, n_item long").fields])
    found = spark.createDataFrame([], kinds)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    for index in _indexes(benchmark, item_col, item_text_col, percent, bins, width, block_bytes):
        held = spark.sparkContext.broadcast(index)

        def run(texts: list, held=held) -> list[list]:
            index = held.value
            return [[[{"item": index.ids[k], "n_shared": c, "n_item": len(index.sets[k])} for k, c in index.match(t)] for t in texts]]

        hits = in_batches(docs, [text_col], [(id_col, id_col)], f"found array<struct<item: {item_type}, n_shared: long, n_item: long>>", run)
        found = found.unionByName(hits.select(id_col, F.explode("found").alias("x")).select(id_col, F.col("x.item").alias(item_col), "x.n_shared", "x.n_item"))
    return found.groupBy(id_col, item_col, "n_item").agg(F.max("n_shared").alias("n_shared"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
    bins: int = BINS,
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; needs no shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col, percent, bins, width, block_bytes):
        held = spark.sparkContext.broadcast(index)

        @frugal
        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.match(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


OP4_SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
t AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM w),
s AS (
  SELECT side, id, CASE WHEN len(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
         ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END AS sh
  FROM t),
e AS (SELECT side, id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared, q.n AS n_item
  FROM e d JOIN e q ON d.side = 0 AND q.side = 1 AND d.g = q.g GROUP BY d.id, q.id, q.n)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item FROM p WHERE 100 * n_shared >= 75 * n_item
"""
