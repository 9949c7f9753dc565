"""Token-ID / binary output: a training order made by a keyed permutation, in fixed-stride shards.

1. Each document is tokenized whole (byte-level BPE, ids below 65,536) and closed by an end
   token; its ids are cut into sequences of ``seq_len``. The last one is filled up with the
   end token and its true length is part of the record.
2. Sequences are numbered 0 .. n-1 by content: documents in the order of id (null first) and a
   hash of the text, then sequences in their order. The rank is found on narrow rows, one a
   document: these are range-partitioned, summed up within each range and offset by the sums
   of the ranges before. Neither the input's files nor the cluster's size change it; rows that
   are equal in id and text are told apart by their place, which their sequences can't show.
3. A keyed Feistel network over the least even number of bits that holds n permutes the
   numbers; a result of n or more is permuted again until it falls below n (cycle walking).
   That is a bijection of 0 .. n-1, so every sequence has its own global slot, and any
   reader can find the slot of a sequence, or the sequence of a slot, from key and n alone.
4. Slots are dealt into ranges of ``shard_records``. A record is a little-endian uint16
   length followed by ``seq_len`` uint16 ids, so record r of a shard starts at r * stride:
   readers are sequential and resume at any slot by arithmetic.

Nothing but counts per range reaches the driver. ``write_shards`` stores one row per shard
(blob, first slot, records, stride, CRC-32, and whose sequences they are) with Spark's own
committer, on any file system that Spark can write; a lost executor repeats its tasks and
commits once. ``read_shards`` and ``read_slots`` cut records out of the blobs by their offsets
and check the CRC-32. The tokenizer's file is read where the driver runs, or else by Spark, and
handed to the tasks, so executors need no copy of it.

Defined results: null and empty texts give one sequence that holds only the end token, so
no document is lost; repeated rows give their own sequences; ids may be of any type that has
an order and come through unchanged; texts are tokenized whole, whatever their length; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from seqloom.llm.shingles import mixed
from seqloom.runtime import frugal, in_batches, materialized, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
SEQ_LEN, SHARD_RECORDS, KEY, ROUNDS = 512, 8192, 0x5EED_0F_0DE5, 6
#: Documents whose slots are broadcast, at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Fixed value: how the vocabulary's makers cut texts before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    """A byte-level BPE from a file of ranks."""
    return _tokenizer(Path(path).read_bytes())


def _tokenizer(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _vocabulary(spark: SparkSession, path: str) -> bytes:
    """The tokenizer's file (about a megabyte), read by the driver or through Spark."""
    if Path(path).exists():
        return Path(path).read_bytes()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. n-1, elementwise."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64(2**half - 1), np.uint64(half)
    keys = mixed((np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key & (2**64 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << shift) | right

    out = once(np.asarray(x, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _records(ids: np.ndarray, seq_len: int, end: int) -> tuple[list[int], list[bytes]]:
    """Lengths and records of one document's ids."""
    n = -(-len(ids) // seq_len)
    body = np.full((n, seq_len + 1), end, "<u2")
    lengths = np.full(n, seq_len, np.int64)
    lengths[-1] = len(ids) - (n - 1) * seq_len
    flat = np.full(n * seq_len, end, "<u2")
    flat[: len(ids)] = ids
    body[:, 1:] = flat.reshape(n, seq_len)
    body[:, 0] = lengths
    return lengths.tolist(), [r.tobytes() for r in body]


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, seq_len: int, end: int) -> DataFrame:
    """One row per document: doc (its number), id, text_hash, n_seq and its sequences' lengths and records."""
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(docs.sparkSession, tokenizer))
    encoding: list = []

    def compute(texts: list) -> list[list]:
        if not encoding:  # once a task
            encoding.append(_tokenizer(sent.value))
        made = [_records(np.array([*encoding[0].encode_ordinary(t or ""), end], "<u2"), seq_len, end) for t in texts]
        return [[len(n) for n, _ in made], [n for n, _ in made], [r for _, r in made]]

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    made = in_batches(narrow, ["text"], [("id", "id"), ("text_hash", "text_hash")], "n_seq long, lengths array<int>, records array<binary>", compute)
    return made.withColumn("doc", F.monotonically_increasing_id())


def ranked(stored: DataFrame, rows_per_range: int = 1_000_000) -> tuple[DataFrame, int, int]:
    """(doc, base) with the number of each document's first sequence, documents, and all sequences."""
    per_doc = stored.select("doc", "id", "text_hash", "n_seq")
    rows = per_doc.count()
    ranges = max(per_doc.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_range))
    order = [F.col("id").asc_nulls_first(), F.col("text_hash").asc(), F.col("doc").asc()]
    dealt = materialized(per_doc.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    # ranges, not documents: one row for each
    sums = dealt.groupBy("range").agg(F.sum("n_seq").alias("k"))
    before = sums.withColumn("offset", F.sum("k").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")).select("range", "offset", "k").collect()
    offsets = dealt.sparkSession.createDataFrame([(r["range"], r["offset"]) for r in before], "range int, offset long")
    within = F.sum("n_seq").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_seq")
    base = dealt.withColumn("within", within).join(F.broadcast(offsets), "range").select("doc", (F.col("offset") + F.col("within")).alias("base"))
    return base, rows, sum(r["k"] for r in before)


def training_order(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end: int = END,
    seq_len: int = SEQ_LEN,
    shard_records: int = SHARD_RECORDS,
    key: int = KEY,
    max_partitions: int = 20_000,
) -> DataFrame:
    """Every sequence with its slot, range-partitioned by shard and sorted by slot in each.

    A partition holds one shard, or several neighbours if there are more than ``max_partitions``.
    """
    stored = materialized(tokenized(docs, id_col, text_col, tokenizer, seq_len, end))
    base, rows, n = ranked(stored)
    n_shards = max(1, -(-n // shard_records))

    def slots(bases: list, counts: list) -> list[list]:
        ordinals = np.repeat(np.array(bases, np.int64), counts) + np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, np.int64)
        placed = feistel(ordinals, n, key) if n else ordinals
        return [np.split(placed, np.cumsum(counts)[:-1])] if counts else [[]]

    # the slots are found on narrow rows; they meet the records by a broadcast of a checked size, or a shuffle
    found = in_batches(base.join(stored.select("doc", "n_seq"), "doc"), ["base", "n_seq"], [("doc", "doc")], "slots array<long>", slots)
    met = stored.join(F.broadcast(found) if rows <= MAX_BROADCAST and n <= 4 * MAX_BROADCAST else found, "doc")
    each = met.select("id", F.posexplode(F.arrays_zip("slots", "lengths", "records")).alias("seq_no", "x"))
    placed = each.select("id", F.col("seq_no").cast("long").alias("seq_no"), F.col("x.slots").alias("slot"), F.col("x.lengths").cast("long").alias("n_tokens"), F.col("x.records").alias("record"))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_records).cast("int"))
    per = -(-n_shards // max_partitions)
    dealt = placed.repartitionById(-(-n_shards // per), F.floor(F.col("shard") / per).cast("int")).sortWithinPartitions("slot")
    return dealt.select(
        "slot",
        F.col("shard").cast("long").alias("shard"),
        (F.pmod("slot", F.lit(shard_records)) * (2 * (seq_len + 1))).cast("long").alias("byte_offset"),
        F.col("id").alias(id_col),
        "seq_no",
        "n_tokens",
        "record",
    )


def shard_blobs(ordered: DataFrame) -> DataFrame:
    """One row per shard: its records one after another, and the document and number of each. ``ordered`` comes from ``training_order``."""
    id_col = ordered.columns[3]
    kind = ordered.schema[id_col].dataType
    schema = StructType.fromDDL("shard long, first_slot long, n_records long, stride long, crc32 long, payload binary, seq_nos array<long>")
    schema = StructType([*schema.fields, StructField("docs", ArrayType(kind))])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def blob() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            slots, _, records, docs, numbers = (rows.column(c).combine_chunks() for c in range(5))
            parts = records.to_pylist()
            body, whole = b"".join(parts), pa.array([0, len(parts)], pa.int32())
            columns = [[shard], [slots[0].as_py()], [len(parts)], [len(parts[0])], [zlib.crc32(body)]]
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([body], pa.binary()), pa.ListArray.from_arrays(whole, numbers), pa.ListArray.from_arrays(whole, docs)], names=schema.names)

        for batch in batches:
            shards = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo and shards[lo] != shard:
                    if held:
                        yield blob()
                    held, shard = [], int(shards[lo])
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield blob()

    placed = ordered.select("slot", "shard", "record", F.col(f"`{id_col}`").alias("doc"), "seq_no")
    return placed.mapInArrow(run, schema)


def write_shards(ordered: DataFrame, path: str) -> None:
    """Stores the shards under ``path``; a run that is repeated replaces them."""
    shard_blobs(ordered).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_slots(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Records of slots ``first`` to ``last`` (inclusive), by arithmetic on the shards' strides."""
    shards = spark.read.parquet(path).where((F.col("first_slot") <= last) & (F.col("first_slot") + F.col("n_records") > first))
    low = F.greatest(F.lit(first), F.col("first_slot"))
    high = F.least(F.lit(last), F.col("first_slot") + F.col("n_records") - 1)
    slots = shards.select("first_slot", "stride", "payload", F.explode(F.sequence(low, high)).alias("slot"))
    return slots.select("slot", F.expr("substring(payload, cast((slot - first_slot) * stride + 1 as int), cast(stride as int))").alias("record"))


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every record of stored shards, cut out at its byte offset, with its slot, document and length; a wrong CRC-32 raises."""
    stored = spark.read.parquet(path)
    kind = stored.schema["docs"].dataType.elementType
    schema = StructType.fromDDL("slot long, shard long, byte_offset long")
    schema = StructType([*schema.fields, StructField(id_col, kind), *StructType.fromDDL("seq_no long, n_tokens long, record binary").fields])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n, stride, crc = (batch.column(c)[i].as_py() for c in range(5))
                body = batch.column(5)[i].as_buffer()
                if zlib.crc32(body) != crc or len(body) != n * stride:
                    raise ValueError(f"shard {shard} is damaged")
                at = np.arange(n + 1, dtype=np.int64) * stride
                record = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), body]).cast(pa.binary())
                lengths = np.frombuffer(body, "<u2").reshape(n, stride // 2)[:, 0].astype(np.int64)
                own = [pa.array(x, pa.int64()) for x in (np.arange(first, first + n), np.full(n, shard), at[:-1])]
                yield pa.RecordBatch.from_arrays([*own, batch.column(7)[i].values, batch.column(6)[i].values, pa.array(lengths), record], names=schema.names)

    return stored.select("shard", "first_slot", "n_records", "stride", "crc32", "payload", "seq_nos", "docs").mapInArrow(run, schema)


def sharded(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Writes the training order of ``docs`` as shards (under ``path``, or into the shared folder) and reads them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(training_order(docs, id_col=id_col, **options), path)
    return read_shards(spark, path, id_col)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
