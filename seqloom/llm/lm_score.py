"""LM scoring: cross-entropy difference of two matched n-gram models of words.

The target model is counted over all documents of the target set, the background model over
all documents. Both are word bigram models over one vocabulary, the V different words of
all documents (lower-case runs, as in ``shingles``) and an end sign, with the same
interpolation:

    p1(z)   = (c(z)  + 1) / (N + V + 2)
    p2(z|y) = (c(yz) + M * p1(z)) / (c(y) + M)

A document starts after a start sign and closes with the end sign. Its score is the mean over
its tokens of target loss minus background loss, in bits: below 0 it resembles the target set
more than the corpus at large.

Counts are exact (up to collisions of 63-bit hashes), cover every whole text and grow with the
corpus, so no task and not the driver ever holds a model. Documents are packed into batches of
about ``BATCH`` bytes, kept in the shared folder. Each batch sends its different words and
bigrams, counted, to cells of the hash range, half as many as there are batches; a cell adds them
up over all batches and answers each batch with the totals of just the entries that it sent. Cells
end at ``FAN``: where there are more than twice as many batches (34 GB of text), groups of some
``FAN`` merge their entries first, cell by cell, and send what differs to finer cells in the group's
name, and so on. So a batch sends ``FAN`` rows at most whatever the corpus, and a task holds two
batches' entries or so. Batches meet their answers by a join on the batch and score their texts. A word in every document is one
entry a batch, so a hot word, source or text doesn't make a hot cell.

Target membership joins documents with labels by id (``marked``). Defined results: null and empty texts
have only the end sign as token and get its score; a null id is never in the target set;
repeated rows count and score as often as they occur; without any target document the target
model is the background model and all scores are 0; texts are read whole, whatever their
length; ids of any type come through unchanged; extra columns are dropped unless named in
``keep``; an empty table gives an empty result.

``train`` and ``score_documents`` are the same on bytes instead of words, for texts without
word boundaries: trigrams of the 256 byte values and an end sign, interpolated as p1 to p3. There
are at most 257 ** 3 of these whatever the corpus, so the two models may be broadcast. The
registered query doesn't use them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.shingles import mixed
from seqloom.runtime import Scratch, frugal, in_batches, materialized

SIZE = 257
END = 256
MASS = 8.0
#: Bytes that a counting step holds before it sorts and adds up.
CHUNK = 4 << 20
#: Bytes of text after which a batch of documents is closed.
BATCH = 8 << 20
#: Parts into which an entry's range of hashes is split, at least and at most; beyond twice as many batches as the most, groups merge first.
PARTS, FAN = 64, 2048
#: Entries of one owner (a batch, later a group) in one cell.
ENTRY = "cell long, owner long, keys binary, n binary, t binary"
#: Ids of the target set that are broadcast, at most.
MAX_BROADCAST_IDS = 1_000_000
_ONE, _GOLD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the signs; no word holds a blank.
_START, _STOP = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" stop"))


def codes(text: str | None) -> np.ndarray:
    """Trigram codes of a whole text, one for each byte and one for the end."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    padded = np.concatenate([[END, END], raw, [END]]).astype(np.int32)
    return (padded[:-2] * SIZE + padded[1:-1]) * SIZE + padded[2:]


def _added(parts: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate(parts)
    if weights is None:
        return np.unique(code, return_counts=True)
    values, at = np.unique(code, return_inverse=True)
    return values, np.bincount(at, np.concatenate(weights), len(values)).astype(np.int64)


def trigram_counts(docs: DataFrame, text_col: str, target_col: str) -> DataFrame:
    """(code, n_all, n_target): exact counts over all rows of ``docs``; ``target_col`` is boolean."""

    @frugal
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(kind: bool) -> None:
            if waiting[kind]:
                held[kind].append(_added(waiting[kind]))
                if len(held[kind]) > 1:
                    held[kind] = [_added([v for v, _ in held[kind]], [c for _, c in held[kind]])]
                waiting[kind], size[kind] = [], 0

        for pdf in batches:
            for text, target in zip(pdf["text"], pdf["target"], strict=True):
                kind = bool(target)
                waiting[kind].append(got := codes(text))
                size[kind] += got.nbytes
                if size[kind] > CHUNK:
                    flush(kind)
        for kind in (False, True):
            flush(kind)
            for values, n in held[kind]:
                yield pd.DataFrame({"code": values.astype(np.int32), "n_all": n, "n_target": n if kind else np.zeros_like(n)})

    narrow = docs.select(F.col(text_col).alias("text"), F.col(target_col).alias("target"))
    return narrow.mapInPandas(count, "code int, n_all long, n_target long").groupBy("code").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))


class Model:
    """Losses in bits of all trigrams that occur, and of others by their shorter contexts."""

    def __init__(self, code: np.ndarray, n: np.ndarray, mass: float = MASS) -> None:
        xy, z = np.divmod(code, SIZE)
        y = xy % SIZE
        n = n.astype(np.float64)
        one = np.bincount(z, n, SIZE)
        two = np.bincount(y * SIZE + z, n, SIZE * SIZE)
        context1, context2 = two.reshape(SIZE, SIZE).sum(axis=1), np.bincount(xy, n, SIZE * SIZE)
        p1 = (one + 1.0) / (one.sum() + SIZE)
        self.p2 = ((two.reshape(SIZE, SIZE) + mass * p1[None, :]) / (context1[:, None] + mass)).ravel()
        self.keep2 = mass / (context2 + mass)
        self.gain = n / (context2[xy] + mass)

    def loss(self, at: np.ndarray, known: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Loss of each token; ``at`` is its place in the list of codes, valid where ``known``."""
        xy, z = np.divmod(code, SIZE)
        p = self.keep2[xy] * self.p2[(xy % SIZE) * SIZE + z]
        if known.any():
            p += np.where(known, self.gain[at], 0.0)
        return -np.log2(p)


class Scorer:
    """Both models over one list of codes."""

    def __init__(self, code: np.ndarray, n_all: np.ndarray, n_target: np.ndarray) -> None:
        order = np.argsort(code)
        self.code = code[order].astype(np.int64)
        n_all, n_target = n_all[order], n_target[order]
        self.background = Model(self.code, n_all)
        self.target = Model(self.code, n_target if n_target.sum() else n_all)
        # one table of places: codes that occur, by context
        self.first = np.searchsorted(self.code, np.arange(SIZE * SIZE + 1, dtype=np.int64) * SIZE)
        # losses of the codes that occur, ready for the common case
        every = np.arange(len(self.code))
        self.known = [m.loss(every, np.ones(len(every), bool), self.code) for m in (self.target, self.background)]

    def score(self, text: str | None) -> tuple[int, float, float]:
        """Tokens, and mean losses of target and background model."""
        got, n = np.unique(codes(text), return_counts=True)
        at = np.searchsorted(self.code, got)
        at[at == len(self.code)] = 0
        known = self.code[at] == got if len(self.code) else np.zeros(len(got), bool)
        losses = []
        for table, model in zip(self.known, (self.target, self.background), strict=True):
            loss = table[at] if len(table) else np.zeros(len(got))
            if not known.all():
                odd = ~known
                loss = loss.copy()
                loss[odd] = model.loss(np.zeros(int(odd.sum()), np.int64), np.zeros(int(odd.sum()), bool), got[odd].astype(np.int64))
            losses.append(float(loss @ n) / int(n.sum()))
        return int(n.sum()), losses[0], losses[1]


def train(docs: DataFrame, *, text_col: str = "text", target_col: str = "target") -> Scorer:
    """Both models from all rows of ``docs``."""
    rows = trigram_counts(docs, text_col, target_col).toPandas()
    return Scorer(rows["code"].to_numpy(np.int64), rows["n_all"].to_numpy(np.int64), rows["n_target"].to_numpy(np.int64))


def score_documents(docs: DataFrame, scorer: Scorer, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_tokens, target_loss, background_loss and their difference, ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer,))

    def run(texts: list) -> list[list]:
        (model,) = sent.value
        got = [model.score(t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got], [g[2] for g in got], [g[1] - g[2] for g in got]]

    return in_batches(docs, [text_col], [(c, c) for c in keep], "n_tokens long, target_loss double, background_loss double, score double", run)


def _packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed: planes of zeros vanish."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _batches(docs: DataFrame, text_col: str, target_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(batch, texts, target, keep as arrays): one row for each ``BATCH`` bytes of a task's documents."""
    taken = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("target"))

    @frugal
    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        pieces: list[pa.RecordBatch] = []
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            rows = pa.Table.from_batches(pieces).combine_chunks()
            kept = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(i).combine_chunks()) for i in range(len(keep))]
            lengths = _packed(np.array([len(t) for t in held]))
            target = _packed(np.array(rows.column("target").to_pylist()))
            texts = pa.compress(b"".join(held), codec="zstd", asbytes=True)
            columns = [pa.array([task << 32 | number], pa.int64()), *[pa.array([x], pa.binary()) for x in (lengths, target, texts)], *kept]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "lengths", "target", "texts", *[f"k{i}" for i in range(len(keep))]])

        for piece in found:
            first = 0
            for at, text in enumerate(piece.column("text").to_pylist()):
                held.append(text.encode("utf-8", "surrogatepass") if text else b"")
                size += len(held[-1])
                if size >= BATCH:
                    pieces.append(piece.slice(first, at + 1 - first))
                    yield row()
                    pieces, held, size, first, number = [], [], 0, at + 1, number + 1
            if first < piece.num_rows:
                pieces.append(piece.slice(first))
        if held:
            yield row()

    arrays = "".join(f", {f.name} array<{f.dataType.simpleString()}>" for f in taken.schema if f.name not in ("text", "target"))
    return materialized(taken.mapInArrow(pack, f"batch long, lengths binary, target binary, texts binary{arrays}"))


class _Batch:
    """Tokens of a batch: ``keys`` are its different words (even) and bigrams (odd), sorted."""

    def __init__(self, lengths: bytes, texts: bytes) -> None:
        size = _unpacked(lengths).astype(np.int64)
        raw, at, parts = pa.decompress(texts, decompressed_size=int(size.sum()), codec="zstd", asbytes=True), 0, []
        self.n = np.ones(len(size), np.int64)
        for i, n in enumerate(size):
            tokens = raw[at : at + n].lower().split()  # as shingles.words
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
            parts += [[_START], hashes, [_STOP]]
            self.n[i] += len(tokens)
            at += n
        every = np.concatenate(parts).astype(np.uint64)
        after = np.ones(len(every), bool)
        after[np.append(0, np.cumsum(self.n + 1)[:-1])] = False
        now = np.flatnonzero(after)
        one = every & ~_ONE
        two = mixed(mixed(every[now - 1] * _GOLD) ^ every[now]) | _ONE
        self.keys, place = np.unique(np.concatenate([one[now], two]), return_inverse=True)
        self.word, self.pair = place[: len(now)], place[len(now) :]
        # the word before each token; the start sign occurs as often as the end sign
        self.before = np.empty(len(every), np.int64)
        self.before[now] = self.word
        starts = np.flatnonzero(~after)
        self.before[starts] = np.searchsorted(self.keys, _STOP & ~_ONE)
        self.before = self.before[now - 1]
        self.doc = np.repeat(np.arange(len(size)), self.n)

    def counts(self, weight: np.ndarray | None = None) -> np.ndarray:
        each = None if weight is None else np.tile(weight[self.doc], 2)
        return np.bincount(np.concatenate([self.word, self.pair]), each, len(self.keys)).astype(np.int64)

    def losses(self, counts: np.ndarray, total: int, size: int) -> np.ndarray:
        """Mean loss of each document by the whole corpus's ``counts`` of the keys."""
        p1 = (counts[self.word] + 1.0) / (total + size + 1)
        p2 = (counts[self.pair] + MASS * p1) / (counts[self.before] + MASS)
        return np.bincount(self.doc, -np.log2(p2), len(self.n)) / self.n


def _parts(owners: int, fan: int) -> int:
    return min(fan, max(PARTS, owners // 2))


def _split(owner: int, keys: np.ndarray, n: np.ndarray, t: np.ndarray, cells: int) -> list[tuple]:
    """(cell, owner, keys, n, t) for each of ``cells`` equal ranges of the hash that hold some of the sorted keys."""
    cell = (((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(cell, prepend=-1, append=cells))
    spans = zip(edges[:-1], edges[1:], strict=True)
    return [(int(cell[lo]), owner, _packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), _packed(n[lo:hi]), _packed(t[lo:hi])) for lo, hi in spans]


def _union(entries: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different keys of several entries, and the places of each entry's keys among them."""
    keys = [np.cumsum(_unpacked(x)) for x in entries]
    values, place = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _summed(pdf: pd.DataFrame, places: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Both counts of each different key, over all entries."""
    place = np.concatenate(places)
    return [np.bincount(place, np.concatenate([_unpacked(x) for x in pdf[c]]), size).astype(np.int64) for c in "nt"]


def _answers(asked: DataFrame, owners: int, cells: int, fan: int, scratch: Scratch) -> tuple[DataFrame, Row]:
    """(owner, cell, n, t): corpus counts of each entry of ``asked`` (cell, owner, keys, n, t), and the corpus's totals.

    Entries lie in ``cells`` equal ranges. Up to ``2 * fan`` owners are added up at once. Of more, groups
    are merged first: one task merges one group's entries of one cell, splits the different keys by the
    next cells, asks for those in the name of the group, and hands the answers down.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        values, places = _union(pdf["keys"])
        n, t = _summed(pdf, places, len(values))
        even = (values & _ONE) == 0
        out = pdf[["owner", "cell"]].copy()
        out["n"], out["t"] = [_packed(n[x]) for x in places], [_packed(t[x]) for x in places]
        out["size"], out["all"], out["target"] = 0, 0, 0
        out.iloc[0, -3:] = [int(even.sum()), int(n[even].sum()), int(t[even].sum())]
        return out

    if owners <= 2 * fan:
        told = scratch.keep(asked.groupBy("cell").applyInPandas(add, "owner long, cell long, n binary, t binary, size long, all long, target long"))
        return told, told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "all", "target")]).first()

    groups = -(-owners // fan)
    finer = _parts(groups, fan)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, places = _union(pdf["keys"])
        return pd.DataFrame(_split(key[1], values, *_summed(pdf, places, len(values)), cells * finer), columns=["cell", "owner", "keys", "n", "t"])

    def hand_down(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        _, places = _union(own["keys"])
        told = told.sort_values("cell")
        n, t = (np.concatenate([_unpacked(x) for x in told[c]]) for c in "nt")
        out = own[["owner", "cell"]].copy()
        out["n"], out["t"] = [_packed(n[x]) for x in places], [_packed(t[x]) for x in places]
        return out

    entries = scratch.keep(asked.withColumn("group", F.pmod(F.xxhash64("owner"), F.lit(groups))))
    told, totals = _answers(entries.groupBy("cell", "group").applyInPandas(merge, ENTRY), groups, cells * finer, fan, scratch)
    of_group = told.withColumn("upper", F.expr(f"cell div {finer}")).groupBy("upper", "owner")
    out = scratch.keep(entries.select("cell", "group", "owner", "keys").groupBy("cell", "group").cogroup(of_group).applyInPandas(hand_down, "owner long, cell long, n binary, t binary"))
    scratch.drop(entries, told)
    return out, totals


def score_words(docs: DataFrame, *, text_col: str = "text", target_col: str = "target", keep: tuple[str, ...] = ("doc_id",), fan: int = FAN) -> DataFrame:
    """Columns ``keep`` with n_tokens, target_loss, background_loss and ``score`` by word models of all rows of ``docs``."""
    batches = _batches(docs, text_col, target_col, keep)
    owners = batches.count()
    parts = _parts(owners, fan)

    @frugal
    def ask(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for batch, lengths, target, texts in zip(pdf["batch"], pdf["lengths"], pdf["target"], pdf["texts"], strict=True):
                b = _Batch(lengths, texts)
                rows = _split(batch, b.keys, b.counts(), b.counts(_unpacked(target).astype(np.float64)), parts)
                yield pd.DataFrame(rows, columns=["cell", "owner", "keys", "n", "t"])

    asked = batches.select("batch", "lengths", "target", "texts").mapInPandas(ask, ENTRY)
    answers, total = _answers(asked, owners, parts, fan, Scratch(docs.sparkSession))
    size, n_all, n_target = total["size"], total["all"], total["target"]

    @frugal
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1)
                b = _Batch(row.column("lengths")[0].as_py(), row.column("texts")[0].as_py())
                told = row.column("answers")[0].as_py()
                n, t = (np.concatenate([_unpacked(x[c]) for x in told]).astype(np.float64) for c in "nt")
                background = b.losses(n, n_all, size)
                target = b.losses(t, n_target, size) if n_target else background
                kept = [row.column(f"k{k}").flatten() for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(b.n), *map(pa.array, (target, background, target - background))], names=[*keep, *measures])

    measures = ("n_tokens", "target_loss", "background_loss", "score")
    by_batch = answers.groupBy(F.col("owner").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("cell", "n", "t"))).alias("answers"))
    schema = "".join(f"`{c}` {docs.select(F.col(f'`{c}`')).schema[0].dataType.simpleString()}, " for c in keep)
    return batches.join(by_batch.hint("merge"), "batch").mapInArrow(run, f"{schema}n_tokens long, target_loss double, background_loss double, score double")


def marked(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", marker: str = "target") -> DataFrame:
    """``docs`` with a boolean column: whether ``target`` lists the row's id.

    Up to ``MAX_BROADCAST_IDS`` ids are broadcast, so that no text is shuffled to be marked;
    beyond, rows with an id are joined by a shuffle.
    """
    ids = target.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct().withColumn("in_target", F.lit(True))
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    own = [c for c in docs.columns if c != marker]
    # a row is one value beside its id, so that no column of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    found = (rows if few else rows.where("id is not null")).join(F.broadcast(ids) if few else ids, "id", "left").select("row", "in_target")
    if not few:
        found = found.unionByName(rows.where("id is null").select("row", F.lit(None).cast("boolean").alias("in_target")))
    return found.select(*[F.col("row")[c].alias(c) for c in own], F.coalesce("in_target", F.lit(False)).alias(marker))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return score_words(marked(docs, good))
