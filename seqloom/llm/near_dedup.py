"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets are found by a
   128-bit fingerprint; one node stands for all of them and carries their least id.
2. One permutation serves all ``bands * rows`` bins: a set's sorted hashes fall into equal
   ranges and each range keeps its least value. Empty bins borrow from a bin chosen by a
   hash of (bin, attempt) until one is filled, which keeps the estimate unbiased.
3. ``rows`` bins form a band key. With 28 bands of 3 rows a pair at the threshold 0.75
   misses all bands with probability (1 - 0.75**3)**28 = 2e-7.
4. Buckets of one node are dropped at once. Any other is a star: each node meets the bucket's
   centre, its most popular node (the one that meets most others over all its buckets, which
   in a group of copies is the text that they come from). So a node has one edge a bucket at
   most, whatever the bucket's size, and the edges of a group go to few centres.
5. Every edge is confirmed on the full sets: 100 * |A and B| >= 75 * |A or B|.
6. Confirmed edges lead from each node to a more popular one; following them twice over puts
   most of a group under one label.
7. A star misses two similar nodes whose centre resembles neither. So the search ends with an
   exact join of all nodes that are in a bucket and don't share a label: with each set's
   shingles in one common order, frequent ones last, two sets at the threshold share one
   among the first quarter of both, and the places and sizes of both bound what they can have
   in common. Keys of many nodes are dealt into classes of set size, each node meeting the
   classes within its own bound only, so that a common passage doesn't pair all its texts.
   What is left is confirmed like the stars' edges.
8. Components take the smallest id by neighbour minima and pointer jumping; each round is a
   table in the shared folder. Nothing is collected but counts and the (bounded) common order.

Hot buckets, keys and components are never gathered in one task: centres and minima come from
partially aggregated groups, rows come back to them by joins whose skewed keys are split.
Tables that no later step reads are deleted on the way.

Cost near the threshold: pairs whose bound in step 7 reaches the threshold are compared even if
their sets turn out not to, so many texts of one group that lie just below 0.75 of each other,
without one text that they all resemble, are compared pairwise.

Defined results: ids may be of any type that has an order. Null and empty texts have an empty
set, are their own component and kept; a row with a null id is named by no component unless an
equal set with an id exists, and isn't kept; rows that repeat an id are one document (its sets
are linked to each other), each kept if the id is its component's least; ties in popularity
are broken by the node's number; texts are read whole, whatever their length; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.shingles import WIDTH, common, mixed, shingle_set
from seqloom.runtime import Scratch, in_batches, materialized

BANDS, ROWS, PERCENT = 28, 3, 75
#: Frequent shingles that the common order knows, at most. Any order gives the same pairs: only
#: speed depends on it.
FREQUENT = 200_000
#: Nodes of a key from which on they meet by size class, and classes for a factor e of size.
CROWDED, CLASSES = 128, 50
#: Ids that are broadcast for a join, at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _borrow_order(bins: int, attempts: int = 64) -> np.ndarray:
    """(bins, attempts): the bins that each empty bin tries, in order."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)[None, :]
    return (mixed((at + np.uint64(1)) * _GOLD) % np.uint64(bins)).astype(np.int64)


_ORDERS: dict[int, np.ndarray] = {}


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set, densified; ``hashes`` mustn't be empty."""
    top = np.uint64(2**64 // bins)
    starts = np.searchsorted(hashes, np.arange(bins, dtype=np.uint64) * top)
    ends = np.append(starts[1:], len(hashes))
    filled = starts < ends
    sig = hashes[np.minimum(starts, len(hashes) - 1)]
    if filled.all():
        return sig
    if bins not in _ORDERS:
        _ORDERS[bins] = _borrow_order(bins)
    empty = np.flatnonzero(~filled)
    tries = _ORDERS[bins][empty]
    ok = filled[tries]
    donor = np.where(ok.any(axis=1), tries[np.arange(len(empty)), ok.argmax(axis=1)], np.flatnonzero(filled)[0])
    out = sig.copy()
    out[empty] = sig[donor]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = sig.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for k in range(rows):
        key = mixed(key ^ parts[:, k])
    return key


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """(id, n, fp, keys): set size, fingerprint, band keys; fp and keys are null without shingles."""

    def compute(texts: list) -> list[list]:
        n, fp, keys = [], [], []
        for text in texts:
            s = shingle_set(text, width)
            n.append(len(s))
            fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else None)
        return [n, fp, keys]

    return in_batches(docs, [text_col], [(id_col, "id")], "n long, fp binary, keys array<long>", compute)


def bucketed(groups: DataFrame) -> DataFrame:
    """(node, rep, n, popularity, keys) of nodes that share a bucket, with the keys they share.

    ``groups`` has (node, rep, n, keys). A node is in ``bands`` buckets at most.
    """
    entries = groups.select("node", "rep", "n", F.explode("keys").alias("key"))
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = entries.join(several, "key")
    return shared.groupBy("node").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.sum("members").alias("popularity"), F.collect_list("key").alias("keys"))


def star_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, popularity): each node and its buckets' centres, with b's popularity, where sizes allow a link."""
    entries = nodes.select(F.explode("keys").alias("key"), "node", "n", "popularity")
    centres = entries.groupBy("key").agg(F.max(F.struct("popularity", "node", "n")).alias("c"))
    edges = entries.join(centres, "key").where((F.col("node") != F.col("c.node")) & (100 * F.least("n", F.col("c.n")) >= percent * F.greatest("n", F.col("c.n"))))
    return edges.select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("c.popularity").alias("popularity")).distinct()


def node_sets(docs: DataFrame, nodes: DataFrame, repeated: DataFrame | None, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, rep, s): the whole set of each node, made anew from the text of its least id.

    The nodes' ids are broadcast up to ``MAX_BROADCAST`` of them and shuffled beyond. Where ids
    repeat, their texts are first made distinct and then told apart by fingerprint.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    made = lambda df, keep, outputs, one: in_batches(df, ["text"], [(c, c) for c in keep], outputs, one)
    plain = lambda values: [[shingle_set(t, width).tobytes() for t in values]]
    named = nodes.select("rep", "node", "fp")
    few = nodes.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    sent = lambda df: F.broadcast(df) if few else df
    if repeated is None:
        return made(texts.join(sent(named.drop("fp")), "rep"), ["node", "rep"], "s binary", plain)

    def told(values: list) -> list[list]:
        sets = [shingle_set(t, width).tobytes() for t in values]
        return [sets, [xxhash.xxh3_128_digest(s) for s in sets]]

    once = made(texts.join(repeated, "rep", "left_anti").join(sent(named.drop("fp")), "rep"), ["node", "rep"], "s binary", plain)
    several = texts.join(repeated, "rep", "left_semi").join(named.select("rep"), "rep", "left_semi").groupBy("rep", "text").agg(F.count(F.lit(1)).alias("k"))
    # texts that differ may still have one set, so one row stands for it
    found = made(several, ["rep"], "s binary, fp binary", told).join(named, ["rep", "fp"]).dropDuplicates(["node"])
    return once.unionByName(found.select("node", "rep", "s"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) that reach the threshold on full sets, with their least ids ra and rb."""

    def linked(left: list, right: list) -> list[list]:
        out = []
        for x, y in zip(left, right, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = common(p, q)
            out.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        return [out]

    rest = [c for c in pairs.columns if c not in ("a", "b")]
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("rep").alias("ra"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("rep").alias("rb"), F.col("s").alias("sb")), "b")
    return in_batches(met, ["sa", "sb"], [(c, c) for c in ["a", "b", "ra", "rb", *rest]], "ok boolean", linked).where("ok").drop("ok")


def labelled(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the popular node that is reached by confirmed star edges, four steps at most."""
    up = scratch.keep(links.groupBy("a").agg(F.max(F.struct("popularity", "b")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("to")))
    for _ in range(2):
        onward = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
        later = scratch.keep(up.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
        scratch.drop(up)
        up = later
    labels = scratch.keep(nodes.select("node").join(up, "node", "left").select("node", F.coalesce("to", "node").alias("label")))
    scratch.drop(up)
    return labels


def common_order(sets: DataFrame, frequent: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles among ``sets`` (node, s) and their counts: two arrays of bounded length, sorted by shingle."""

    def every(values: list) -> list[list]:
        # the first row of a batch has the counts of all its sets
        h, k = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in values]), return_counts=True)
        none = [[]] * (len(values) - 1)
        return [[h, *none], [k, *none]]

    counted = in_batches(sets, ["s"], [], "h array<long>, k array<long>", every).select(F.explode(F.arrays_zip("h", "k")).alias("x")).select("x.h", "x.k")
    often = scratch.keep(counted.groupBy("h").agg(F.sum("k").alias("k")).where("k > 2"))
    # the least count from which on there are few enough, by half powers of two
    step = F.floor(2 * F.log2("k")).cast("int")
    cut, held = None, 0
    for r in sorted(often.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if (held := held + r["count"]) > frequent:
            break
        cut = r["step"]
    kept = often.where(step >= cut if cut is not None else F.lit(False)).toPandas().sort_values("h")
    scratch.drop(often)
    return kept["h"].to_numpy(np.int64), kept["k"].to_numpy(np.int64)


def prefixes(sets: DataFrame, percent: int, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """(node, n, first): set size and the set's first shingles in one common order, frequent ones last."""
    sent = sets.sparkSession.sparkContext.broadcast(common_order(sets, frequent, scratch))

    def compute(values: list) -> list[list]:
        known, count = sent.value
        sizes, first = [], []
        for x in values:
            h = np.frombuffer(x, np.int64)
            n, weight = len(h), np.zeros(len(h), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                weight = np.where(known[place] == h, count[place], 0)
            sizes.append(n)
            first.append(h[np.lexsort((h, weight))[: n - -(-percent * n // 100) + 1]])
        return [sizes, first]

    return in_batches(sets, ["s"], [("node", "node")], "n int, first array<long>", compute)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * CLASSES).cast("int")


def remaining(firsts: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Distinct (a, b) of all nodes with different labels whose prefixes meet and may reach the threshold."""
    rows = firsts.join(labels, "node").select("node", "label", "n", F.posexplode("first").alias("at", "h")).select("node", "label", "n", (F.col("n") - F.col("at")).alias("left"), "h")
    split = rows.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("members")).where("l0 <> l1").select("h", (F.col("members") >= CROWDED).alias("crowded"))
    met = scratch.keep(rows.join(split, "h"))
    # at the first shingle that both hold, all common ones are still ahead: the node with fewer left
    # (a) bounds the size of the other, and meets the classes of such sizes
    least = F.col("n") * (percent / 100.0)
    most = F.least(F.col("left") * ((100 + percent) / percent) - F.col("n"), F.col("n") * (100.0 / percent))
    classes = F.when(F.col("crowded"), F.sequence(_size_class(least), _size_class(most))).otherwise(F.array(F.lit(-1)))
    a = met.where(most >= least).withColumn("class", F.explode(classes)).alias("a")
    b = met.withColumn("class", F.when(F.col("crowded"), _size_class(F.col("n"))).otherwise(F.lit(-1))).alias("b")
    both = (F.col("a.h") == F.col("b.h")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.label") != F.col("b.label"))
    fewer = (F.col("a.left") < F.col("b.left")) | (F.col("a.left") == F.col("b.left")) & (F.col("a.node") < F.col("b.node"))
    reach = F.col("a.left") * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    sized = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    pairs = a.join(b.hint("merge"), both & fewer & reach & sized).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    out = scratch.keep(pairs)
    scratch.drop(met)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the least id reachable."""
    both = scratch.keep(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").distinct())
    state = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"), F.lit(True).alias("moved")))
    while state.where("moved").limit(1).count():
        # each node tells its neighbours its label; the least one wins, and is followed to its own label
        labels = state.select("id", "component")
        told = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("m"))
        stepped = labels.join(told.select(F.col("a").alias("id"), "m"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("j"))
        new = stepped.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("j", "c")).alias("component"))
        later = scratch.keep(new.select("id", "component", (F.col("old") != F.col("component")).alias("moved")))
        scratch.drop(state)
        state = later
    scratch.drop(both)
    return state.select("id", "component")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
    width: int = WIDTH,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.keep(sketches(docs, id_col, text_col, bands, rows, width))
    named = sketch.where(F.col("fp").isNotNull() & F.col("id").isNotNull())
    grouped = named.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    groups = scratch.keep(grouped.withColumn("node", F.monotonically_increasing_id()))
    nodes = scratch.keep(bucketed(groups).join(groups.select("node", "fp"), "node"))
    several = scratch.keep(named.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min(F.xxhash64("fp")).alias("f0"), F.max(F.xxhash64("fp")).alias("f1")).where("k > 1"))
    repeated = several.select(F.col("id").alias("rep")) if several.limit(1).count() else None
    sets = scratch.keep(node_sets(docs, nodes, repeated, id_col, text_col, width))
    starred = scratch.keep(confirmed(star_edges(nodes, percent), sets, percent))
    labels = labelled(nodes, starred, scratch)
    firsts = scratch.keep(prefixes(sets, percent, scratch))
    pairs = remaining(firsts, labels, percent, scratch)
    links = starred.select("ra", "rb").unionByName(confirmed(pairs, sets, percent).select("ra", "rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if repeated is not None:
        # an id with more than one set links the groups of these sets
        spread = several.where("f0 <> f1").select("id")
        ties = named.join(spread, "id", "left_semi").select("id", "fp").distinct().join(groups.select("fp", "rep"), "fp").where(F.col("id") != F.col("rep"))
        links = links.unionByName(ties.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    state = components(links.where("a <> b"), scratch)
    # a copy's own id counts too: it may be reached under another set
    of_fp = groups.select("fp", "rep").join(state.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    found = sketch.where(F.col("fp").isNotNull()).join(of_fp, "fp", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    found = found.unionByName(sketch.where(F.col("fp").isNull()).select("id", "n", F.col("id").alias("component")))
    scratch.drop(nodes, several, sets, starred, labels, firsts, pairs)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of sets by their common shingles, then the least id reachable.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
         ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.o FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
