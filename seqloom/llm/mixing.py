"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source is shuffled (by a keyed hash of its id and text) and offered up to
``max_epochs`` times. A copy's virtual finish time is the number of words its source has
served so far, divided by the source's target; all copies are ordered by that time and
the order is cut where the total budget is used up.

Prefix sums never put a source or the whole table into one task. A source's shuffled order
is dealt into about sqrt(rows) hash ranges; sums per range give each range its offset, and
only rows of one range meet in a window. The global cut works alike: virtual time is dealt
into bins, sums per bin find the bin in which the budget ends, and only that bin is sorted.

Targets: sources in code-point order (null last) weigh ``weights``, repeating. They share
``budget_share`` of all words; a target stops at ``max_epochs`` times its source's words
and the excess is shared anew by weight. That is one water level, found by sorting the
sources by cap / weight.

Sources are put in order in one task: that is one narrow row a source, not a document.

Defined results: a null text has size 0 and is never taken; null sources form one source;
null ids are shuffled as an empty id; repeated rows are separate documents, and rows equal in id
and text are alike to the queue, so that a rerun takes the same texts; ties in virtual time go
by source, key, then copy; texts are counted whole, whatever their length; ids may be of any
type; columns of any name come through unchanged, for a row travels as one value; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.runtime import materialized

#: Words are runs of anything but space and the control characters from tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(__row, __size, __source, __id, __key, __h): the row itself, its key (shuffle order) and the key's first 32 bits.

    The row is one value, so no column of its own can clash with a working column. The key
    covers the text, so that rows without an id, or with one id, are dealt apart.
    """
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    own = lambda c: F.col("__row")[c]
    name = F.coalesce(own(id_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), name, F.lit(":"), F.md5(F.coalesce(own(text_col), F.lit("")))))
    keyed = taken.select("__row", word_count(own(text_col)).alias("__size"), own(source_col).alias("__source"), own(id_col).cast("string").alias("__id"), key.alias("__key"))
    return keyed.withColumn("__h", F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget_share: float, max_epochs: int) -> DataFrame:
    """One row per source: __rank, __total, __target. ``sizes`` has (__source, __size)."""
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"))
    ranked = per.withColumn("__rank", F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(float(max_epochs)) * F.col("__total")
    by_ratio = W.orderBy("__ratio", "__rank")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        ranked.withColumn("__w", weight)
        .withColumn("__cap", cap)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__budget", F.lit(float(budget_share)) * F.sum("__total").over(everything))
        .withColumn("__spent", F.sum("__cap").over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__cap"))
        .withColumn("__left", F.sum("__w").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__capped", (F.col("__budget") - F.col("__spent")) / F.col("__left") >= F.col("__ratio"))
    )
    # the first source below its cap sets the level of all later ones
    first = F.min(F.when(~F.col("__capped"), F.struct("__ratio", "__rank", "__spent", "__left"))).over(everything)
    level = (F.col("__budget") - F.col("__first.__spent")) * F.col("__w") / F.col("__first.__left")
    return levels.withColumn("__first", first).select(
        "__source", "__rank", "__total", F.when(F.col("__capped"), F.col("__cap")).otherwise(level).alias("__target"), F.col("__budget")
    )


def _copies(rows: DataFrame, max_epochs: int, bins: int) -> DataFrame:
    """One row per copy with its virtual finish time __v and bin."""
    return (
        rows.where(F.col("__size") > 0)
        .select("__size", "__rank", "__key", "__id", "__prefix", "__total", "__target", F.explode(F.array(*[F.lit(c) for c in range(max_epochs)])).alias("__copy"))
        .withColumn("__v", (F.col("__copy") * F.col("__total") + F.col("__prefix")) / F.col("__target"))
        .withColumn("__bin", F.least(F.floor(F.col("__v") * bins), F.lit(4 * bins)).cast("long"))
    )


def _queued(keyed: DataFrame, offsets: DataFrame, sources: DataFrame, parts: int, few_sources: bool, few_offsets: bool) -> DataFrame:
    """Adds __prefix: words of the source up to and with this row, in shuffled order."""
    hint = F.broadcast if few_sources else (lambda x: x)
    hint_offsets = F.broadcast if few_offsets else (lambda x: x)
    within = W.partitionBy("__source", "__part").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    parted = keyed.withColumn("__part", F.floor(F.col("__h") * parts / F.lit(2**32)).cast("long"))
    summed = parted.withColumn("__within", F.sum("__size").over(within))
    o = offsets.select(F.col("__source").alias("o_source"), F.col("__part").alias("o_part"), "__offset")
    s = sources.select(F.col("__source").alias("s_source"), "__rank", "__total", "__target")
    return (
        summed.join(hint_offsets(o), F.col("__source").eqNullSafe(F.col("o_source")) & (F.col("__part") == F.col("o_part")))
        .join(hint(s), F.col("__source").eqNullSafe(F.col("s_source")))
        .withColumn("__prefix", F.col("__offset") + F.col("__within"))
        .drop("o_source", "o_part", "s_source")
    )


def _mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    max_broadcast_rows: int = 100_000,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """(__row, __size, __total, __target, __copies, __taken): each row as one value, its size, its source's size and target, and the words taken (repeats counted).

    With ``keep``, rows hold these columns only, and texts are read and counted once; else they are
    whole, and texts are read again at the end rather than shuffled or stored.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    # what the queue needs of each row, and what the caller asks for of a row: no text unless it is asked for
    own = F.struct(*[F.col("__row")[c].alias(c) for c in keep]) if keep is not None else None
    narrow = ["__id", "__source", "__size", "__key", "__h"]
    sized = materialized(keyed.select(*narrow, *([own.alias("__row")] if own is not None else [])))
    rows = sized.count()
    parts = max(64, math.isqrt(rows))
    sources = materialized(source_targets(sized, weights, budget_share, max_epochs))
    n_sources = sources.count()
    by_part = sized.withColumn("__part", F.floor(F.col("__h") * parts / F.lit(2**32)).cast("long")).groupBy("__source", "__part").agg(F.sum("__size").alias("__sum"))
    before = W.partitionBy("__source").orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = materialized(by_part.withColumn("__offset", F.sum("__sum").over(before) - F.col("__sum")).select("__source", "__part", "__offset"))
    few = {"few_sources": n_sources <= max_broadcast_rows, "few_offsets": n_sources * parts <= max_broadcast_rows}

    copies = _copies(_queued(sized, offsets, sources, parts, **few), max_epochs, parts)
    in_order = W.orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = (sources.agg(F.max("__budget")).first() or [None])[0] or 0.0
    ends = (
        copies.groupBy("__bin")
        .agg(F.sum("__size").alias("__sum"))
        .withColumn("__upto", F.sum("__sum").over(in_order))
        .where(F.col("__upto") > F.lit(budget))
        .orderBy("__bin")
        .limit(1)
        .collect()
    )
    order = ["__v", "__rank", "__key", "__id"]
    taken_copy = F.lit(True)
    if ends:
        at, left = ends[0]["__bin"], budget - (ends[0]["__upto"] - ends[0]["__sum"])
        running = F.sum("__size").over(W.orderBy(*[F.col(c).asc_nulls_first() for c in order], "__copy").rowsBetween(W.unboundedPreceding, W.currentRow))
        last = (
            copies.where(F.col("__bin") == at)
            .withColumn("__run", running)
            .where(F.col("__run") <= F.lit(left))
            .orderBy(F.col("__run").desc())
            .select(*order)
            .limit(1)
            .collect()
        )
        taken_copy = F.col("__bin") < at
        if last:
            v, rank, key, _id = last[0]
            same = (F.col("__rank") == rank) & ((F.col("__key") < key) | ((F.col("__key") == key) & (F.coalesce("__id", F.lit("")) <= F.lit(_id or ""))))
            upto = (F.col("__v") < F.lit(v)) | ((F.col("__v") == F.lit(v)) & ((F.col("__rank") < rank) | same))
            taken_copy = taken_copy | ((F.col("__bin") == at) & upto)

    queued = _queued(sized if keep is not None else keyed, offsets, sources, parts, **few)
    times = [((F.lit(c) * F.col("__total") + F.col("__prefix")) / F.col("__target")) for c in range(max_epochs)]
    taken = F.lit(0)
    for k, v in enumerate(times):
        queued = queued.withColumn(f"__v{k}", F.when(F.col("__size") > 0, v))
        as_copy = queued.withColumn("__v", F.col(f"__v{k}")).withColumn("__bin", F.least(F.floor(F.col("__v") * parts), F.lit(4 * parts)).cast("long"))
        queued = as_copy.withColumn(f"__t{k}", F.coalesce(F.when(F.col("__size") > 0, taken_copy), F.lit(False)).cast("long"))
        taken = taken + F.col(f"__t{k}")
    counted = queued.withColumn("__copies", taken)
    return counted.select("__row", "__size", "__total", "__target", "__copies", (F.col("__size") * F.col("__copies")).alias("__taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (or its columns ``keep``) with __size, __total (of its source), __target (its source's), __copies and __taken (words, repeats counted); columns of ``docs`` so named give way.

    The options are those of ``_mixed``.
    """
    mixed = _mixed(docs, **options)
    outputs = [c for c in mixed.columns if c != "__row"]
    own = [c for c in mixed.schema["__row"].dataType.names if c not in outputs]
    return mixed.select(*[F.col("__row")[c].alias(c) for c in own], *outputs)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``."""
    mixed = _mixed(docs, **options)
    copies = mixed.where(F.col("__copies") > 0).select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__n"))
    return copies.select("__row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rn, doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM per),
weighed AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * total AS cap FROM ranked),
lev AS (
  SELECT *, cap / w AS ratio, 1.5::DOUBLE * CAST(sum(total) OVER () AS DOUBLE) AS budget,
         sum(cap) OVER (ORDER BY cap / w, rnk ROWS UNBOUNDED PRECEDING) - cap AS spent,
         sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft
  FROM weighed),
capped AS (SELECT *, (budget - spent) / wleft >= ratio AS is_capped FROM lev),
level AS (SELECT spent AS s0, wleft AS w0 FROM capped WHERE NOT is_capped ORDER BY ratio, rnk LIMIT 1),
targets AS (
  SELECT c.source, c.rnk, c.total, c.budget, CASE WHEN c.is_capped THEN c.cap ELSE (c.budget - l.s0) * c.w / l.w0 END AS target
  FROM capped c LEFT JOIN level l ON true),
queue AS (
  SELECT s.*, t.rnk, t.total, t.target, t.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, CAST(s.doc_id AS VARCHAR), s.size, s.rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, c.copy, CAST(c.copy * q.total + q.prefix AS DOUBLE) / q.target AS v
  FROM queue q CROSS JOIN (VALUES (0), (1)) c(copy) WHERE q.size > 0),
cut AS (
  SELECT rn, size, budget, sum(size) OVER (ORDER BY v, rnk, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
got AS (SELECT rn, CAST(sum(size) AS BIGINT) AS taken FROM cut WHERE upto <= budget GROUP BY rn)
SELECT q.doc_id, q.size, q.total AS source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN got g USING (rn)
"""
