"""Conversation structure repair by weighted finite-state composition.

Three machines are composed:

* the input acceptor: a conversation's rows in order, each read as its role's initial and its
  fault (blank, duplicate, truncated or none);
* the edit transducer ``edits_of`` / ``INSERTS``: keep, rerole, delete or insert, with costs;
* the role grammar ``GRAMMAR``: nothing, or an optional system turn and then user and
  assistant in turns.

States of the composition are (row, grammar state). They are made only when a path reaches them,
and once for all rows that read alike (``step``). Weights are pairs (cost, labels), added by
pairs and compared by cost, then by the labels' bytes; the best path is found in topological
order. Inserts are taken to stand before a row, so every path over the same rows ends with a
label that reads a row and no label string is another's prefix: the comparison then holds under
concatenation from both sides, and paths over stretches of rows may be joined later.

That is what splits long conversations. Rows are ordered by a global range sort; each stretch of
``PIECE`` rows gives one 4 x 4 matrix of weights (``weights``), a conversation's matrices are
joined from its end to its start (``chained``, narrow rows only, a few numbers of state), then read
from the start (``followed``), and each stretch is edited where its rows are (``repaired``). Equal
rows (one turn, role and text) travel as one row with a count. Only the hash over a repaired
conversation in ``digest`` is sequential by its nature: it streams rows in order in bounded memory.

Defined results: null role or text is one space; a null conversation id is a conversation, null
turns come first; rows of one turn are ordered by role, then text, so copies are adjacent; columns
of other names are not read, so no name can clash; a conversation without rows has an empty path;
texts are hashed whole, whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqloom.runtime import frugal, in_batches, materialized, table

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States 0 (start), 1 (after system), 2 (after user), 3 (after assistant): what a role's initial leads to.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Arcs that read no row: label, cost, initial of the role written.
INSERTS = (("I", 3, "u"), ("I", 3, "a"))
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a stretch; a power of two that divides Spark's ids of one partition (2^33).
PIECE = 2048
_BLANKS = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]


def edits_of(initial: str, fault: int) -> Iterator[tuple[str, int, str]]:
    """Arcs of the edit transducer that read a row: label, cost, initial written (none if it is deleted)."""
    yield "D", 4, ""
    if fault not in (BLANK, DUPLICATE):
        more = 3 if fault == TRUNCATED else 0
        yield "K", more, initial
        for written in ROLES:
            yield "R", 3 + more, written


def _inserted(state: int) -> dict[int, Weight]:
    """Grammar states by the best inserts that lead there; more than two would come back to a state already seen."""
    best, layer = {state: (0, "")}, {state: (0, "")}
    for _ in range(2):
        after: dict[int, Weight] = {}
        for g, (cost, labels) in layer.items():
            for label, more, written in INSERTS:
                if (to := GRAMMAR[g].get(written)) is not None:
                    after[to] = min(after.get(to, (cost + more, labels + label)), (cost + more, labels + label))
        layer = {g: w for g, w in after.items() if g not in best or w < best[g]}
        best |= layer
    return best


@functools.cache
def step(initial: str, fault: int) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """The composition around one row: for each grammar state before it, (state after it, cost, labels)."""
    out = []
    for state in range(len(GRAMMAR)):
        best: dict[int, Weight] = {}
        for g, (cost, labels) in _inserted(state).items():
            for label, more, written in edits_of(initial, fault):
                to = GRAMMAR[g].get(written) if label != "D" else g
                if to is not None:
                    weight = (cost + more, labels + label)
                    best[to] = min(best.get(to, weight), weight)
        out.append(tuple((to, *w) for to, w in sorted(best.items())))
    return tuple(out)


@functools.cache
def tail(state: int) -> Weight:
    """The best inserts behind the last row that reach a final state."""
    return min(w for g, w in _inserted(state).items() if g in FINAL)


def weights_of(rows: list[tuple[str, int]]) -> list[list[Weight | None]]:
    """Best weights over some rows (initial, fault), from each grammar state to each."""
    out = []
    for start in range(len(GRAMMAR)):
        at: dict[int, Weight] = {start: (0, "")}
        for initial, fault in rows:
            after: dict[int, Weight] = {}
            arcs = step(initial if initial in ("s", "u", "a") else "", fault)
            for g, (cost, labels) in at.items():
                for to, more, added in arcs[g]:
                    weight = (cost + more, labels + added)
                    if to not in after or weight < after[to]:
                        after[to] = weight
            at = after
        out.append([at.get(g) for g in range(len(GRAMMAR))])
    return out


def stream(df: DataFrame, keep: list[tuple[str, str]], outputs: str, run: Callable[[Iterator[dict]], Iterator[list]]) -> DataFrame:
    """``run`` over a partition's rows in order, as dicts; kept columns take their type from ``df``."""
    added = StructType.fromDDL(outputs)
    schema = StructType([StructField(new, df.schema[old].dataType) for old, new in keep] + added.fields)

    @frugal
    def over(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        held, size = [], 0
        for row in run(rows()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str)) + 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(over, schema)


def ordered(rows: DataFrame) -> DataFrame:
    """(c, t, r, x, n, fault, mid): distinct rows with their number of copies, faults and global order, stored.

    ``rows`` has conversation ``c``, turn ``t``, role ``r`` and text ``x``.
    """
    once = rows.groupBy("c", "t", "r", "x").agg(F.count(F.lit(1)).alias("n"))
    turn = F.struct(F.col("t").isNotNull().alias("has"), "t")
    again = once.groupBy("c", "r", F.sha2("x", 256).alias("h")).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    again = again.select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("h").alias("h2"), "first")
    same = F.col("c").eqNullSafe(F.col("c2")) & (F.col("r") == F.col("r2")) & (F.sha2("x", 256) == F.col("h2"))
    bare = F.rtrim("x", F.lit(_BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("first") < turn, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    joined = once.join(again, same, "left").select("c", "t", "r", "x", "n", fault.alias("fault"))
    placed = joined.repartitionByRange("c", "t", "r", F.substring("x", 1, 64)).sortWithinPartitions("c", "t", "r", "x")
    return materialized(placed.withColumn("mid", F.monotonically_increasing_id()))


def _piece() -> Column:
    return F.floor(F.col("mid") / PIECE)


def weights(rows: DataFrame) -> DataFrame:
    """(c, piece, w): each stretch's matrix, as costs and label strings in row-major order."""
    code = F.struct("mid", F.substring("r", 1, 1).alias("i"), "fault")
    pieces = rows.groupBy("c", _piece().alias("piece")).agg(F.sort_array(F.collect_list(code)).alias("codes"))

    def compute(codes: list) -> list[list]:
        costs, labels = [], []
        for rows in codes:
            flat = [w for line in weights_of([(r["i"], r["fault"]) for r in rows]) for w in line]
            costs.append([w and w[0] for w in flat])
            labels.append([w and w[1] for w in flat])
        return [costs, labels]

    return in_batches(pieces, ["codes"], [("c", "c"), ("piece", "piece")], "costs array<long>, labels array<string>", compute)


_NEW = object()


def chained(matrices: DataFrame) -> DataFrame:
    """(c, piece, to, labels): for each stretch and state before it, the state behind it and the labels of the best path to the end.

    Stretches are read from the end. What is kept of all later ones is, by state, the cost
    and the place of its label string among the four.
    """
    size = len(GRAMMAR)

    def run(rows: Iterator[dict]) -> Iterator[list]:
        c, after = _NEW, []
        for row in rows:
            if row["c"] != c:
                c, after = row["c"], [tail(g) for g in range(size)]
            found = []
            for g in range(size):
                ways = [(row["costs"][k] + after[h][0], row["labels"][k], after[h][1], h) for h in range(size) if row["costs"][k := g * size + h] is not None]
                found.append(min(ways))
            place = {key: n for n, key in enumerate(sorted({way[1:3] for way in found}))}
            after = [(way[0], place[way[1:3]]) for way in found]
            yield [c, row["piece"], [way[3] for way in found], [way[1] for way in found]]

    ends = matrices.repartition("c").sortWithinPartitions("c", F.desc("piece"))
    return stream(ends, [("c", "c"), ("piece", "piece")], "to array<int>, labels array<string>", run)


def followed(choices: DataFrame) -> DataFrame:
    """(c, piece, state, labels, tail): the path's state before each stretch, its labels there, and those behind the last row."""

    def run(rows: Iterator[dict]) -> Iterator[list]:
        c, state, held = _NEW, 0, None
        for row in rows:
            if row["c"] != c:
                if held is not None:
                    yield [*held, tail(state)[1]]
                c, state, held = row["c"], 0, None
            if held is not None:
                yield [*held, ""]
            held = [c, row["piece"], state, row["labels"][state]]
            state = row["to"][state]
        if held is not None:
            yield [*held, tail(state)[1]]

    starts = choices.repartition("c").sortWithinPartitions("c", "piece")
    return stream(starts, [("c", "c"), ("piece", "piece")], "state int, labels string, tail string", run)


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of all conversations, one row an edit: (c, mid, sub, label, copies, role, text, t, r, fault, cost).

    Rows are in order by (mid, sub) within their conversation ``c``. Deleted rows have no
    ``role`` and ``text``; further copies of a row follow it as one deletion with their number.
    """
    paths = followed(chained(weights(rows)))
    lead = paths.select("c", "piece", F.lit(-1).cast("long").alias("mid"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in ("t", "r", "x", "n", "fault")], "state", "labels", "tail")
    body = rows.select("c", _piece().alias("piece"), "mid", "t", "r", "x", "n", "fault", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("labels"), F.lit(None).cast("string").alias("tail"))
    together = lead.unionByName(body).repartition("c", "piece").sortWithinPartitions("c", "piece", "mid")

    def run(rows: Iterator[dict]) -> Iterator[list]:
        state = at = 0
        labels = end = ""

        def insert(c, mid: int, sub: int) -> list:
            nonlocal state
            written = next(i for i in ROLES if i in GRAMMAR[state])
            state = GRAMMAR[state][written]
            return [c, None, mid, sub, "I", 1, ROLES[written], "", None, None, 3]

        for row in rows:
            if row["mid"] < 0:
                state, labels, end, at = row["state"], row["labels"], row["tail"], 0
                continue
            c, mid, sub = row["c"], row["mid"], 0
            while labels[at] == "I":
                yield insert(c, mid, sub)
                at, sub = at + 1, sub + 1
            label, role, text, cost = labels[at], None, None, 4
            at += 1
            if label != "D":
                # inserts before a row are the only choice of another state, so the state is known here
                written = row["r"][:1] if label == "K" else next(i for i in ROLES if i in GRAMMAR[state])
                state, role, text = GRAMMAR[state][written], row["r"] if label == "K" else ROLES[written], row["x"]
                cost = (0 if label == "K" else 3) + (3 if row["fault"] == TRUNCATED else 0)
            yield [c, row["t"], mid, sub, label, 1, role, text, row["r"], row["fault"], cost]
            if row["n"] > 1:
                fault = BLANK if row["fault"] == BLANK else DUPLICATE
                yield [c, row["t"], mid, sub + 1, "D", row["n"] - 1, None, None, row["r"], fault, 4 * (row["n"] - 1)]
            if at == len(labels):
                for k in range(len(end)):
                    yield insert(c, mid, sub + 2 + k)

    return stream(together, [("c", "c"), ("t", "t")], "mid long, sub int, label string, copies long, role string, text string, r string, fault int, cost long", run)


def digest(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each ``c`` of ``ids``: counts of faults, cost, labels in order and the repaired conversation's hash.

    A conversation's rows are read in order by one task, a row at a time.
    """
    lead = ids.select("c", *[F.lit(-1 if k == "mid" else None).cast(edits.schema[k].dataType).alias(k) for k in edits.columns if k != "c"])
    together = lead.unionByName(edits).repartition("c").sortWithinPartitions("c", "mid", "sub")

    def run(rows: Iterator[dict]) -> Iterator[list]:
        seen, c = False, None

        def done() -> list:
            span = max(turns[1] - turns[0] + 1 - turns[2], 0) if turns else 0
            return [c, span, *faults[1:], illegal, cost, "".join(audit), sha.hexdigest()]

        for row in rows:
            if row["mid"] < 0:
                if seen:
                    yield done()
                seen, c = True, row["c"]
                turns, faults, illegal, cost, audit, sha, last, some = None, [0, 0, 0, 0], 0, 0, [], hashlib.sha256(), None, False
                continue
            cost += row["cost"]
            audit.append(row["label"] * row["copies"])
            if row["label"] != "I":
                faults[row["fault"]] += row["copies"]
                initial = row["r"][:1]
                if last is not None and last + initial not in ("su", "ua", "au"):
                    illegal += 1
                illegal += (row["copies"] - 1) * ((2 * initial) not in ("su", "ua", "au"))
                last = initial
                if (t := row["t"]) is not None:
                    turns = (turns[0], t, turns[2] + (t != turns[1])) if turns else (t, t, 1)
            if row["role"] is not None:
                sha.update((("\n" if some else "") + f"{row['role']}:{row['text']}").encode())
                some = True
        if seen:
            yield done()

    return stream(together, [("c", "c")], "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", run)


def repair(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(edits, digest) of conversations whose rows are one turn each; see ``repaired`` and ``digest``."""
    rows = _rows(conversations, id_col, turn_col, role_col, text_col)
    edits = repaired(ordered(rows))
    return edits, digest(edits, rows.select("c").distinct())


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = F.lit(" ")
    return conversations.select(F.col(f"`{id_col}`").alias("c"), F.col(f"`{turn_col}`").alias("t"), F.coalesce(F.col(f"`{role_col}`"), blank).alias("r"), F.coalesce(F.col(f"`{text_col}`"), blank).alias("x"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the contract's damage, drawn by crc32 of conversation and turn."""
    key = F.concat(F.coalesce(F.col("c").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("t").cast("string"), F.lit(" ")))
    drawn = rows.withColumn("d", F.pmod(F.crc32(key.cast("binary")), F.lit(20))).where("d != 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x"))
    hurt = drawn.select("c", "t", F.when(F.col("d") == 4, "user").otherwise(F.col("r")).alias("r"), text.alias("x"), F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return hurt.select("c", "t", "r", "x", F.explode("copies")).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    found = digest(repaired(ordered(damaged(rows))), rows.select("c").distinct())
    return found.withColumnRenamed("c", "conv_id")


#: The bit-by-bit CRC-32, the damage and a path search from each conversation's end, all by lists.
OP12_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(b)::BIGINT FOR b IN string_split(k, '')]),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS d FROM base),
hurt AS (
  SELECT c, t, CASE WHEN d = 4 THEN 'user' ELSE r END AS r, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
         unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY c) AS n, lag(left(r, 1)) OVER w AS before,
         row_number() OVER (PARTITION BY c, r, x ORDER BY t NULLS FIRST, copy) AS nth, rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt WINDOW w AS (PARTITION BY c ORDER BY t NULLS FIRST, r, x, copy)),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, left(r, 1) AS ini,
         before IS NOT NULL AND before || left(r, 1) NOT IN ('su', 'ua', 'au') AS bad FROM placed),
-- from the last row to the first: for each grammar state the best (cost, labels, repaired text) of what follows
search(c, i, v0, v1, v2, v3) AS (
  SELECT c, n + 1, {'k': 0, 's': '', 'o': []::VARCHAR[]}, {'k': 6, 's': 'II', 'o': ['user:', 'assistant:']}, {'k': 3, 's': 'I', 'o': ['assistant:']}, {'k': 0, 's': '', 'o': []::VARCHAR[]} FROM faulty WHERE i = 1
  UNION ALL
  SELECT c, i,
    list_min([w0, {'k': w2.k + 3, 's': 'I' || w2.s, 'o': list_prepend('user:', w2.o)}, {'k': w3.k + 6, 's': 'II' || w3.s, 'o': list_concat(['user:', 'assistant:'], w3.o)}]),
    list_min([w1, {'k': w2.k + 3, 's': 'I' || w2.s, 'o': list_prepend('user:', w2.o)}, {'k': w3.k + 6, 's': 'II' || w3.s, 'o': list_concat(['user:', 'assistant:'], w3.o)}]),
    list_min([w2, {'k': w3.k + 3, 's': 'I' || w3.s, 'o': list_prepend('assistant:', w3.o)}]),
    list_min([w3, {'k': w2.k + 3, 's': 'I' || w2.s, 'o': list_prepend('user:', w2.o)}])
  FROM (
    SELECT f.c, f.i,
      list_min(list_filter([{'k': v0.k + 4, 's': 'D' || v0.s, 'o': v0.o}, CASE WHEN f < 1 OR f > 2 THEN CASE ini WHEN 's' THEN {'k': v1.k + f, 's': 'K' || v1.s, 'o': list_prepend(r || ':' || x, v1.o)} WHEN 'u' THEN {'k': v2.k + f, 's': 'K' || v2.s, 'o': list_prepend(r || ':' || x, v2.o)} END END, CASE WHEN f < 1 OR f > 2 THEN {'k': v2.k + 3 + f, 's': 'R' || v2.s, 'o': list_prepend('user:' || x, v2.o)} END], lambda e: e IS NOT NULL)) AS w0,
      list_min(list_filter([{'k': v1.k + 4, 's': 'D' || v1.s, 'o': v1.o}, CASE WHEN (f < 1 OR f > 2) AND ini = 'u' THEN {'k': v2.k + f, 's': 'K' || v2.s, 'o': list_prepend(r || ':' || x, v2.o)} END, CASE WHEN f < 1 OR f > 2 THEN {'k': v2.k + 3 + f, 's': 'R' || v2.s, 'o': list_prepend('user:' || x, v2.o)} END], lambda e: e IS NOT NULL)) AS w1,
      list_min(list_filter([{'k': v2.k + 4, 's': 'D' || v2.s, 'o': v2.o}, CASE WHEN (f < 1 OR f > 2) AND ini = 'a' THEN {'k': v3.k + f, 's': 'K' || v3.s, 'o': list_prepend(r || ':' || x, v3.o)} END, CASE WHEN f < 1 OR f > 2 THEN {'k': v3.k + 3 + f, 's': 'R' || v3.s, 'o': list_prepend('assistant:' || x, v3.o)} END], lambda e: e IS NOT NULL)) AS w2,
      list_min(list_filter([{'k': v3.k + 4, 's': 'D' || v3.s, 'o': v3.o}, CASE WHEN (f < 1 OR f > 2) AND ini = 'u' THEN {'k': v2.k + f, 's': 'K' || v2.s, 'o': list_prepend(r || ':' || x, v2.o)} END, CASE WHEN f < 1 OR f > 2 THEN {'k': v2.k + 3 + f, 's': 'R' || v2.s, 'o': list_prepend('user:' || x, v2.o)} END], lambda e: e IS NOT NULL)) AS w3
    FROM search s JOIN faulty f ON f.c IS NOT DISTINCT FROM s.c AND f.i = s.i - 1)),
sums AS (
  SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM faulty GROUP BY c)
SELECT ids.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.k, 0)::BIGINT AS cost, coalesce(v0.s, '') AS audit, sha256(coalesce(array_to_string(v0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c FROM base) ids LEFT JOIN sums ON sums.c IS NOT DISTINCT FROM ids.c LEFT JOIN search ON search.c IS NOT DISTINCT FROM ids.c AND search.i = 1
"""
