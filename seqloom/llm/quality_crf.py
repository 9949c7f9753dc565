"""Quality: a linear-chain conditional random field labels every line good or bad.

A document's lines that hold a word are the chain. A line's features are shares of its
characters and words (capitals, symbols, exclamation marks, digits, bars, words that repeat the
one before, short and long words), its length, how it begins and ends, and whether it repeats
an earlier line; the same shares of the lines before and after it are features as well, and so
is standing first or last. The field has one weight a feature and four transition weights.

Forward and backward messages are kept as log-odds of good against bad (``messages``), so each
is one number a line. A line's marginal is the sum of the two; marginals, weighted by the lines'
characters, give the document's mean, and a logistic curve over its log-odds the score.

Learning uses labelled rows whose crc32(id) mod 5 is not 0, at most ``sample_rows`` of them (the
least by a hash of the id; 4,000 by default, a documented bound). Lines take their document's
label. The likelihood is maximised by L-BFGS: every evaluation is one Spark job in which tasks
sum gradients over their documents, so only sums reach the driver. Labels, language, source and
id are never inputs of a score.

Defined results: null and empty texts and those without a word are one line without words;
texts are read whole, in stretches of ``STRETCH`` characters that end at a blank where there is
one (a longer word counts as several); without usable labels of both kinds fixed weights hold;
a row without an id is never held out nor learned from; repeated rows get equal scores;
columns of any name pass through ``score_quality`` unless they are named as its score; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.toxicity import training_sample
from seqloom.runtime import frugal, in_batches, materialized

STRETCH = 1 << 20
#: Counts of a line, added over its stretches.
COUNTS = UPPER, LETTER, SYMBOL, MARK, DIGIT, BAR, POINT, CHAR, WORD, REPEAT, SHORT, LONG = range(12)
#: Own features, and those of them that neighbours lend.
OWN = ("bias", "upper", "symbol", "mark", "digit", "bar", "repeat", "word_length", "short", "words", "ends", "begins", "long", "point", "again")
LENT = ("upper", "symbol", "mark", "digit", "bar", "repeat", "again")
SIZE = len(OWN) + 2 * len(LENT) + 2
#: Weights where no labels teach any: good unless capitals, symbols, marks, bars or repetition prevail.
_FIXED = dict(bias=3.0, upper=-4.0, symbol=-8.0, mark=-8.0, bar=-6.0, repeat=-6.0, again=-1.0)
_STAY = 1.0
_HASH = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Field:
    """Feature weights (for good), transition weights [from][to], and the score's curve."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]


def default_field() -> Field:
    weights = np.zeros(SIZE)
    for name, w in _FIXED.items():
        weights[OWN.index(name)] = w
    return Field(weights, _STAY * np.eye(2), (0.0, 1.0))


@functools.cache
def _classes() -> np.ndarray:
    """Bits by code point of the basic plane: which counts a character adds to; bit 15 marks a blank."""
    bits = np.zeros(1 << 16, np.uint16)
    for k in range(1 << 16):
        ch = chr(k)
        if ch.isalpha():
            bits[k] = 1 << LETTER | (1 << UPPER if ch.isupper() else 0)
        elif ch.isdigit():
            bits[k] = 1 << DIGIT
        elif ch in " \t\x0b\x0c\r":
            bits[k] = 1 << 15
        elif ch in "!?¡¿":
            bits[k] = 1 << MARK
        elif ch in ".,;:'\"-()’“”«»":
            bits[k] = 1 << POINT
        else:
            bits[k] = 1 << (BAR if ch == "|" else SYMBOL)
    return bits


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, v, np.uint64)])) for v in (_HASH, pow(_HASH, -1, 1 << 64)))
    return up, down


def _stretches(line: str) -> Iterator[str]:
    at = 0
    while len(line) - at > STRETCH:
        cut = line.rfind(" ", at, at + STRETCH)
        cut = at + STRETCH if cut <= at else cut
        yield line[at:cut]
        at = cut
    yield line[at:]


def _counted(parts: list[str]) -> np.ndarray:
    """The counts of some short pieces of lines, in one pass over all their characters."""
    cp = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = _classes()[np.minimum(cp, 0xFFFF)]
    ends = np.flatnonzero(cp == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros((len(parts), len(COUNTS)))

    def per_line(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[ends] - sums[starts]

    for k in (UPPER, LETTER, SYMBOL, MARK, DIGIT, BAR, POINT):
        out[:, k] = per_line(bits >> k & 1)
    out[:, CHAR] = ends - starts
    inside = (bits >> 15 == 0) & (cp != 10)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first):
        where, length = np.searchsorted(ends, first), last - first
        up, down = _powers(1 << int(len(cp)).bit_length())
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)])])
            word = (sums[last] - sums[first]) * down[first]
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (where[1:] == where[:-1]) & (length[1:] == length[:-1])])
        for k, held in ((WORD, None), (REPEAT, again), (SHORT, length <= 3), (LONG, length > 14)):
            out[:, k] = np.bincount(where if held is None else where[held], minlength=len(parts))
    return out


def lines_of(text: str | None) -> list[str]:
    """A text's lines that hold a word; one empty line where none does."""
    return [line for line in (text or "").split("\n") if line.strip(" \t\x0b\x0c\r")] or [""]


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features by line, characters by line) of each text."""
    chains = [lines_of(t) for t in texts]
    lines = [line for chain in chains for line in chain]
    counts = np.zeros((len(lines), len(COUNTS)))
    held, owner, size = [], [], 0
    for k, line in enumerate(lines):
        for part in _stretches(line) if len(line) > STRETCH else (line,):
            held.append(part)
            owner.append(k)
            size += len(part) + 1
            if size > STRETCH:
                np.add.at(counts, owner, _counted(held))
                held, owner, size = [], [], 0
    if held:
        np.add.at(counts, owner, _counted(held))

    chars, words, letters = (np.maximum(counts[:, k], 1) for k in (CHAR, WORD, LETTER))
    own = np.zeros((len(lines), len(OWN)))
    own[:, 0] = 1
    own[:, 1] = counts[:, UPPER] / letters
    for column, k in ((2, SYMBOL), (3, MARK), (4, DIGIT), (13, POINT)):
        own[:, column] = np.sqrt(counts[:, k] / chars)
    for column, k in ((5, BAR), (6, REPEAT), (8, SHORT), (12, LONG)):
        own[:, column] = counts[:, k] / words
    own[:, 7] = np.minimum((counts[:, CHAR] - words + 1) / words / 10, 3)
    own[:, 9] = np.log1p(counts[:, WORD]) / 5
    for k, line in enumerate(lines):
        bare = line.strip(" \t\x0b\x0c\r")
        own[k, 10], own[k, 11] = bare[-1:] in (".", "!", "?"), bare[:1].isupper()

    out, at, lent = [], 0, [OWN.index(name) for name in LENT]
    for chain in chains:
        n, seen = len(chain), set()
        x = np.zeros((n, SIZE))
        x[:, : len(OWN)] = own[at : at + n]
        for k, line in enumerate(chain):
            x[k, OWN.index("again")] = line in seen
            seen.add(line)
        x[1:, len(OWN) : len(OWN) + len(LENT)] = x[:-1][:, lent]
        x[:-1, len(OWN) + len(LENT) : SIZE - 2] = x[1:][:, lent]
        x[0, SIZE - 2] = x[-1, SIZE - 1] = 1
        out.append((x, np.maximum(counts[at : at + n, CHAR], 1)))
        at += n
    return out


def messages(logits: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Forward and backward log-odds of every line of some chains, and each chain's log partition function.

    Chains run in step, the longest first, so a step is one operation over all that still go on.
    """
    order = sorted(range(len(logits)), key=lambda k: -len(logits[k]))
    lengths = np.array([len(logits[k]) for k in order])
    most = int(lengths.max(initial=0))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([logits[k] for k in order]) if order else np.zeros(0)
    forward, backward = np.zeros_like(flat), np.zeros_like(flat)
    total = np.zeros(len(order))
    (t00, t01), (t10, t11) = moves
    live = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")
    for t in range(most):
        at = starts[: live[t]] + t
        if t:
            before = forward[at - 1]
            bad = np.logaddexp(t00, before + t10)
            total[: live[t]] += bad
            forward[at] = flat[at] + np.logaddexp(t01, before + t11) - bad
        else:
            forward[at] = flat[at]
    for t in range(most - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        after = flat[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(t10, t11 + after) - np.logaddexp(t00, t01 + after)
    total += np.logaddexp(0, forward[starts[1:] - 1])
    place = {k: n for n, k in enumerate(order)}
    cut = [slice(starts[place[k]], starts[place[k] + 1]) for k in range(len(order))]
    return [forward[c] for c in cut], [backward[c] for c in cut], total[[place[k] for k in range(len(order))]]


def _good(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (x * weights).sum(axis=1)  # a row's sum is the same in every batch, unlike a matrix product's


def evidence(texts: list[str | None], field: Field) -> list[float]:
    """Log-odds of the length-weighted mean marginal of each text's lines."""
    found = features(texts)
    forward, backward, _ = messages([_logits(x, field.weights) for x, _ in found], field.moves)
    out = []
    for (_, chars), f, b in zip(found, forward, backward, strict=True):
        bad = float((_good(-(f + b)) * chars).sum() / chars.sum())
        bad = min(max(bad, 1e-4), 1 - 1e-4)
        out.append(round(float(np.log((1 - bad) / bad)), 9))
    return out


def scores(texts: list[str | None], field: Field) -> list[float]:
    a, b = field.curve
    return [float(np.round(_good(np.float64(a + b * z)), 9)) for z in evidence(texts, field)]


def gradient(docs: list[tuple[int, np.ndarray]], weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The negative log-likelihood of documents (label, features), then its gradient, as one vector."""
    forward, backward, total = messages([_logits(x, weights) for _, x in docs], moves)
    out = np.zeros(1 + SIZE + 4)
    for (y, x), f, b, z in zip(docs, forward, backward, total, strict=True):
        steps = len(x) - 1
        out[0] += z - (y * _logits(x, weights).sum() + steps * moves[y, y])
        out[1 : 1 + SIZE] += (_good(f + b) - y) @ x
        if steps:
            u = f[1:] - (np.logaddexp(moves[0, 1], f[:-1] + moves[1, 1]) - np.logaddexp(moves[0, 0], f[:-1] + moves[1, 0]))
            pair = np.stack([i * f[:-1] + moves[i, j] + j * (u + b[1:]) for i in (0, 1) for j in (0, 1)])
            pair = np.exp(pair - np.logaddexp.reduce(pair, axis=0))
            pair[3 * y] -= 1
            out[1 + SIZE :] += pair.sum(axis=1)
    return out


def minimised(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 25, memory: int = 6) -> np.ndarray:
    """L-BFGS with halved steps; each evaluation is a pass over the data."""
    w, pairs = start.copy(), []
    value, grad = evaluate(w)
    for _ in range(steps):
        q, held = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            held.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.abs(grad).sum(), 1.0)
        for (s, y), a in zip(pairs, reversed(held), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        rate = 1.0
        for _ in range(8):
            moved = w - rate * q
            new, slope = evaluate(moved)
            if new <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            return w
        s, y = moved - w, slope - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y)]
        done = value - new < 1e-5 * max(abs(value), 1e-9)
        w, value, grad = moved, new, slope
        if done:
            break
    return w


def learn(sample: DataFrame, ridge: float = 0.003) -> Field:
    """The field that (id, text, y) rows teach; ``ridge`` draws its weights to the fixed ones."""
    start = default_field()
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).first()
    n, good = totals["n"], totals["good"] or 0
    if min(good, n - good) < 3:
        return start

    def chains(texts: list) -> list[list]:
        return [[x.astype(np.float32).ravel() for x, _ in features(texts)]]

    stored = materialized(in_batches(sample, ["text"], [("y", "y")], "x array<float>", chains))
    prior = np.concatenate([start.weights, start.moves.ravel()])

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        @frugal
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held = np.zeros(1 + len(w))
            for batch in batches:
                rows = [(y, np.asarray(x, np.float64).reshape(-1, SIZE)) for y, x in zip(batch.column(0).to_pylist(), (v.values.to_numpy(zero_copy_only=False) for v in batch.column(1)), strict=True)]
                held += gradient(rows, w[:SIZE], w[SIZE:].reshape(2, 2))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held)], names=["k", "v"])

        sums = {r["k"]: r["v"] for r in stored.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        found = np.array([sums[k] for k in range(1 + len(w))]) / n
        away = w - prior
        return float(found[0] + ridge / 2 * away @ away), found[1:] + ridge * away

    w = minimised(evaluate, prior)
    field = Field(w[:SIZE], w[SIZE:].reshape(2, 2), (0.0, 1.0))
    held = in_batches(sample, ["text"], [("y", "y")], "z double", lambda texts: [evidence(texts, field)]).collect()
    return Field(field.weights, field.moves, _curve(np.array([r["z"] for r in held]), np.array([r["y"] for r in held], float)))


def _curve(z: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, drawn to (0, 1), by Newton steps."""
    order = np.lexsort((y, z))
    z, y = z[order], y[order]
    prior, w, x = np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.stack([np.ones(len(z)), z], axis=1)
    pull = ridge * len(z) / 100
    for _ in range(50):
        p = _good(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(2), x.T @ (y - p) - pull * (w - prior))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_quality(docs: DataFrame, field: Field, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    return in_batches(docs, [text_col], [(c, c) for c in docs.columns if c != score_col], f"`{score_col}` double", lambda texts: [scores(texts, field)])


def labelled_lines(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, chars, good): every line's marginal, for those who drop bad lines instead of documents."""

    def compute(texts: list) -> list[list]:
        found = features(texts)
        forward, backward, _ = messages([_logits(x, field.weights) for x, _ in found], field.moves)
        return [[[(k, int(c), float(p)) for k, (c, p) in enumerate(zip(chars, _good(f + b), strict=True))] for (_, chars), f, b in zip(found, forward, backward, strict=True)]]

    found = in_batches(docs, [text_col], [(id_col, "id")], "lines array<struct<line int, chars long, good double>>", compute)
    return found.select("id", F.explode("lines").alias("l")).select(F.col("id").alias(id_col), "l.*")


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str, sample_rows: int = 4000) -> Field:
    """The field that the labels of a data directory teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return learn(training_sample(docs, labels, "doc_id", "text", "quality", sample_rows))


def op11_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs.select("doc_id", "text"), learned(spark, docs, sf_dir)).drop("text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
