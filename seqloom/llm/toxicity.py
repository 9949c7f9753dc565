"""Toxicity: a weighted finite-state pattern grammar whose insult words are learned from labels.

The grammar is composed of small finite-state machines, kept as state tables:

* the lexicon reads a word and writes its class: insult or threat (with a weight), target
  (whom a clause addresses), negation, reported speech, or none;
* ``VOICE`` reads classes from left to right: own words, negated ones (a second negation takes
  the first back) or reported ones, whichever came last;
* ``ADDRESS`` notes whether a target was met;
* the clause transducer is their composition: ``VOICE`` and ``ADDRESS`` in step from the left,
  ``ADDRESS`` once more from the right. Between a left and a right state each insult or threat
  of a clause (a stretch between sentence marks, line ends, commas and bars) writes the mode it
  stands in (plain, aimed, negated or reported) with its weight times the arc's.

Texts are searched for lexicon entries; only clauses that hold one are run through the clause
transducer. Weights of a text's matched clauses, by mode, are the inputs of a logistic score
in which a long text needs more of them than a short one. A word scores by its clause only: one
that stands alone is a clause of one word, plain and aimed at nobody.

Learning uses labelled rows whose crc32(id) mod 5 is not 0, at most ``sample_rows`` of them
(the least by a hash of the id; 8,000 by default, a documented bound). Word stems (prefixes of
3 to 10 letters, or whole words; all whose evidence suffices) enter the lexicon one after another by likelihood ratio:
how much likelier a toxic document is to hold one, two or three different words with that
stem, counted on documents that earlier stems don't explain. Stems that only come with chosen
ones join them if nearly all their holders are toxic. Fixed lists of common insults,
threats, targets, negations and speech verbs start it off. Labels, language, source and id
are never inputs of a score.

Defined results: null and empty texts score by the constant term alone; texts and clauses are
read whole, whatever their length; without usable labels the fixed lists are weighed by fixed
coefficients; a row without an id is never held out nor learned from; repeated rows get equal
scores, and repeated ids give one row to learn from; ties between stems go to the one that asks
for fewer words, then to the longer, then by name; columns of any name pass through
``score_toxicity`` unless they are named as its score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.runtime import frugal, in_batches, materialized

#: Starting lexicon, whole words.
INSULTS = "idiot moron imbecile stupid scum loser worthless pathetic disgusting trash vermin pig bastard bitch cretin halfwit degenerate filth idiota estúpido estúpida imbécil basura asqueroso crétin débile ordure connard salope dégoûtant dummkopf vollidiot abschaum widerlich trottel arschloch".split()
THREATS = "kill murder hang shoot stab strangle exterminate eradicate burn matar mataré asesinar tuer tuerai égorger töten umbringen erschießen".split()
TARGETS = frozenset("you your yours yourself he she they them those these people everyone tú usted ustedes vosotros tu toi vous ils elles eux du dich ihr euch sie".split())
NEGATIONS = frozenset("not never no isn't aren't don't doesn't nunca jamás ne pas jamais nicht kein keine nie".split())
SPEECH_VERBS = frozenset("said says wrote writes claimed claims called calls quoted quotes reported reports alleged according dijo dice escribió afirmó dit écrit déclaré selon sagte sagt schrieb behauptete laut".split())

_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_MARKS = re.compile(r"[.!?;:,|\n\r\"“”«»()]")
MODES = ("plain", "aimed", "negated", "reported")
LENGTHS = range(3, 11)
#: Likelihood ratio (G-squared) that a stem needs.
LEAST = 16.0
_FIXED = np.array([-4.0, 1.6, 2.2, 0.6, 0.4, 1.6, 1.0, 0.8, 0.5])


@dataclass(frozen=True)
class Grammar:
    """Stems (a trailing ``$``: whole words only) with weights, threats, and score coefficients."""

    insults: dict[str, float]
    threats: frozenset[str]
    coefficients: np.ndarray


def _entries(stems) -> re.Pattern:
    """The lexicon as one automaton: an entry begins at a word's first letter and takes the whole word."""
    whole = sorted((re.escape(s[:-1]) for s in stems if s.endswith("$")), reverse=True)
    open_ = sorted((re.escape(s) for s in stems if not s.endswith("$")), reverse=True)
    parts = [rf"(?:{'|'.join(whole)})(?![^\W\d_])"] if whole else []
    if open_:
        parts.append(rf"(?:{'|'.join(open_)})[^\W\d_]*")
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})") if parts else re.compile(r"(?!)")


def _clause_start(text: str, least: int, at: int) -> int:
    """Where the clause around ``at`` begins: after the last mark, which is looked for in stretches that double."""
    hi, step = at, 400
    while hi > least:
        lo = max(least, hi - step)
        last = max((k.end() for k in _MARKS.finditer(text, lo, hi)), default=None)
        if last is not None:
            return last
        hi, step = lo, 2 * step
    return least


class Machine:
    """A complete deterministic machine over word classes: ``steps[state, class]`` is the next state."""

    def __init__(self, names: list, start, moves: dict[tuple, object]) -> None:
        self.names, self.at = names, names.index(start)
        self.steps = np.array([[names.index(moves.get((state, c), state)) for c in range(len(CLASSES))] for state in names])

    def __and__(self, other: Machine) -> Machine:
        """Both machines in step: states are pairs, of which only those that can be reached are kept."""
        start = (self.names[self.at], other.names[other.at])
        found, moves, k = [start], {}, 0
        while k < len(found):
            p, q = (m.names.index(x) for m, x in zip((self, other), found[k], strict=True))
            for c in range(len(CLASSES)):
                to = (self.names[self.steps[p, c]], other.names[other.steps[q, c]])
                moves[found[k], c] = to
                if to not in found:
                    found.append(to)
            k += 1
        return Machine(found, start, moves)


#: What the lexicon writes for a word.
CLASSES = OTHER, INSULT, THREAT, TARGET, NEGATION, SPEECH = range(6)
#: Read from left to right: what was said last, and whether it still holds after a second negation.
VOICE = Machine(["own", "negated", "reported"], "own", {("own", NEGATION): "negated", ("reported", NEGATION): "negated", ("negated", NEGATION): "own", ("own", SPEECH): "reported", ("negated", SPEECH): "reported"})
#: Read from either side: whether a target was met.
ADDRESS = Machine(["nobody", "somebody"], "nobody", {("nobody", TARGET): "somebody"})
#: Composed: voice and target to the left; the target to the right is read from the other end.
LEFT, RIGHT = VOICE & ADDRESS, ADDRESS


def _arcs() -> tuple[list, np.ndarray]:
    """What an insult or a threat writes between a left and a right state: its mode, and the arc's weight."""
    modes, weights = [], np.ones((len(LEFT.names), len(RIGHT.names), len(CLASSES)))
    for i, (voice, before) in enumerate(LEFT.names):
        modes.append([])
        for j, after in enumerate(RIGHT.names):
            aimed = "somebody" in (before, after)
            modes[-1].append(("aimed" if aimed else "plain") if voice == "own" else voice)
            # a threat that names nobody is mostly about something else
            weights[i, j, THREAT] = 1.0 if aimed else 0.5
    return modes, weights


_MODES, _WEIGHTS = _arcs()
_FIXED_CLASSES = {**dict.fromkeys(SPEECH_VERBS, SPEECH), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(TARGETS, TARGET)}


class Reader:
    """Runs the grammar over texts: lexicon, then the left and right machines, then the arcs' output."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.stems = {**grammar.insults, **{f"{w}$": 1.0 for w in grammar.threats}}
        self.find = _entries(self.stems)
        self.by_length = sorted({len(s) for s in self.stems if not s.endswith("$")}, reverse=True)
        self.left, self.right = LEFT.steps.tolist(), RIGHT.steps.tolist()

    def entry(self, word: str) -> tuple[str, float] | None:
        """The lexicon's longest entry for a word, and its weight."""
        if (key := f"{word}$") in self.stems:
            return key, self.stems[key]
        for n in self.by_length:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                return word[:n], w
        return None

    def classes(self, words: list[str]) -> tuple[list[int], dict[int, tuple[str, float]]]:
        """The lexicon transducer: each word's class, and the entries of insults and threats by place."""
        out, entries = [], {}
        for k, w in enumerate(words):
            if (found := self.entry(w)) is not None:
                entries[k] = found
                out.append(THREAT if found[0][:-1] in self.grammar.threats else INSULT)
            else:
                out.append(_FIXED_CLASSES.get(w, OTHER))
        return out, entries

    def clause(self, words: list[str]) -> list[tuple[str, str, str, float]]:
        """The clause transducer: (mode, word, entry, weight) of each insult and threat."""
        classes, entries = self.classes(words)
        after, at = [0] * len(words), RIGHT.at
        for k in range(len(words) - 1, -1, -1):
            after[k] = at
            at = self.right[at][classes[k]]
        out, at = [], LEFT.at
        for k, c in enumerate(classes):
            if k in entries:
                entry, weight = entries[k]
                out.append((_MODES[at][after[k]], words[k], entry, weight * float(_WEIGHTS[at, after[k], c])))
            at = self.left[at][c]
        return out

    def matches(self, text: str | None) -> list[tuple[str, str, str, float]]:
        """Matches of all clauses that hold an entry."""
        if not text:
            return []
        low, out, done = text.lower(), [], -1
        for m in self.find.finditer(low):
            if m.start() < done:
                continue
            start = _clause_start(low, max(done, 0), m.start())
            after = _MARKS.search(low, m.end())
            done = after.start() if after else len(low)
            out += self.clause(_LETTERS.findall(low[start:done]))
        return out

    def inputs(self, text: str | None) -> np.ndarray:
        """1, weights by mode, rate, different words, different entries, threats."""
        found = self.matches(text)
        x = np.zeros(9)
        x[0] = 1.0
        if found:
            by_mode = dict.fromkeys(MODES, 0.0)
            threats = 0.0
            for mode, _, entry, weight in found:
                by_mode[mode] += weight
                threats += weight if entry[:-1] in self.grammar.threats else 0.0
            total = sum(by_mode.values())
            x[1:5] = [math.log1p(by_mode[m]) for m in MODES]
            x[5] = math.log1p(1000 * total / (len(text) + 300))
            x[6] = math.log1p(len({w for _, w, _, _ in found}))
            x[7] = math.log1p(len({e for _, _, e, _ in found}))
            x[8] = math.log1p(threats)
        return x

    def score(self, text: str | None) -> float:
        z = float(self.inputs(text) @ self.grammar.coefficients)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def stems_of(text: str | None) -> Counter:
    """(stem, k): whether the text has k different words with it, for k of 1, 2 and 3."""
    out: Counter = Counter()
    count: Counter = Counter()
    for word in set(_LETTERS.findall((text or "").lower())):
        for n in LENGTHS:
            if n > len(word):
                break
            count[word[:n]] += 1
        if len(word) >= 3:
            count[f"{word}$"] += 1
    for stem, k in count.items():
        for least in range(1, min(k, 3) + 1):
            out[stem, least] = 1
    return out


def likelihood_ratio(a: np.ndarray, n: np.ndarray, total_a: float, total: float) -> np.ndarray:
    """G-squared of holding a feature (a toxic of n holders) against the rest; 0 where it isn't a sign of toxicity."""
    b, c = n - a, total_a - a
    d = total - total_a - b

    def term(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    share = total_a / max(total, 1)
    g = 2 * (term(a, n * share) + term(b, n * (1 - share)) + term(c, (total - n) * share) + term(d, (total - n) * (1 - share)))
    return np.where(a > n * share, g, 0.0)


def choose_stems(features: list[tuple[str, int]], rows: list[np.ndarray], toxic: np.ndarray, least: float = LEAST) -> dict[str, float]:
    """Stems in order of their likelihood ratio on documents that earlier ones don't explain, with weights.

    ``rows`` has the features of each document. A chosen stem's documents leave all counts, so
    each document is taken out once. All stems with enough evidence are chosen; as each takes
    several toxic documents out, there are fewer of them than rows.
    """
    n, a = np.zeros(len(features)), np.zeros(len(features))
    holders: dict[int, list[int]] = defaultdict(list)
    for i, held in enumerate(rows):
        n[held] += 1
        a[held] += toxic[i]
        for f in held.tolist():
            holders[f].append(i)
    stems: dict[str, list[int]] = defaultdict(list)
    for f, (stem, _) in enumerate(features):
        stems[stem].append(f)
    left, total, toxic_left = np.ones(len(rows), bool), len(rows), int(toxic.sum())
    asked, length, live = np.array([-k for _, k in features]), np.array([len(s) for s, _ in features]), np.ones(len(features), bool)
    chosen: dict[str, float] = {}
    while live.any():
        g = np.where(live & (n > 0), np.round(likelihood_ratio(a, n, toxic_left, total), 6), -1.0)
        if g.max() < least:
            break
        # equal evidence: fewer words asked for, then the longer stem, then the first by name
        ties = np.flatnonzero(g == g.max())
        top = int(ties[np.lexsort((ties, -length[ties], -asked[ties]))[0]])
        stem = features[top][0]
        odds = (a[top] + 0.5) / (n[top] - a[top] + 0.5)
        chosen[stem] = float(np.clip(math.log(odds * max(total - toxic_left, 1) / max(toxic_left, 1)) / 3, 0.3, 2.0))
        live[stems[stem]] = False
        for i in holders[top]:
            if left[i]:
                left[i] = False
                n[rows[i]] -= 1
                a[rows[i]] -= toxic[i]
                total -= 1
                toxic_left -= int(toxic[i])
    return chosen | companions(features, rows, toxic, chosen)


def companions(features: list[tuple[str, int]], rows: list[np.ndarray], toxic: np.ndarray, chosen: dict[str, float], purity: float = 0.9, least: float = 60.0) -> dict[str, float]:
    """Stems that always come with chosen ones: nearly all their holders are toxic, and they take many endings.

    Copies of one document give its words pure holders too, but each such stem only one ending.
    """
    n, a = np.zeros(len(features)), np.zeros(len(features))
    for i, held in enumerate(rows):
        n[held] += 1
        a[held] += toxic[i]
    endings: dict[str, set[str]] = defaultdict(set)
    for stem, _ in features:
        if not stem.endswith("$"):
            endings[stem[:-1]].add(stem)
    g = np.round(likelihood_ratio(a, n, int(toxic.sum()), len(rows)), 6)
    able = [f for f, (stem, _) in enumerate(features) if len(endings.get(stem, ())) >= 4 and g[f] >= least and a[f] >= purity * n[f]]
    found: dict[str, float] = {}
    for f in sorted(able, key=lambda f: (-g[f], features[f][1], -len(features[f][0]), features[f][0])):
        stem = features[f][0]
        if not any(stem.startswith(c.rstrip("$")) or c.startswith(stem) for c in [*chosen, *found]):
            found[stem] = 1.0
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Coefficients by Newton steps, drawn to ``prior``."""
    w = prior.copy()
    pull = np.full(len(w), ridge)
    pull[0] = ridge / 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def default_grammar() -> Grammar:
    return Grammar({f"{w}$": 1.0 for w in INSULTS}, frozenset(THREATS), _FIXED.copy())


def _evidence(a: Column, n: Column, toxic: int, total: int) -> Column:
    """``likelihood_ratio`` as an expression of the JVM."""
    share, away = toxic / max(total, 1), 1 - toxic / max(total, 1)

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    without = F.lit(float(total)) - n
    g = 2 * (term(a, n * share) + term(n - a, n * away) + term(F.lit(float(toxic)) - a, without * share) + term(without - (F.lit(float(toxic)) - a), without * away))
    return F.when(a > n * share, g).otherwise(F.lit(0.0))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(id, text, y) of at most ``sample_rows`` labelled documents outside the held-out fifth; of texts that share an id one, the least by a hash."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0))
    rows = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    one = texts.join(F.broadcast(rows), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    return materialized(one.select("id", F.col("t.text").alias("text"), "y"))


def learn(sample: DataFrame) -> Grammar:
    """A grammar from (id, text, y); only counts and small vectors of the bounded sample reach the driver."""
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a")).first()
    total, toxic = totals["n"], totals["a"] or 0
    if toxic < 3 or toxic == total:
        return default_grammar()

    @frugal
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, a = Counter(), Counter()

        def parts() -> Iterator[pd.DataFrame]:
            keys = list(n)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield pd.DataFrame({"stem": [s for s, _ in part], "k": [k for _, k in part], "n": [n[f] for f in part], "a": [a[f] for f in part]})
            n.clear()
            a.clear()

        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                found = stems_of(text)
                n.update(found)
                if y:
                    a.update(found)
                if len(n) > 100_000:  # partial counts are summed below
                    yield from parts()
        yield from parts()

    counts = sample.select("text", "y").mapInPandas(count, "stem string, k long, n long, a long").groupBy("stem", "k").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    # candidates: every stem whose evidence over the whole sample reaches what a choice needs
    top = counts.where(_evidence(F.col("a"), F.col("n"), toxic, total) >= LEAST).orderBy("stem", "k").collect()
    features = [(r["stem"], int(r["k"])) for r in top]
    at = {f: i for i, f in enumerate(features)}

    def held(texts: list) -> list[list]:
        return [[[at[f] for f in stems_of(t) if f in at] for t in texts]]

    found_in = in_batches(sample, ["text"], [("y", "y")], "f array<int>", held).collect()
    rows = [np.array(sorted(r["f"]), np.int64) for r in found_in]
    found = choose_stems(features, rows, np.array([r["y"] for r in found_in], float))
    grammar = Grammar({f"{w}$": 1.0 for w in INSULTS} | found, frozenset(THREATS), _FIXED.copy())

    def vectors(texts: list) -> list[list]:
        reader = Reader(grammar)
        return [[reader.inputs(t) for t in texts]]

    data = in_batches(sample, ["text"], [("y", "y")], "x array<double>", vectors).collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float)
    return Grammar(grammar.insults, grammar.threats, fit_logistic(x, y, _FIXED))


def score_toxicity(docs: DataFrame, grammar: Grammar, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    reader: list[Reader] = []

    def compute(texts: list) -> list[list]:
        if not reader:  # once a task
            reader.append(Reader(grammar))
        return [[reader[0].score(t) for t in texts]]

    return in_batches(docs, [text_col], [(c, c) for c in docs.columns if c != score_col], f"`{score_col}` double", compute)


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str, sample_rows: int = 8000) -> Grammar:
    """The grammar that the labels of a data directory teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return learn(training_sample(docs, labels, "doc_id", "text", "toxic", sample_rows))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), learned(spark, docs, sf_dir)).drop("text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
