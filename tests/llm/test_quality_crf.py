"""The quality field: enumerated label sequences, plain counts, finite differences, held-out rows, odd inputs."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from seqloom.llm import quality_crf as q

SF = "/root/testdata/sf0.01"


def test_messages_against_all_label_sequences():
    rng = np.random.default_rng(4)
    for _ in range(30):
        moves = rng.normal(size=(2, 2)) * 2
        logits = [rng.normal(size=n) * 3 for n in (3, 1, 6, 6, 2)]
        forward, backward, total = q.messages(logits, moves)
        for u, f, b, z in zip(logits, forward, backward, total, strict=True):
            weight, good = 0.0, np.zeros(len(u))
            for labels in itertools.product((0, 1), repeat=len(u)):
                w = math.exp(sum(u[k] for k, y in enumerate(labels) if y) + sum(moves[i, j] for i, j in itertools.pairwise(labels)))
                weight += w
                good += w * np.array(labels)
            assert np.allclose(1 / (1 + np.exp(-(f + b))), good / weight) and math.isclose(z, math.log(weight), abs_tol=1e-9)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    docs = [(int(rng.integers(2)), rng.normal(size=(n, q.SIZE))) for n in (1, 4, 3, 9)]
    w = rng.normal(size=q.SIZE + 4) * 0.3

    def value(w):
        return q.gradient(docs, w[: q.SIZE], w[q.SIZE :].reshape(2, 2))

    found = value(w)[1:]
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert math.isclose(found[k], (value(w + step)[0] - value(w - step)[0]) / 2e-5, rel_tol=1e-4, abs_tol=1e-5)


def plain(line):
    """A line's own features, counted one character and word at a time."""
    blanks = " \t\x0b\x0c\r"
    words, word = [], ""
    for ch in line + " ":
        if ch in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += ch
    letters = sum(ch.isalpha() for ch in line)
    chars = max(len(line), 1)
    n = max(len(words), 1)
    symbols = [ch for ch in line if not ch.isalpha() and not ch.isdigit() and ch not in blanks and ch not in "!?¡¿|.,;:'\"-()’“”«»"]
    return {
        "upper": sum(ch.isupper() and ch.isalpha() for ch in line) / max(letters, 1),
        "symbol": math.sqrt(len(symbols) / chars),
        "mark": math.sqrt(sum(ch in "!?¡¿" for ch in line) / chars),
        "digit": math.sqrt(sum(ch.isdigit() for ch in line) / chars),
        "bar": line.count("|") / n,
        "repeat": sum(a == b for a, b in itertools.pairwise(words)) / n,
        "short": sum(len(w) <= 3 for w in words) / n,
        "long": sum(len(w) > 14 for w in words) / n,
        "words": math.log1p(len(words)) / 5,
    }


def some_text(rng):
    alphabet = "abcXYZé ñ.,!?|#%&1 2\t　漢"
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
    return "\n".join([*lines, "the the the end end.", *lines[:1]])


def test_features_against_plain_counts():
    rng = random.Random(2)
    texts = [some_text(rng) for _ in range(40)] + [None, "", " \n\t", "one", "🙂 🙂 🙂"]
    for text, (x, chars) in zip(texts, q.features(texts), strict=True):
        lines = q.lines_of(text)
        assert len(lines) == len(x) and list(chars) == [max(len(line), 1) for line in lines]
        for k, line in enumerate(lines):
            for name, v in plain(line).items():
                assert math.isclose(x[k, q.OWN.index(name)], v, abs_tol=1e-9), (name, line)
            assert x[k, q.OWN.index("again")] == (line in lines[:k])
            for name in q.LENT:
                before, after = (x[j, q.OWN.index(name)] if 0 <= j < len(x) else 0 for j in (k - 1, k + 1))
                at = len(q.OWN) + q.LENT.index(name)
                assert (x[k, at], x[k, at + len(q.LENT)]) == (before, after)


def test_long_lines_are_read_in_stretches(monkeypatch):
    line = "word other, " * 400 + "#"
    whole = q.features([line])[0][0]
    monkeypatch.setattr(q, "STRETCH", 64)
    assert np.allclose(q.features([line, "x"])[0][0], whole)


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(9)
    texts = [some_text(rng) for _ in range(30)]
    field = q.default_field()
    assert q.scores(texts, field) == [q.scores([t], field)[0] for t in texts]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_rows(spark):
    got = q.op11_quality_crf(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 60 and sum(r["predicted"] != r["quality"] for r in rows) <= 0.05 * len(rows)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_odd_inputs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b. " * 200_000, 7), (2, None, 8), (2, "", 9), (2**60 + 1, "Good line.\nBAD!! BAD!! BAD!!", 1), (None, "x", 2), (5, "Same text.", 3), (6, "Same text.", 4)], "doc_id long, text string, line int")
    field = q.learn(docs.limit(0).selectExpr("doc_id id", "text", "line y"))
    assert np.array_equal(field.weights, q.default_field().weights)
    rows = q.score_quality(docs, field).collect()
    assert len(rows) == 7 and {r["line"] for r in rows} == {1, 2, 3, 4, 7, 8, 9} and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["line"]: r for r in rows}
    assert by[3]["score"] == by[4]["score"] and by[8]["score"] == by[9]["score"] and by[1]["doc_id"] == 2**60 + 1
    lines = q.labelled_lines(docs.where("line = 1"), field).orderBy("line").collect()
    assert len(lines) == 2 and lines[0]["good"] > 0.5 > lines[1]["good"]
    docs.where("false").drop("line").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert q.op11_quality_crf(spark, str(tmp_path)).count() == 0
