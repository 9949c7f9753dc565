"""Whole-trace models: plain versions of kernels, coefficients and words, persistence, runs."""

import cmath
import itertools
import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from seqloom.operators import traceml as tm

ROOT = Path(__file__).resolve().parent.parent


def traces(spark, n=80, seed=3, length=80):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = length + i % 5
        z = np.sin(np.arange(m) * (0.4 if i % 2 else 0.9) + rng.uniform(0, 6)) + rng.normal(size=m) * 0.3
        rows.append((i, z.tolist(), i % 2))
    return spark.createDataFrame(rows, "id long, z array<double>, label int")


def plain_share(z, places, dilation, padded, bias):
    """Share of positions whose weighted sum exceeds the bias; beyond the ends are zeros."""
    weights = [2 if j in places else -1 for j in range(9)]
    at = range(len(z)) if padded or len(z) <= 8 * dilation else range(4 * dilation, len(z) - 4 * dilation)
    sums = [sum(w * (z[p + (j - 4) * dilation] if 0 <= p + (j - 4) * dilation < len(z) else 0) for j, w in enumerate(weights)) for p in at]
    return sum(s > bias for s in sums) / len(sums)


def test_minirocket_against_a_plain_version(spark):
    df = traces(spark, 12, length=40)
    model = tm.MiniRocket(numFeatures=84 * 5, sampleRows=4).fit(df)
    dilations, shares, biases = (model.getOrDefault(p) for p in ("dilations", "shares", "biases"))
    assert dilations[0] == 1 and dilations == sorted(set(dilations)) and sum(shares) == 5 and len(biases) == 420 and max(dilations) * 8 <= 41
    kernels = list(itertools.combinations(range(9), 3))
    for r in model.transform(df).where("id in (1, 4)").collect():
        at = 0
        for d, (dilation, n) in enumerate(zip(dilations, shares, strict=True)):
            for k, places in enumerate(kernels):
                for _ in range(n):
                    want = plain_share(r["z"], places, dilation, (k + d) % 2 == 0, biases[at])
                    assert math.isclose(r["features"][at], want, abs_tol=1.5 / len(r["z"])), (dilation, places)
                    at += 1
        assert at == 420
    odd = spark.createDataFrame([(1, []), (2, None), (3, [1.0]), (4, [float("nan"), None, 2.0])], "id long, z array<double>")
    assert all(len(r["features"]) == 420 and np.isfinite(r["features"]).all() for r in model.transform(odd).collect())


def plain_words(z, sizes, values, letters, normed, reduced, pairs, edges):
    out, at = Counter(), 0
    for size in sizes:
        own = [edges[at + k * (letters - 1) : at + (k + 1) * (letters - 1)] for k in range(values)]
        at += values * (letters - 1)
        names = []
        for s in range(len(z) - size + 1):
            w = z[s : s + size]
            if normed:
                m = sum(w) / size
                sd = math.sqrt(sum((x - m) ** 2 for x in w) / size)
                w = [(x - m) / (sd if sd > 1e-12 else 1) for x in w]
            v = []
            for k in range(1, values // 2 + 1):
                c = sum(x * cmath.exp(-2j * math.pi * k * t / size) for t, x in enumerate(w))
                v += [round(c.real, 9), round(c.imag, 9)]
            names.append("".join(str(sum(x > e for e in own[k])) for k, x in enumerate(v)))
        for s, name in enumerate(names):
            if reduced and s and names[s - 1] == name:
                continue
            out[f"{size}:{name}"] += 1
            if pairs and s >= size:
                out[f"{size}:{names[s - size]}+{name}"] += 1
    return out


@pytest.mark.parametrize(("normed", "reduced", "pairs"), [(False, False, True), (True, True, False)])
def test_symbolic_words_against_a_plain_version(spark, normed, reduced, pairs):
    df = traces(spark, 30, length=40)
    words = tm.SymbolicWords(windows=[8, 12], normed=normed, reduced=reduced, pairs=pairs, mostWords=60)
    edges = words.learned_edges(df)
    first = sorted(sum(x * math.cos(2 * math.pi * t / 8) for t, x in enumerate(r["z"][s : s + 8])) for r in df.collect() for s in range(len(r["z"]) - 7))
    if not normed:  # equally deep bins over all windows
        assert np.allclose(edges[:3], [first[math.ceil(q * len(first)) - 1] for q in (0.25, 0.5, 0.75)], atol=1e-6)
    got = {}
    for r in words.counts(df, ["id"], edges).collect():
        got.setdefault(r["id"], Counter())[r["word"]] = r["n"]
    want = {r["id"]: plain_words(r["z"], [8, 12], 4, 4, normed, reduced, pairs, edges) for r in df.collect()}
    same = sum(sum((got[i] & want[i]).values()) for i in want) / sum(sum(c.values()) for c in want.values())
    assert same > 0.999 and all(sum(got[i].values()) == sum(want[i].values()) or reduced for i in want)
    model = words.fit(df)
    chosen = model.getOrDefault("chosen")
    by_class = {y: Counter() for y in (0, 1)}
    for r in df.collect():
        by_class[r["label"]] += got[r["id"]]
    totals = {y: sum(c.values()) for y, c in by_class.items()}
    whole = sum(totals.values())

    def chi2(w):
        n = sum(c[w] for c in by_class.values())
        return sum((c[w] - n * totals[y] / whole) ** 2 / (n * totals[y] / whole) for y, c in by_class.items())

    every = sorted({w for c in by_class.values() for w in c}, key=lambda w: (-round(chi2(w), 6), w))
    assert len(chosen) == 60 and min(chi2(w) for w in chosen) >= chi2(every[60]) - 1e-6
    row = model.transform(df).where("id = 3").first()
    assert row["features"] == [float(got[3][w]) for w in chosen]


@pytest.mark.parametrize("name", sorted(tm.STAGES))
def test_pipelines_tell_classes_apart_and_survive_saving(spark, name, tmp_path):
    df = traces(spark)
    model = tm.trace_pipeline(name, {"minirocket": 420, "weasel": 100, "boss": 100}.get(name)).fit(df.where("id < 60"))
    told = {r["id"]: r["p"] for r in model.transform(df.where("id >= 60")).collect()}
    assert sum(p == i % 2 for i, p in told.items()) >= 18
    run = tm.save_run(model, str(tmp_path))
    again = tm.load_run(spark, str(tmp_path))
    assert tm.latest_run(spark, str(tmp_path)) == run and isinstance(again, PipelineModel)
    assert {r["id"]: r["p"] for r in again.transform(df.where("id >= 60")).collect()} == told


def test_the_latest_run_in_a_new_session(spark, tmp_path):
    df = traces(spark)
    assert tm.latest_run(spark, str(tmp_path)) is None
    with pytest.raises(ValueError, match="no run"):
        tm.load_run(spark, str(tmp_path))
    tm.save_run(tm.trace_pipeline("boss", 40).fit(df), str(tmp_path), "first")
    model = tm.trace_pipeline("minirocket", 168).fit(df)
    tm.save_run(model, str(tmp_path), "second")
    assert tm.latest_run(spark, str(tmp_path)) == "second" and tm.load_run(spark, str(tmp_path), "first").stages[0].getOrDefault("normed") is True
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".LATEST-")]
    df.write.parquet(f"{tmp_path}/traces")
    want = sorted((r["id"], r["p"]) for r in model.transform(df).collect())
    code = (
        "import sys; from pyspark.sql import SparkSession; from seqloom.operators import traceml as tm; from seqloom.runtime import ship\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); ship(s)\n"
        "print(sorted((r['id'], r['p']) for r in tm.load_run(s, sys.argv[1]).transform(s.read.parquet(sys.argv[1] + '/traces')).collect()))"
    )
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0 and done.stdout.strip() == str(want), done.stderr[-2000:]


def test_ridge_ignores_the_scale_of_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.1 * x[:, 1] > 0).astype(int)
    rows = [([float(a), float(b) * 1e6, 7.0], int(t)) for (a, b, _), t in zip(x, y, strict=True)] + [([0.0, 0.0, 7.0], None)]
    model = tm.Ridge().fit(spark.createDataFrame(rows, "features array<double>, label int"))
    u = (x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0)
    t = 2.0 * y - 1
    want = np.linalg.solve(u.T @ u + np.eye(2), u.T @ (t - t.mean())) / x[:, :2].std(axis=0) / [1, 1e6]
    assert np.allclose(model.getOrDefault("weights")[:2], want, rtol=1e-6) and model.getOrDefault("weights")[2] == 0


def test_votes_of_segments(spark):
    told = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 1), ("b", 0), ("c", 0)], "bead string, p int")
    got = {r["bead"]: (r["majority"], r["sum_vote"]) for r in tm.beads_of(told, ["bead"]).collect()}
    assert got == {"a": (1, 1), "b": (0, 1), "c": (0, 0)}
