"""Steps whose cost must grow no faster than their input, and results that must not hang on rounding or size."""

import tracemalloc

import numpy as np
import pytest

from seqloom.functions import numeric
from seqloom.operators import metrics, trace, traceml


def spots(n, columns=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, columns)) + 4.0 * rng.integers(0, 3, n)[:, None]


@pytest.mark.parametrize("seed", range(6))
def test_ward_by_chains_equals_the_greedy_merges(seed):
    x = spots(90 + seed, seed=seed)
    if seed % 2:
        x = np.repeat(x, 2, axis=0)
    merges = numeric.ward_merges(x)
    for k in (2, 3, 5):
        assert (numeric.cut(merges, len(x), k) == numeric.agglomerative(numeric.distances(x), k)).all()


@pytest.mark.parametrize("method,options", [("hierarchical", {"n_clusters": 2}), ("kmeans", {"n_clusters": 2}), ("kmeans", {"max_k": 3}), ("dbscan", {"min_samples": 3})])
def test_clusterings_hold_no_matrix_of_all_pairs(method, options):
    x = spots(5000)
    tracemalloc.start()
    labels = numeric.cluster(x, method, outlier_z=3.0, **options)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 5000 and peak < 5000 * 5000 * 8  # one matrix; they held several


def test_block_forms_equal_those_on_matrices():
    x = np.repeat(spots(120), 2, axis=0)
    d = numeric.distances(x)
    labels = numeric.agglomerative(d, 3)
    assert np.isclose(numeric.silhouette_of(x, labels), numeric.silhouette(d, labels))
    assert (numeric.dbscan_of(x, 4) == numeric.dbscan(d, 4)).all()
    assert (numeric.nearest(spots(120), 5) == numeric.neighbours(numeric.distances(spots(120)), 5)).all()


def test_copies_of_points_are_met_once(monkeypatch):
    x = np.repeat(spots(100), 50, axis=0)[np.random.default_rng(1).permutation(5000)]
    formed, sqrt = [0], np.sqrt

    def counted(a, *more, **options):
        formed[0] += np.size(a)
        return sqrt(a, *more, **options)

    monkeypatch.setattr(numeric.np, "sqrt", counted)
    near, labels = numeric.nearest(x, 5), numeric.dbscan_of(x, 4, 1.0)
    s = numeric.silhouette_of(x, labels % 3)
    assert formed[0] < 5000 * 5000 / 2  # of 5 times 5000 * 5000
    monkeypatch.undo()
    d = sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert (near == numeric.neighbours(d, 5)).all() and (labels == numeric.dbscan(d, 4, 1.0)).all() and np.isclose(s, numeric.silhouette(d, labels % 3))


@pytest.mark.parametrize("seed", range(4))
def test_density_clusters_by_strips_equal_those_on_a_matrix(seed):
    rng = np.random.default_rng(seed)
    x = spots(250, 1 + seed, seed)
    x = np.concatenate([np.round(x, 1), x[rng.integers(0, 250, 60)]])
    for eps in (None, 0.3):
        assert (numeric.dbscan_of(x, 4, eps) == numeric.dbscan(sqrt_distances(x), 4, eps)).all()


def sqrt_distances(x):
    return np.sqrt(sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1])))


def test_curves_of_several_forms_are_made_once(spark, monkeypatch):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from seqloom.plans import jobs

    rows = spark.range(60).select((F.col("id") % 6).alias("bead"), F.lit(0).alias("g"), (F.col("id") / 6).cast("long").alias("frame"), F.row_number().over(W.partitionBy(F.col("id") % 6).orderBy("id")).cast("double").alias("x"), (F.col("id") * 1.0).alias("f"))
    plans = []
    monkeypatch.setattr(jobs, "features", lambda r, *a, _own=jobs.features: plans.append(r._jdf.queryExecution().optimizedPlan().toString()) or _own(r, *a))
    chosen = [jobs.Pipeline("a", "percentile_grid", n_grid=5), jobs.Pipeline("b", "force_percentile_grid", n_grid=5)]
    assert jobs.labelled(rows, ["g", "bead"], chosen, measured=False).count() == 12
    assert len(plans) == 2 and not any("Window" in p for p in plans)


def test_means_halfway_between_two_texts_do_not_hang_on_the_order_of_rows(spark):
    # 0.99 / 32 = 0.0309375 and 0.98 / 64 = 0.0153125, which sums of doubles miss on either side
    rows = []
    for key in range(60):
        n, hundredths = (32, 99) if key % 2 else (64, 98)
        parts = [hundredths // n] * n
        for i in range(hundredths % n):
            parts[i] += 1
        rng = np.random.default_rng(key)
        moved = rng.permutation(n)
        for a, b in zip(moved[::2], moved[1::2], strict=True):
            shift = int(rng.integers(0, 6))
            parts[a], parts[b] = parts[a] + shift, parts[b] - shift
        rows += [(key, i, p / 100.0, 1.0) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "k int, i int, accuracy double, correct double").repartition(16)
    got = {r["k"]: r["accuracy"] for r in metrics.merged_replicates(df, ["k"], "i").collect()}
    assert {got[k] for k in got if k % 2} == {"0.030938"} and {got[k] for k in got if not k % 2} == {"0.015313"}


def test_means_of_values_that_are_no_decimals(spark):
    df = spark.createDataFrame([(1, 1, float("nan"), 1.0), (1, 2, 0.5, 2.0), (2, 1, None, 1.0)], "k int, i int, accuracy double, correct double")
    assert {r["k"]: r["accuracy"] for r in metrics.merged_replicates(df, ["k"], "i").collect()} == {1: "NaN", 2: None}


def test_steps_at_the_bound_are_no_spikes_whatever_the_order(spark):
    # eight steps of one unit among fifty: the deviation is 0.4 units, and 2.5 deviations are one unit exactly
    rows = []
    for bead in range(200):
        rng = np.random.default_rng(bead)
        steps = np.zeros(50)
        steps[rng.choice(50, 8, replace=False)] = 100.0 * rng.permutation([1, -1] * 4)
        rows += [(bead, i, float(z)) for i, z in enumerate(np.concatenate([[0.0], np.cumsum(steps)]))]
    df = spark.createDataFrame(rows, "bead int, frame int, z double").repartition(16)
    got = trace.rule_flags(df, ["bead"], n_sigma=2.5, gap_len=100)
    assert got.where("spike").count() == 0 and got.count() == 200
    assert trace.rule_flags(df, ["bead"], n_sigma=2.4999, gap_len=100).where("spike").count() == 200
    assert trace.rule_flags(df.where("bead = 0"), ["bead"], n_sigma=2.5, gap_len=1).first()["dropout"]


def test_split_points_are_exact_for_any_number_of_values(spark):
    # more values than the sketch kept apart, in odd proportions, with many equal ones
    df = spark.range(1_200_001).selectExpr("id % 2 AS g", "cast((id * 7919 % 1200001) * (id % 3) AS double) AS x")
    got = {r["g"]: list(r["q"]) for r in traceml.split_points(df, ["g"], "x", 4).collect()}
    for g, part in df.toPandas().groupby("g"):
        ordered, n = np.sort(part["x"].to_numpy()), len(part)
        assert got[g] == [float(ordered[-(-i * n // 4) - 1]) for i in (1, 2, 3)]


def test_kernel_shares_of_many_kernels_equal_those_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    calls = []
    monkeypatch.setattr(traceml, "responses", lambda *a, _own=traceml.responses: calls.append(a) or _own(*a))
    for length in (1, 7, 40, 333):
        z, own = rng.normal(size=length).round(1), rng.normal(size=(84, 3)).round(1)
        for number, dilation in enumerate((1, 2, 9)):
            one = [(r[:, None] > own[k]).mean(axis=0).tolist() for k, r in enumerate(traceml.responses(z, dilation, number))]
            for entries in (10, 2_000_000):
                assert traceml.shares_above(z, dilation, number, own, entries).tolist() == one
    calls.clear()
    traceml.MiniRocketModel()._set(dilations=[1, 2], shares=[1, 1], biases=[0.0] * 168).one()(rng.normal(size=50))
    assert not calls  # a model forms no response kernel by kernel


def test_a_text_is_judged_without_moving_its_words(spark, tmp_path):
    from pyspark.sql import functions as F

    from jobs import text_traces

    rng = np.random.default_rng(5)
    texts = [" ".join("x" * int(k) for k in rng.integers(1, 5 + i % 30, rng.integers(1, 60))) for i in range(150)]
    texts += ["", " \t ", "one", "aa bb", "a a a a a a a a", "a a a a a a a bbb", "x" * 90 + " a b c d e f g h"]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)] + [(900, "s", None)], "doc_id long, source string, text string")
    found = text_traces.beads_of(docs, text_traces.OPTIONS)
    rules = {k: text_traces.OPTIONS[k] for k in ("variance_thresh", "n_sigma", "gap_len", "flat_tol")}
    long = trace.word_lengths(docs, ["doc_id"])
    want = {r["doc_id"]: tuple(r[c] for c in (*text_traces.RULES, "usable")) for r in trace.rule_flags(long, ["doc_id"], **rules).collect()}
    got = {r["doc_id"]: tuple(r[c] for c in (*text_traces.RULES, "usable")) for r in found.where("samples > 0").collect()}
    assert got == want and len(want) > 150
    assert found.where("samples = 0 AND usable = 0").count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


@pytest.mark.parametrize("seed", (0, 1, 3))  # planes without closed parts
def test_locally_linear_embedding_by_elimination_equals_the_dense_one(seed):
    x = np.random.default_rng(seed).uniform(size=(300, 2))  # one part: the directions are unique but for their signs
    assert np.allclose(np.abs((numeric.lle(x, 3, dense=300) * numeric.lle(x, 3, dense=0)).sum(axis=0)), 1.0, atol=1e-4)
    x = spots(300, seed=seed)  # several parts: directions without error are free against each other, the errors are not
    near, w = numeric.neighbour_weights(x, 5)
    a = np.eye(300)
    a[np.arange(300)[:, None], near] -= w
    got = numeric.lle(x, 8, dense=0)
    assert np.allclose(got.T @ got, np.eye(8), atol=1e-8) and np.allclose(got.sum(axis=0), 0.0, atol=1e-6)
    assert np.allclose(np.linalg.norm(a @ got, axis=0) ** 2, np.linalg.eigvalsh(a.T @ a)[1:9], rtol=1e-6, atol=1e-12)


def test_locally_linear_embedding_of_copies_follows_the_points():
    x = spots(150)
    copies = np.repeat(x, 8, axis=0)
    got = numeric.lle(copies, 2)
    assert np.allclose(got.reshape(150, 8, 2), got[::8][:, None], atol=1e-8)
    want = numeric.pca(x, 2)
    assert np.allclose(np.abs((got[::8] * want).sum(axis=0)) * 8**0.5, np.linalg.norm(want, axis=0), atol=1e-6)
    same = numeric.lle(np.ones((1100, 3)), 2)
    assert np.allclose(same.T @ same, np.eye(2)) and np.isfinite(same).all()


@pytest.mark.parametrize("copies", (1, 20))
def test_locally_linear_embedding_holds_no_matrix_of_all_pairs(copies):
    x = np.repeat(spots(5000 // copies, 2), copies, axis=0)
    tracemalloc.start()
    y = numeric.reduce_dimensions(x, "lle", 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert y.shape == (5000, 2) and np.isfinite(y).all() and peak < 5000 * 5000 * 8  # one matrix; four were held
