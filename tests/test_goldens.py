"""Hand-worked examples of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import arrays, numeric
from seqloom.operators import align, curves, group, metrics, models, select, trace
from seqloom.operators import generate

NAN, INF = float("nan"), float("inf")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def near(a, b, tol=1e-9):
    return len(a) == len(b) and all(math.isclose(x, y, abs_tol=tol) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def interval_script(spark, table):
    data = [(1, i, *map(float, r)) for i, r in enumerate(table)]
    return align.parse_interval_script(spark.createDataFrame(data, "bead long, seq int, dt double, pos double, speed double, rot double, rot_speed double"), ["bead"])


def test_interval_scripts(spark):
    got = rows(interval_script(spark, [(5, 2, 1, 0, 0), (10, 6, 0.5, 0, 0), (3, 6, 1, 10, 5)]).orderBy("seq"), "t0", "t1", "mag_pos", "mag_rot")
    assert near(got, [(0, 2, 2, 0), (5, 13, 6, 0), (15, 15, 6, 10)])
    got = rows(interval_script(spark, [(0, 2, 1, 0, 0), (5, 6, 0.5, 0, 0)]).orderBy("seq"), "t0", "t1", "mag_pos", "mag_rot")
    assert near(got, [(0, 2, 2, 0), (5, 13, 6, 0)])


@pytest.fixture
def command_script(spark):
    text = "move magpos 3 speed 0.5; idle 10; move magrot 20 speed 4; idle 2; move magpos 1;; comment"
    return align.parse_command_script(spark.createDataFrame([(1, text)], "bead long, text string"), ["bead"])


def test_command_script(command_script):
    got = rows(command_script.orderBy("seq"), "t0", "t1", "mag_pos", "mag_speed", "mag_rot", "rot_speed")
    assert near(got, [(0, 6, 3, 0.5, 0, 0), (10, 15, 3, 0.5, 20, 4), (15, 17, 1, 1, 20, 4)])


def test_regions_of_a_script(command_script):
    assert near(rows(align.force_regions(command_script, ["bead"], speed=0.5).orderBy("t0"), "t0", "t1"), [(0, 6), (10, 15)])
    assert near(rows(align.rotation_regions(command_script, ["bead"]), "t0", "t1"), [(10, 17)])
    assert near(rows(align.force_regions(command_script, ["bead"], extension_only=True, increasing=False), "t0", "t1"), [(15, 17)])


def test_rotation_region_is_closed_by_the_next_unturned_move(spark):
    data = [(1, i, float(i), i + 0.5, 0.0, 0.3, r, 1.0) for i, r in enumerate([0.0, 5.0, 5.0, 0.0, 0.0, 7.0])]
    script = spark.createDataFrame(data, "bead long, seq int, t0 double, t1 double, mag_pos double, mag_speed double, mag_rot double, rot_speed double")
    assert near(rows(align.rotation_regions(script, ["bead"]).orderBy("t0"), "t0", "t1"), [(1, 3.5), (5, 5.5)])


def test_relative_regions(spark):
    data = [(1, i, float(i), i + 0.5, 0.0, s, 0.0, 1.0) for i, s in enumerate([0.3, 0.1, 0.3, 0.1, 0.1, 0.3])]
    script = spark.createDataFrame(data, "bead long, seq int, t0 double, t1 double, mag_pos double, mag_speed double, mag_rot double, rot_speed double")
    assert near(rows(align.relative_regions(script, ["bead"]).orderBy("t0"), "t0", "t1"), [(0, 3), (5, 5)])


def test_positions_at_times(spark, command_script):
    frames = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((-1, 0, 3, 6, 8, 15, 16, 20))], "bead long, frame int, t double")
    got = rows(align.actuator_at(frames, command_script, ["bead"]).orderBy("frame"), "mag_pos")
    assert near(got, [(0,), (0,), (1.5,), (3,), (3,), (3,), (2,), (1,)])


def test_unknown_equation_is_an_error():
    with pytest.raises(ValueError):
        align.force_of(F.lit(1.0), "other")


def test_energy_with_ties(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 1.0, 4.0), (1, 3, 3.0, 3.0), (1, 4, NAN, 1.0), (1, 5, 9.0, None)], "bead long, frame int, x double, f double")
    assert near(rows(curves.energy_curve(df, ["bead"]).orderBy("rn"), "x", "e"), [(1, 0), (1, 0), (2, 2.5), (3, 4.5)])


def test_array_helpers(spark):
    df = spark.createDataFrame([([0.0, 10.0],)], "z array<double>")
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert one(arrays.resampled(F.col("z"), 5)) == [0.0, 2.5, 5.0, 7.5, 10.0]
    assert one(arrays.edge_padded(F.col("z"), 4)) == [0.0, 10.0, 10.0, 10.0]
    assert one(arrays.normalised(F.col("z"))) == [0.0, 1.0]
    assert one(arrays.slopes(F.col("z"), 2.0)) == [5.0, 5.0]
    long = spark.createDataFrame([(list(map(float, range(10))),), ([1.0, 2.0, 3.0],)], "z array<double>")
    starts = [[s["start"] for s in r["s"]] for r in long.select(arrays.segments(F.col("z"), 4, 3).alias("s")).collect()]
    assert starts == [[0, 3, 6], []]
    assert long.select(arrays.even_subsample(F.col("z"), 4).alias("v")).first()["v"] == [0.0, 3.0, 6.0, 9.0]


def test_dropout_needs_a_whole_run(spark):
    data = [(b, i, float(v)) for b, z in ((1, [1, 1, 1, 1, 1, 1, 2]), (2, [1, 1, 1, 1, 1, 2])) for i, v in enumerate(z)]
    df = spark.createDataFrame(data, "bead long, frame int, z double")
    got = dict(rows(trace.rule_flags(df, ["bead"], n_sigma=100.0, gap_len=5), "bead", "dropout"))
    assert got == {1: True, 2: False}


def test_median_outliers(spark):
    df = spark.createDataFrame([(0, i, 0, d) for i, d in enumerate((1.0, 1.0, 2.0, 3.0, 100.0))], "g int, id int, label int, dist double")
    assert [r["label"] for r in curves.median_outliers(df, ["g"], 3.0).orderBy("id").collect()] == [0, 0, 0, 0, -1]
    assert curves.median_outliers(df, ["g"], None) is df


def test_good_cluster(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 1), (0, 1), (1, -1)], "y int, p int")
    assert rows(metrics.good_cluster(df), "cluster", "accuracy") == [(0, 0.8)]
    assert sorted(rows(metrics.good_cluster_predictions(df), "p", "predicted")) == [(-1, 0), (0, 1), (0, 1), (1, 0), (1, 0)]


def test_votes(spark):
    data = [(1, v) for v in (1, 0, 1, 0)] + [(2, v) for v in (0, 1, 2, 1)] + [(3, 1)]
    got = dict(rows(metrics.votes(spark.createDataFrame(data, "bead long, p int"), ["bead"], 4), "bead", "vote"))
    assert got == {1: 1, 2: 1}
    three = spark.createDataFrame([(1, v) for v in (0, 1, 2)], "bead long, p int")
    assert dict(rows(metrics.votes(three, ["bead"], 3), "bead", "vote")) == {1: 0}


def test_segment_votes(spark):
    p = spark.createDataFrame([(0, 1), (0, 0)], "bead long, p int")
    everyone = spark.createDataFrame([(0,), (1,)], "bead long")
    assert sorted(rows(metrics.majority(p, ["bead"], everyone), "bead", "vote")) == [(0, 0), (1, 0)]
    assert sorted(rows(metrics.sum_vote(p, ["bead"], everyone), "bead", "vote")) == [(0, 1), (1, 0)]


def test_merged_replicates_round_half_even(spark):
    df = spark.createDataFrame([("m", "p", 0.8, 8.0, "a", 1), ("m", "p", 0.9, 9.0, "b", 2)], "method string, path string, accuracy double, correct double, source string, k int")
    assert rows(metrics.merged_replicates(df, ["method", "path"], "k"), "accuracy", "correct", "source") == [("0.850000", 8, "a")]


def test_fillers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, NAN, 3.0, INF))], "bead long, frame int, z double")
    assert rows(trace.filled(df, ["bead"]).orderBy("frame"), "z") == [(1,), (2,), (3,), (0,)]
    assert rows(trace.filled(df, ["bead"], inf_to_mean=True).orderBy("frame"), "z") == [(1,), (2,), (3,), (2,)]


def test_gap_interpolation_extrapolates(spark):
    data = [(1, i, float(i), v) for i, v in enumerate((NAN, 1.0, NAN, 3.0, 4.0, NAN))] + [(2, 0, 0.0, NAN), (2, 1, 1.0, 7.0), (3, 0, 0.0, NAN)]
    got = trace.gaps_interpolated(spark.createDataFrame(data, "bead long, frame int, t double, z double"), ["bead"]).orderBy("bead", "frame")
    assert near(rows(got, "z"), [(0,), (1,), (2,), (3,), (4,), (5,), (7,), (7,), (0,)])


@pytest.mark.parametrize("y, p, ari, nmi", [([0, 0, 1, 1], [1, 1, 0, 0], 1.0, 1.0), ([0, 0, 0], [0, 0, 0], 1.0, 1.0), ([0, 0, 1, 1], [0, 0, 0, 0], 0.0, 0.0), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, 0.0)])
def test_agreement(spark, y, p, ari, nmi):
    got = metrics.agreement(spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p int")).first()
    assert math.isclose(got["ari"], ari, abs_tol=1e-9) and math.isclose(got["nmi"], nmi, abs_tol=1e-9)


def test_binary_metrics_of_one_class(spark):
    r = metrics.binary_metrics(spark.createDataFrame([(1, 1), (1, 0)], "y int, p int"), []).first()
    assert (r["accuracy"], r["balanced_accuracy"], r["mcc"]) == (0.5, 0.5, 0.0)


def test_numeric_algorithms_on_two_blobs():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.3, (25, 4)), rng.normal(5, 0.3, (25, 4))])
    truth = np.repeat([0, 1], 25)
    for method in ("kmeans", "gmm", "hierarchical", "dbscan", "hdbscan", "spectral"):
        labels = numeric.cluster(x, method, max_k=3, min_samples=4)
        if method == "gmm":
            labels = numeric.gmm(x, 2)[0]
        main = [np.bincount(labels[(truth == c) & (labels >= 0)]).argmax() for c in (0, 1)]
        assert main[0] != main[1], method
        assert np.mean(labels == np.array(main)[truth]) > 0.85, method
    for method in ("fpca", "isomap", "lle", "laplacian", "tsne", "umap", "dtw_mds"):
        y = numeric.reduce_dimensions(x, method, 2)
        assert y.shape[0] == 50 and np.isfinite(y).all(), method
    assert numeric.silhouette(numeric.distances(x), truth) > 0.8


def test_dtw_and_spanning():
    assert numeric.dtw([0, 1, 2, 3], [0, 0, 1, 2, 3]) == 0.0
    assert numeric.dtw([0, 0], [1, 1]) == 2.0
    x = np.array([[0.0, 1, 2], [0, 1, 2], [5, 5, 5]])
    d = numeric.dtw_distances(x)
    assert d[0, 1] == 0 and d[0, 2] == d[2, 0] == 12.0


def test_density_clusters_equal_the_dense_version(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.2, (20, 2)), rng.normal(3, 0.2, (20, 2)), rng.uniform(-5, 8, (10, 2))])
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, v array<double>")
    got = dict(rows(group.density_clusters(group.within_reach(df, ["g"], "id", 0.5), df, 4), "id", "label"))
    want = numeric.dbscan(numeric.distances(x), 4, 0.5)
    assert {i for i in got if got[i] < 0} == set(np.flatnonzero(want < 0).tolist())
    pairs = {(got[i], int(want[i])) for i in got if got[i] >= 0}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_ridge_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = (x @ [2.0, -1.0, 0.5, 0, 0] > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "features array<double>, label int")
    w, b, alpha = models.ridge(df)
    told = models.ridge_predict(df, w, b)
    assert told.where("label = p").count() > 185 and alpha > 0
    w2, b2, _ = numeric.ridge_classifier(x, y, [alpha])
    assert np.allclose(w, w2) and math.isclose(b, b2, abs_tol=1e-9)


def long_traces(spark, traces=40, samples=4000):
    """Straight lines with noise, one sample every 0.05 s; text keys."""
    rows = spark.range(traces * samples).select(F.concat(F.lit("trace "), (F.col("id") / samples).cast("int").cast("string")).alias("name"), (F.col("id") % samples).alias("frame"))
    rows = rows.withColumn("t", F.col("frame") * 0.05).withColumn("clean", F.col("frame") * 0.5)
    return rows.withColumn("z", F.col("clean") + 10.0 * generate.gaussian("name", "frame", seed=7))


def by_trace(df, *columns):
    pdf = df.toPandas().sort_values(["name", "frame"])
    return {name: {c: g[c].to_numpy() for c in columns} for name, g in pdf.groupby("name")}


def test_generation_depends_on_seed_and_keys_only(spark):
    rows = spark.range(600).select((F.col("id") % 20).alias("name"), F.col("id").alias("k"))
    a, b = (by_trace(generate.simulated(r, ["name"], "k"), "t", "clean", "z") for r in (rows.repartition(3), rows.orderBy(F.desc("id")).repartition(7, "k")))
    assert a.keys() == b.keys() and all(np.array_equal(a[n]["z"], b[n]["z"]) for n in a)
    assert all(np.allclose(np.diff(v["t"]), 0.05) and abs((v["z"] - v["clean"]).std() - 10) < 2 for v in a.values())
    only = by_trace(generate.simulated(rows, ["name"], "k", weights=generate.usable_weights(include=["activity_up_fast"])), "clean")
    slopes = np.concatenate([np.diff(v["clean"]) / 0.05 for v in only.values()])
    assert ((slopes > -1e-6) & (slopes < 70.001)).all() and (slopes > 39.999).mean() > 0.9
    assert "jump_back" not in generate.usable_weights(exclude=["jump_back"]) and abs(sum(generate.usable_weights().values()) - 1.005) < 1e-9


def test_corruptions_keep_to_their_ranges(spark):
    rows = long_traces(spark)
    plain = by_trace(rows, "t", "clean", "z")
    for kind in generate.CORRUPTIONS:
        got = by_trace(generate.corrupted(rows.withColumn("kind", F.lit(kind)), ["name"], gaps=(1.0, 8.0)), "t", "clean", "z")
        assert got.keys() == plain.keys()
        for name, v in got.items():
            p = plain[name]
            t, clean, z = v["t"], v["clean"], v["z"]
            if kind == "lost_bead":
                k = int(np.isnan(clean).argmax())
                lo, hi = p["z"][:k].min(), p["z"][:k].max()
                margin = max(4 * (hi - lo), 2000)
                assert 0.2 <= t[k] / t[-1] <= 0.81 and np.array_equal(z[:k], p["z"][:k]) and z[k:].min() >= lo - margin and z[k:].max() <= hi + margin and z[k:].max() - z[k:].min() > 1.5 * margin
            elif kind == "missing_regions":
                assert np.array_equal(np.isnan(clean), np.isnan(z)) and 0.9 <= np.isnan(z).sum() * 0.05 <= 24.3
            elif kind == "high_noise":
                assert 1.4 < (z - p["z"]).std() / (p["z"] - p["clean"]).std() < 4.2
            elif kind == "inconsistent_noise":
                assert np.array_equal(clean, p["clean"]) and (z - clean).std() < 30
            else:
                rate = (clean - p["clean"])[1:] / t[1:]
                assert np.allclose(rate, rate[0]) and 0.3 <= rate[0] <= 3.0 and 3.7 < (z - clean).std() / (p["z"] - p["clean"]).std() < 7.4
    same = by_trace(generate.corrupted(rows.withColumn("kind", F.lit(None).cast("string")), ["name"]), "z")
    assert all(np.array_equal(same[n]["z"], plain[n]["z"]) for n in plain)


def test_pieces_and_their_corrupted_share(spark):
    cut = generate.pieces(long_traces(spark, 3), ["name"], 20.0)
    made = generate.corrupted_share(cut, ["name", "piece"], ["name"], usable_ratio=0.7)
    pieces = made.groupBy("name", "piece", "label", "bad_feature").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
    assert len(pieces) == 30 and all(r["a"] == 0 and r["b"] <= 20.0 for r in pieces)
    assert sum(1 - r["label"] for r in pieces) == 9 and all((r["bad_feature"] is None) == (r["label"] == 1) for r in pieces)


def test_augmentation_keeps_to_its_ranges(spark):
    rows = long_traces(spark, 60, 1000).withColumn("label", F.lit(1)).drop("clean")
    plain = by_trace(rows, "z")
    made = generate.augmented(rows, ["name"], corrupt_share=0.8).toPandas().sort_values(["name", "frame"])
    kinds = set()
    for name, g in made.groupby("name"):
        z, p, kind = g["z"].to_numpy(), plain[name]["z"], g["change"].iloc[0]
        kinds.add(kind)
        assert len(z) == 1000 and set(g["label"]) == {int(kind == "mild")}
        runs = np.diff(np.flatnonzero(np.diff(np.concatenate([[1], np.diff(z) == 0, [1]]))))
        if kind == "mild":
            assert np.corrcoef(z, p)[0, 1] > 0.98 and 0.8 < z.std() / p.std() < 1.25
        elif kind in ("dropout", "flat_region"):
            assert runs.max() >= 15
        elif kind == "spike":
            assert np.abs(np.diff(z)).max() > 3 * p.std()
        elif kind == "lost_tail":
            assert z.max() - z.min() > 1.5 * (p.max() - p.min())
    assert kinds == {"mild", *generate.SPOILS}
    short = spark.createDataFrame([("a", 0, float("nan"), 1), ("a", 1, 2.0, 1), (None, 0, float("inf"), 0)], "name string, frame long, z double, label int")
    got = generate.augmented(short, ["name"], corrupt_share=1.0).collect()
    assert len(got) == 3 and {r["change"] for r in got} == {"mild"} and {r["label"] for r in got} == {0} and all(np.isfinite(r["z"]) for r in got)


def test_stratified_takes_exact_shares(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 9 else i % 2) for i in range(1000)], "id long, y int")
    got = {(r["y"], r["fold"]): r["count"] for r in select.stratified(df, "y", 0.25, "id", bins=8).groupBy("y", "fold").count().collect()}
    assert got == {(0, "test"): 125, (0, "train"): 375, (1, "test"): 100, (1, "train"): 300, (None, "test"): 25, (None, "train"): 75}
    assert sorted(r["__i"] for r in select.numbered(df, "id").collect()) == list(range(1000))


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 6}") for i in range(60)], "id long, g string")
    folds = select.split_groups(df, "g", 0.8).select("g", "fold").distinct().collect()
    assert len(folds) == 6 and {r["fold"] for r in folds} == {"train", "test"}
    align.check_disjoint(df.where("id < 10"), df.where("id >= 10"), "id")
    with pytest.raises(ValueError):
        align.check_disjoint(df, df, "id")


def test_jobs_keep_going_after_an_error(spark):
    df = spark.createDataFrame([(g, i, [float(i), float(g * i)]) for g in range(2) for i in range(8)], "g int, id int, v array<double>")
    out = group.clustered(df, ["g"], "id", "no_such_method").collect()
    assert len(out) == 16 and all(r["label"] == -1 and "no_such_method" in r["error"] for r in out)
