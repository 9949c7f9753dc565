"""Models of whole traces, and the tuner."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import models, select
from seqloom.plans import jobs


def traces(spark):
    rng = np.random.default_rng(3)
    z = [(np.linspace(0, 4 * (i % 2), 60 + i % 5) + rng.normal(size=60 + i % 5) * 0.3).tolist() for i in range(60)]
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(z)], "id long, z array<double>, label int")


@pytest.mark.parametrize("name", models.TRACE_MODELS)
def test_trace_models_tell_classes_apart(spark, name):
    df = traces(spark)
    told = models.fit_traces(df.where("id < 40"), ["id"], name, n_features={"minirocket": 168, "boss": 60, "weasel": 60}.get(name, 12))(df.where("id >= 40"))
    assert told.count() == 20 and told.where("p = label").count() >= 19


def test_names_without_a_counterpart_are_listed(spark):
    names = {r["name"]: r["available"] for r in models.available(spark).collect()}
    assert {n for n in names if not names[n]} == {"hivecotev1", "hivecotev2", "custom"}
    assert all(names[n] for n in models.TRACE_MODELS)


def test_tuner_runs_every_combination(spark):
    rng = np.random.default_rng(1)
    curve = [("e", b, i, float(i), (1 + 9 * (b % 2)) * i + rng.normal() * 0.01) for b in range(8) for i in range(30)]
    rows = spark.createDataFrame(curve, "experiment string, bead long, frame long, x double, f double")
    truth = rows.select("experiment", "bead").distinct().withColumn("y", (F.col("bead") % 2).cast("int"))
    grid = [{"n_grid": 10, "n_clusters": 2}, {"n_grid": 20, "n_clusters": 2}]
    assert jobs.drawn({"n_grid": [10, 20]}, 5) == jobs.drawn({"n_grid": [10, 20]}, 5)
    runs, summary = jobs.tuned(rows, truth, ["experiment", "bead"], [(jobs.PRESETS["partitioned_kmeans"], grid)])
    assert {r["pipeline"] for r in runs.collect()} == {"partitioned_kmeans#0", "partitioned_kmeans#1"}
    best = summary.first()
    assert best["n_ok"] == 2 and best["n_failed"] == 0 and best["max_score"] >= best["mean_score"] >= best["min_score"]


def test_ensembles_vote_and_options_count(spark):
    from seqloom.plans import jobs

    rng = np.random.default_rng(5)
    rows, truth = [], []
    for e in range(2):
        for b in range(10):
            scale = 1.0 if b % 2 else 4.0
            rows += [(e, b, k, float(x), float(scale * x * x + rng.normal(0, 0.01))) for k, x in enumerate(np.linspace(0, 1, 40))]
            truth.append((e, b, b % 2))
    curves = spark.createDataFrame(rows, "experiment int, bead int, frame int, x double, f double")
    known = spark.createDataFrame(truth, "experiment int, bead int, y int")
    keys = ["experiment", "bead"]
    entries = [
        {"name": "plain", "representation": "percentile_grid", "n_clusters": 2, "min_cluster_size": 1, "n_init": 20, "n_grid": 11},
        {"name": "one", "representation": "percentile_grid", "n_clusters": 1, "min_cluster_size": 1, "outlier_z": None, "n_grid": 11},
        {"name": "z", "representation": "common_grid_intersection", "n_clusters": 2, "z_thresh": 0.1, "n_grid": 11},
        {"name": "vote", "ensemble_pipelines": ["plain", "one", "plain_too"]},
        {"name": "plain_too", "representation": "force_percentile_grid", "n_clusters": 2, "min_cluster_size": 1, "n_grid": 11},
    ]
    pipelines = [jobs.pipeline_from(x) for x in entries]
    assert pipelines[0].n_init == 20 and pipelines[2].z_thresh == 0.1 and not any(p.extra for p in pipelines)
    got = {(r["pipeline"], r["experiment"]): r for r in jobs.evaluate(curves, known, keys, pipelines).collect()}
    assert len(got) == 10 and got["plain", 0]["accuracy"] == 1.0 and got["one", 0]["accuracy"] == 0.5
    # two of three members say good where the bead is good; where it isn't, only "one" may
    assert got["vote", 0]["accuracy"] == got["vote", 1]["accuracy"] == 1.0
    told = jobs.predicted(curves, known, keys, pipelines)
    per = {r["pipeline"]: r for r in jobs.result_rows(told.withColumn("ext", F.lit(0)), ["experiment"], "ext").where("experiment = 0").collect()}
    assert per["plain"]["ari"] == per["vote"]["nmi"] == 1.0 and per["plain"]["cluster_counts"] == "5,5" and per["plain"]["silhouette"] > 0.5 and per["vote"]["silhouette"] is None
    names = spark.createDataFrame([(e, f"/d/{e}", f"{e}", f"x{e}", "s") for e in range(2)], "experiment int, path string, rel_path string, experiment_id string, source string")
    table = jobs.result_table(jobs.result_rows(told.withColumn("ext", F.lit(0)), ["experiment"], "ext"), pipelines, names, ["experiment"])
    assert table.columns == ["pipeline", *jobs.RESULT_COLUMNS] and len(jobs.RESULT_COLUMNS) == 29 and table.count() == 10
    with pytest.raises(ValueError, match="odd"):
        jobs.evaluate(curves, known, keys, [jobs.pipeline_from({"name": "x", "odd": 1})])
    with pytest.raises(ValueError, match="nobody"):
        jobs.evaluate(curves, known, keys, [jobs.pipeline_from({"name": "x", "ensemble_pipelines": ["nobody"]})])


def test_a_failed_group_has_no_accuracy(spark):
    from seqloom.plans import jobs

    rows = spark.createDataFrame([(0, b, k, float(k), float(k * b)) for b in range(6) for k in range(9)], "experiment int, bead int, frame int, x double, f double")
    truth = spark.createDataFrame([(0, b, b % 2) for b in range(6)], "experiment int, bead int, y int")
    got = jobs.evaluate(rows, truth, ["experiment", "bead"], [jobs.Pipeline("bad", "percentile_grid", clustering="no_such", n_grid=5)]).first()
    assert got["accuracy"] is None and got["n_failed"] > 0


def test_a_failed_member_is_no_vote(spark):
    from seqloom.plans import jobs

    rows = spark.createDataFrame([(e, b, k, float(k), float(k * b)) for e in range(2) for b in range(7) for k in range(9 if b < 6 else 1)], "experiment int, bead int, frame int, x double, f double")
    # curves of experiment 1 differ in length, and one sorted by force can't be stacked with the others
    rows = rows.where("experiment = 0 OR bead <> 2 OR frame < 5")
    truth = spark.createDataFrame([(e, b, b % 2) for e in range(2) for b in range(7)], "experiment int, bead int, y int")
    members = [jobs.Pipeline("fine", "percentile_grid", n_grid=5, n_clusters=2), jobs.Pipeline("odd", "raw_extension_sorted_by_force", n_clusters=2)]
    got = {(r["experiment"], r["bead"]): r for r in jobs.ensemble(rows, truth, ["experiment", "bead"], members).collect()}
    assert len(got) == 14
    for (e, b), r in got.items():  # bead 6 has one sample and no curve: dropped where all went well, failed where its group did
        assert (r["p"] in (0, 1) and r["error"] is None) if e == 0 else (r["p"] is None and r["error"].startswith("odd: ValueError")), (e, b, r)
    assert got[0, 6]["p"] == 0
    vote = jobs.Pipeline("vote", members=("fine", "odd"))
    scored = {r["experiment"]: r for r in jobs.evaluate(rows, truth, ["experiment", "bead"], [vote], {p.name: p for p in members}).collect()}
    assert scored[0]["accuracy"] is not None and scored[0]["n_failed"] == 0
    assert scored[1]["n_failed"] == scored[1]["n"] == 7 and scored[1]["accuracy"] is None and scored[1]["tn"] is None
    told = jobs.predicted(rows, truth, ["experiment", "bead"], [vote], {p.name: p for p in members})
    row = jobs.result_rows(told.withColumn("ext", F.lit(0)), ["experiment"], "ext").where("experiment = 1").first()
    assert row["accuracy"] is None and row["error"].startswith("odd: ")


def test_draws_are_exact_nested_and_bounded(spark):
    df = spark.createDataFrame([(i // 2, str(i)) for i in range(500)], "id long, v string")  # ids repeat
    rows = lambda n, bins: {(r["id"], r["v"]) for r in select.least_drawn(df, n, "id", "v", bins=bins).collect()}
    order = [(r["id"], r["v"]) for r in df.orderBy(select.hashed("id", "v"), "id", "v").collect()]
    for bins in (1, 7, 4096):
        for n in (0, 1, 99, 499, 500, 900):
            assert rows(n, bins) == set(order[:n])
    assert select.least_drawn(df.where("false"), 5, "id").count() == 0
    assert select.least_drawn(df, 3, "id").columns == ["id", "v"] and select.least_drawn(df, 3, "id").count() == 3


def test_learning_curves_use_nested_shares(spark):
    df = spark.createDataFrame([(i, float(i % 2) + (i % 7) / 10, i % 2) for i in range(120)], "id long, x double, label int")
    train, test = models.train_test(df)
    told = {r["fraction"]: r for r in models.learning_curve(train, test, ["x"], "tree", [0.2, 1.0]).collect()}
    assert set(told) == {0.2, 1.0} and told[1.0]["accuracy"] == 1.0 and told[0.2]["test_set"] == "test"
