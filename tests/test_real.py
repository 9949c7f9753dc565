"""Measured traces from files to result rows: loading by path, preparation, training, stored models, votes."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.plans import real

BEADS, FRAMES = 8, 240


def traces(rng):
    """Good beads wander smoothly, bad ones are flat with spikes; nm, three axes."""
    t = np.arange(FRAMES)
    out = np.zeros((FRAMES, BEADS, 3))
    for b in range(BEADS):
        out[:, b, 2] = 900 * np.sin(t / rng.uniform(9, 15) + b) + rng.normal(0, 30, FRAMES) if b % 2 else np.where(rng.random(FRAMES) < 0.02, 4000, 0) + rng.normal(0, 30, FRAMES)
    return out


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("data"), np.random.default_rng(5)
    for k in range(5):
        folder = root / f"src{k % 2}" / f"e{k}"
        folder.mkdir(parents=True)
        with open(folder / "traces.npy", "wb") as f:
            np.save(f, np.ones(3))
            z = traces(rng)
            z[3, 1, 2] = np.nan
            np.save(f, z[:100])
            np.save(f, z[100:])
        (folder / "config.yaml").write_text("framerate: 10\nrefIndices: 0\nzcorrection: 1.0\n")
        (folder / "traces_selected.pickle").write_bytes(pickle.dumps({f"Bead_{b + 1}_z": [z[:, b, 2]] for b in range(BEADS) if b % 2}))
    e = real.load(spark, str(root))
    return root, e


def test_loading_by_path(spark, data, tmp_path):
    root, e = data
    assert e.samples.count() == 5 * BEADS * FRAMES
    assert {(r["bead"], r["is_good"]) for r in e.beads.select("bead", "is_good").distinct().collect()} == {(b, b % 2 == 1) for b in range(BEADS)}
    rows = real.counts(e).collect()
    assert len(rows) == 5 and all((r["n_frames"], r["n_beads"], r["n_good"], r["has_both_classes"]) == (FRAMES, BEADS, 4, True) for r in rows)
    one = real.load(spark, str(root / "src0" / "e0" / "traces.npy"))
    assert one.beads.count() == BEADS
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "Experiment.txt").write_text("".join(f"{i} {i * 100} 0 0 {i % 7}\n" for i in range(20)))
    assert real.load(spark, str(tmp_path)).samples.count() == real.load(spark, str(tmp_path / "c" / "Experiment.txt")).samples.count() == 20
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no traces"):
        real.load(spark, str(tmp_path / "none"))


def test_preparation(spark, data):
    root, e = data
    fold = real.split(e, 0.6)
    assert {r["fold"]: r["count"] for r in fold.groupBy("fold").count().collect()} == {"train": 3, "test": 2}
    assert real.split(e, test_all=True).where("fold = 'test'").count() == 5 and real.split(e, both_classes=True).count() == 5
    one = real.counts(e).select("exp_id").orderBy("exp_id").limit(1)
    scaled = real.prepared(e, real.Scaled(50), one, (3.0, 2.0)).collect()
    every = np.concatenate([r["z"] for r in scaled])
    assert len(scaled) == BEADS and abs(every.mean() - 3) < 1e-9 and abs(every.std() - 2) < 1e-9
    raw = {r["bead"]: r for r in real.prepared(e, real.Scaled(FRAMES), one).collect()}
    own = e.samples.join(one, "exp_id", "left_semi").where("bead = 1").orderBy("frame").toPandas()["z"].to_numpy()
    assert np.isnan(own[3]) and np.allclose(raw[1]["z"], np.where(np.isnan(own), np.nanmean(own), own)) and raw[1]["label"] == 1
    cut = real.prepared(e, real.Segments(60, 40))
    assert cut.count() == 5 * BEADS * 5 and real.prepared(e, real.Segments(60, 40, most=37)).count() == 37


def test_models_on_measured_traces(spark, data, tmp_path):
    root, e = data
    fold = real.split(e, 0.6).cache()
    train, test = fold.where("fold = 'train'"), fold.where("fold = 'test'")
    names = real.fit_bundle(e, train, str(tmp_path), length=120)
    real.fit_model(e, train, str(tmp_path), "minirocket", real.Segments(60), n_features=168)
    real.fit_model(e, train, str(tmp_path), "interval_ridge", real.Scaled(80), n_features=12)
    rows = real.evaluate(spark, e, test, str(tmp_path), [*names, "minirocket", "interval_ridge"], length=120, data_root=str(root)).collect()
    assert len(rows) == 2 * (len(names) + 3) and list(rows[0].asDict()) == real.RESULT_COLUMNS
    for r in rows:
        assert r["n_beads"] == BEADS == r["tp"] + r["tn"] + r["fp"] + r["fn"] and r["correct"] == r["tp"] + r["tn"] and r["source"] in ("src0", "src1") and r["path"].endswith(r["experiment_id"])
        if r["method"] not in ("rules", "approach1_scaled_dt"):
            assert r["accuracy"] >= 0.75, r
    model, config = real.load_model(spark, f"{tmp_path}/minirocket")
    told = real.told_by(e, test, model, config).cache()
    assert told.count() == 2 * BEADS * 4
    votes = real.bead_accuracy(told, e, test).first()
    assert (votes["n_test_beads"], votes["n_test_experiments"]) == (16, 2) and votes["accuracy_majority_vote"] >= 0.85 and votes["accuracy_sum_threshold"] >= 0.85
    # a bead without segments is told 0
    none = real.by_bead(told.where("bead <> 1"), e, test).where("bead = 1").first()
    assert (none["majority"], none["sum_vote"], none["label"]) == (0, 0, 1)
    with pytest.raises(ValueError, match="no traces"):
        real.fit_model(e, train.where("false"), str(tmp_path), "minirocket", real.Segments(60))
