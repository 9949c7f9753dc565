"""Resumed runs, runtime estimates, label files and the dataset cache."""

import collections
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.plans import bulk, jobs
from seqloom.sources import cache, labels

KEYS = ["experiment", "bead"]


def curves(spark, experiments=6):
    rows = [(e, b, k, float(k), float((1 + 9 * (b % 2)) * k)) for e in range(experiments) for b in range(6) for k in range(20)]
    frame = spark.createDataFrame(rows, "experiment int, bead int, frame int, x double, f double")
    return frame, frame.select(*KEYS).distinct().withColumn("y", (F.col("bead") % 2).cast("int"))


def plain(df):
    return sorted(map(str, df.select("pipeline", "experiment", "tp", "tn", "fp", "fn", "n", "accuracy", "n_failed").collect()))


def test_a_run_that_was_cut_off_computes_only_what_is_missing(spark, tmp_path, monkeypatch):
    rows, truth = curves(spark)
    two = [jobs.Pipeline("a", "percentile_grid", n_grid=5, n_clusters=2), jobs.Pipeline("b", "force_percentile_grid", n_grid=5, n_clusters=2)]
    where, whole, seen = f"{tmp_path}/results", jobs.evaluate, []

    def counted(rows, truth, keys, pipelines, known=None):
        seen.append((pipelines[0].name, truth.select("experiment").distinct().count()))
        if len(seen) == 3:
            raise KeyboardInterrupt
        return whole(rows, truth, keys, pipelines, known)

    monkeypatch.setattr(jobs, "evaluate", counted)
    with pytest.raises(KeyboardInterrupt):
        bulk.resumed(rows, truth, KEYS, two, where, parts=3)
    kept = bulk.stored(truth, KEYS, where).count()
    assert kept == sum(n for _, n in seen[:2])
    done = bulk.resumed(rows, truth, KEYS, two, where, parts=3)
    assert len(done) + 2 == len(bulk.missing(truth, KEYS, two, f"{tmp_path}/none", 3).select("pipeline", "part").distinct().collect())
    got = bulk.results(truth, KEYS, two, where)
    assert plain(got) == plain(whole(rows, truth, KEYS, two)) and got.where("accuracy = 1.0").count() == 12
    assert bulk.resumed(rows, truth, KEYS, two, where, parts=3) == []
    # new experiments: only their parts; changed options: another run of that pipeline only
    more, known = curves(spark, 7)
    again = bulk.resumed(more, known, KEYS, two, where, parts=3)
    assert {p for p, _ in again} == {"a", "b"} and len(again) == 2 and bulk.results(known, KEYS, two, where).count() == 14
    changed = [two[0], jobs.overlaid(two[1], n_grid=7)]
    assert {p for p, _ in bulk.resumed(more, known, KEYS, changed, where, parts=3)} == {"b"}
    assert bulk.results(known, KEYS, changed, where).count() == 14


def test_a_pipeline_that_cannot_run_gives_rows_with_an_error(spark, tmp_path):
    rows, truth = curves(spark, 2)
    odd = [jobs.pipeline_from({"name": "x", "odd": 1}), jobs.Pipeline("fine", "percentile_grid", n_grid=5, n_clusters=2)]
    bulk.resumed(rows, truth, KEYS, odd, f"{tmp_path}/r", parts=2)
    got = {(r["pipeline"], r["experiment"]): r for r in bulk.results(truth, KEYS, odd, f"{tmp_path}/r").collect()}
    assert len(got) == 4 and "odd" in got["x", 0]["error"] and got["x", 1]["accuracy"] is None and got["fine", 0]["accuracy"] == 1.0 and got["fine", 0]["error"] is None


def test_runtime_estimate(spark):
    rows, truth = curves(spark, 5)
    got = bulk.estimated(rows, truth, KEYS, [jobs.Pipeline("a", "percentile_grid", n_grid=5, n_clusters=2)], n_sample=2).first()
    assert (got["n_groups"], got["n_sample"]) == (5, 2) and got["rows"] == 2 * 6 * 20 and abs(got["estimate"] - 2.5 * got["seconds"]) < 1e-9
    none = bulk.estimated(rows.where("false"), truth.where("false"), KEYS, [jobs.Pipeline("a")]).first()
    assert (none["n_groups"], none["estimate"]) == (0, 0.0)


class Hostile:
    def __reduce__(self):
        return (eval, ("__import__('os').abort()",))


@pytest.mark.parametrize("protocol", range(6))
def test_keys_of_pickles_without_unpickling(protocol, tmp_path):
    import io

    arrays = [np.arange(5.0), np.arange(5)]
    for made in (dict, collections.OrderedDict, lambda x: collections.defaultdict(list, x)):
        held = made({"Bead_3_z": arrays, "Bead_1_z": [arrays, {"inner": 1}], "other": Hostile(), 7: "number", "Bead_3_y": ("x", None, True)})
        assert labels.pickle_keys(io.BytesIO(pickle.dumps(held, protocol))) == ["Bead_3_z", "Bead_1_z", "other", "Bead_3_y"]
    assert labels.pickle_keys(io.BytesIO(pickle.dumps({}, protocol))) == []
    for other in ("text", b"bytes"):
        with pytest.raises((ValueError, IndexError)):
            labels.pickle_keys(io.BytesIO(pickle.dumps(other, protocol)[:-1]))
    with pytest.raises(ValueError):
        labels.pickle_keys(io.BytesIO(pickle.dumps("text", protocol)))


def test_the_preferred_label_file_masks_the_beads(spark, tmp_path):
    def save(path, *keys):
        where = tmp_path / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(pickle.dumps({k: [np.zeros(3)] for k in keys}))

    save("a/traces_selected.pickle", "Bead_1_z")
    save("a/deep/traces_filtered.pickle", "Bead_2_z", "Bead_9_z", "note")
    save("b/traces_filtered.pickle", "no bead")
    save("b/original_prepost/x/traces_selected.pickle", "Bead_3_z")
    save("b/traces_selected.pickle", "Bead_1_z")
    save("d/labels.pickle", "Bead_1_z")
    (tmp_path / "a/traces_filtered.pickle").write_bytes(b"not a pickle")
    beads = spark.createDataFrame([(f"{tmp_path}/{e}", b) for e in "abcd" for b in range(3)], "exp_id string, bead int")
    got = {(r["exp_id"][-1], r["bead"]): r["is_good"] for r in labels.good_mask(spark, str(tmp_path), beads).collect()}
    good = {e: [b for b in range(3) if got[e, b]] for e in "abcd"}
    assert good == {"a": [1], "b": [2], "c": [0, 1, 2], "d": [0, 1, 2]}


def test_a_larger_dataset_serves_a_smaller_request(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n).withColumn("z", F.col("id") * 2)

    ask = lambda n, **params: cache.cached(spark, str(tmp_path), {"seed": 1, "dt": 0.05, **params}, n, make)
    assert ask(50).count() == 50 and made == [50]
    assert sorted(r["z"] for r in ask(20).collect()) == list(range(0, 40, 2)) and ask(50).count() == 50 and made == [50]
    assert ask(80).count() == 80 and made == [50, 80] and ask(60).count() == 60 and made == [50, 80]
    assert ask(10, seed=2).count() == 10 and made == [50, 80, 10]
