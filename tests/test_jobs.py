"""The jobs: growing input, reruns, cut-off runs, their command lines, and the models against a dense solver."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import text_traces, transfer_matrix
from jobs.common import config_of
from seqloom.operators import trace, transfer

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def stored(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def beads(spark, out):
    return sorted(map(tuple, text_traces.newest(spark.read.schema(text_traces.BEADS).parquet(f"{out}/beads")).drop("batch").collect()), key=str)


def plain(results):
    return sorted(map(tuple, results.drop("last_batch").collect()))


@pytest.fixture
def text_job(spark, tmp_path):
    """Runs the job on the folder ``docs``, which starts with a part of the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("doc_id < 120").coalesce(1).write.parquet(f"{tmp_path}/docs")

    def run(out="out", where=f"{tmp_path}/docs"):
        return text_traces.run(spark, str(ROOT / "jobs/text_traces.json"), where, f"{SF}/labels.parquet", f"{tmp_path}/{out}", f"{tmp_path}/{out}-checkpoint")

    return run, docs, tmp_path


@tables
def test_growing_input_takes_only_what_is_new(spark, text_job, caplog):
    run, docs, tmp = text_job
    caplog.set_level(logging.INFO, "seqloom.jobs")
    first = plain(run())
    assert sum(r[1] for r in first) == 120
    before = stored(tmp / "out")
    assert plain(run()) == first and stored(tmp / "out") == before  # nothing new: no file is touched
    docs.where("doc_id >= 120 AND source = 'src3'").coalesce(1).write.mode("append").parquet(f"{tmp}/docs")
    caplog.clear()
    second = run()
    n = docs.where("doc_id >= 120 AND source = 'src3'").count()
    assert f"batch 1: read {n} documents" in caplog.text and "1 experiments to score" in caplog.text
    after = stored(tmp / "out")
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and all("experiment=src3/" in p for p in changed)
    docs.where("doc_id >= 120 AND source <> 'src3'").coalesce(1).write.mode("append").parquet(f"{tmp}/docs")
    assert sum(r[1] for r in plain(second)) == 120 + n
    third = plain(run())
    whole = plain(run("whole", f"{SF}/documents.parquet"))
    assert third == whole and beads(spark, f"{tmp}/out") == beads(spark, f"{tmp}/whole")


@tables
def test_a_run_that_was_cut_off_is_made_up_for(spark, text_job, monkeypatch):
    run, docs, tmp = text_job
    with monkeypatch.context() as m:
        m.setattr(text_traces, "results_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    assert sum(r[1] for r in plain(run())) == 120
    # a batch whose commit was lost runs again and replaces its own partitions
    (tmp / "out-checkpoint/commits/0").unlink()
    for crc in (tmp / "out-checkpoint/commits").glob(".0.crc"):
        crc.unlink()
    rows = beads(spark, f"{tmp}/out")
    assert sum(r[1] for r in plain(run())) == 120 and beads(spark, f"{tmp}/out") == rows


@tables
def test_a_newer_row_of_a_bead_counts(spark, text_job):
    run, docs, tmp = text_job
    run()
    was = docs.where("doc_id = 7").first()
    spark.createDataFrame([(7, "same " * 50, was["lang"], was["source"], 5), (None, "x", None, None, 1), (1000, None, None, None, 0)], docs.schema).coalesce(1).write.mode("append").parquet(f"{tmp}/docs")
    got = run()
    assert sum(r[1] for r in plain(got)) == 121
    row = text_traces.newest(spark.read.schema(text_traces.BEADS).parquet(f"{tmp}/out/beads")).where("doc_id = 7").first()
    assert (row["samples"], row["flat"], row["dropout"], row["usable"], row["batch"]) == (50, True, True, 0, 1)
    assert got.where("experiment = 'none'").first()["n_beads"] == 1


@tables
def test_the_matrix_job_reruns_to_the_same_result(spark, tmp_path):
    def run():
        return sorted(map(tuple, transfer_matrix.run(spark, str(ROOT / "jobs/transfer_matrix.json"), f"{SF}/documents.parquet", f"{SF}/labels.parquet", str(tmp_path)).collect()))

    first = run()
    assert run() == first and {r[1] for r in first} >= {"all", "en"}


@tables
def test_command_lines(tmp_path):
    for name, more in (("text_traces", ["--checkpoint", f"{tmp_path}/c"]), ("transfer_matrix", [])):
        done = subprocess.run([sys.executable, str(ROOT / f"jobs/{name}.py"), "--config", str(ROOT / f"jobs/{name}.json"), "--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet", "--out", f"{tmp_path}/{name}", *more], capture_output=True, text=True, cwd=tmp_path)
        assert done.returncode == 0 and "read" in done.stderr and "wrote" in done.stderr, done.stderr[-2000:]
        assert list((tmp_path / name).rglob("*.parquet"))


def test_unknown_options_are_refused(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"gap_len": 3}))
    assert config_of(spark, f"{tmp_path}/c.json", {"gap_len": 5, "n": 1}) == {"gap_len": 3, "n": 1}
    with pytest.raises(ValueError, match="gap_len"):
        config_of(spark, f"{tmp_path}/c.json", {"n": 1})


def test_jobs_need_no_optional_part():
    for path in (ROOT / "jobs").glob("*.py"):
        assert "seqloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_models_of_all_sets_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(1e6 + rng.normal()), float(rng.normal() * 100), 5.0, int(rng.random() < 0.4)) for i in range(400)]
    rows += [(900, "c", 1e6, float("nan"), 5.0, 1), (901, "c", 1e6, None, 5.0, 1), (902, "a", 1.0, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "id long, g string, x double, z double, k double, y int")
    members = {g: F.col("g") == g for g in "abcd"} | {"all": F.lit(True)}
    models = transfer.fitted(frame, members, {"x": ["x"], "xzk": ["x", "z", "k"]}, alpha=2.0)
    assert {(m.train_set, m.feature_set) for m in models} == {(s, f) for s in ("a", "b", "c", "all") for f in ("x", "xzk")}
    clean = [(g, [x, z if z is not None and np.isfinite(z) else 0.0, k], y) for _, g, x, z, k, y in rows if y is not None]
    for m in models:
        took = [(v, 2 * y - 1) for g, v, y in clean if m.train_set in (g, "all")]
        at = [("x", "z", "k").index(f) for f in m.features]
        x, y = np.array([v for v, _ in took])[:, at], np.array([y for _, y in took], float)
        scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
        u = (x - x.mean(axis=0)) / scale
        w = np.linalg.solve(u.T @ u + 2.0 * np.eye(len(at)), u.T @ (y - y.mean()))
        assert np.allclose(m.weights, w, atol=1e-6) and np.isclose(m.bias, y.mean())
    table = {(r["train_set"], r["feature_set"], r["eval_set"]): r for r in transfer.matrix(frame, models, "g").collect()}
    assert len(table) == 8 * 4 and table["a", "x", "all"]["n"] == 402 and table["c", "x", "c"]["tp"] == 2
    assert transfer.matrix(frame, [], "g").count() == 0
    with pytest.raises(ValueError, match="at most"):
        transfer.fitted(frame, {str(k): F.lit(True) for k in range(201)}, {"x": ["x"]})


def test_word_lengths(spark):
    frame = spark.createDataFrame([(1, " one\ttwo\n\nthree "), (2, ""), (3, None), (4, "é" * 300_000)], "id long, text string")
    got = {(r["id"], r["frame"]): r["z"] for r in trace.word_lengths(frame, ["id"]).collect()}
    assert got == {(1, 0): 3, (1, 1): 3, (1, 2): 5, (4, 0): 300_000}
