"""Round trips of file sources and sinks, and the stream windows."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import align
from seqloom.plans import jobs
from seqloom.sources import discovery, npy, ranges, sinks, text
from seqloom.streaming import windows


def npy_file(path, scale, *blocks):
    with open(path, "wb") as f:
        np.save(f, np.asarray(scale, float))
        for b in blocks:
            np.save(f, b)


def test_block_files(spark, tmp_path):
    a, b = np.arange(24.0).reshape(4, 2, 3), np.arange(12.0).reshape(2, 2, 3) + 100
    npy_file(tmp_path / "traces.npy", [1.0, 2.0, 10.0], a, b)
    df = npy.read_blocks(spark, str(tmp_path / "traces.npy"))
    got = {(r["frame"], r["bead"], r["axis"]): r["v"] for r in df.collect()}
    whole = np.concatenate([a, b]) * [1.0, 2.0, 10.0]
    assert len(got) == 36 and all(got[k] == whole[k] for k in got)
    assert npy.read_blocks(spark, str(tmp_path / "traces.npy"), pixel_units=True).where("frame = 5 and bead = 1 and axis = 2").first()["v"] == b[1, 1, 2]
    shape = ranges.shapes(spark, str(tmp_path / "traces.npy")).first()
    assert (shape["frames"], shape["first_block_frames"], shape["beads"], shape["blocks"]) == (6, 4, 2, 2)
    wide = npy.split_axes(df, ["path"]).where("frame = 0 and bead = 1").first()
    assert (wide["x"], wide["y"], wide["z"]) == (3.0, 8.0, 50.0)


def test_cut_off_and_hostile_block_files(spark, tmp_path):
    npy_file(tmp_path / "cut.npy", [1.0], np.ones((2, 1, 3)), np.ones((5, 1, 3)))
    data = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(data[:-8])
    assert npy.read_blocks(spark, str(tmp_path / "cut.npy"), permissive=True).count() == 6
    with pytest.raises(Exception, match="ends inside"):
        npy.read_blocks(spark, str(tmp_path / "cut.npy")).count()
    buffer = io.BytesIO()
    np.save(buffer, np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError, match="refused"):
        npy.record(buffer.getvalue(), 0)
    with pytest.raises(ValueError):
        npy.record(b"\x93NUMPY" + struct.pack("<BB", 1, 0)[::-1] + b"zz", 4)


def test_normalised_samples(spark):
    samples = spark.createDataFrame([("e", f, b, a, float(1000 * (10 * f + b) + a)) for f in range(3) for b in range(3) for a in range(3)], "exp_id string, frame long, bead int, axis int, v double")
    config = spark.createDataFrame([("e", 10.0, -1, 2.0)], "exp_id string, framerate double, reference int, correction double")
    got = {(r["frame"], r["bead"]): (round(r["t"], 6), round(r["z"], 6)) for r in text.normalised_samples(samples, config).collect()}
    assert got[(1, 0)] == (0.1, 4.0) and got[(2, 2)] == (0.2, 0.0)


def test_text_files(spark, tmp_path):
    (tmp_path / "Experiment.txt").write_text("0 1000 1 2 3 4 5 -1.#IND000\n1 2000 1 2 3 4 5 6\n\n")
    lines = text.lines(spark, str(tmp_path / "Experiment.txt"))
    got = [(r["line"], r["bead"], r["t"], r["z"]) for r in text.read_samples(lines, ["path"]).orderBy("line", "bead").collect()]
    assert got == [(0, 0, 1.0, 3.0), (0, 1, 1.0, None), (1, 0, 2.0, 3.0), (1, 1, 2.0, 6.0)]
    (tmp_path / "good.txt").write_text("time(ms)\tz_3\tz_12\n1000\t1.5\t-1.#IND000\n")
    assert sorted((r["t"], r["bead"], r["z"]) for r in text.read_curated(spark, str(tmp_path / "good.txt")).collect()) == [(1.0, 2, 1.5), (1.0, 11, None)]
    (tmp_path / "pos.txt").write_text("1 2\nbad line\n3\n4 5 extra\n")
    pos = text.lines(spark, str(tmp_path / "pos.txt"))
    assert sorted((r["x"], r["y"]) for r in text.read_positions(pos, ["path"]).collect()) == [(1, 2), (4, 5)]
    assert text.position_count(pos, ["path"]).first()["n"] == 3
    (tmp_path / "config.yaml").write_text("framerate: 100 # Hz\nrefIndices: [1, 4]\nother:\n  nested: 1\n")
    conf = text.settings(text.read_settings(text.lines(spark, str(tmp_path / "config.yaml")), ["path"])).first()
    assert (conf["framerate"], conf["reference"], conf["correction"]) == (100.0, 4, 0.88)
    (tmp_path / "script.txt").write_text("5 2 1 0 0\n10 6 0.5 0 0\nshort\n")
    script = align.parse_interval_script(text.read_interval_lines(text.lines(spark, str(tmp_path / "script.txt")), ["path"]), ["path"])
    assert [(r["t0"], r["t1"]) for r in script.orderBy("seq").collect()] == [(0.0, 2.0), (5.0, 13.0)]


def files(spark, *paths):
    return spark.createDataFrame([(p, 2097152) for p in paths], "path string, size long")


def test_discovery(spark, tmp_path):
    f = files(spark, "a/e1/traces.npy", "a/e1/beadpos_xy.txt", "a/e2/x/traces.npy", "a/e2/x/beadpos_xy.txt", "a/e2/y/traces.npy", "a/e2/y/beadpos_xy.txt", "b/test_1/traces.npy", "b/e3/Experiment.txt")
    assert [r["folder"] for r in discovery.experiment_folders(f).collect()] == ["a/e1", "a/e2/x", "a/e2/y"]
    found = {r["folder"]: r["layout"] for r in discovery.catalogue(f).collect()}
    assert found == {"a/e1": "single", "a/e2": "two_full_children", "b/e3": "text"}
    counts = spark.createDataFrame([("a/e2/x", 3), ("a/e2/y", 9)], "folder string, n long")
    assert [(r["folder"], r["number"]) for r in discovery.paired_folders(f, counts).orderBy("number").collect()] == [("a/e2/y", 0), ("a/e2/x", 1)]
    shapes = spark.createDataFrame([("a/e1", 100, 5)], "folder string, frames long, beads long")
    labels = spark.createDataFrame([("e1", True), ("e1", False)], "experiment_id string, is_good boolean")
    out = spark.createDataFrame([("x",)], "id string")
    rows = {r["path"]: r for r in discovery.manifest(f, shapes, labels, exclude=out).collect()}
    assert rows["a/e1"]["size_mb"] == 2.0 and rows["a/e1"]["has_both_classes"] and not rows["a/e2/y"]["has_labels"] and "a/e2/x" not in rows
    (tmp_path / "r" / "s").mkdir(parents=True)
    (tmp_path / "r" / "s" / "traces.npy").write_bytes(b"12")
    assert [tuple(r) for r in discovery.listing(spark, str(tmp_path)).collect()] == [("r/s/traces.npy", 2)]


def test_label_files_in_order(spark):
    f = files(spark, "e/labels_filtered.csv", "e/labels.csv", "e/original_prepost_labels.csv", "e/other.csv")
    got = [r["path"].split("/")[1] for r in discovery.best_label_files(f).orderBy("rank").collect()]
    assert got == ["original_prepost_labels.csv", "labels.csv", "labels_filtered.csv"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"')], "id long, s string")
    sinks.write_results(df, f"{tmp_path}/r")
    sinks.write_results(df, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 4
    both = sinks.union_all([df, spark.createDataFrame([(3, 1.5)], "id long, extra double")])
    assert both.columns == ["id", "s", "extra"] and both.count() == 3
    arrays = spark.createDataFrame([(1, 0, [1.0, 2.0], [0.0, 1.0]), (2, 1, [1.0] * 5, [0.0] * 5), (3, 1, [4.0, 5.0, 6.0], [0.0] * 3)], "id long, label int, z array<double>, t array<double>")
    sinks.save_dataset(arrays, f"{tmp_path}/d")
    got = {r["id"]: r for r in sinks.load_dataset(spark, f"{tmp_path}/d").collect()}
    assert got[1]["z_median"] == [1.0, 2.0, 2.0] and len(got[1]["z_padded"]) == 5 and got[2]["z_median"] == [1.0] * 3
    split = spark.createDataFrame([("train", "p", "e", "s"), ("test", "q", "f", "s")], "fold string, path string, experiment_id string, source string")
    sinks.write_split(split, f"{tmp_path}/split", 42, 0.8)
    assert [r["path"] for r in sinks.read_split(spark, f"{tmp_path}/split").collect()] == ["p"]
    results = spark.createDataFrame([("tree", "real", 0.5), ("forest", "real", 0.75)], "model string, train_set string, balanced_accuracy double")
    gaps = spark.createDataFrame([("std", 0.4, 1.0), ("mean", float("nan"), 2.0)], "feature string, ks_stat double, wasserstein double")
    assert "Best model: forest" in sinks.report(results, gaps) and "| std | 0.400 | 1.000 |" in sinks.report(results, gaps)


def test_registry(spark, tmp_path):
    assert len(jobs.registry()) == 14 * 8 * 7
    (tmp_path / "p.json").write_text('[{"name": "x", "representation": "percentile_grid", "clustering": "dbscan", "dim_reduction": "lle", "dim_reduction_n_components": 3, "odd": 1}, "percentile_grid-none-kmeans"]')
    read = jobs.read_registry(spark, str(tmp_path / "p.json"))
    assert read["x"].reduction == "lle" and read["x"].n_components == 3 and read["x"].extra == {"odd": 1} and len(read) == 2
    assert jobs.overlaid(read["x"], n_clusters=4, odd=2).extra == {"odd": 2}


def test_stream_windows(spark, tmp_path):
    events = spark.range(200).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 10)).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.repartition(4).write.parquet(f"{tmp_path}/events")
    stream = windows.event_stream(spark, f"{tmp_path}/events", spark.read.parquet(f"{tmp_path}/events"), per_trigger=10)
    got = windows.run_to_end(windows.windowed(stream, "1 hour"), "w_hour", "complete")
    want = windows.windowed(events, "1 hour")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    got = windows.run_to_end(windows.sessions(stream, "25 minutes"), "w_session", "complete")
    assert got.agg(F.sum("n")).first()[0] == 200


@pytest.mark.parametrize("scale", [[1.0, 2.0, 3.0], (1, 2, 3), np.array([1.0, 2.0, 3.0]), np.array([1, 2, 3], ">i4"), [np.float64(1.0), 2.0, np.int32(3)]])
@pytest.mark.parametrize("protocol", [2, 4])
def test_dictionary_headers_are_read_without_unpickling(scale, protocol, tmp_path):
    import io
    import pickle

    own = np.array({"axisScale": scale, "names": ["x", "y"], "nested": {"a": None, "b": True}}, dtype=object)
    block = np.arange(24.0).reshape(2, 4, 3)
    out = io.BytesIO()
    np.save(out, own)
    if protocol == 2:  # an older writer's record: the same header, another pickle
        start = npy.layout(io.BytesIO(out.getvalue()))[3]
        out = io.BytesIO(out.getvalue()[:start] + pickle.dumps(own, 2))
        out.seek(0, 2)
    np.save(out, block)
    found = list(npy.blocks(out.getvalue()))
    assert found[0].tolist() == [1.0, 2.0, 3.0] and (found[1] == block).all()


def test_headers_that_would_run_code_are_refused():
    import io
    import os

    class Bad:
        def __reduce__(self):
            return (os.system, ("true",))

    for value in ({"axisScale": Bad()}, {"axisScale": [1.0], "f": print}, Bad(), {"no": 1}):
        out = io.BytesIO()
        np.save(out, np.array(value, dtype=object), allow_pickle=True)
        with pytest.raises(ValueError):
            list(npy.blocks(out.getvalue()))


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_block_files_by_byte_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(n, 4, 3)) for n in (5, 1, 40)] + [np.asfortranarray(rng.normal(size=(17, 4, 3))), rng.integers(0, 99, (3, 4, 3)).astype(">i2")]
    npy_file(tmp_path / "traces.npy", [1.0, 2.0, 10.0], *parts)
    whole = np.concatenate(parts) * [1.0, 2.0, 10.0]
    for size in (1, 500, 1 << 20):
        got = ranges.read_blocks(spark, str(tmp_path), slice_bytes=size).toPandas()
        assert len(got) == whole.size and np.array_equal(got.sort_values(["frame", "bead", "axis"])["v"].to_numpy().reshape(whole.shape), whole)
    few = ranges.read_blocks(spark, str(tmp_path / "traces.npy"), frames=(4, 9), pixel_units=True, slice_bytes=300).toPandas()
    assert sorted(few["frame"].unique()) == list(range(4, 9)) and np.array_equal(few.sort_values(["frame", "bead", "axis"])["v"].to_numpy(), np.concatenate(parts)[4:9].ravel())
    assert ranges.slices(ranges.block_index(spark, str(tmp_path)), 4, 9).agg(F.sum(F.col("b") - F.col("a"))).first()[0] == 5
    data = (tmp_path / "traces.npy").read_bytes()
    counted = Counted(data)
    scale, rows = ranges.scanned(counted, len(data))
    assert scale == [1.0, 2.0, 10.0] and [r["rows"] for r in rows] == [5, 1, 40, 17, 3] and counted.taken < 160 * (1 + len(parts))
    (tmp_path / "traces.npy").write_bytes(data[:-1])
    assert ranges.read_blocks(spark, str(tmp_path), permissive=True).count() == whole[:-3].size
    with pytest.raises(Exception, match="ends inside"):
        ranges.read_blocks(spark, str(tmp_path)).count()


def test_block_files_beyond_two_gigabytes(spark, tmp_path):
    frames, last = 1_300_000, np.arange(2 * 100 * 3, dtype=float).reshape(2, 100, 3)
    with open(tmp_path / "traces.npy", "wb") as f:
        np.save(f, np.array([1.0]))
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (frames, 100, 3)})
        f.seek(frames * 100 * 3 * 8, 1)  # a hole: it takes no room
        np.save(f, last)
    assert (tmp_path / "traces.npy").stat().st_size > 3 * 10**9
    shape = ranges.shapes(spark, str(tmp_path)).first()
    assert (shape["frames"], shape["beads"], shape["blocks"]) == (frames + 2, 100, 2)
    cut = ranges.slices(ranges.block_index(spark, str(tmp_path)))
    assert cut.count() > 90 and cut.agg(F.max((F.col("b") - F.col("a")) * F.col("width") * 8)).first()[0] <= ranges.SLICE_BYTES
    got = ranges.read_blocks(spark, str(tmp_path), frames=(frames - 3, None)).toPandas().sort_values(["frame", "bead", "axis"])
    assert len(got) == 5 * 300 and np.array_equal(got["v"].to_numpy()[900:], last.ravel()) and (got["v"].to_numpy()[:900] == 0).all()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_datasets_in_npz_files(spark, tmp_path, save):
    rng = np.random.default_rng(2)
    n, longest = 300, 50
    lengths = rng.integers(2, longest, n)
    traces, times = np.full((n, longest), np.nan), np.full((n, longest), np.nan)
    for k, m in enumerate(lengths):
        traces[k, :m], times[k, :m] = rng.normal(size=m), np.arange(m) * 0.1
    traces[3, lengths[3] - 1] = np.nan  # a sample lost at the end
    save(tmp_path / "set.npz", traces=traces, times=times, traces_sktime=traces[:, None, :5], traces_sktime_2d=traces[:, :5], labels=np.arange(n) % 2, n_traces=n, format_version=np.array("2"), meta=np.array([{"a": 1}], dtype=object))
    index = {r["name"]: (r["rows"], r["width"]) for r in ranges.npz_index(spark, str(tmp_path / "set.npz")).collect()}
    assert index["traces"] == (n, longest) and index["traces_sktime"] == (n, 5) and index["labels"] == (n, 1) and index["n_traces"] == (1, 1) and "meta" not in index
    got = {r["row"]: r["v"] for r in ranges.read_npz(spark, str(tmp_path), "traces", rows=(10, 250), slice_bytes=4000).collect()}
    assert sorted(got) == list(range(10, 250)) and all(np.array_equal(got[k], traces[k], equal_nan=True) for k in got)
    rows = ranges.read_dataset(spark, str(tmp_path)).collect()
    assert len(rows) == n
    for r in rows:
        m = lengths[r["id"]] - (r["id"] == 3)
        assert r["label"] == r["id"] % 2 and np.array_equal(r["z"], traces[r["id"], :m], equal_nan=True) and np.allclose(r["t"], times[r["id"], :m])
    save(tmp_path / "fixed.npz", X=traces[:, :5])
    fixed = ranges.read_dataset(spark, str(tmp_path / "fixed.npz")).where("id = 7").first()
    assert len(fixed["z"]) == 5 and fixed["label"] is None and fixed["t"] is None


def test_directories_of_large_archives():
    # a 64-bit entry: sizes and place stand in its extra field
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", allowZip64=True) as z, z.open("a.npy", "w", force_zip64=True) as f:
        np.save(f, np.arange(3.0))
    raw = data.getvalue()
    assert [(m[0], m[1], m[3]) for m in ranges.members(io.BytesIO(raw), len(raw))] == [("a.npy", 0, 0)]
    with pytest.raises(npy.Truncated):
        ranges.members(io.BytesIO(raw[:40]), 40)
