"""Queries of selection, parsing, grouping, generation and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import generate, group, models
from seqloom.operators import select as op
from seqloom.operators import trace as tr
from seqloom.plans.fixtures import TRACE, rounded, trace
from seqloom.runtime import materialized, table
from seqloom.sources import discovery, text


def _draw(seed, *columns):
    """``select.hashed`` as SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(columns)}, '{seed}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _paths(s, d):
    """One path a customer: region/nation/customer, some of them test folders."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("test_"), F.col("n_name"))).otherwise(F.col("n_name"))
    return c.select("c_custkey", F.concat_ws("/", "r_name", folder, F.concat(F.lit("exp"), F.col("c_custkey").cast("string"))).alias("path"), F.col("c_acctbal").alias("size"))


_PATHS = """paths AS (SELECT c_custkey, r_name || '/' || CASE WHEN c_custkey % 11 = 0 THEN 'test_' || n_name ELSE n_name END || '/exp' || CAST(c_custkey AS VARCHAR) AS path, c_acctbal AS size
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _path_parts(s, d):
    return _paths(s, d).select("c_custkey", op.source_of(F.col("path")).alias("source"), op.experiment_of(F.col("path")).alias("experiment_id"), op.is_test_path(F.col("path")).alias("is_test"), op.safe_name(F.col("path")).alias("safe"))


def _bead_keys(s, d):
    k = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Bead_"), F.col("p_partkey").cast("string"), F.lit("_z"))).otherwise(F.col("p_name"))
    return table(s, d, "part").select("p_partkey", F.coalesce(op.bead_index(k), F.lit(-1)).alias("bead"))


def _truth(s, d):
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "gc_").when(F.col("p_partkey") % 4 == 1, "uc_").when(F.col("p_partkey") % 4 == 2, "bb_").otherwise("gb_"), F.col("p_partkey").cast("string"))
    rows = table(s, d, "part").select("p_partkey", name.alias("name"))
    out = None
    for scheme in ("good_bad", "coilable_uncoilable", "coilable_uncoilable_bad"):
        part = op.labelled(rows, scheme).select("p_partkey", F.lit(scheme).alias("scheme"), op.truth_of(F.col("name"), scheme).alias("truth"), F.lit(op.default_class(scheme)).alias("default_class"))
        out = part if out is None else out.unionByName(part)
    return out


def _samples(s, d):
    """Conversation turns as sample lines: number, time and tokens of the text's length."""
    c = table(s, d, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    value = F.concat_ws(" ", F.lit("1"), (F.col("turn") * 100).cast("string"), n.cast("string"), F.lit(text.MISSING), (n * 2).cast("string"), F.lit("x"), (n % 7).cast("string"), F.lit("2.5"))
    return c.select(F.col("conv_id"), F.col("turn").alias("line"), F.col("role"), F.concat(F.lit("  "), value, F.lit(" ")).alias("value"))


def _settings(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    values = F.map_filter(
        F.create_map(
            F.lit("framerate"), F.when(k % 3 == 0, (k + 1).cast("string")), F.lit("refIndices"), F.when(k % 4 == 0, F.concat(F.lit("[1, "), k.cast("string"), F.lit("]"))).when(k % 4 == 1, k.cast("string")), F.lit("zcorrection"), F.when(k % 5 == 0, F.lit("0.9")).when(k % 5 == 1, F.lit("bad"))
        ),
        lambda _, v: v.isNotNull(),
    )
    return rounded(text.settings(e.select("event_id", values.alias("values"))).select("event_id", "framerate", "reference", "correction"))


def _catalogue_files(s, d):
    """Files of the paths: traces for all, positions for some, labels for a few."""
    p = _paths(s, d)
    names = F.array(F.lit("traces.npy"), F.when(F.col("c_custkey") % 2 == 0, "beadpos_xy.txt"), F.when(F.col("c_custkey") % 3 == 0, "config.yaml"))
    files = p.select("path", "size", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name"))
    return files.select(F.concat_ws("/", "path", "name").alias("path"), (F.col("size") * 1000).alias("size"))


def _manifest(s, d):
    shapes = _paths(s, d).select(F.col("path").alias("folder"), (F.col("c_custkey") * 10).alias("frames"), (F.col("c_custkey") % 50).alias("beads"))
    labels = table(s, d, "labels").select(F.concat(F.lit("exp"), F.col("doc_id").cast("string")).alias("experiment_id"), (F.col("quality") == 1).alias("is_good"))
    drop = op.without_comments(table(s, d, "customer").where("c_custkey % 13 = 0").select(F.concat(F.lit(" exp"), F.col("c_custkey").cast("string"), F.lit(" # out")).alias("value")))
    return discovery.manifest(_catalogue_files(s, d), shapes, labels, exclude=drop)


def _truthy(s, d):
    v = F.element_at(F.array(*[F.lit(x) for x in (" True", "no", "1", "YES ", "0", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", op.truthy(v).alias("flag"))


def _emb(s, d):
    # groups of at most 50 neighbours by id: bounded whatever the table's size
    return table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("grp"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _grouped(method, **o):
    return lambda s, d: group.clustered(_emb(s, d), ["grp"], "id", method, **o).select("grp", "id", "label", "error")


def _reduced(method, **o):
    return lambda s, d: rounded(group.reduced(_emb(s, d), ["grp"], "id", method, 2, **o).select("grp", "id", F.posexplode("v").alias("pos", "x")))


def _features(s, d):
    f = tr.features8(trace(s, d), ["bead"])
    return f.withColumnRenamed("bead", "id").withColumn("label", (F.col("id") % 2).cast("int"))


F8 = ["variance", "diff_std", "max_abs_diff", "median_abs_diff", "ptp", "p25", "p75", "autocorr_lag1"]


def _density(s, d):
    e = _emb(s, d)
    return group.density_clusters(group.within_reach(e, ["grp"], "id", 1.25), e, 5)


def _kernels(s, d):
    t = tr.resampled_traces(trace(s, d), ["bead"], 64)
    return rounded(group.kernel_features(t, ["bead"], 20).select("bead", F.posexplode("features").alias("pos", "x")))


def _ridge(s, d):
    t = group.kernel_features(tr.resampled_traces(trace(s, d), ["bead"], 64), ["bead"], 20).withColumn("label", (F.col("bead") % 2).cast("int"))
    w, b, _ = models.ridge(t)
    return models.ridge_predict(t, w, b).select("bead", "label", "p")


def _evaluated(s, d):
    train, test = models.train_test(_features(s, d))
    return rounded(models.fit_evaluate(train, {"train": train, "test": test}, F8, ["tree", "logistic"]))


def _series(s, d):
    return tr.as_arrays(trace(s, d), ["bead"], "z")


def _words(s, d):
    from seqloom.operators.traceml import SymbolicWords

    rows = _series(s, d)
    words = SymbolicWords(windows=[8], pairs=False)
    return words.counts(rows, ["bead"], words.learned_edges(rows))


def _minirocket(s, d):
    from seqloom.operators.traceml import trace_pipeline

    rows = materialized(_series(s, d).withColumn("label", (F.col("bead") % 2).cast("int")))  # a fit reads it several times
    told = trace_pipeline("minirocket", 504).fit(rows.where("bead % 4 < 2")).transform(rows)
    return rounded(told.select("bead", "label", "p", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total")))


#: Windows of eight samples, their first two Fourier coefficients, and bins whose bounds are the values at ranks ceil(q * n).
_WORDS = "WITH " + TRACE + """,
k AS (SELECT unnest([1, 2]) AS k),
v AS (SELECT a.bead, a.frame, k, count(*) AS n, round(sum(b.z * cos(2.0::DOUBLE * pi() * k * (b.frame - a.frame) / 8)), 9) AS re, round(-sum(b.z * sin(2.0::DOUBLE * pi() * k * (b.frame - a.frame) / 8)), 9) AS im
  FROM trace a JOIN trace b ON b.bead = a.bead AND b.frame BETWEEN a.frame AND a.frame + 7 CROSS JOIN k GROUP BY 1, 2, 3 HAVING count(*) = 8),
x AS (SELECT bead, frame, 2 * k - 2 AS i, re AS x FROM v UNION ALL SELECT bead, frame, 2 * k - 1, im FROM v),
r AS (SELECT i, x, row_number() OVER (PARTITION BY i ORDER BY x) AS r, count(*) OVER (PARTITION BY i) AS n FROM x),
e AS (SELECT i, max(CASE WHEN r = ceil(0.25 * n) THEN x END) AS q1, max(CASE WHEN r = ceil(0.5 * n) THEN x END) AS q2, max(CASE WHEN r = ceil(0.75 * n) THEN x END) AS q3 FROM r GROUP BY i),
w AS (SELECT bead, frame, string_agg(CAST(CAST(x > q1 AS INT) + CAST(x > q2 AS INT) + CAST(x > q3 AS INT) AS VARCHAR), '' ORDER BY i) AS w FROM x JOIN e USING (i) GROUP BY bead, frame)
SELECT bead, '8:' || w AS word, count(*) AS n FROM w GROUP BY 1, 2"""


def _simulated(s, d):
    made = generate.simulated(trace(s, d), ["bead"], "frame", noise=10.0)
    return rounded(made.groupBy("bead").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t_end"), F.avg("clean").alias("clean"), F.stddev_pop(F.col("z") - F.col("clean")).alias("noise")), digits=4)


def _long(s, d):
    return trace(s, d).select("bead", "frame", "t", "z", (F.col("bead") % 2).cast("int").alias("label"))


def _split(s, d):
    cut = generate.pieces(trace(s, d).withColumn("clean", F.floor("z").cast("double")), ["bead"], 300000.0)
    made = generate.corrupted_share(cut, ["bead", "piece"], ["bead"], 0.5, gaps=(20000.0, 60000.0))
    return made.groupBy("bead", "piece", "label", "bad_feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t"), 3).alias("t_end"), F.round(F.avg(F.when(F.col("label") == 1, F.col("z"))), 6).alias("mean"))


def _augmented(s, d):
    made = generate.augmented(_long(s, d), ["bead"])
    return rounded(made.groupBy("bead", "label", "change").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("change").isin("mild", "curved_drift"), F.col("z"))).alias("mean")), digits=4)


def _bootstrapped(s, d):
    made = generate.bootstrap(_long(s, d), ["bead"], 200)
    return made.groupBy("draw", "bead", "source_label", "label", "change").agg(F.count(F.lit(1)).alias("n"))


def _choice(draw, shares):
    """``generate.chosen`` as SQL."""
    below, parts = 0.0, []
    for name, share in list(shares.items())[:-1]:
        below += share / sum(shares.values())
        parts.append(f"WHEN {draw} < {below!r}::DOUBLE THEN '{name}'")
    return f"CASE {' '.join(parts)} ELSE '{list(shares)[-1]}' END"


def _normal(seed, *columns):
    return f"sqrt(-2.0::DOUBLE * ln(greatest({_draw(seed, *columns)}, 1e-15::DOUBLE))) * cos(2.0::DOUBLE * pi() * {_draw(seed + 1, *columns)})"


#: The states' parameters as rows; a stretch's duration by kind.
_STRETCHES = f""",
states(state, kind, lo1, hi1, lo2, hi2, direction) AS (VALUES {", ".join(f"('{name}', '{kind}', {p.get('durations', p.get('rates', (p.get('least', 0.0), 0.0)))[0]}::DOUBLE, {p.get('durations', p.get('rates', (0.0, p.get('most', 0.0))))[1]}::DOUBLE, {p.get('slopes', p.get('sizes', p.get('noise', (p.get('alpha', 0.0), 0.0))))[0]}::DOUBLE, {p.get('slopes', p.get('sizes', p.get('noise', (0.0, 0.0))))[1]}::DOUBLE, {p.get('direction', 0)})" for name, (kind, _, p) in generate.USABLE_STATES.items())}),
drawn AS (SELECT bead, frame AS k, {_choice(_draw(42, "bead", "frame"), generate.usable_weights())} AS state, {_draw(43, "bead", "frame")} AS u1, {_draw(44, "bead", "frame")} AS u2 FROM trace),
sized AS (SELECT bead, k, state, CAST(greatest(1, floor(CASE kind WHEN 'pause' THEN -ln(1.0::DOUBLE - u1) / (lo1 + (hi1 - lo1) * u2) WHEN 'power' THEN least(lo1 * pow(1.0::DOUBLE - u1, -1.0::DOUBLE / lo2), hi1) WHEN 'activity' THEN lo1 + (hi1 - lo1) * u1 ELSE 0 END / 0.05::DOUBLE)) AS BIGINT) AS samples,
  CASE kind WHEN 'activity' THEN direction * (lo2 + (hi2 - lo2) * u2) * 0.05::DOUBLE ELSE 0 END AS rise, CASE kind WHEN 'jump' THEN direction * (lo2 + (hi2 - lo2) * u2) ELSE 0 END AS step, CASE WHEN state = 'high_noise' THEN lo2 + (hi2 - lo2) * u1 ELSE 0 END AS own FROM drawn JOIN states USING (state))"""
_SIMULATED = "WITH " + TRACE + _STRETCHES + f""",
placed AS (SELECT *, coalesce(sum(samples) OVER w, 0) AS before, coalesce(sum(step + rise * (samples - 1)) OVER w, 0) AS level FROM sized WINDOW w AS (PARTITION BY bead ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
long AS (SELECT bead, level, step, rise, own, unnest(range(samples)) AS i, CAST(before AS BIGINT) AS before FROM placed),
f AS (SELECT *, before + i AS frame FROM long), c AS (SELECT bead, frame, level + step + rise * i + own * {_normal(52, "bead", "frame")} AS clean, 10.0::DOUBLE * {_normal(62, "bead", "frame")} AS e FROM f)
SELECT bead, count(*) AS n, round(max(frame) * 0.05::DOUBLE, 4) AS t_end, round(avg(clean), 4) AS clean, round(stddev_pop(e), 4) AS noise FROM c GROUP BY bead"""
_SPLIT = "WITH " + TRACE + f""",
c AS (SELECT bead, CAST(floor((t - min(t) OVER (PARTITION BY bead)) / 300000.0::DOUBLE) AS BIGINT) AS piece, t, z FROM trace),
p AS (SELECT bead, piece, count(*) AS n, max(t) - min(t) AS t_end, avg(z) AS m FROM c GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY bead ORDER BY {_draw(132, "bead", "piece")}, piece) <= floor(count(*) OVER (PARTITION BY bead) * 0.5::DOUBLE) AS bad FROM p)
SELECT bead, piece, CASE WHEN bad THEN 0 ELSE 1 END AS label, CASE WHEN bad THEN {_choice(_draw(133, "bead", "piece"), generate.BAD_FEATURES)} END AS bad_feature, n, round(t_end, 3) AS t_end, CASE WHEN NOT bad THEN round(m, 6) END AS mean FROM r"""
_CHANGE = _choice("{kind}", dict.fromkeys(generate.SPOILS, 1.0))


def _uniform(seed, lo, hi, *columns):
    return f"({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {_draw(seed, *columns)})"


#: A curved drift has mean zero, so the mean of such a trace is that of the mild change as well.
_AUGMENTED = "WITH " + TRACE + f""",
s AS (SELECT *, z - lag(z) OVER w AS d, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY bead) AS n FROM trace WINDOW w AS (PARTITION BY bead ORDER BY frame)),
g AS (SELECT bead, count(*) AS n, median(z) AS c, stddev_pop(z) AS sd, coalesce(stddev_pop(d), 0) AS steps FROM s GROUP BY bead),
m AS (SELECT bead, avg({_uniform(42, 0.9, 1.1, "bead")} * (z + CASE WHEN steps > 0 THEN steps ELSE greatest(0.02::DOUBLE * sd, 1e-6) END * {_uniform(43, 0.05, 0.25, "bead")} * {_normal(44, "bead", "frame")} + coalesce(i / nullif(s.n - 1.0::DOUBLE, 0), 0) * sd * {_uniform(46, -0.05, 0.05, "bead")}) + c * (1.0::DOUBLE - {_uniform(47, 0.9, 1.1, "bead")})) AS mean FROM s JOIN g USING (bead) GROUP BY bead),
k AS (SELECT bead, n, {_draw(48, "bead")} < 0.35 AS bad, CASE WHEN {_draw(48, "bead")} < 0.35 AND n >= 4 THEN {_CHANGE.format(kind=_draw(49, "bead"))} ELSE 'mild' END AS change FROM g)
SELECT bead, CASE WHEN bad THEN 0 ELSE CAST(bead % 2 AS INT) END AS label, change, n, CASE WHEN change IN ('mild', 'curved_drift') THEN round(mean, 4) END AS mean FROM k JOIN m USING (bead)"""
_BOOTSTRAPPED = "WITH " + TRACE + f""",
b AS (SELECT bead, count(*) AS n, row_number() OVER (ORDER BY bead) - 1 AS i FROM trace GROUP BY bead),
d AS (SELECT range AS draw, CAST(floor({_draw(42, "range")} * (SELECT count(*) FROM b)) AS BIGINT) AS i FROM range(200))
SELECT draw, bead, CAST(bead % 2 AS INT) AS source_label, CASE WHEN {_draw(48, "draw")} < 0.35 THEN 0 ELSE CAST(bead % 2 AS INT) END AS label, CASE WHEN {_draw(48, "draw")} < 0.35 AND n >= 4 THEN {_CHANGE.format(kind=_draw(49, "draw"))} ELSE 'mild' END AS change, n FROM d JOIN b USING (i)"""


QUERIES = {
    "path_parts": (_path_parts, "WITH " + _PATHS + " SELECT c_custkey, split_part(path, '/', 1) AS source, split_part(path, '/', 3) AS experiment_id, len(list_filter(string_split(path, '/'), lambda x: x = 'test' OR starts_with(x, 'test_'))) > 0 AS is_test, translate(path, '/ ', '__') AS safe FROM paths"),
    "bead_keys": (_bead_keys, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INT) - 1 ELSE -1 END AS bead FROM part"),
    "truth_classes": (
        _truth,
        """SELECT p_partkey, 'good_bad' AS scheme, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END AS truth, 0 AS default_class FROM part WHERE p_partkey % 4 IN (2, 3)
UNION ALL SELECT p_partkey, 'coilable_uncoilable', CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, 0 FROM part WHERE p_partkey % 4 IN (0, 1)
UNION ALL SELECT p_partkey, 'coilable_uncoilable_bad', CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END, 2 FROM part WHERE p_partkey % 4 IN (0, 1, 2)""",
    ),
    "truthy_flags": (_truthy, "SELECT p_partkey, p_partkey % 6 IN (0, 2, 3) AS flag FROM part"),
    "sample_lines": (
        lambda s, d: rounded(text.read_samples(_samples(s, d), ["conv_id", "role"])),
        "WITH c AS (SELECT conv_id, role, turn AS line, length(coalesce(text, '')) AS n FROM conversations) SELECT conv_id, role, line, b AS bead, line * 100 / 1000.0::DOUBLE AS t, CASE WHEN b = 0 THEN n::DOUBLE END AS x, CASE WHEN b = 1 THEN (n % 7)::DOUBLE END AS y, CASE WHEN b = 0 THEN (n * 2)::DOUBLE ELSE 2.5::DOUBLE END AS z FROM c, (VALUES (0), (1)) v(b)",
    ),
    "position_lines": (
        lambda s, d: text.read_positions(table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.when(F.col("turn") % 2 == 0, "x").otherwise(F.col("turn").cast("string")), F.col("conv_id").cast("string")).alias("value")), ["conv_id", "turn"]),
        "SELECT conv_id, turn, CAST(turn AS INT) AS x, CAST(conv_id AS INT) AS y FROM conversations WHERE turn % 2 <> 0",
    ),
    "position_counts": (
        lambda s, d: text.position_count(table(s, d, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("value")), ["conv_id"]),
        "SELECT conv_id, CAST(count_if(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) >= 2) AS BIGINT) AS n FROM conversations GROUP BY conv_id",
    ),
    "settings": (
        _settings,
        "WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT event_id, CASE WHEN k % 3 = 0 THEN (k + 1)::DOUBLE ELSE 58.0::DOUBLE END AS framerate, CASE WHEN k % 4 IN (0, 1) THEN k ELSE -1 END AS reference, CASE WHEN k % 5 = 0 THEN 0.9::DOUBLE ELSE 0.88::DOUBLE END AS correction FROM k",
    ),
    "folder_flags": (
        lambda s, d: op.folder_flags(discovery.folders(_catalogue_files(s, d))),
        "WITH " + _PATHS + " SELECT path AS folder, true AS traces, c_custkey % 2 = 0 AS positions, c_custkey % 3 = 0 AS script_or_config, c_custkey % 2 = 0 AS traces_positions, false AS positions_only FROM paths",
    ),
    "experiment_folders": (
        lambda s, d: discovery.experiment_folders(_catalogue_files(s, d)),
        "WITH " + _PATHS + " SELECT path AS folder, split_part(path, '/', 3) AS experiment_id, split_part(path, '/', 1) AS source FROM paths WHERE c_custkey % 11 <> 0",
    ),
    "experiment_catalogue": (
        lambda s, d: discovery.catalogue(_catalogue_files(s, d)).select("folder", "layout", "experiment_id", "source"),
        "WITH " + _PATHS + """, own AS (SELECT path AS folder, regexp_replace(path, '/[^/]*$', '') AS up, c_custkey % 2 = 0 AS positions FROM paths),
kids AS (SELECT up AS folder, count(*) FILTER (positions) AS whole, count(*) AS n FROM own GROUP BY 1),
tops AS (SELECT folder, CASE WHEN whole = 2 THEN 'two_full_children' ELSE 'all_and_good_children' END AS layout FROM kids WHERE whole = 2 OR n = 2),
found AS (SELECT * FROM tops UNION ALL SELECT folder, 'single' FROM own WHERE positions AND up NOT IN (SELECT folder FROM tops))
SELECT folder, layout, string_split(folder, '/')[-1] AS experiment_id, split_part(folder, '/', 1) AS source FROM found""",
    ),
    "manifest": (
        _manifest,
        "WITH " + _PATHS + """ SELECT path, split_part(path, '/', 3) AS experiment_id, split_part(path, '/', 1) AS source, round(size * 1000 / 1048576.0::DOUBLE, 2) + 0.0::DOUBLE AS size_mb, c_custkey * 10 AS n_frames, c_custkey % 50 AS n_beads, doc_id IS NOT NULL AS has_labels, false AS has_both_classes
FROM paths LEFT JOIN labels ON doc_id = c_custkey WHERE c_custkey % 13 <> 0""",
    ),
    "both_class_experiments": (
        lambda s, d: table(s, d, "labels").groupBy((F.col("doc_id") % 40).alias("experiment_id")).agg((F.bool_or(F.col("quality") == 1) & F.bool_or(F.col("quality") == 0)).alias("both")).where("both").select("experiment_id"),
        "SELECT doc_id % 40 AS experiment_id FROM labels GROUP BY 1 HAVING bool_or(quality = 1) AND bool_or(quality = 0)",
    ),
    "majority_source": (
        lambda s, d: op.majority_source(table(s, d, "customer"), "c_mktsegment", "c_custkey"),
        "SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, min(c_custkey) LIMIT 1",
    ),
    "far_from_median": (
        lambda s, d: rounded(op.far_from_median(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 8, "p_partkey")),
        "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, round(abs(p_retailprice - (SELECT median(p_retailprice) FROM part)), 6) AS gap FROM part ORDER BY abs(p_retailprice - (SELECT median(p_retailprice) FROM part)) DESC, p_partkey LIMIT 8",
    ),
    "best_row": (
        lambda s, d: rounded(op.best_row(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal")).alias("score")), "score", "s_suppkey")),
        "SELECT s_suppkey, round(s_acctbal, 6) AS score FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1",
    ),
    "three_decimals": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", op.decimals3(F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))).alias("text")),
        "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE format('{:.3f}', s_acctbal) END AS text FROM supplier",
    ),
    "set_difference": (
        lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(s, d, "orders").where("o_totalprice > 200000").select("o_custkey")),
        "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    ),
    "membership_filter": (
        lambda s, d: op.only(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_acctbal > 5000").select("c_custkey"), "o_custkey").select("o_orderkey", "o_custkey"),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    ),
    "exclusion_filter": (
        lambda s, d: op.excluded(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_acctbal > 5000").select("c_custkey"), "o_custkey").select("o_orderkey", "o_custkey"),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    ),
    "distinct_clusters": (
        lambda s, d: table(s, d, "embeddings").groupBy((F.col("vec_id") % 5).alias("grp")).agg(F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("n")),
        "SELECT vec_id % 5 AS grp, count(DISTINCT CASE WHEN label <> 0 THEN label END) AS n FROM embeddings GROUP BY 1",
    ),
    "config_overlay": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", F.explode(op.overlaid(F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("x")), F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("c"), F.lit("y"))))),
        "SELECT n_nationkey, k AS key, CASE k WHEN 'a' THEN n_name WHEN 'b' THEN CAST(n_regionkey AS VARCHAR) ELSE 'y' END AS value FROM nation, (VALUES ('a'), ('b'), ('c')) v(k)",
    ),
    "unknown_options": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", F.explode(op.unknown_keys(F.create_map(F.lit("name"), F.col("n_name"), F.lit("other"), F.lit("x")), ["name"]))),
        "SELECT n_nationkey, 'other' AS key, 'x' AS value FROM nation",
    ),
    "histogram": (
        lambda s, d: table(s, d, "part").select(F.width_bucket("p_retailprice", F.lit(900.0), F.lit(2100.0), F.lit(34)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CAST(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2100 THEN 35 ELSE floor((p_retailprice - 900) / (1200 / 34.0::DOUBLE)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY 1",
    ),
    "confusion_pivot": (
        lambda s, d: table(s, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).select("quality", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1")),
        "SELECT quality, CAST(count_if(toxic = 0) AS BIGINT) AS predicted_0, CAST(count_if(toxic = 1) AS BIGINT) AS predicted_1 FROM labels GROUP BY 1",
    ),
    "train_test_groups": (
        lambda s, d: op.split_groups(_paths(s, d).select("c_custkey", op.source_of(F.col("path")).alias("source")), "source"),
        "WITH " + _PATHS + f""", p AS (SELECT c_custkey, split_part(path, '/', 1) AS source FROM paths), g AS (SELECT DISTINCT source FROM p),
  r AS (SELECT source, row_number() OVER (ORDER BY {_draw(42, "source")}, source) AS k, count(*) OVER () AS n FROM g)
SELECT p.source, c_custkey, CASE WHEN k <= greatest(1, least(CAST(round(0.8 * n) AS INT), greatest(n - 1, 1))) THEN 'train' ELSE 'test' END AS fold FROM p JOIN r USING (source)""",
    ),
    "stratified_split": (
        lambda s, d: op.stratified(table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), "label", 0.25, "id"),
        f"""WITH r AS (SELECT doc_id AS id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY {_draw(42, "doc_id")}, doc_id) AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT id, label, CASE WHEN k <= round(0.25 * n) THEN 'test' ELSE 'train' END AS fold FROM r""",
    ),
    "drawn_half": (
        lambda s, d: op.least_drawn(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "orders").count() // 2, "o_orderkey", seed=3),
        f"SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY {_draw(3, 'o_orderkey')}, o_orderkey) <= (SELECT count(*) // 2 FROM orders)",
    ),
    "capped_groups": (
        lambda s, d: op.capped(trace(s, d).select("exp_id", "bead").distinct(), ["exp_id"], 5, "exp_id", "bead"),
        "WITH " + TRACE + f", b AS (SELECT DISTINCT exp_id, bead FROM trace) SELECT exp_id, bead FROM b QUALIFY row_number() OVER (PARTITION BY exp_id ORDER BY {_draw(42, 'exp_id', 'bead')}, exp_id, bead) <= 5",
    ),
    "bootstrap": (
        lambda s, d: op.bootstrapped(table(s, d, "labels"), 500, "doc_id"),
        f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels), d AS (SELECT range AS draw, CAST(floor({_draw(42, "range")} * (SELECT count(*) FROM labels)) AS BIGINT) AS i FROM range(500))
SELECT draw, doc_id, quality, toxic FROM d JOIN r USING (i)""",
    ),
    "clusters_kmeans": (_grouped("kmeans", max_k=4), None),
    "clusters_gmm": (_grouped("gmm", max_k=3, reduction="fpca", n_components=3), None),
    "clusters_hierarchical": (_grouped("hierarchical", max_k=4), None),
    "clusters_dbscan": (_grouped("dbscan"), None),
    "clusters_hdbscan": (_grouped("hdbscan", min_samples=3), None),
    "clusters_optics": (_grouped("optics", min_samples=3), None),
    "clusters_spectral": (_grouped("spectral", max_k=4), None),
    "clusters_dtw": (lambda s, d: group.clustered(_emb(s, d), ["grp"], "id", "dtw", max_k=3), None),
    "density_clusters": (
        _density,
        """WITH RECURSIVE v AS (SELECT vec_id // 50 AS grp, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
near AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.grp = y.grp AND x.id <> y.id WHERE list_distance(x.v, y.v) <= 1.25),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
reach(id, label) AS (SELECT id, id FROM core UNION SELECT b, label FROM reach JOIN near ON a = reach.id WHERE b IN (SELECT id FROM core)),
named AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
border AS (SELECT a AS id, min(label) AS edge FROM near JOIN named ON named.id = b GROUP BY a)
SELECT v.id, coalesce(label, edge, -1) AS label FROM v LEFT JOIN named USING (id) LEFT JOIN border USING (id)""",
    ),
    "reduction_fpca": (_reduced("fpca"), None),
    "reduction_isomap": (_reduced("isomap"), None),
    "reduction_lle": (_reduced("lle"), None),
    "reduction_laplacian": (_reduced("laplacian", n_neighbors=5), None),
    "reduction_tsne": (_reduced("tsne"), None),
    "reduction_umap": (_reduced("umap"), None),
    "reduction_dtw_mds": (lambda s, d: rounded(group.reduced(_emb(s, d), ["grp"], "id", "dtw_mds", 2).select("grp", "id", F.posexplode("v").alias("pos", "x"))), None),
    "kernel_features": (_kernels, None),
    "ridge_classifier": (_ridge, None),
    "models_evaluated": (_evaluated, None),
    "discriminator": (lambda s, d: rounded(models.discriminator(_features(s, d).where("label = 1"), _features(s, d).where("label = 0"), F8)), None),
    "global_kmeans": (lambda s, d: models.kmeans(_emb(s, d), 3).select("id", "label"), None),
    "global_mixture": (lambda s, d: models.mixture(models.pca(_emb(s, d), 3).select("id", F.col("scores").alias("v")), 2).select("id", "label"), None),
    "symbolic_words": (_words, _WORDS),
    "minirocket_classifier": (_minirocket, None),
    "simulated_traces": (_simulated, _SIMULATED),
    "split_traces": (_split, _SPLIT),
    "usable_states": (
        lambda s, d: generate.stretches(trace(s, d), ["bead"], "frame", 0.05).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("samples").alias("samples")),
        "WITH " + TRACE + _STRETCHES + " SELECT state, count(*) AS n, CAST(sum(samples) AS BIGINT) AS samples FROM sized GROUP BY state",
    ),
    "augmented_traces": (_augmented, _AUGMENTED),
    "bootstrap_synthetic": (_bootstrapped, _BOOTSTRAPPED),
    "drawn_features": (
        lambda s, d: rounded(generate.drawn_features(table(s, d, "customer"), "c_custkey").withColumnRenamed("c_custkey", "id")),
        f"""WITH f AS (SELECT c_custkey AS id, {", ".join(f"{lo}::DOUBLE + {hi - lo}::DOUBLE * {_draw(42 + k, 'c_custkey')} AS f{k}" for k, (lo, hi) in enumerate(generate.FEATURE_RANGES))} FROM customer),
m AS (SELECT median(f0) AS m0, median(f1) AS m1 FROM f), y AS (SELECT f.*, CASE WHEN f0 > m0 AND f1 > m1 THEN 1 ELSE 0 END AS y FROM f, m)
SELECT id, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, CASE WHEN {_draw(51, "id")} < 0.1 THEN 1 - y ELSE y END AS label FROM y""",
    ),
    "corrupted_lost_bead": (
        lambda s, d: rounded(generate.with_lost_bead(trace(s, d), ["bead"]).select("bead", "frame", "z")),
        "WITH " + TRACE + f""", a AS (SELECT *, min(t) OVER w + 0.5::DOUBLE * (max(t) OVER w - min(t) OVER w) AS loss FROM trace WINDOW w AS (PARTITION BY bead)),
b AS (SELECT *, min(CASE WHEN t < loss THEN z END) OVER w AS lo, max(CASE WHEN t < loss THEN z END) OVER w AS hi FROM a WINDOW w AS (PARTITION BY bead)), c AS (SELECT *, greatest(4.0::DOUBLE * (hi - lo), 2000.0::DOUBLE) AS margin FROM b)
SELECT bead, frame, round(CASE WHEN t >= loss THEN lo - margin + (hi - lo + 2.0::DOUBLE * margin) * {_draw(42, "bead", "frame")} ELSE z END, 6) AS z FROM c""",
    ),
    "corrupted_gaps": (
        lambda s, d: generate.with_gaps(trace(s, d), trace(s, d).where("frame % 10 = 0").select("bead", F.col("t").alias("g0"), (F.col("t") + 50000.0).alias("g1")), ["bead"]).groupBy("bead").agg(F.count_if(F.isnan("z")).alias("n")),
        "WITH " + TRACE + ", g AS (SELECT bead, t AS g0, t + 50000.0::DOUBLE AS g1 FROM trace WHERE frame % 10 = 0), h AS (SELECT DISTINCT t.bead, t.frame FROM trace t JOIN g ON g.bead = t.bead AND t.t >= g0 AND t.t < g1) SELECT bead, count(*) AS n FROM h GROUP BY bead",
    ),
    "corrupted_drift": (
        lambda s, d: rounded(generate.with_drift(trace(s, d), ["bead"], 0.001).select("bead", "frame", "z"), digits=5),
        "WITH " + TRACE + " SELECT bead, frame, round(z + 0.001::DOUBLE * (t - min(t) OVER (PARTITION BY bead)), 5) AS z FROM trace",
    ),
    "corrupted_noise": (
        lambda s, d: rounded(generate.with_noise(trace(s, d).withColumn("clean", F.floor("z").cast("double")), ["bead"]).select("bead", "frame", "z")),
        "WITH " + TRACE + f""", n AS (SELECT *, stddev_pop(z - floor(z)) OVER (PARTITION BY bead) AS sd FROM trace)
SELECT bead, frame, round(z + sqrt(-2.0::DOUBLE * ln(greatest({_draw(42, "bead", "frame")}, 1e-15::DOUBLE))) * cos(2.0::DOUBLE * pi() * {_draw(43, "bead", "frame")}) * sd * 2.0::DOUBLE, 6) AS z FROM n""",
    ),
}


def _jobs(s, d):
    from seqloom.plans import jobs
    from seqloom.plans.fixtures import curves

    keys = ["exp_id", "bead"]
    truth = trace(s, d).select(*keys).distinct().withColumn("y", (F.col("bead") % 2).cast("int"))
    return curves(s, d), truth, keys, jobs


def _evaluation(s, d):
    rows, truth, keys, jobs = _jobs(s, d)
    chosen = [jobs.Pipeline("pct-kmeans", "percentile_grid", n_grid=21, max_k=3), jobs.Pipeline("force-fpca-gmm", "force_percentile_grid", "fpca", "gmm", n_components=2, n_grid=21, max_k=2), jobs.Pipeline("arc-lle-dbscan", "arc_length_percentile", "lle", "dbscan", n_components=2, n_grid=21, min_samples=3)]
    return rounded(jobs.evaluate(rows, truth, keys, chosen))


def _ensemble(s, d):
    rows, truth, keys, jobs = _jobs(s, d)
    members = [jobs.Pipeline("a", "percentile_grid", n_grid=21, n_clusters=2), jobs.Pipeline("b", "force_percentile_grid", n_grid=21, n_clusters=2), jobs.Pipeline("c", "percentile_grid_normalised", clustering="hierarchical", n_grid=21, n_clusters=2)]
    return jobs.ensemble(rows, truth, keys, members)


def _told(s, d):
    """Truth, cluster (some beads have none, some are outliers) and best-cluster prediction of beads in extensions of experiments."""
    from seqloom.plans import jobs

    v = table(s, d, "embeddings").select(
        F.lit("given").alias("pipeline"), (F.col("vec_id") % 7).alias("exp_id"), (F.floor(F.col("vec_id") / 7) % 3).alias("ext"), F.col("vec_id").alias("bead"),
        F.when(F.col("vec_id") % 5 < 2, 1).otherwise(0).alias("y"),
        F.when(F.col("label") % 11 == 3, F.lit(None)).when(F.col("label") % 5 == 4, -1).otherwise((F.col("label") + F.when(F.col("vec_id") % 5 < 2, F.col("vec_id") % 2).otherwise(0)) % 3).cast("int").alias("label"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("silhouette"),
    )
    return jobs.good_by_group(v, ["pipeline", "exp_id", "ext"]), jobs


def _result_rows(index):
    def query(s, d):
        told, jobs = _told(s, d)
        return rounded(jobs.result_rows(told, ["exp_id"], "ext", index).select("pipeline", "exp_id", "n_extensions", *[F.col(c) for c in RESULT_VALUES]))

    return query


RESULT_VALUES = "accuracy ari nmi n_beads n_clusters cluster_counts n_outliers n_good_in_clustering n_bad_in_clustering tp tn fp fn chosen_cluster_size n_good_real n_bad_real".split()


def _result_sql(index):
    pick = "CASE WHEN {i} < 0 THEN 1 ELSE least({i} + 1, n_extensions) END".format(i=index)
    mean = ", ".join(f"round(avg({c}), 6) AS m_{c}" for c in ("accuracy", "ari", "nmi"))
    chosen = ", ".join((f"round(m_{c}, 6)" if index < 0 else f"round(e.{c}, 6)") + f" AS {c}" for c in ("accuracy", "ari", "nmi"))
    beads = "CAST(sum_beads AS BIGINT)" if index < 0 else "e.n_beads"
    return f"""
WITH v AS (SELECT vec_id % 7 AS exp_id, (vec_id // 7) % 3 AS ext, vec_id AS bead, CASE WHEN vec_id % 5 < 2 THEN 1 ELSE 0 END AS y,
  CASE WHEN label % 11 = 3 THEN NULL WHEN label % 5 = 4 THEN -1 ELSE (label + CASE WHEN vec_id % 5 < 2 THEN vec_id % 2 ELSE 0 END) % 3 END AS label FROM embeddings),
c AS (SELECT exp_id, ext, label, count(*) AS k, count_if(y = 1) - CAST(count_if(y <> 1) AS BIGINT) AS lead FROM v WHERE label IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT exp_id, ext, label AS best FROM c WHERE label >= 0 QUALIFY row_number() OVER (PARTITION BY exp_id, ext ORDER BY lead DESC, label) = 1),
t AS (SELECT v.*, CASE WHEN v.label = b.best THEN 1 ELSE 0 END AS p FROM v LEFT JOIN b USING (exp_id, ext)),
m AS (SELECT exp_id, ext, count(*) AS n_beads, CAST(count_if(y = 1 AND p = 1) AS BIGINT) AS tp, CAST(count_if(y <> 1 AND p <> 1) AS BIGINT) AS tn, CAST(count_if(y <> 1 AND p = 1) AS BIGINT) AS fp, CAST(count_if(y = 1 AND p <> 1) AS BIGINT) AS fn, count_if(y = p) / count(*)::DOUBLE AS accuracy,
  CAST(count_if(p = 1) AS BIGINT) AS chosen_cluster_size, CAST(count_if(y = 1) AS BIGINT) AS n_good_real, CAST(count_if(y <> 1) AS BIGINT) AS n_bad_real FROM t GROUP BY 1, 2),
q AS (SELECT *, n_beads::DOUBLE AS n, tp::DOUBLE AS a11, fn::DOUBLE AS a10, fp::DOUBLE AS a01, tn::DOUBLE AS a00 FROM m),
r AS (SELECT *, a11 * (a11 - 1) / 2 + a10 * (a10 - 1) / 2 + a01 * (a01 - 1) / 2 + a00 * (a00 - 1) / 2 AS s,
  (a11 + a10) * (a11 + a10 - 1) / 2 + (a01 + a00) * (a01 + a00 - 1) / 2 AS a, (a11 + a01) * (a11 + a01 - 1) / 2 + (a10 + a00) * (a10 + a00 - 1) / 2 AS b, n * (n - 1) / 2 AS t2,
  -(CASE WHEN a11 + a10 > 0 THEN (a11 + a10) / n * ln((a11 + a10) / n) ELSE 0 END + CASE WHEN a01 + a00 > 0 THEN (a01 + a00) / n * ln((a01 + a00) / n) ELSE 0 END) AS hy,
  -(CASE WHEN a11 + a01 > 0 THEN (a11 + a01) / n * ln((a11 + a01) / n) ELSE 0 END + CASE WHEN a10 + a00 > 0 THEN (a10 + a00) / n * ln((a10 + a00) / n) ELSE 0 END) AS hp,
  -(CASE WHEN a11 > 0 THEN a11 / n * ln(a11 / n) ELSE 0 END + CASE WHEN a10 > 0 THEN a10 / n * ln(a10 / n) ELSE 0 END + CASE WHEN a01 > 0 THEN a01 / n * ln(a01 / n) ELSE 0 END + CASE WHEN a00 > 0 THEN a00 / n * ln(a00 / n) ELSE 0 END) AS hj FROM q),
k AS (SELECT exp_id, ext, string_agg(CAST(k AS VARCHAR), ',' ORDER BY label) FILTER (WHERE label >= 0) AS cluster_counts, CAST(count_if(label >= 0) AS BIGINT) AS n_clusters, CAST(coalesce(sum(k) FILTER (WHERE label < 0), 0) AS BIGINT) AS n_outliers FROM c GROUP BY 1, 2),
e AS (SELECT r.*, k.cluster_counts, k.n_clusters, k.n_outliers, CASE WHEN (a + b) / 2 = a * b / t2 THEN 1.0 ELSE (s - a * b / t2) / ((a + b) / 2 - a * b / t2) END AS ari,
  CASE WHEN hy < 1e-15 AND hp < 1e-15 THEN 1.0 ELSE 2 * (hy + hp - hj) / (hy + hp) END AS nmi, row_number() OVER (PARTITION BY exp_id ORDER BY ext) AS i, count(*) OVER (PARTITION BY exp_id) AS n_extensions FROM r LEFT JOIN k USING (exp_id, ext)),
w AS (SELECT exp_id, {mean}, sum(n_beads) AS sum_beads FROM e GROUP BY 1)
SELECT 'given' AS pipeline, e.exp_id, n_extensions, {chosen}, {beads} AS n_beads, n_clusters, cluster_counts, n_outliers, n_good_real AS n_good_in_clustering, n_bad_real AS n_bad_in_clustering, tp, tn, fp, fn, chosen_cluster_size, n_good_real, n_bad_real
FROM e JOIN w USING (exp_id) WHERE i = {pick}"""


def _scored_rules(s, d):
    _, truth, keys, jobs = _jobs(s, d)
    return rounded(jobs.score_rules(trace(s, d), truth, keys, ["exp_id"], n_sigma=2.5, gap_len=3))


def _windows(s, d):
    from seqloom.streaming import windows

    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(windows.windowed(e, "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "mean", "ptp"))


_SCORED_RULES = "WITH " + TRACE + """,
s AS (SELECT *, z - lag(z) OVER (PARTITION BY exp_id, bead ORDER BY frame) AS d FROM trace),
r AS (SELECT *, sum(CASE WHEN coalesce(abs(d) <= 1e-6, false) THEN 0 ELSE 1 END) OVER (PARTITION BY exp_id, bead ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM s),
l AS (SELECT *, count(*) FILTER (abs(d) <= 1e-6) OVER (PARTITION BY exp_id, bead, run) AS len FROM r),
f AS (SELECT exp_id, bead, bead % 2 AS y, CASE WHEN stddev_pop(z) <= 1e-6 OR max(len) >= 3 OR coalesce(max(abs(d)) > 2.5 * CASE WHEN coalesce(stddev_pop(d), 0) <= 0 THEN 1e-10 ELSE stddev_pop(d) END, false) THEN 0 ELSE 1 END AS p FROM l GROUP BY 1, 2)
SELECT exp_id, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) AS n, count(*) FILTER (y = p) AS correct, round(count(*) FILTER (y = p) / count(*), 6) AS accuracy, 'rules' AS method FROM f GROUP BY exp_id"""


QUERIES |= {
    "evaluated_pipelines": (_evaluation, None),
    "ensemble_pipelines": (_ensemble, None),
    "result_rows": (_result_rows(-1), _result_sql(-1)),
    "result_rows_of_extension": (_result_rows(1), _result_sql(1)),
    "scored_rules": (_scored_rules, _SCORED_RULES),
    "event_windows": (_windows, "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS ptp FROM events GROUP BY 1, 2"),
}
