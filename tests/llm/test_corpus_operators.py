"""Near-dedup, decontamination, mixing, token shards, LM scores, toxicity, media: brute force and odd inputs."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, flac, lm_score, mixing, token_shards, toxicity
from seqloom.llm.shingles import common, shingle_set, words

WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=5):
    """Groups of edited copies, exact copies, short, empty and repeated rows."""
    rng, out = random.Random(seed), []
    for g in range(12):
        base = sentence(rng, rng.randint(8, 120)).split()
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            out.append(" ".join(text).upper() if rng.random() < 0.3 else "\t".join(text))
    out += ["", None, "   ", "one two", "One  TWO", "one two three", sentence(rng, 20000)]
    out.append(out[-1])
    return out


def test_shingles_are_those_of_the_definition():
    for text in corpus():
        assert len(shingle_set(text)) == len(plain_set(text))
    a, b = shingle_set("A b c d e f g h"), shingle_set("a B c d e f x y")
    assert common(a, b) == 2 and common(a, shingle_set(None)) == 0


def test_contamination_against_all_pairs(spark):
    rng = random.Random(4)
    items = [sentence(rng, n) for n in (3, 5, 7, 15, 33, 60, 120)] + ["", None]
    docs = []
    for text in items * 3:
        body = sentence(rng, rng.choice((0, 30, 5000)))
        kept = (text or "").split()
        if kept and rng.random() < 0.5:
            kept[rng.randrange(len(kept))] = "edited"
        docs.append(f"{body} {' '.join(kept)} {sentence(rng, 10)}")
    docs += ["", None, items[0], items[0].upper(), " ".join(items[5].split()[:30])]
    want = set()
    for i, d in enumerate(docs):
        for k, q in enumerate(items):
            s = plain_set(q)
            if s and 100 * len(s & plain_set(d)) >= 75 * len(s):
                want.add((i, k, len(s & plain_set(d)), len(s)))
    dd = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bb = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert want
    for block in (decontaminate.BLOCK_BYTES, 6000):  # one pass, and many blocks
        got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.find_contamination(dd, bb, block_bytes=block).collect()}
        assert got == want
    left = {r["doc_id"] for r in decontaminate.decontaminate(dd.withColumn("item_id", F.lit("x")), bb).collect()}
    assert left == set(range(len(docs))) - {i for i, *_ in want}
    assert decontaminate.find_contamination(dd.where("false"), bb).count() == 0
    assert decontaminate.find_contamination(dd, bb.where("false")).count() == 0
    assert decontaminate.decontaminate(dd, bb.where("false")).count() == len(docs)


def brute_targets(totals, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, target, open_ = share * sum(totals.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= most * totals[s]]
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = float(most * totals[s])
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_reaches_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(0, 60)), rng.choice(["b", "a", "é", None, "z"] + ["hot"] * 5), "x") for i in range(900)]
    rows += [(1000, None, "a", "x"), (1001, "", "only", "x"), (None, "some words here", "b", "x"), (5, "twice twice", "a", "x"), (5, "twice twice", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    totals, taken, biggest = collections.Counter(), collections.Counter(), 0
    for r in got:
        assert r["__size"] == len(words(r["text"])) and r["__taken"] in (0, r["__size"], 2 * r["__size"])
        totals[r["source"]] += r["__size"]
        taken[r["source"]] += r["__taken"]
        biggest = max(biggest, r["__size"])
    targets = brute_targets(totals)
    for r in got:
        assert r["__total"] == totals[r["source"]] and math.isclose(r["__target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 2 * biggest
    assert sum(taken.values()) <= 1.5 * sum(totals.values())
    again = {(r["doc_id"], r["text"], r["__taken"]) for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text"], r["__taken"]) for r in got}
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix_sources(df.where("false")).count() == 0
    assert all(r["__taken"] == 0 for r in mixing.mix_sources(df.where("doc_id = 1001")).collect())


def test_mix_with_clashing_columns_and_rows_without_ids(spark):
    rows = [(None, f"some words {'more ' * (i % 5)}", f"s{i % 2}", i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __part int")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and all(r["__size"] == r["__part"] for r in mixed.collect())
    again = mixing.mixed_documents(df.repartition(5))
    count = lambda d: collections.Counter((r["text"], r["source"]) for r in d.collect())
    assert count(mixed) == count(again)
    # keys of rows without an id differ by text
    keyed = mixing._keyed(df, "doc_id", "text", "source", "mix")
    assert keyed.select("__key").distinct().count() == df.select("text").distinct().count()


def test_ids_come_through_every_operator(spark):
    """Ids beyond 2**53 beside a null, text ids, and columns named like working ones."""
    big = 2**53 + 1
    rows = [(big, "a text of some words here", 1, 2), (None, None, 3, 4), (big + 2, "", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, c0 int")
    items = spark.createDataFrame([(big, "text of some words here"), (None, "a text of some words")], "item_id long, text string")
    want = {big, None, big + 2}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs, items).collect()} == {(big, big), (big, None)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {None, big + 2}
    assert {r["doc_id"] for r in mixing.mix_sources(docs.withColumn("source", F.lit("s"))).collect()} == want
    assert {r["doc_id"] for r in flac.with_media(docs).collect()} == want
    assert {r["doc_id"] for r in flac.pcm_blocks(flac.with_media(docs)).collect()} == want
    scored = toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), toxicity.default_grammar(), score_col="s").collect()
    assert {r["doc_id"] for r in scored} == want and all(r["score"] == "x" for r in scored)
    target = spark.createDataFrame([(big,), (None,)], "doc_id long")
    marked = lm_score.marked(docs, target)
    assert {r["doc_id"]: r["target"] for r in marked.collect()} == {big: True, None: False, big + 2: False}
    assert {r["doc_id"] for r in lm_score.score_words(marked).collect()} == want
    by_bytes = lm_score.score_documents(docs, lm_score.train(marked)).collect()
    assert {r["doc_id"] for r in by_bytes} == want
    text_ids = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r["doc_id"] for r in decontaminate.find_contamination(text_ids, items).collect()} == {str(big)}
    assert {r["doc_id"] for r in lm_score.score_words(lm_score.marked(text_ids, target)).collect()} == {str(big), None, str(big + 2)}


def test_marks_by_shuffle_equal_marks_by_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40 if i % 3 else None, "t") for i in range(200)], "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    count = lambda: collections.Counter((r["doc_id"], r["target"]) for r in lm_score.marked(docs, target).collect())
    by_broadcast = count()
    monkeypatch.setattr(lm_score, "MAX_BROADCAST_IDS", 1)
    assert count() == by_broadcast


def test_rows_without_an_id_are_never_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "calm"), (2**53 + 3, "calm")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["held_out"] for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect()}
    assert got == {None: False, 2**53 + 3: zlib.crc32(str(2**53 + 3).encode()) % 5 == 0}


def test_one_text_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 10).groupBy("id").count().where("count > 1").count() == 0


def test_machines_against_a_plain_reading():
    """Modes of random clauses, word by word from the definition of voice and address."""
    rng, reader = random.Random(4), toxicity.Reader(toxicity.default_grammar())
    for _ in range(500):
        clause = [rng.choice(["you", "not", "never", "said", "idiot", "moron", "kill", "tree", "house"]) for _ in range(rng.randint(1, 9))]
        voice, want = "own", []
        for w in clause:
            if w in ("idiot", "moron", "kill"):
                aimed = "you" in clause
                mode = voice if voice != "own" else "aimed" if aimed else "plain"
                want.append((mode, w, f"{w}$", 0.5 if w == "kill" and not aimed else 1.0))
            elif w in ("not", "never"):
                voice = "own" if voice == "negated" else "negated"
            elif w == "said":
                voice = "reported"
        assert reader.matches(" ".join(clause)) == want


def test_mix_has_no_python_in_its_plan(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", "t")], "doc_id long, text string, source string")
    plan = mixing.mix_sources(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_keyed_bijection(n):
    x = np.arange(n)
    y = token_shards.feistel(x, n)
    assert sorted(y.tolist()) == x.tolist()
    assert token_shards.feistel(y, n, inverse=True).tolist() == x.tolist()
    if n >= 1000:
        assert (token_shards.feistel(x, n, key=1) != y).mean() > 0.9 and (y == x).mean() < 0.05


def test_token_shards_round_trip(spark, tmp_path):
    texts = ["", None, "hello world", "é ü 漢字 \U0001f600", "word " * 3000, "<|endoftext|> is text"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(2, "hello world", 0)], "doc_id long, text string, slot int")
    ordered = token_shards.training_order(df, seq_len=64, shard_records=16)
    rows = ordered.collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == list(range(n))
    assert all(r["shard"] == r["slot"] // 16 and r["byte_offset"] == r["slot"] % 16 * 130 and len(r["record"]) == 130 for r in rows)
    encoding = token_shards.load_tokenizer(token_shards.TOKENIZER)
    by_doc = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["seq_no"]):
        ids = np.frombuffer(r["record"], "<u2")
        assert ids[0] == r["n_tokens"]
        if r["doc_id"] != 2:
            by_doc[r["doc_id"]] += ids[1 : 1 + ids[0]].tolist()
    for i, t in enumerate(texts):
        if i != 2:
            assert by_doc[i][-1] == token_shards.END and encoding.decode(by_doc[i][:-1]) == (t or "")
    path = str(tmp_path / "shards")
    token_shards.write_shards(ordered, path)
    stored = spark.read.parquet(path).collect()
    assert all(zlib.crc32(r["payload"]) == r["crc32"] and len(r["payload"]) == r["stride"] * r["n_records"] for r in stored)
    some = {r["slot"]: r["record"] for r in token_shards.read_slots(spark, path, 10, 40).collect()}
    assert some == {r["slot"]: r["record"] for r in rows if 10 <= r["slot"] <= 40}
    assert token_shards.training_order(df.where("false")).count() == 0


def plain_slot(x, n, key=token_shards.KEY, rounds=token_shards.ROUNDS):
    """The permutation in plain integers, one number at a time."""
    full = 2**64 - 1

    def mix(v):
        v ^= v >> 33
        v = v * 0xFF51AFD7ED558CCD & full
        v ^= v >> 33
        v = v * 0xC4CEB9FE1A85EC53 & full
        return v ^ v >> 33

    half = 1
    while 4**half < n:
        half += 1
    keys = [mix((r * 0x9E3779B97F4A7C15 & full) ^ key) for r in range(1, rounds + 1)]
    while True:
        left, right = x >> half, x % 2**half
        for k in keys:
            left, right = right, left ^ mix(right ^ k) % 2**half
        x = left << half | right
        if x < n:
            return x


def test_slots_follow_content_not_layout(spark, tmp_path):
    big = 2**53 + 1
    rows = [(big + 2, "b " * 300), (None, "n"), (big, "a " * 200), (3, "x"), (3, "y " * 90), (3, "x"), (None, None)] + [(i, f"text {i} " * (i % 7)) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [token_shards.sharded(d, path=str(tmp_path / str(k)), seq_len=16, shard_records=8).collect() for k, d in enumerate((df.coalesce(1), df.repartition(5, "text"), df.orderBy(F.desc("doc_id"))))]
    assert sorted(map(tuple, got[0]), key=str) == sorted(map(tuple, got[1]), key=str) == sorted(map(tuple, got[2]), key=str)
    # brute force: documents by id, then by the text's hash; each sequence in its slot
    encoding = token_shards.load_tokenizer(token_shards.TOKENIZER)
    hashes = {tuple(r)[:2]: r["h"] for r in df.select("*", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    sequences = []
    for doc, text in ordered:
        ids = [*encoding.encode_ordinary(text or ""), token_shards.END]
        for k in range(0, len(ids), 16):
            part = ids[k : k + 16]
            sequences.append((doc, k // 16, len(part), np.array([len(part), *part, *[token_shards.END] * (16 - len(part))], "<u2").tobytes()))
    n = len(sequences)
    want = {plain_slot(k, n): s for k, s in enumerate(sequences)}
    assert {r["slot"]: (r["doc_id"], r["seq_no"], r["n_tokens"], bytes(r["record"])) for r in got[0]} == want
    assert all((r["shard"], r["byte_offset"]) == (r["slot"] // 8, r["slot"] % 8 * 34) for r in got[0])


def test_shards_of_text_ids_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "two words", 1), ("a", None, 2)], "doc_id string, text string, slot int")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_shards.sharded(df).collect()} == {("b", 3), ("a", 1)}
    assert token_shards.sharded(df.where("false")).count() == 0


def test_a_damaged_shard_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    token_shards.sharded(df, path=str(tmp_path / "a"))
    blobs = spark.read.parquet(str(tmp_path / "a")).withColumn("payload", F.concat(F.lit(b"x"), F.expr("substring(payload, 2)")))
    blobs.write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged"):
        token_shards.read_shards(spark, str(tmp_path / "b")).collect()


def test_lm_scores_against_direct_counts(spark):
    docs = [(1, "hello there", True), (2, "hello world", False), (3, None, False), (4, "hello hello", True), (5, "", False), (5, "", False), (6, "x" * 50000, False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean")
    counts = {False: collections.Counter(), True: collections.Counter()}
    for _, t, g in docs:
        raw = [256, 256, *(t or "").encode(), 256]
        for k in range(2, len(raw)):
            for kind in {False, g}:
                counts[kind][tuple(raw[k - 2 : k + 1])] += 1

    def loss(c, t):
        one, two, y1, xy1 = (collections.Counter() for _ in range(4))
        for (x, y, z), n in c.items():
            one[z] += n
            two[y, z] += n
            y1[y] += n
            xy1[x, y] += n
        total, raw = 0.0, [256, 256, *(t or "").encode(), 256]
        for k in range(2, len(raw)):
            x, y, z = raw[k - 2 : k + 1]
            p = (one[z] + 1) / (sum(one.values()) + 257)
            p = (two[y, z] + 8 * p) / (y1[y] + 8)
            total -= math.log2((c[x, y, z] + 8 * p) / (xy1[x, y] + 8))
        return total / (len(raw) - 2)

    scored = lm_score.score_documents(df, lm_score.train(df)).collect()
    assert len(scored) == len(docs)
    for r in scored:
        text = next(t for i, t, _ in docs if i == r["doc_id"])
        if r["doc_id"] < 6:
            assert math.isclose(r["target_loss"], loss(counts[True], text), rel_tol=1e-9)
            assert math.isclose(r["background_loss"], loss(counts[False], text), rel_tol=1e-9)
        assert r["score"] == r["target_loss"] - r["background_loss"] and r["n_tokens"] == len((text or "").encode()) + 1
    none = df.withColumn("target", F.lit(False))
    assert all(r["score"] == 0 for r in lm_score.score_documents(none, lm_score.train(none)).collect())


def test_word_scores_against_direct_counts(spark, monkeypatch):
    docs = [(1, "the cat  sat", True), (2, "the dog sat on The cat", False), (3, None, False), (4, "cat the sat", True), (5, "", None), (5, "", None), (None, "dog\tcat " * 900, False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean")
    monkeypatch.setattr(lm_score, "BATCH", 20)
    one, two = ({k: collections.Counter() for k in (False, True)} for _ in range(2))
    for _, t, g in docs:
        w = [b"<", *words(t), b">"]
        for kind in {False, bool(g)}:
            one[kind].update(w[1:])
            two[kind].update(zip(w, w[1:]))

    def loss(kind, t):
        w, n, out = [b"<", *words(t), b">"], sum(one[kind].values()), []
        for y, z in zip(w, w[1:]):
            p1 = (one[kind][z] + 1) / (n + len(one[False]) + 1)
            out.append(-math.log2((two[kind][y, z] + 8 * p1) / (one[kind][b">" if y == b"<" else y] + 8)))
        return sum(out) / len(out)

    rows = lm_score.score_words(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = next(t for i, t, _ in docs if i == r["doc_id"])
        assert r["n_tokens"] == len(words(text)) + 1
        assert math.isclose(r["target_loss"], loss(True, text), rel_tol=1e-9) and math.isclose(r["background_loss"], loss(False, text), rel_tol=1e-9)
        assert r["score"] == r["target_loss"] - r["background_loss"]
    seen = {r["doc_id"]: r["background_loss"] for r in rows}
    assert abs(seen[1] - seen[4]) > 0.01  # the order of the same words counts
    assert all(r["score"] == 0 for r in lm_score.score_words(df.withColumn("target", F.lit(False))).collect())
    assert lm_score.score_words(df.where("false")).count() == 0
    # the same by merged groups, where some two owners meet in a cell
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])
    assert sorted(lm_score.score_words(df.repartition(7), fan=2).collect(), key=key) == sorted(rows, key=key)


def test_word_scores_merge_over_several_levels(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "cat", f"w{rng.randrange(40)}", f"only{i}"]) for _ in range(30)), i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean").repartition(60)
    assert lm_score._batches(df, "text", "target", ("doc_id",)).count() > 3 * 3 * 6  # batches, groups, groups of groups
    flat, deep = ({r["doc_id"]: r for r in lm_score.score_words(df, fan=fan).collect()} for fan in (lm_score.FAN, 3))
    assert flat == deep and len(flat) == 400


def test_lm_query_scores_words(spark, tmp_path):
    spark.createDataFrame([(1, "ab cd"), (2, "cd ab ab")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["doc_id"]: r for r in lm_score.op10_lm_score(spark, str(tmp_path)).collect()}
    assert rows[1]["n_tokens"] == 3 and rows[2]["n_tokens"] == 4 and rows[1]["score"] < rows[2]["score"]


def test_clauses_are_taken_whole():
    reader = toxicity.Reader(toxicity.default_grammar())
    modes = lambda text: [mode for mode, *_ in reader.matches(text)]
    for n in (1, 60, 90, 5000):
        far = "quiet " * n
        assert modes(f"you {far}idiot") == ["aimed"] and modes(f"never {far}idiot") == ["negated"] and modes(f"says {far}idiot") == ["reported"]
        assert modes(f"never. {far}idiot") == ["plain"] and modes(f"never idiot, {far}idiot") == ["negated", "plain"]


def test_toxicity_learns_and_holds_out(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        text = sentence(rng, rng.randint(20, 80)).split()
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(3, 6) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["zorg", "zorgen", "zorgal", "zorgut", "blip"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "zorgen zorgal blip " * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i in (0, 17, 899):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(y, got[i]["predicted"]) for i, _, y in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[5002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_clause_transducer_modes():
    reader = toxicity.Reader(toxicity.default_grammar())
    modes = lambda text: [m for m, *_ in reader.matches(text)]
    assert modes("what a moron.") == ["plain"]
    assert modes("you are a moron") == ["aimed"]
    assert modes("that is not a moron") == ["negated"]
    assert modes("she said idiot, idiot") == ["reported", "plain"]
    assert modes("nothing here") == [] and modes(None) == [] and modes("moronic") == []
    assert reader.score("you idiot. you moron. you scum.") > reader.score("not an idiot") > reader.score("calm prose")


def test_default_grammar_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 10)).coefficients.tolist() == toxicity._FIXED.tolist()


def payloads():
    rng = np.random.default_rng(1)
    out = [flac.payload_of(t)[0] for t in (None, "", "abc", "x" * 1000, "é" * 300, "hello world " * 100, "漢字" * 4000)]
    out += [rng.integers(0, 256, 192 * k, dtype=np.uint8).tobytes() for k in (1, 3, 200)]
    t = np.arange(192 * 40)
    return [*out, (128 + 100 * np.sin(t / 30)).astype(np.uint8).tobytes(), (t % 251).astype(np.uint8).tobytes(), bytes([0, 255] * 96 * 3), bytes(192 * 5)]


def test_flac_round_trip_and_both_readers():
    data = payloads()
    streams = flac.encode(data, frames_at_once=50)
    assert flac.decode(streams, frames_at_once=64) == data
    assert flac.encode([data[5]]) == [streams[5]]
    for stream, payload in zip(streams, data, strict=True):
        at, total, _, offsets = flac._layout(stream)
        parts, n = [], 0
        for k in range(len(offsets)):
            x, end = flac._read_frame(stream, at + int(offsets[k]))
            parts.append(x.astype(np.int8))
            n += len(x)
        assert n == total and end == len(stream)
        assert (np.concatenate(parts).view(np.uint8) ^ 0x80).tobytes() == payload


@pytest.mark.parametrize("where", [-1, -30, 60, 90])
def test_flac_notices_damage(where):
    stream = bytearray(flac.encode([flac.payload_of("some text to store " * 40)[0]])[0])
    stream[where] ^= 0x10
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_media_query_reads_stored_streams(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stored = []
    monkeypatch.setattr(flac, "materialized", lambda df, f=flac.materialized: stored.append(f(df)) or stored[-1])
    rows = flac.op8_flac_media(spark, str(tmp_path)).collect()
    assert len(stored) == 1 and {r["doc_id"]: len(r["media"]) for r in stored[0].collect()} == {r["doc_id"]: r["media_bytes"] for r in rows}


def test_media_query_and_pcm_blocks(spark, tmp_path):
    import hashlib

    texts = ["", None, "abc", "abc", "word " * 40000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in flac.op8_flac_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        payload, n = flac.payload_of(t)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2][1:] == rows[3][1:] and rows[0][1:] == rows[1][1:]
    media = flac.with_media(spark.read.parquet(str(tmp_path / "documents.parquet")))
    blocks = flac.pcm_blocks(media, block_samples=4096).orderBy("doc_id", "block").collect()
    for i, t in enumerate(texts):
        own = [b for b in blocks if b["doc_id"] == i]
        assert b"".join(b["pcm"] for b in own) == flac.payload_of(t)[0]
        assert all(b["sample_offset"] == b["block"] * 4096 and b["n_samples"] == len(b["pcm"]) for b in own)
    assert flac.pcm_blocks(media.where("false")).count() == 0


def test_all_stems_with_enough_evidence_are_chosen():
    # 300 stems, each in seven toxic documents of its own, among clean ones that hold none
    features = [(f"stem{k:03d}$", 1) for k in range(300)]
    rows = [np.array([k]) for k in range(300) for _ in range(7)] + [np.array([], np.int64)] * 20_000
    toxic = np.array([1.0] * 2100 + [0.0] * 20_000)
    assert set(toxicity.choose_stems(features, rows, toxic)) == {s for s, _ in features}


def test_an_index_is_bounded_by_its_bytes_not_by_its_texts(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"item {k} of many") for k in range(3000)], "item_id long, text string")
    blocks = list(decontaminate._indexes(items, "item_id", "text", 75, 128, 5, 1 << 20))
    sizes = [sum(keys.nbytes + held.nbytes for _, keys, held in b.classes) + b.seen.nbytes + b.values.nbytes + sum(s.nbytes for s in b.sets) for b in blocks]
    assert len(blocks) > 4 and max(sizes) < 1.3 * (1 << 20) and sum(len(b.ids) for b in blocks) == 3000
    docs = spark.createDataFrame([(1, "item 7 of many"), (2, "item 9999 of many")], "doc_id long, text string")
    found = decontaminate.find_contamination(docs, items, block_bytes=1 << 20).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 7)]
