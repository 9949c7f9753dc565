"""Conversation repair: all edit sequences by brute force, stretches against whole paths, odd inputs."""

import hashlib
import itertools
import random
import re

import pytest

from seqloom.llm import conversation_repair as cr

MARKS = ("Hi.", "Why?", "and", "", " \t", "ok!", "Hi.")


def brute(rows):
    """(cost, labels, repaired) of the cheapest edits of (role, text) rows, from all sequences that matter."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        ways = [(4, "D", None)]
        if fault not in ("b", "d"):
            more = 3 * (fault == "t")
            ways += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        choices.append([(3 * len(put) + cost, "I" * len(put) + label, [*((p, "") for p in put), *([out] if out else [])]) for put in inserts for cost, label, out in ways])
    choices.append([(3 * len(put), "I" * len(put), [(p, "") for p in put]) for put in inserts])
    best = None
    for picked in itertools.product(*choices):
        out = [turn for _, _, part in picked for turn in part]
        if re.fullmatch(r"(s?(ua)+)?", "".join(role[:1] or " " for role, _ in out)):
            found = (sum(c for c, _, _ in picked), "".join(s for _, s, _ in picked), out)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def test_cheapest_edits_against_all_sequences(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(("user", "assistant", "system", "tool", "")), rng.choice(MARKS)) for _ in range(rng.randint(1, 4))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
        want[c] = brute(turns)
    edits, summary = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["c"]: r for r in summary.collect()}
    assert len(got) == 60
    for c, (cost, audit, out) in want.items():
        text = "\n".join(f"{role}:{text}" for role, text in out)
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), c
    kept = edits.where("role is not null").orderBy("c", "mid", "sub").collect()
    for c in want:
        assert [(r["role"], r["text"]) for r in kept if r["c"] == c] == want[c][2]


def test_stretches_join_to_the_path_of_the_whole():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(2, 14))]
        cut = rng.randint(1, len(rows) - 1)
        whole, left, right = cr.weights_of(rows), cr.weights_of(rows[:cut]), cr.weights_of(rows[cut:])
        for g, h in itertools.product(range(4), repeat=2):
            ways = [(a[0] + b[0], a[1] + b[1]) for k in range(4) if (a := left[g][k]) and (b := right[k][h])]
            assert whole[g][h] == min(ways, default=None)


def test_a_long_conversation_is_split_and_joined(spark, monkeypatch):
    rng = random.Random(5)
    turns = [(t // 2, rng.choice(("user", "assistant", "system")), f"{rng.choice(MARKS)} {rng.randint(0, 40)}{rng.choice('. ')}") for t in range(1500)]
    turns.sort(key=lambda r: r)
    frame = spark.createDataFrame([(7, *t) for t in turns] + [(8, *t) for t in turns[:3]], "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, cr.repair(frame)[1].collect()))
    monkeypatch.setattr(cr, "PIECE", 16)
    assert sorted(map(tuple, cr.repair(frame)[1].collect())) == whole and len(whole[0][7]) >= 1500
    labels, n = whole[0][7], 0
    for label in labels:  # each label but an insert reads one row
        n += label != "I"
    assert n == 1500


def test_nulls_ties_copies_clashing_names_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, c string, mid int, fault string"
    more = ("c", 1, "f")
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 2, "user", "b."), (1, 2, "assistant", "a."), (1, 2, "user", "a."), (2, 0, "user", "x."), (2, 0, "user", "x."), (2, 0, "user", "x."), (2, 5, "assistant", "y " * 200_000 + "."), (2**60 + 1, 0, "user", "q?")]
    got = {r["c"]: r for r in cr.repair(spark.createDataFrame([r + more for r in rows], schema))[1].collect()}
    assert set(got) == {None, 1, 2, 2**60 + 1}
    assert (got[None]["blank"], got[None]["gaps"], got[None]["audit"], got[None]["illegal"]) == (1, 0, "DKI", 1)
    # rows of one turn: by role, then text
    assert (got[1]["cost"], got[1]["audit"]) == brute([("assistant", "a."), ("user", "a."), ("user", "b.")])[:2]
    assert (got[2]["audit"], got[2]["duplicate"], got[2]["gaps"], got[2]["illegal"], got[2]["cost"]) == ("KDDK", 2, 4, 2, 8)
    assert got[2]["repaired_sha256"] == hashlib.sha256(("user:x.\nassistant:" + "y " * 200_000 + ".").encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(empty)[1].count() == 0


@pytest.mark.parametrize("rows", [[(3, t, "user", "Hi.") for t in range(40)]])
def test_all_rows_dropped_or_empty(spark, tmp_path, rows):
    gone = [(c, 0, "user", "Hi.") for c in range(400)]
    spark.createDataFrame(rows + gone, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert len(got) == 400
    dropped = [r for r in got.values() if r["audit"] == ""]
    assert dropped and all((r["gaps"], r["cost"], r["illegal"], r["repaired_sha256"]) == (0, 0, 0, hashlib.sha256(b"").hexdigest()) for r in dropped)
