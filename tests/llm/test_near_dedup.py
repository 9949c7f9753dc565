"""Near-dedup: all pairs by brute force, hot groups around the threshold, odd ids and columns."""

import random

import numpy as np
import pytest

from seqloom import runtime
from seqloom.llm import near_dedup
from seqloom.llm.shingles import common, shingle_set
from tests.llm.test_corpus_operators import WORDS, corpus, plain_set, sentence

BIG = 2**53 + 1


def brute_components(texts):
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def found(spark, rows, schema="doc_id long, text string", **options):
    return near_dedup.near_duplicates(spark.createDataFrame(rows, schema), **options).collect()


def test_near_duplicates_against_all_pairs(spark):
    texts = corpus()
    sizes, least = brute_components(texts)
    got = {r["doc_id"]: r for r in found(spark, list(enumerate(texts)))}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == least
    assert [got[i]["kept"] for i in range(len(texts))] == [i == c for i, c in enumerate(least)]


def varied(rng, base, most):
    """``base`` with a run of up to ``most`` words replaced: similarities lie on both sides of 0.75."""
    text, n = list(base), rng.randint(1, most)
    at = rng.randrange(len(text) - n)
    text[at : at + n] = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(text)


@pytest.mark.parametrize("crowded", [near_dedup.CROWDED, 4])
def test_a_large_group_around_the_threshold(spark, monkeypatch, crowded):
    """1,500 variants of an original that isn't there, and texts that share a long passage: no link is lost."""
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    rng = random.Random(11)
    base, passage = sentence(rng, 90).split(), sentence(rng, 60)
    texts = [varied(rng, base, 22) for _ in range(1500)] + [f"{passage} {sentence(rng, rng.randint(8, 30))}" for _ in range(300)]
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # postings give the common shingles of all pairs
    by = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            by.setdefault(h, []).append(i)
    both = np.zeros((len(texts), len(texts)), np.int32)
    for members in by.values():
        both[np.ix_(members, members)] += 1
    n = np.array([len(s) for s in sets])
    linked = np.argwhere(np.triu(100 * both >= 75 * (n[:, None] + n[None, :] - both), 1))
    for i, j in linked.tolist():
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    least = [find(i) for i in range(len(texts))]
    assert 1 < len(set(least[:1500])) < 1500
    got = {r["doc_id"]: r["component_id"] for r in found(spark, list(enumerate(texts)))}
    assert [got[i] for i in range(len(texts))] == least


def test_near_duplicates_that_meet_in_hot_buckets_only(spark):
    passage, rng = sentence(random.Random(8), 104), random.Random(9)
    # 100 common shingles; two texts with 15 own ones each are similar (0.77), all others have 33 (0.60 and 0.68)
    texts = [f"{passage} " + " ".join(f"own{i}x{rng.random()}" for _ in range(15 if i in (700, 900) else 33)) for i in range(1500)]
    got = {r["doc_id"]: r["component_id"] for r in found(spark, list(enumerate(texts)))}
    assert got == {i: 700 if i == 900 else i for i in range(1500)}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b = sentence(random.Random(1), 40), sentence(random.Random(2), 40)
    rows = [(7, a), (7, b), (9, b), (None, a), (3, a), (None, None), (4, "")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in found(spark, rows)]
    assert sorted(got, key=str) == sorted([(7, 3, False), (7, 3, False), (9, 3, False), (None, 3, False), (3, 3, True), (None, None, False), (4, 4, True)], key=str)


def test_ids_pass_unchanged_beside_nulls(spark):
    text = sentence(random.Random(1), 30)
    rows = [(BIG, text), (None, text), (BIG + 2, text), (BIG + 4, "another text"), (None, None), (BIG + 6, "")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found(spark, rows))
    assert got == [(0, 0, False), (0, BIG, False), (BIG, BIG, True), (BIG + 2, BIG, False), (BIG + 4, BIG + 4, True), (BIG + 6, BIG + 6, True)]


def test_repeated_ids_link_their_texts(spark):
    rng = random.Random(2)
    x, y, z = (sentence(rng, 40) for _ in range(3))
    near = " ".join(x.split()[:-1] + ["other"])
    rows = [(5, x), (5, y), (5, y), (7, near), (9, y + " more"), (11, z), (3, z), (3, x)]
    got = {(r["doc_id"], r["component_id"]) for r in found(spark, rows)}
    assert got == {(5, 3), (7, 3), (9, 3), (11, 3), (3, 3)}


def test_text_ids_and_clashing_columns(spark):
    text = sentence(random.Random(3), 20)
    rows = [("b", text, 1, 2, 3), ("a", text, 1, 2, 3), ("c", "x", 1, 2, 3)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in found(spark, rows, "doc_id string, text string, id int, node int, key int")}
    assert got == {("b", "a", False), ("a", "a", True), ("c", "c", True)}


def test_empty_table(spark):
    assert found(spark, []) == []
    assert sorted(tuple(r) for r in found(spark, [(1, None), (2, "")])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_long_text_is_read_whole(spark):
    rng = random.Random(4)
    long = sentence(rng, 60_000)
    changed = long[: len(long) // 2] + " " + sentence(rng, 30_000)
    got = {r["doc_id"]: r["component_id"] for r in found(spark, [(1, long), (2, long + " tail"), (3, changed)])}
    assert got == {1: 1, 2: 1, 3: 3}


def test_tables_on_the_way_are_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}")
    found(spark, list(enumerate(corpus())))
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("table-")]) <= 3  # what the lazy result still reads


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    truth = common(a, b) / (len(a) + len(b) - common(a, b))
    agree = np.mean(near_dedup.signature(a, 2048) == near_dedup.signature(b, 2048))
    assert abs(agree - truth) < 0.05
    small = np.sort(pool[:5])
    assert set(near_dedup.signature(small, 84)) <= set(small.tolist())
