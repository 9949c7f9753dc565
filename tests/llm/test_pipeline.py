"""The corpus pipeline against a plain version of each stage's decisions."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import token_shards
from seqloom.llm.shingles import words
from tests.llm.test_corpus_operators import brute_targets, plain_set, sentence
from tests.llm.test_near_dedup import brute_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows, labels = random.Random(21), [], []
    items = [sentence(rng, 25) for _ in range(3)]
    for i in range(240):
        text = sentence(rng, rng.randint(10, 60))
        kind = i % 12
        if kind == 1:
            text = " ".join(f"{w} idiot moron scum" if k % 9 == 0 else w for k, w in enumerate(text.split()))
        elif kind == 2 and rows:
            text = rows[-2][1]
        elif kind == 3:
            text = f"{text} {items[i % 3]} {text[:40]}"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, 1, int(kind == 1)))
    rows += [(500, None, "en", "src0", 0), (501, "", None, None, None), (7, rows[7][1], "en", "src3", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items


def test_stages_one_by_one(spark, tables):
    path, rows, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]

    clean = stages["toxicity"](spark, docs, path)
    clean.write.parquet(f"{path}/s1")
    clean = spark.read.parquet(f"{path}/s1")
    want = [r for r in rows if "idiot" not in (r[1] or "")]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(want, key=str) and clean.columns == docs.columns

    once = stages["near_dedup"](spark, clean, path)
    once.write.parquet(f"{path}/s2")
    once = spark.read.parquet(f"{path}/s2")
    unique = list({r[0]: r for r in reversed(want)}.values())
    unique.sort(key=lambda r: r[0])
    _, component = brute_components([r[1] for r in unique])
    kept = [r for k, r in enumerate(unique) if component[k] == k]
    assert sorted(r["doc_id"] for r in once.collect()) == [r[0] for r in kept] and once.columns == docs.columns

    out = stages["decontamination"](spark, once, path)
    out.write.parquet(f"{path}/s3")
    out = spark.read.parquet(f"{path}/s3")
    sets = [plain_set(q) for q in items]
    left = [r for r in kept if not any(100 * len(s & plain_set(r[1])) >= 75 * len(s) for s in sets)]
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in left] and 0 < len(left) < len(kept)

    mixed = stages["mixing"](spark, out, path)
    mixed.write.parquet(f"{path}/s4")
    mixed = spark.read.parquet(f"{path}/s4")
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    totals = collections.Counter()
    taken = collections.Counter()
    for r in left:
        totals[r[3]] += len(words(r[1]))
        taken[r[3]] += len(words(r[1])) * copies[r[0]]
    assert set(copies.values()) <= {1, 2}
    for source, target in brute_targets(totals).items():
        assert abs(taken[source] - target) <= 130

    final = stages["token_output"](spark, mixed, path).collect()
    assert sorted(r["slot"] for r in final) == list(range(len(final)))
    encoding = token_shards.load_tokenizer(token_shards.TOKENIZER)
    n = collections.Counter()
    for r in final:
        n[r["doc_id"]] += int(np.frombuffer(r["record"][:2], "<u2")[0])
    texts = {r[0]: r[1] for r in rows}
    assert n == collections.Counter({i: c * (len(encoding.encode_ordinary(texts[i] or "")) + 1) for i, c in copies.items()})


def test_run_is_the_stages_in_order(spark, tables):
    path, _, _ = tables
    got = corpus_pipeline.run(spark, path).collect()
    again = corpus_pipeline.run(spark, path).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in again)
