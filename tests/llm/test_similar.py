"""Near-duplicates by similarity: SimHash candidates against exact Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest
from near import near_components

from proxweave.llm import simhash


def texts():
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(4000)]
    out = []
    for n in [30, 60, 120, 300] * 12:  # from well above 0.8 to well below
        words = [rng.choice(vocab) for _ in range(n)]
        cut = list(words)
        for at in rng.sample(range(n), max(1, n // rng.choice([30, 50, 80]))):
            cut[at] = rng.choice(vocab)
        out += [" ".join(words), " ".join(cut), " ".join(words[: rng.randint(n * 3 // 4, n)])]
    base = [rng.choice(vocab) for _ in range(80)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(80)] = f"z{i}"
        out.append(" ".join(copy))
    line = " ".join(vocab[:12])
    out += [f"{line} {' '.join(rng.choice(vocab) for _ in range(9))}" for _ in range(40)]
    return [*out, "", None, "one", "ONE", "two words", " \n"]


@pytest.mark.parametrize(("bucket_rows", "group_shingles"), [(4096, 1 << 20), (8, 1000)])
def test_components_equal_exact_similarity(spark, bucket_rows, group_shingles):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = simhash.similar_components(docs, bucket_rows=bucket_rows, group_shingles=group_shingles)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    want = near_components(rows)
    assert [got[i] for i in range(len(rows))] == want


def test_recall_at_the_limit(spark):
    rng = random.Random(22)
    word = lambda: f"w{rng.randrange(50000)}"
    rows = []
    for _ in range(300):  # 10 of 90 shingles a side are others: 80 / 100 are shared
        core = [word() for _ in range(84)]
        rows += [" ".join(core + [word() for _ in range(10)]), " ".join(core + [word() for _ in range(10)])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert all(found[i] in (i, i - 1) for i in found)
    assert sum(found[i] == i - 1 for i in range(1, 600, 2)) >= 0.97 * 300


def test_a_third_in_one_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(9000)}"
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(3000):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(120)) for _ in range(6000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    plans = []
    real = simhash.plan_rounds
    monkeypatch.setattr(simhash, "plan_rounds", lambda *a: plans.append(real(*a)) or plans[-1])
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs, bucket_rows=256, group_shingles=50_000).collect()}
    assert np.prod(plans[0]) <= 64  # probe rows for each text, however large the group
    assert {found[i] for i in range(3000)} == {0}
    assert all(found[i] == i for i in range(3000, 9000))


def test_rounds_grow_slowly_with_the_table():
    rows = [np.prod(simhash.plan_rounds(10**k, 256, 0.8, 0.98)) for k in range(3, 11)]
    assert rows == sorted(rows) and rows[-1] <= 40 * rows[0]
    for k in range(3, 11):
        m, rounds = simhash.plan_rounds(10**k, 256, 0.8, 0.98)
        hit = (1 - simhash.differing(0.8)) ** (256 / m)
        assert 1 - (1 - hit) ** (m * rounds) >= 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (4, "A b c d e f", 2), (7, None, 3), (8, "", 4), (8, "", 4)], "doc_id long, text string, component long")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in simhash.similar_components(docs).collect()))
    assert got == [(0, 4), (4, 4), (7, 7), (8, 7), (8, 7)]
    assert simhash.similar_components(docs.limit(0)).count() == 0
