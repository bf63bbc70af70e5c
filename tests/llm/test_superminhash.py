"""SuperMinHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
from test_ngram_join import brute, corpus

from quarry.llm import superminhash as smh
from quarry.llm.bpe import mix
from quarry.llm.ngram_join import shingles


def plain_signature(elements, slots):
    """One element and one step at a time, without early stopping."""
    out = [2 ** 64 - 1] * slots
    for h in elements:
        order = list(range(slots))
        for j in range(slots):
            draw = int(mix(np.array([h], np.uint64) + smh._salt(j))[0])
            k = j + ((draw & 0xFFFFFFFF) * (slots - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | draw >> 32)
    return out


def test_early_stopping_changes_no_signature(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (0, 1, 2, 7, 40, 300, 9)]
    want = np.array([plain_signature(s, 24) for s in sets], np.uint64)
    for size in (100_000, 50, 8):
        monkeypatch.setattr(smh, "SLICE", size)
        assert (smh.signatures(sets, 24) == want).all()


def test_equal_slots_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for shared, other in ((800, 100), (500, 250), (30, 4)):
        hits = []
        for _ in range(30):
            x = rng.integers(0, 2 ** 63, shared + 2 * other).astype(np.uint64)
            a, b = smh.signatures([np.sort(x[:shared + other]), np.sort(np.r_[x[:shared], x[shared + other:]])], 112)
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - shared / (shared + 2 * other)) < 0.03


def test_sketches_agree_in_the_equal_slots(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2 ** 40, (20, smh.SLOTS)).astype(np.uint64)
    b = np.where(rng.random(a.shape) < 0.7, a, rng.integers(0, 2 ** 40, a.shape).astype(np.uint64))
    nibbles = lambda s: [[int(x) >> 4 * i & 15 for x in row for i in range(16)] for row in s]
    x, y = smh.sketch(a), smh.sketch(b)
    want = [sum(p == q for p, q in zip(u, v)) for u, v in zip(nibbles(x), nibbles(y))]
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(zip(x.view(np.int64).tolist(), y.view(np.int64).tolist()))],
                               "i int, x array<long>, y array<long>")
    assert [r[0] for r in df.orderBy("i").select(smh.agreement("x", "y")).collect()] == want
    assert [int(smh._agreements(p, q[None])[0]) for p, q in zip(x, y)] == want
    assert ((a == b).sum(axis=1) <= want).all() and smh.likely(80) == 152


@pytest.mark.parametrize("seed,hot,block", [(1, 50, 1000), (2, 2, 1000), (3, 50, 3)])
def test_equal_to_brute_force(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(smh, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as n", "2 as bands", "3 as comp")
    got = [tuple(r) for r in smh.near_duplicates(df, hot=hot).collect()]
    want = [(*r, r[0] == r[2]) for r in brute(rows, width=4)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_copies_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(smh, "COPIES", 3)
    rows = [(i, "one two three four five") for i in range(5, 25)] + [(1, "another text of a few words"), (2, "")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in smh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: (5, i == 5) for i in range(5, 25)}, 1: (1, True), 2: (2, True)}


def test_empty_table_and_a_very_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert smh.near_duplicates(none).collect() == []
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(9000) for _ in range(250_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:240_000])), (3, " ".join(words[:120_000]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in smh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(shingles(t, 4)), 3 if i == 3 else 1) for i, t in rows}
