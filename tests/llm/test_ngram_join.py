"""The grouped prefix join against brute force over all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import blocks, ngram_join
from quarry.llm.components import components


def brute(rows, width=5, percent=80):
    """(n, smallest reachable id) per row by comparing all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]))
    near = {i: [j for j in range(len(rows)) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
            for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(seed):
    """Copies, a large family of near copies, chains of near copies, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    text = lambda n: [word() for _ in range(n)]
    rows = [None, "", "  \n ", "a", "A", "b c", "B  c", "x " * 30, "x " * 9, "a b c d e", "a b c d e f"]
    base = text(90)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(90)] = word()
        rows.append(" ".join(copy))
    chain = text(60)
    for _ in range(25):
        chain = list(chain)
        chain[rng.randrange(60)] = word()
        rows.append(" ".join(chain))
    passage = text(60)
    for n in (1, 4, 8, 12, 14, 16, 20, 60, 200):
        rows += [" ".join(passage + text(n)), " ".join(text(n) + passage)]
    rows += [" ".join(text(rng.randrange(1, 80))) for _ in range(20)]
    rows += [t.upper() if t else t for t in rng.choices(rows, k=15)]
    ids = rng.sample(range(1000), len(rows))
    return [*zip(ids, rows), (None, rows[20]), (ids[0], rows[0]), (ids[30], rows[30])]


@pytest.mark.parametrize("seed,rounds", [(1, 3), (2, 0), (3, 1)])
def test_components_equal_brute_force(spark, seed, rounds, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", 700)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "k", 1, None) for i, t in rows], "doc_id long, text string, key string, n int, shared string")
    got = ngram_join.join(docs.repartition(3), rounds=rounds).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 48) - 1), max_size=50), st.integers(1, 9), st.sampled_from([48, 64]))
def test_blocks_round_trip(values, parts, bits):
    own = np.array(sorted({v << (bits - 48) for v in values}), np.uint64)
    out = []
    for part, lo, hi in blocks.cuts(own, parts, bits):
        low, high = blocks.range_start(part, parts, bits), blocks.range_start(part + 1, parts, bits)
        assert low <= int(own[lo]) and int(own[hi - 1]) < high
        out += blocks.undeltas(blocks.deltas(own[lo:hi], low, bits), low, bits).tolist()
    assert out == own.tolist()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)}
