"""Vector searches against brute force."""

import math

import numpy as np
import pytest

from quarry.llm import ann, mtree
from quarry.llm import vectors as V


def table(n=700, d=12, seed=1, equal=250):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[: n // 3] = x[0] + 0.05 * x[: n // 3]
    x[-equal:] = x[1]  # a third of all rows are one vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * d), (1060, [None] + [1.0] * (d - 1)), (1080, [math.nan] * d),
           (1100, [math.inf] * d), (1120, [1.0] * (d + 1)), (None, [1.0] * d)]
    return rows + [(i, v, 0) for i, v in odd]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def taking_part(rows, d, zero):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == d
            and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))]


def brute(rows, k, mod, turn=lambda v: v):
    ids = np.array([i for i, _ in rows])
    x = np.array([turn(v) for _, v in rows])
    out = {}
    for i, q in zip(ids, x):
        if i % mod == 0:
            score = x @ q
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


@pytest.mark.parametrize("kw", [{}, {"list_rows": 40, "block_rows": 64, "ask_rows": 10}])
def test_ann_recall(spark, kw):
    rows = table()
    want = brute(taking_part(rows, 12, False), 20, 20)
    got = found(ann.search(frame(spark, rows), **kw))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    # equal vectors tie: count a found vector with a score as good as the last true one
    good = sum(sum(s >= want[q][-1][1] - 1e-12 for _, s in got[q]) for q in want)
    assert max(hits, good) >= 0.9 * 20 * len(want)
    x = dict(taking_part(rows, 12, False))
    for q, own in got.items():
        assert len(own) == 20
        for i, s in own:
            assert s == pytest.approx(float(x[i] @ x[q]), abs=1e-12)
        assert own == sorted(own, key=lambda t: (-t[1], t[0]))


@pytest.mark.parametrize("kw", [{}, {"routing": 5, "shard_rows": 50, "ask_rows": 10}])
def test_mtree_is_exact(spark, monkeypatch, kw):
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    rows = table()
    want = brute(taking_part(rows, 12, True), 20, 20, lambda v: np.floor(64 * v))
    got = found(mtree.search(frame(spark, rows), **kw))
    assert got == {q: [(i, int(s)) for i, s in own] for q, own in want.items()}


@pytest.mark.parametrize("search", [ann.search, mtree.search])
def test_few_and_no_rows(spark, search):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(0, 80, 20)]
    got = found(search(frame(spark, rows)))
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i in (60, 40, 20, 0) if i != q] for q in (0, 20, 40, 60)}
    assert search(frame(spark, rows).where("false")).count() == 0
    assert search(frame(spark, [(20, None, 1)])).count() == 0
    assert search(frame(spark, rows[:1])).count() == 0


def test_tree_search_visits_less_than_all_but_misses_none():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 6)) * 30, 400, axis=0) + rng.normal(size=(8000, 6))
    tree, seen = mtree.MTree(x), []

    def take(rows):
        seen.extend(tree.order[rows].tolist())
        return float(np.sort(mtree.apart(x[seen], x[5]))[min(9, len(seen) - 1)])

    tree.search(x[5], float("inf"), take)
    assert set(np.argsort(mtree.apart(x, x[5]))[:10]) <= set(seen) and len(seen) < 4000


def test_scan_keeps_the_near():
    rng = np.random.default_rng(5)
    y, q = rng.normal(size=(3000, 64)), rng.normal(size=(10, 64))
    d = V.distances(q, y)
    limit = np.sort(d, axis=1)[:, 20]
    a, r = ann.scan(y, q, limit)
    kept = set(zip(a.tolist(), r.tolist()))
    near = [(i, j) for i in range(10) for j in np.flatnonzero(d[i] < limit[i])]
    assert sum(p in kept for p in near) >= 0.98 * len(near) and len(kept) < 600


def test_large_components_are_exact():
    v = np.array([[2.0 ** 30, 3.0], [2.0 ** 30, 2.0]])
    q = np.array([2.0 ** 30, 1.0])
    assert not mtree.exact_in_doubles(v, q)
    assert mtree.dots(v, q, False).tolist() == [2 ** 60 + 3, 2 ** 60 + 2]
