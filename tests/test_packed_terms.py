"""F4, F11 of round 4: term weights of document sets as arrays, held against rows; and the search's packed counts."""

import random
import time

import numpy as np

from quarry.operators import block_index
from quarry.operators import vectors as B
from quarry.operators.block_index import BlockIndex, TermBlocks


def test_packed_sets_equal_rows(spark, monkeypatch):
    rng = random.Random(3)
    kb = spark.createDataFrame([(i, " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.choice([0, 1, 9, 40])))) for i in range(50)]
                               + [(7, "w1 again"), (8, None)], "doc_id long, content string")
    sets = lambda seed: spark.createDataFrame([(f"q{random.Random(seed + i).randrange(25)}", random.Random(seed - i).randrange(55))
                                               for i in range(70)] + [(None, 3), ("q1", 3), ("q1", 3), (f"only{seed}", 3)], "question_id string, doc_id long")
    model = B.fit_tfidf(kb, "doc_id", "content", persist=True)
    one, two = sets(100), sets(900)
    rows = model.raw_terms(kb, "doc_id", "content")
    cos = lambda raw: {r.question_id: round(r.cosine, 9) for r in B.sparse_cosine(B.docset_terms(one, raw), B.docset_terms(two, raw)).collect()}
    want = cos(rows)
    want.pop(None, None)
    packed = model.packed_terms(kb, "doc_id", "content")
    for terms in (1_000_000, 50):
        monkeypatch.setattr(B, "SET_TERMS", terms)
        assert cos(packed) == want
    assert want["only100"] == want["only900"] == 0.0 and max(want.values()) > 0.5
    assert cos(packed.limit(0)) == {}


def test_a_search_hands_over_few_rows(spark, monkeypatch):
    """Before, a row per token and block went to Python."""
    monkeypatch.setattr(block_index, "FEW_TERMS", 0)
    monkeypatch.setattr(block_index, "BLOCK_CHARS", 2_000)
    kb = spark.createDataFrame([(i, f"a{i} b{i % 7} c{i % 3} d{i} e{i}") for i in range(300)], "doc_id long, content string")
    terms = TermBlocks.count(kb)
    model = B.fit_tfidf_blocks(terms)
    index = BlockIndex.build(terms, model.vocab)
    asked = spark.createDataFrame([(1, "a5 b5"), (2, "c1"), (3, "none")], "question_id long, question string")
    got = [(r.question_id, r["rank"], r.doc_id) for r in index.search(model.transform(asked, "question_id", "question"), 2).collect()]
    assert sorted(got) == [(1, 1, 5), (1, 2, 12), (2, 1, 1), (2, 2, 4)]
    assert index.packed.count() <= block_index.PACKS * terms.n_blocks < terms.rows.count()


def test_scores_in_single_precision_only_bound_the_result():
    """Sums that differ by less than single precision shows, ties, k above the number of documents, steps of every size."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    n, vocab = 300, 12
    tf = rng.integers(0, 3, (n, vocab))
    tf[:, 0] = 1_000_000 + np.arange(n) // 2  # a frequent token, nearly the same everywhere
    norm = np.sqrt((tf * tf).sum(axis=1))
    lists = lambda f: [f(j).tolist() for j in range(vocab)]
    x = pa.table({"tokens": [[f"t{j}" for j in range(vocab)], None], "keys": [lists(lambda j: np.flatnonzero(tf[:, j])), None],
                  "tfs": [lists(lambda j: tf[tf[:, j] > 0, j]), None], "names": [None, list(range(n))], "norms": [None, norm.tolist()]},
                 schema=pa.schema({"tokens": pa.list_(pa.string()), "keys": pa.list_(pa.list_(pa.int64())),
                                   "tfs": pa.list_(pa.list_(pa.int32())), "names": pa.list_(pa.int64()), "norms": pa.list_(pa.float64())}))
    cell = block_index._Cell(x, pa.array([f"t{j}" for j in range(vocab)]))
    place = {w: i for i, w in enumerate(cell.tokens.to_pylist())}
    asked = [[0], [0, 1, 2], [3], [], [5, 6, 7, 8]]
    at = np.cumsum([0, *map(len, asked)])
    tokens, w = np.array([place[f"t{j}"] for q in asked for j in q]), rng.random(at[-1]) + 0.1
    for k in (1, 4, 299, 400):
        for sums in (1, 700, 160_000):
            block_index_sums, block_index.SUMS = block_index.SUMS, sums
            try:
                got = {(q, d): s for a in cell.best(at, tokens, w, k) for q, d, s in zip(*a)}
            finally:
                block_index.SUMS = block_index_sums
            want = {}
            for q, js in enumerate(asked):
                s = sum((w[at[q] + i] * tf[:, j] / norm for i, j in enumerate(js)), np.zeros(n))
                best = sorted((-round(v, 9), d) for d, v in enumerate(s) if v > 0)[:k]
                want |= {(q, d): -v for v, d in best}
            assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-9 for p in got), (k, sums)


def test_what_is_stored_leaves_no_shuffle_files(spark):
    """Before, a query's shuffles stayed on disk until the driver happened to collect its garbage."""
    from quarry.operators.text_index import stored
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    x = spark.range(1000).selectExpr("id % 7 AS k", "id")
    written = [stored(x.groupBy("k").count(), "counts") for _ in range(4)]
    until = time.time() + 5
    while tracker.shuffleStatuses().size() > before and time.time() < until:
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= before
    assert [w.agg({"count": "sum"}).first()[0] for w in written] == [1000] * 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
