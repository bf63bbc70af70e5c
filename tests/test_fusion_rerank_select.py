import math

from quarry.operators import fusion as E
from quarry.operators import rerank as R
from quarry.operators import select as G


def test_minmax_golden(spark):
    hits = spark.createDataFrame([(1, "l", "a", 0.2), (1, "l", "b", 0.6), (1, "l", "c", 1.0),
                                  (2, "l", "d", 0.5), (2, "l", "e", 0.5)],
                                 "question_id int, list_name string, doc_key string, score double")
    got = {(r.question_id, r.doc_key): round(r.ns, 12) for r in E.normalised_lists(hits).collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 0.5, (1, "c"): 1.0, (2, "d"): 0.0, (2, "e"): 0.0}


def test_rrf_golden(spark):
    hits = spark.createDataFrame([(1, "entity", "x", 0), (1, "entity", "x", 2)],
                                 "question_id int, list_name string, doc_key string, rank0 int")
    r = E.rrf_term(hits).first()
    assert abs(r.rrf - (0.5 / 61 + 0.5 / 63)) < 1e-15


def test_softmax_and_anchor_prior_golden(spark):
    pool = spark.createDataFrame([(1, "a", 10), (1, "b", 11)], "question_id int, doc_key string, doc_id int")
    kb = spark.createDataFrame([(10, "zzz", None), (11, "Access Cost", None)],
                               "doc_id int, name string, alternative_names string")
    qs = spark.createDataFrame([(1, "access cost, budget")], "question_id int, question string")
    logits = spark.createDataFrame([(1, 10, 2.0), (1, 11, 0.0)], "question_id int, doc_id int, logit double")
    out = {r.doc_key: r.prob for r in R.rerank_scores(pool, qs, kb, lambda p, q: logits).collect()}
    e = [math.exp(0.0), math.exp(-2.0 / 1.6)]
    p = [e[0] / sum(e), e[1] / sum(e)]
    b = [p[0], p[1] * 1.6]
    assert abs(out["a"] - b[0] / sum(b)) < 1e-12 and abs(out["b"] - b[1] / sum(b)) < 1e-12


def select(spark, rows, anchors=(), max_docs=2):
    """Chosen places (from 1) in probability order and covered entities of one question."""
    items = [(n, f"d{n}", n, p, t, list(k), list(h)) for n, (p, t, k, h) in enumerate(rows, 1)]
    schema = ("question_id int, anchors array<string>, max_docs int, items array<struct<final_rank:int,doc_key:string,doc_id:int,"
              "prob:double,tokens:int,key_match:array<boolean>,name_has:array<boolean>>>")
    got = G.fold_selection(spark.createDataFrame([(1, list(anchors), max_docs, items)], schema)).orderBy("sel_rank").collect()
    return [r.doc_id for r in got], (got[0].covered if got else [])


def plain(probs, tokens):
    return [(p, t, (), ()) for p, t in zip(probs, tokens)]


def test_abstain_gate_golden(spark):
    assert select(spark, plain([0.05] * 20, [10] * 20))[0] == []
    assert select(spark, plain([1 / 3] * 3, [10] * 3))[0] == [1, 2]


def test_adaptive_select_token_budget_golden(spark):
    assert select(spark, plain([0.5, 0.3, 0.1], [900, 1500, 900]), max_docs=5)[0] == [1, 3]


def test_anchor_pass_and_forced_entity(spark):
    rows = [(0.6, 10, (False, False), (False, False)), (0.3, 10, (True, False), (True, False)), (0.1, 10, (False, False), (False, True))]
    assert select(spark, rows, ["a", "b"]) == ([2, 3], ["a", "b"])


def test_anchor_twice_and_too_long_document(spark):
    rows = [(0.5, 3000, (True, True), (True, True)), (0.4, 100, (True, True), (False, False)), (0.1, 100, (False, False), (False, False))]
    # the most probable match does not fit; the next pass takes nothing for the same reason; mass fill goes on
    assert select(spark, rows, ["a", "b"], 5) == ([2, 3], [])
    rows[0] = (0.5, 300, (True, True), (True, True))
    assert select(spark, rows, ["a", "b"], 1) == ([1], ["a", "b"])


def test_summary_of_an_abstained_question(spark):
    final = spark.createDataFrame([(1, 0.1), (1, 0.1)], "question_id int, prob double")
    selected = spark.createDataFrame([], "question_id int, doc_id int, prob double, tokens int, sel_rank int")
    kb = spark.createDataFrame([(1, "text")], "doc_id int, content string")
    assert [tuple(r) for r in G.selection_summary(selected, final, kb).collect()] == [(1, 0, 0.0, 0, "")]


def test_mmr_equals_brute_force():
    import numpy as np
    rng = np.random.default_rng(0)
    size = np.array([12, 1, 5])
    prob = np.where(np.arange(12) < size[:, None], -np.sort(-rng.random((3, 12)), axis=1), 0)
    vec = rng.normal(size=(3, 12, 8))
    vec /= np.linalg.norm(vec, axis=2, keepdims=True)
    rank = R.mmr_ranks(prob, vec, size, 0.5)
    for q, n in enumerate(size):
        order = np.argsort(rank[q, :n])
        assert sorted(rank[q, :n]) == list(range(1, n + 1)) and order[0] == 0
        for turn in range(1, n):  # every pick is the best of what was left
            worth = {i: 0.5 * prob[q, i] - 0.5 * max(vec[q, i] @ vec[q, j] for j in order[:turn]) for i in order[turn:]}
            assert worth[order[turn]] >= max(worth.values()) - 1e-12


def test_inject_anchor_swaps_without_duplicates(spark):
    rows = [(1, f"d{i}", i, i == 15) for i in range(1, 17)]
    df = spark.createDataFrame(rows, "question_id int, doc_key string, r int, is_anchor boolean")
    out = {r.doc_key: r.r2 for r in R.inject_anchors(df, 12).collect()}
    assert out["d15"] == 12 and out["d12"] == 15 and sorted(out.values()) == list(range(1, 17))
