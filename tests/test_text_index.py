"""Bounded text search against the plain join of all postings, and the composed answer job."""

import random
from math import sqrt

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers as H
from quarry.operators import text_index
from quarry.operators.text_index import ImpactIndex
from quarry.operators.vectors import topk_sparse
from quarry.plans.adaptive import KnowledgeBase
from quarry.plans.answer_adaptive import answer_adaptive


def unit(weights):
    n = sqrt(sum(w * w for w in weights.values()))
    return {t: w / n for t, w in weights.items()}


def corpus(seed, docs, questions):
    """Tokens from very frequent ones (t0) to those of one document, short documents and copies among them."""
    rng = random.Random(seed)
    pick = lambda n: {f"t{int(200 * rng.random() ** 3)}": rng.choice([0.2, 0.5, 1, 1, 3]) for _ in range(n)}
    kb = {i: unit(pick(rng.choice([1, 2, 8, 40]))) for i in range(docs)}
    for i in range(docs, docs + 10):
        kb[i] = kb[i - docs]
    qs = {i: unit(pick(rng.choice([1, 3, 12]))) for i in range(questions)}
    qs[questions] = {"unknown": 1.0}
    qs[questions + 1] = {"t0": 1.0}
    return kb, qs


def plain(kb, qs, k):
    out = []
    for q, terms in qs.items():
        scores = {d: sum(w * doc[t] for t, w in terms.items() if t in doc) for d, doc in kb.items() if terms.keys() & doc.keys()}
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
        out += [(q, r + 1, d, round(scores[d], 6)) for r, d in enumerate(best)]
    return out


def frames(spark, kb, qs):
    rows = lambda x: [(i, t, float(w)) for i, terms in x.items() for t, w in terms.items()]
    return (spark.createDataFrame(rows(kb), "doc_id long, token string, w double"),
            spark.createDataFrame(rows(qs), "question_id long, token string, w double"))


@pytest.mark.parametrize("seed,k,seeds", [(1, 5, 1_000), (2, 1, 1), (3, 30, 2)])
def test_equal_to_the_plain_join(spark, monkeypatch, seed, k, seeds):
    monkeypatch.setattr(text_index, "SEEDS", seeds)
    kb, qs = corpus(seed, 300, 40)
    kb_terms, q_terms = frames(spark, kb, qs)
    got = [(r[0], r[1], r[2], round(r[3], 6)) for r in topk_sparse(q_terms, kb_terms, k).collect()]
    assert sorted(got) == sorted(plain(kb, qs, k))


def test_frequent_tokens_reach_few_documents(spark):
    rng = random.Random(4)
    kb = {i: unit({**{f"f{j}": rng.uniform(0.01, 0.1) for j in range(12)}, f"r{i % 500}": 1.0}) for i in range(2_000)}
    qs = {i: unit({**{f"f{j}": 0.05 for j in range(12)}, f"r{i}": 1.0}) for i in range(20)}
    kb_terms, q_terms = frames(spark, kb, qs)
    index = ImpactIndex.build(kb_terms)
    terms = q_terms.withColumnRenamed("w", "wq").join(index.tokens, "token")
    cuts = index.cuts(terms, index.thresholds(terms, 3, "question_id"), "question_id")
    assert index.candidates(terms, cuts, "question_id").count() <= 20 * 4
    got = [(r[0], r[1], r[2], round(r[3], 6)) for r in index.search(q_terms, 3).collect()]
    assert sorted(got) == sorted(plain(kb, qs, 3))


def test_empty_sides(spark):
    kb_terms, q_terms = frames(spark, *corpus(5, 20, 3))
    assert topk_sparse(q_terms.limit(0), kb_terms, 3).collect() == []
    assert topk_sparse(q_terms, kb_terms.limit(0), 3).collect() == []


DOCS = [(1, "a::1", "a", "Access cost", "Access cost is the price of reaching the data. It is paid once."),
        (2, "a::2", "a", "Data quality", "Data quality describes how well records fit their use."),
        (3, "b::3", "b", "Growth", "Growth is the change of revenue in a year.")]


def test_the_composed_job(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, doc_key string, type string, name string, content string")
    kb = KnowledgeBase.fit(docs)
    words = sorted({w.lower() for d in DOCS for w in d[4].replace(".", "").split()} | {"what"})
    dictionary = spark.createDataFrame([(w, 5) for w in words], "word string, freq long")
    terms = spark.createDataFrame([], "term string")
    qs = spark.createDataFrame([(1, "What is access cost? What is growth in revnue?"), (2, "What is data quality?"), (3, ""), (4, None)],
                               "question_id long, question string")
    found = answer_adaptive(qs, kb, H.first_sentence_model, dictionary, terms)
    nested = {r["question_id"]: r for r in found.nested.collect()}
    assert nested[1]["mode"] == "multi" and [i["sub_no"] for i in nested[1]["items"]] == [0, 1]
    assert "revenue" in nested[1]["corrected"] and nested[2]["mode"] == "single"
    answers = {(q, i["sub_no"]): i["result"]["answer"] for q, r in nested.items() for i in r["items"]}
    known = {d[4].split(". ")[0].rstrip(".") + "." for d in DOCS} | {H.NO_INFO_ANSWER}
    assert set(answers) == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)} and set(answers.values()) <= known
    assert answers[3, 0] == answers[4, 0] == H.NO_INFO_ANSWER
    report = found.report().collect()
    assert len(report) == 5 and all(r["validation_status"] in ("PASSED", "PARTIAL", "FAILED") and r["confidence"] for r in report)
    assert {r["validation_status"] for r in report if r["question_id"] > 2} == {"FAILED"}


def test_a_model_starts_once_a_task_and_gets_bounded_batches(spark):
    prompts = spark.range(50).select(F.col("id").alias("question_id"), F.expr("repeat('x', int(id % 5) * 100)").alias("prompt")).coalesce(1)

    def make():
        calls = []

        def model(texts):
            calls.append(sum(map(len, texts)))
            return [f"{len(calls)}:{len(t)}:{max(calls)}" for t in texts]
        return model
    got = [r["answer"].split(":") for r in H.generate_answers(prompts, make, max_chars=1_000).orderBy("question_id").collect()]
    assert [int(g[1]) for g in got] == [i % 5 * 100 for i in range(50)]
    assert max(int(g[0]) for g in got) > 5 and max(int(g[2]) for g in got) <= 1_000
