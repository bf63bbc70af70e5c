"""Search over blocks of documents, held against the plain join of all postings."""

import random

from pyspark.sql import functions as F

from quarry.operators import block_index
from quarry.operators import vectors as B
from quarry.operators.block_index import BlockIndex, TermBlocks
from quarry.plans.catalog import QUERIES
from quarry.sources.kb import verbatim_gold


def corpus(spark, docs=120, questions=15):
    """Words from very frequent to single ones; copies, a key that comes twice, texts without words, null texts and keys."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"W{int(300 * rng.random() ** 3)}" for _ in range(n))
    kb = [(i, text(rng.choice([1, 3, 30, 80]))) for i in range(docs)]
    kb += [(i + docs, kb[i][1]) for i in range(20)] + [(0, text(5)), (None, text(9)), (900, ""), (901, None), (902, "..")]
    qs = [(i, text(rng.choice([1, 4, 12]))) for i in range(questions)] + [(500, "w0"), (501, "unknown"), (502, None), (None, "w0 w1")]
    return spark.createDataFrame(kb, "doc_id long, content string"), spark.createDataFrame(qs, "question_id long, question string")


def plain(model, kb, qs, k):
    both = model.transform(qs, "question_id", "question").withColumnRenamed("w", "wq").join(model.transform(kb, "doc_id", "content"), "token")
    best = {}
    for r in both.where("question_id is not null and doc_id is not null").groupBy("question_id", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("s")).collect():
        best.setdefault(r.question_id, []).append((-round(r.s, 9), r.doc_id))
    return sorted((q, n + 1, d, round(-s, 6)) for q, x in best.items() for n, (s, d) in enumerate(sorted(x)[:k]))


def test_block_search_equals_the_plain_join(spark, monkeypatch):
    kb, qs = corpus(spark)
    model = B.fit_tfidf(kb, "doc_id", "content")
    want = plain(model, kb, qs, 4)
    for chars, few, chunk, often in ((4_000_000, 1_000, 16_384, 50_000), (900, 1_000, 4, 10), (900, 0, 5, 0)):
        monkeypatch.setattr(block_index, "BLOCK_CHARS", chars)
        monkeypatch.setattr(block_index, "FEW", few)
        monkeypatch.setattr(block_index, "FEW_TERMS", few)
        monkeypatch.setattr(block_index, "CHUNK", chunk)
        monkeypatch.setattr(block_index, "OFTEN", often)
        terms = TermBlocks.count(kb)
        fitted = B.fit_tfidf_blocks(terms)
        assert {tuple(r) for r in fitted.dfreq.collect()} == {tuple(r) for r in model.dfreq.collect()}
        assert sorted(map(repr, terms.counts().collect())) == sorted(map(repr, B.term_counts(kb).collect()))
        found = B.topk_sparse(fitted.transform(qs, "question_id", "question"), BlockIndex.build(terms, fitted.vocab), 4)
        assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in found.collect()) == want


def test_block_search_of_nothing(spark):
    kb, qs = corpus(spark)
    for a, b in ((kb.limit(0), qs), (kb, qs.limit(0))):
        terms = TermBlocks.count(a)
        model = B.fit_tfidf_blocks(terms)
        assert BlockIndex.build(terms, model.vocab).search(model.transform(b, "question_id", "question"), 3).collect() == []


def test_text_search_keeps_one_row_a_token_and_block(spark, tmp_path, monkeypatch):
    """Before, a row per posting was written and shuffled."""
    kb, qs = corpus(spark)
    kb.select("doc_id", F.col("content").alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    qs.select(F.col("question_id").alias("item_id"), F.col("question").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes, keep = {}, block_index.stored

    def stored(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(block_index, "stored", stored)
    assert QUERIES["text_topk"](spark, str(tmp_path)).count() > 0
    assert sizes["counts"] == B.term_counts(kb).select("token").distinct().count()


def test_gold_joins_only_the_questions_tokens(spark, monkeypatch):
    from quarry.sources import kb as K
    names, keep = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df, name: names.append((name, df.count())) or keep(df, name))
    docs = spark.createDataFrame([(1, "a rare word here"), (2, "a word here too"), (3, None)], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "a rare word"), (2, "here"), (3, ""), (4, None)], "question_id long, question string")
    got = {tuple(r) for r in verbatim_gold(asked, docs).collect()}
    assert got == {(1, 1), (2, 1), (2, 2)}
    assert dict(names)["gold-candidates"] == 3


def test_known_names_do_not_shuffle_the_questions_grams(spark):
    from quarry.operators import questions as C
    asked = spark.createDataFrame([(1, "what is red bolt here"), (2, "a valve and red"), (3, None)], "question_id long, question string")
    known = spark.createDataFrame([("Red Bolt",), ("valve",), (" ",), (None,)], "name string")
    out = C.extract_anchors_extended(asked, known=known)
    got = {r.question_id: r.anchors_ext for r in out.collect()}
    assert "red bolt" in got[1] and "valve" in got[2] and "red bolt" not in got[2]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "known-grams" in plan and any("BroadcastHashJoin [gram" in line for line in plan.splitlines())
