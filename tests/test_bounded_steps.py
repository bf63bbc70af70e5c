"""Steps that were rewritten to grow no faster than their input."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers as H
from quarry.operators import text_index
from quarry.operators import vectors as B
from quarry.operators.block_index import BlockIndex, TermBlocks
from quarry.plans import adaptive_queries as Q
from quarry.plans import entity_queries
from quarry.plans.adaptive import KnowledgeBase, retrieve_adaptive
from quarry.plans.catalog import ORACLES, QUERIES
from quarry.sources import kb as K

DOCS = [(i, f"s::{i}", "s", f"Title{i % 3}", "s", f"alpha w{i} w{i + 1} w{i + 2} omega tail{i % 4}") for i in range(40)]
COLUMNS = "doc_id long, doc_key string, type string, name string, source string, content string"


def docs_of(spark, rows=DOCS):
    return spark.createDataFrame(rows, COLUMNS)


class Asked:
    """An index that keeps the keys it was asked for."""

    def __init__(self, index):
        self.index, self.keys = index, []

    def search(self, q_terms, k, q_key="question_id"):
        self.keys.append({r[0] for r in q_terms.select(q_key).distinct().collect()})
        return self.index.search(q_terms, k, q_key)


def test_rows_of_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = docs_of(spark, DOCS + DOCS[:1] + [(None, "n", "s", "n", "s", "x")])
    ids = spark.createDataFrame([(0,), (0,), (3,), (None,), (999,)], "doc_id long")
    for few in (1_000_000, 1):
        monkeypatch.setattr(text_index, "FEW_IDS", few)
        assert sorted(r.doc_id for r in text_index.rows_of(docs, ids).collect()) == [0, 0, 3]


def test_repeated_requests_are_answered_once(spark):
    """60 events ask 3 questions (one is blank, one event comes twice, one has no conversation)."""
    kb = docs_of(spark)
    terms = TermBlocks.count(kb)
    model = B.fit_tfidf_blocks(terms)
    index = BlockIndex.build(terms, model.vocab)
    text = {0: ("w3 w4 alpha", "records w3 w4 tail"), 1: ("w20 omega", None), 2: (" ", "x")}
    rows = [(i, i % 3, *text[i % 3]) for i in range(60)] + [(0, 0, *text[0]), (100, None, "", None)]
    asked = spark.createDataFrame(rows, "question_id long, conv_id long, question string, answer string")
    seen = Asked(index)
    got, rejected = H.answer_repeated(asked, "conv_id", kb, model, seen, k=3, min_similarity=0.1)
    want, wrong = H.answer_batch(asked.select("question_id", "question"), asked.select("question_id", "answer"), kb, model, index, k=3,
                                 min_similarity=0.1)
    plain = lambda df: sorted(str((r.question_id, r.answer, r.quality_check, r.validation_status, [x.snippet for x in r.sources],
                                   round(r.combined_score or 0, 6), r.meta)) for r in df.collect())
    assert plain(got) == plain(want)
    assert sorted(map(tuple, rejected.collect())) == sorted(map(tuple, wrong.collect()))
    assert seen.keys[0] == {0, 1}


def test_conversation_searches_ask_every_question(spark, tmp_path):
    """F12 to F14 of round 4: every conversation question, against all documents."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"w{c % 38} alpha t{t}") for c in range(50) for t in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(d[0], d[5], "en", "s", 9) for d in DOCS], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    want = {c * H.TURNS + t for c, t, role, _ in turns if role == "user"}
    assert "%" not in ORACLES["build_context"]
    for name in ("build_context", "answer_payload"):
        got = [r.question_id for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(want)


def test_entity_evaluation_asks_every_hundredth_typo_question(spark, monkeypatch):
    """the sampled relationship questions, and the typo questions whose id is divisible by 100."""
    names = spark.createDataFrame([("KPI", str(i), f"Name{i}") for i in range(30)], "type string, entity_key string, name string")
    direct = spark.range(1_000).select(F.col("id").alias("question_id"), F.lit("What is Growth Rate?").alias("question"), F.lit("kpi").alias("entity_type"),
                                       F.lit("Growth Rate").alias("entity_name"), F.lit("KPI").alias("expected_document_type"),
                                       F.lit("c").alias("category"), F.array(F.lit("KPI::Growth Rate")).alias("ground_truth_docs"))
    monkeypatch.setattr(entity_queries, "entity_pool", lambda *_: names)
    monkeypatch.setattr(entity_queries, "direct_questions_all", lambda *_: direct)
    monkeypatch.setattr(Q, "entity_kb", lambda *_: None)

    class Stop(Exception):
        pass

    def stop(questions, _):
        raise Stop({r.question_id for r in questions.collect()})

    monkeypatch.setattr(Q.P, "retrieve_adaptive", stop)
    with pytest.raises(Stop) as found:
        Q.q_run_evaluation_entities(spark, "")
    ids = found.value.args[0]
    assert {i for i in ids if 0 <= i < 1_000} == set(range(0, 1_000, 100)) and len(ids) > 500


def test_queries_of_the_same_words_are_searched_once(spark):
    """The lists of a question repeat its entities."""
    kb = KnowledgeBase.fit(docs_of(spark))
    kb.index = Asked(kb.index)
    queries = [("a", "w3 Alpha"), ("b", "W3 alpha."), ("c", "w9"), ("d", "w9."), ("e", ""), ("f", None), ("g", "unknown")]
    got = {}
    for r in kb.search(spark.createDataFrame(queries, "sq_key string, text string"), 4).collect():
        got.setdefault(r.sq_key, []).append((r["rank"], r.doc_id, round(r.score, 9)))
    assert kb.index.keys == [{"w3 alpha", "w9"}]
    assert sorted(got) == ["a", "b", "c", "d"]
    assert sorted(got["a"]) == sorted(got["b"]) and sorted(got["c"]) == sorted(got["d"]) and len(got["a"]) == 4


def test_the_parts_of_a_run_read_only_documents_that_were_hit(spark):
    """Later parts are handed these documents, each once."""
    kb = KnowledgeBase.fit(docs_of(spark))
    qs = spark.createDataFrame([(1, "What is w3 w4?"), (2, "Title1 and w20")], "question_id long, question string")
    res = retrieve_adaptive(qs, kb)
    hit = {r.doc_id for r in res.hits.collect()}
    assert {r.doc_id for r in res.docs.collect()} == hit
    assert {r.doc_id for r in res.pool.collect()} <= hit and res.selected.count() > 0
    assert {r.doc_id for r in kb.counts(res.pool).collect()} == {r.doc_id for r in res.pool.collect()}


def test_gold_looks_only_at_documents_with_an_anchor(spark, monkeypatch):
    """the counts tell which texts hold a question's rarest word; no other text is tokenized."""
    docs = docs_of(spark, DOCS + [(5, "s::5b", "s", "t", "s", "w5 w6 w7 but not the item")])
    qs = spark.createDataFrame([(1, "w5 w6 w7"), (2, "alpha w9 w10 w11 omega"), (3, "ail2"), (4, ""), (5, "no such text here")],
                               "question_id long, question string")
    read = []
    plain = K.postings
    monkeypatch.setattr(K, "postings", lambda kb, *a: read.append({r[0] for r in kb.select("doc_id").collect()}) or plain(kb, *a))
    got = {(r.question_id, r.doc_id) for r in K.verbatim_gold(qs, docs, terms=TermBlocks.count(docs)).collect()}
    texts = [(r.doc_id, r.content) for r in docs.collect()]
    assert got == {(q.question_id, d) for q in qs.collect() for d, t in texts if q.question and q.question in t}
    assert len(read) == 1 and len(read[0]) < 10


def test_a_step_of_the_probe_search_is_bounded(spark, monkeypatch):
    """scores of one step, however large the cells are."""
    plain = B._score_block

    def bounded(qm, qkeys, qexcl, kb_keys, *rest, **kw):
        assert len(qm) * min(len(kb_keys), 4096) <= 600_000
        return plain(qm, qkeys, qexcl, kb_keys, *rest, **kw)

    vec = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(2001)) - 1000).cast("float"))
    x = spark.range(2_000).select("id", vec.alias("embedding"))
    qs = x.select(F.col("id").alias("question_id"), "embedding", F.col("id").alias("self_id"))
    kb = x.select(F.col("id").alias("doc_id"), "embedding")
    want = {tuple(r)[:3] for r in B.topk(qs, kb, 5, kb_key="doc_id", exclude_col="self_id").collect()}
    monkeypatch.setattr(B, "_score_block", bounded)
    got = B.approx_topk(qs, kb, 5, kb_key="doc_id", exclude_col="self_id", n_cells=1)
    assert {tuple(r)[:3] for r in got.collect()} == want
