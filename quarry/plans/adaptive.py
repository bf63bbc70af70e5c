"""Adaptive retrieval (G11) and evaluation runs (J16), one part after the other.

What the parts hand on is small (a question's hits, pool and ranked rows) and is stored in the session's
``spark.checkpoint.dir``: the next part reads it instead of running the search again, and so does
a lost executor. Of the knowledge base each part reads only the rows of the documents it was handed, by
``text_index.rows_of``, so no text but theirs is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT, RetrievalConfig
from quarry.operators import fusion as E
from quarry.operators import rerank as Fr
from quarry.operators import select as G
from quarry.operators import vectors as B
from quarry.operators.block_index import BlockIndex, TermBlocks
from quarry.operators.text_index import rows_of, stored


def with_all_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the optional columns of a KB, null where they are missing."""
    for c in ("source", "alternative_names", "bsc_subfamilies"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    return docs


@dataclass
class KnowledgeBase:
    """A KB with its fitted lexical models. ``docs`` columns: doc_id, doc_key, type,
    name, source, content, alternative_names, bsc_subfamilies."""

    docs: DataFrame
    tfidf: B.TfidfModel
    index: BlockIndex
    bm25: Fr.Bm25Model

    @classmethod
    def fit(cls, docs: DataFrame, cfg: RetrievalConfig = DEFAULT) -> "KnowledgeBase":
        """Tokenize the corpus once into stored term counts (the index, written to the
        shared checkpoint folder); document frequencies, BM25 statistics, search
        weights and pool vectors are all derived from it."""
        docs = with_all_columns(docs)
        terms = TermBlocks.count(docs)
        n_docs = terms.n_texts
        tfidf = B.fit_tfidf_blocks(terms, of_texts=False)
        total = terms.n_tokens()
        idf_all = tfidf.dfreq.select("token", F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) /
                                                    (F.col("df") + 0.5)).alias("idf"))
        bm25 = Fr.Bm25Model(docs=docs.select("doc_id", "content"), df=idf_all, avgdl=float(total) / max(n_docs, 1))
        return cls(docs=docs, tfidf=tfidf, index=BlockIndex.build(terms, tfidf.vocab), bm25=bm25)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (sq_key, text) -> (sq_key, rank, doc_id, score). Queries of the same words are searched for once."""
        words = F.array_join(B.tokens(F.col("text")), " ")
        asked = stored(queries.select("sq_key", words.alias("words")).where(F.col("words") != ""), "queries")
        q_terms = self.tfidf.transform(asked.select("words", F.col("words").alias("text")).distinct(), "words", "text")
        found = stored(self.index.search(q_terms, k, "words"), "found")
        return asked.join(found, "words").select("sq_key", "rank", "doc_id", "score")

    def counts(self, doc_ids: DataFrame) -> DataFrame:
        """(doc_id, token, tf) of the given documents only, stored: their texts are tokenized again, which costs less
        than to read every posting."""
        return stored(B.term_counts(rows_of(self.docs.select("doc_id", "content"), doc_ids)), "pool-counts")


class AdaptiveResult:
    """The stages of one run, each made when it is first asked for: hits, pool, reranked, selected."""

    def __init__(self, questions: DataFrame, kb: KnowledgeBase, hits: DataFrame, cfg: RetrievalConfig, use_mmr: bool):
        self.questions, self.kb, self.hits, self.cfg, self.use_mmr = questions, kb, hits, cfg, use_mmr

    @cached_property
    def docs(self) -> DataFrame:
        """The documents that were hit."""
        return stored(rows_of(self.kb.docs, self.hits), "hit-documents")

    @cached_property
    def pool(self) -> DataFrame:
        return stored(E.fuse(self.questions, self.hits, self.docs, self.cfg), "pool")

    @cached_property
    def reranked(self) -> DataFrame:
        counts = replace(self.kb, docs=self.docs).counts(self.pool)
        bm25 = replace(self.kb.bm25, tf=counts)
        ranked = stored(Fr.rerank_scores(self.pool, self.questions, self.docs, lambda p, q: Fr.score_pairs_bm25(p, q, bm25),
                                         self.cfg), "ranked")  # read three times
        vectors = B.dense_from_terms(self.kb.tfidf.weights_from_counts(counts), "doc_id", self.cfg.dense_dim)
        return Fr.diversify(ranked, vectors, self.cfg, use_mmr=self.use_mmr)

    @cached_property
    def selected(self) -> DataFrame:
        return G.adaptive_select(self.reranked, self.questions, self.docs, self.cfg)


def retrieve_adaptive(questions: DataFrame, kb: KnowledgeBase, cfg: RetrievalConfig = DEFAULT,
                      use_mmr: bool = True, use_pairs: bool = False, checkpoint: bool = True) -> AdaptiveResult:
    """E (fan-out, search, fusion) -> F (re-rank, diversify) -> G (select)."""
    subqs = E.fan_out(questions, use_pairs=use_pairs)
    if checkpoint:
        subqs = stored(subqs, "sub-queries")
    hits = E.search_lists(subqs, kb.search, kb.docs, cfg)
    return AdaptiveResult(questions, kb, stored(hits, "hits") if checkpoint else hits, cfg, use_mmr)


def stage_output(res: AdaptiveResult, stage: str) -> DataFrame:
    """J14 stage choice: wide (fused pool), reranked, final (selected).
    -> question_id, rank, doc_key, score."""
    if stage == "wide":
        return res.pool.select("question_id", F.col("pool_rank").alias("rank"), "doc_key",
                               F.col("fused").alias("score"))
    if stage == "reranked":
        return res.reranked.select("question_id", F.col("final_rank").alias("rank"), "doc_key",
                                   F.col("prob").alias("score"))
    return res.selected.select("question_id", F.col("sel_rank").alias("rank"), "doc_key",
                               F.col("prob").alias("score"))
