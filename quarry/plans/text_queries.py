"""Queries over ``documents`` (text KB) and ``benchmark`` (questions).

Gold for a benchmark item = the documents that contain it verbatim; items without
any such document are the out-of-domain questions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.config import GRID_KS
from quarry.functions.text import norm_key
from quarry.operators import evaluate as J
from quarry.operators import vectors as B
from quarry.operators.block_index import BlockIndex, TermBlocks
from quarry.operators.text_index import stored
from quarry.plans.registry import register, rounded
from quarry.sources.kb import benchmark_questions, documents_kb, verbatim_gold

TOKEN_SQL = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"

SQL_TFIDF = f"""
WITH dt AS (SELECT doc_id, unnest({TOKEN_SQL.format(c='text')}) AS token FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT token, count(DISTINCT doc_id) AS df FROM dt GROUP BY token),
voc AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM dfq, nd),
dtf AS (SELECT doc_id, token, count(*) AS tf FROM dt GROUP BY doc_id, token),
dw0 AS (SELECT doc_id, token, tf * idf AS w FROM dtf JOIN voc USING (token)),
dw AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0)
"""

SQL_TEXT_SEARCH = SQL_TFIDF + f""",
qt AS (SELECT item_id AS question_id, unnest({TOKEN_SQL.format(c='text')}) AS token FROM benchmark),
qtf AS (SELECT question_id, token, count(*) AS tf FROM qt GROUP BY question_id, token),
qw0 AS (SELECT question_id, token, tf * idf AS w FROM qtf JOIN voc USING (token)),
qw AS (SELECT question_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS w FROM qw0),
sc AS (SELECT question_id, doc_id, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (token)
       GROUP BY question_id, doc_id),
rk AS (SELECT question_id, doc_id, score,
              CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER)
              AS rank FROM sc)
"""

SQL_KB = r"""
kb AS (SELECT doc_id, source AS type,
              coalesce(regexp_replace(regexp_extract(text, '^\s*(\S+(?:\s+\S+){0,2})', 1), '\s+', ' ', 'g'), '') AS name,
              text AS content FROM documents),
kbk AS (SELECT doc_id, type, name, content,
               CASE WHEN coalesce(type, '') <> '' THEN type || '::' || trim(name || ' #' || CAST(doc_id AS VARCHAR), ' ')
                    ELSE 'content::' || substr(sha256(coalesce(content, '')), 1, 16) END AS doc_key FROM kb)
"""

SQL_GOLD = """
gold AS (SELECT b.item_id AS question_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')
"""


def text_kb(spark, sf):
    return documents_kb(spark, sf)


def text_model(spark, sf):
    kb = text_kb(spark, sf)
    terms = TermBlocks.count(kb)
    return kb, terms, B.fit_tfidf_blocks(terms)


def text_hits(spark, sf, k, fitted=None):
    _, terms, model = fitted or text_model(spark, sf)
    q_terms = model.transform(benchmark_questions(spark, sf), "question_id", "question")
    return B.topk_sparse(q_terms, BlockIndex.build(terms, model.vocab), k, kb_key="doc_id")


def text_gold(spark, sf, terms=None):
    return verbatim_gold(benchmark_questions(spark, sf), text_kb(spark, sf), terms=terms)


# ---------------------------------------------------------------- A13, A14, C5


@register("doc_key", "WITH " + SQL_KB.strip() + " SELECT doc_id, type, name, doc_key FROM kbk")
def q_doc_key(spark, sf):
    """Document identity for the text KB."""
    return text_kb(spark, sf).select("doc_id", "type", "name", "doc_key")


@register("count_by_type", "SELECT source AS type, count(*) AS n FROM documents GROUP BY source")
def q_count_by_type(spark, sf):
    """Documents per type."""
    return text_kb(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register("norm_key", "WITH " + SQL_KB.strip() + r""",
nk AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))
       AS name_key FROM kbk)
SELECT doc_id, name_key FROM nk""")
def q_norm_key(spark, sf):
    """Normalised name keys of the KB."""
    return text_kb(spark, sf).select("doc_id", norm_key("name").alias("name_key"))


# ---------------------------------------------------------------- B1


@register("embed", SQL_TFIDF + """,
bk AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 64 AS INTEGER) AS dim, w FROM dw),
bs AS (SELECT doc_id, dim, sum(w) AS v FROM bk GROUP BY doc_id, dim),
bn AS (SELECT doc_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM bs)
SELECT doc_id, dim, round(value, 6) AS value FROM bn""")
def q_embed(spark, sf):
    """B1: hashed dense TF-IDF vectors of the KB, as (doc_id, dim, value) for non-zero dims."""
    _, terms, model = text_model(spark, sf)
    dense = B.dense_from_terms(terms.weights(model.vocab.withColumn("bucket", B.token_bucket(64))), "doc_id", 64)
    return rounded(dense.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
                   .where(F.col("value") != 0))


# ---------------------------------------------------------------- B2 (sparse)


@register("text_topk", SQL_TEXT_SEARCH + "SELECT question_id, rank, doc_id, round(score, 6) AS score FROM rk "
                                         "WHERE rank <= 10")
def q_text_topk(spark, sf):
    """B2 over the inverted index: benchmark items against documents, top-10."""
    return rounded(text_hits(spark, sf, 10))


# ---------------------------------------------------------------- gold, J4, J13-J15


@register("benchmark_gold", "WITH " + SQL_GOLD.strip() + " SELECT question_id, doc_id FROM gold")
def q_benchmark_gold(spark, sf):
    """Documents containing each benchmark item verbatim (anchor-token join + verify)."""
    return text_gold(spark, sf)


SQL_TEXT_EVAL = SQL_TEXT_SEARCH + "," + SQL_GOLD + """,
res AS (SELECT * FROM rk WHERE rank <= 5),
fl AS (SELECT r.question_id, r.rank, r.doc_id, r.score, (g.doc_id IS NOT NULL) AS is_gold
       FROM res r LEFT JOIN gold g ON g.question_id = r.question_id AND g.doc_id = r.doc_id),
ng AS (SELECT question_id, count(*) AS n_gold FROM gold GROUP BY question_id),
per AS (SELECT question_id, count(*) AS n_sel, sum(CAST(is_gold AS INTEGER)) AS tp,
               min(CASE WHEN is_gold THEN rank END) AS first_rank,
               string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY rank) AS selected,
               string_agg(CASE WHEN is_gold THEN CAST(rank AS VARCHAR) END, '|' ORDER BY rank) AS rom,
               avg(score) AS avg_similarity, max(score) AS best
        FROM fl GROUP BY question_id),
ev AS (SELECT b.item_id AS question_id, coalesce(ng.n_gold, 0) AS n_gold, coalesce(per.selected, '') AS selected,
              coalesce(per.n_sel, 0) AS n_selected, coalesce(per.tp, 0) AS tp, per.first_rank,
              coalesce(per.rom, '') AS ranks_of_matches, per.avg_similarity, per.best
       FROM benchmark b LEFT JOIN ng ON ng.question_id = b.item_id LEFT JOIN per ON per.question_id = b.item_id),
m AS (SELECT *, CASE WHEN n_selected > 0 THEN tp / n_selected ELSE 0.0 END AS precision,
             CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0.0 END AS recall,
             CASE WHEN n_gold > 0 THEN coalesce(1.0 / first_rank, 0.0) ELSE 0.0 END AS mrr FROM ev),
pq AS (SELECT question_id, CAST(n_gold AS BIGINT) AS n_gold, selected, precision, recall,
              CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
              mrr, CAST(first_rank AS INTEGER) AS rank_of_first_match, ranks_of_matches, avg_similarity,
              CASE WHEN n_gold = 0 AND n_selected > 0 THEN 1 ELSE 0 END AS ood_fp,
              CASE WHEN n_gold = 0 AND best >= 0.3 THEN 1 ELSE 0 END AS ood_fp_score,
              CAST(n_gold = 0 AS INTEGER) AS is_ood, CAST(n_selected AS INTEGER) AS n_selected
       FROM m)
"""


def text_eval(spark, sf, fixed_k=5, mode="nonempty", min_score=None):
    fitted = text_model(spark, sf)
    hits = text_hits(spark, sf, fixed_k, fitted).withColumn("doc_key", F.col("doc_id").cast("string"))
    gold = stored(text_gold(spark, sf, fitted[1]), "gold").withColumn("doc_key", F.col("doc_id").cast("string"))  # read twice
    qs = benchmark_questions(spark, sf)
    return J.evaluate(qs, gold, hits, fixed_k=fixed_k, ood_fp_mode=mode, ood_min_score=min_score)


@register("evaluate_text", SQL_TEXT_EVAL + """
SELECT question_id, n_gold, selected, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(mrr, 6) AS mrr, rank_of_first_match, ranks_of_matches,
       round(avg_similarity, 6) AS avg_similarity, ood_fp, is_ood, n_selected FROM pq""")
def q_evaluate_text(spark, sf):
    """J14 (J8-J10, J12, J13): per-question metrics of top-5 text search against verbatim gold."""
    return rounded(text_eval(spark, sf))


@register("ood_false_positive", SQL_TEXT_EVAL + """
SELECT question_id, is_ood, ood_fp_score AS ood_fp FROM pq""")
def q_ood_false_positive(spark, sf):
    """J13 in ``score`` mode: an out-of-domain question counts if any kept score >= 0.3."""
    return text_eval(spark, sf, mode="score", min_score=0.3).select("question_id", "is_ood", "ood_fp")


@register("aggregate_metrics", SQL_TEXT_EVAL + """
SELECT count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, round(avg(mrr), 6) AS mrr,
       round(avg(rank_of_first_match), 6) AS avg_rank_of_first_match,
       round(count(rank_of_first_match) / count(*), 6) AS hit_rate,
       round(avg(avg_similarity), 6) AS avg_similarity,
       round(coalesce(sum(CASE WHEN is_ood = 1 THEN ood_fp END) / sum(CASE WHEN is_ood = 1 THEN 1 END), 0.0), 6)
         AS ood_fp_rate,
       round(sum(ood_fp) / count(*), 6) AS ood_fp_rate_all
FROM pq""")
def q_aggregate_metrics(spark, sf):
    """Macro metrics over all benchmark items."""
    return rounded(J.aggregate_metrics(text_eval(spark, sf)))


@register("grid_search_text", SQL_TEXT_SEARCH + "," + SQL_GOLD + """,
hits AS (SELECT r.question_id, r.doc_id, r.rank, r.score, (g.doc_id IS NOT NULL) AS is_gold
         FROM rk r LEFT JOIN gold g ON g.question_id = r.question_id AND g.doc_id = r.doc_id WHERE r.rank <= 10),
g AS (SELECT * FROM (SELECT CAST(k AS INTEGER) AS k FROM (VALUES (1),(2),(3),(4),(5),(7),(10)) v(k)) gk,
                    (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES (0.1),(0.2),(0.25),(0.3),(0.35),(0.5),(0.7),(0.9))
                     v(t)) gt),
kept AS (SELECT g.k, g.threshold, h.* FROM hits h, g WHERE h.rank <= g.k AND h.score >= g.threshold),
per_q AS (SELECT k, threshold, question_id, count(*) AS ret, sum(CAST(is_gold AS BIGINT)) AS tp,
                 min(CASE WHEN is_gold THEN rank END) AS first_rank, sum(score) AS sim_sum
          FROM kept GROUP BY k, threshold, question_id),
nq AS (SELECT b.item_id AS question_id, (SELECT count(*) FROM gold WHERE gold.question_id = b.item_id) AS n_gold
       FROM benchmark b),
j AS (SELECT g.k, g.threshold, nq.question_id, nq.n_gold, p.ret, p.tp, p.first_rank, p.sim_sum
      FROM nq CROSS JOIN g LEFT JOIN per_q p ON p.k = g.k AND p.threshold = g.threshold
                                            AND p.question_id = nq.question_id),
a AS (SELECT k, threshold, count(*) AS n_q, coalesce(sum(tp), 0) AS tp, coalesce(sum(ret), 0) AS ret,
             CAST(sum(n_gold) AS BIGINT) AS gt, count(ret) AS q_any,
             sum(coalesce(1.0 / first_rank, 0.0)) AS rr_sum, sum(sim_sum) AS sim_sum, avg(first_rank) AS first_avg
      FROM j GROUP BY k, threshold),
m AS (SELECT k, threshold, CASE WHEN ret > 0 THEN tp / ret ELSE 0.0 END AS precision,
             CASE WHEN gt > 0 THEN tp / gt ELSE 0.0 END AS recall, q_any / n_q AS false_positive_rate,
             rr_sum / n_q AS retrieval_mrr, CASE WHEN ret > 0 THEN sim_sum / ret ELSE 0.0 END AS avg_similarity,
             coalesce(first_avg, 0.0) AS rank_of_first_match FROM a)
SELECT k, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1,
       round(false_positive_rate, 6) AS false_positive_rate, round(retrieval_mrr, 6) AS retrieval_mrr,
       round(avg_similarity, 6) AS avg_similarity, round(rank_of_first_match, 6) AS rank_of_first_match FROM m""")
def q_grid_search_text(spark, sf):
    """J4 on text retrieval with verbatim gold (the reference's grid files, on driver data)."""
    fitted = text_model(spark, sf)
    hits = text_hits(spark, sf, max(GRID_KS), fitted)
    found = stored(text_gold(spark, sf, fitted[1]), "gold")  # read twice
    gold = found.withColumn("is_gold", F.lit(True))
    hits = hits.join(gold, ["question_id", "doc_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    n_gold = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    qs = benchmark_questions(spark, sf).select("question_id").join(n_gold, "question_id", "left").select(
        "question_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"))
    return rounded(J.grid_search(hits, qs, doc_col="doc_id"))
