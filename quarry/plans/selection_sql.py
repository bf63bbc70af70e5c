"""DuckDB SQL of MMR (F7, F8) and adaptive selection (G1-G10) over the documents KB, as folds.

Each builder continues the common table expressions of the re-ranking oracle (``p2``: question_id,
doc_key, doc_id, ents, is_anchor, prob).
"""

from __future__ import annotations

from quarry.config import DEFAULT as CFG
from quarry.operators import questions as C
from quarry.plans import sqlgen as S


def _cut(sql: str, start: str) -> str:
    return sql[:sql.index(start)].rstrip()


def mmr_ctes(rerank_sql: str) -> str:
    """... up to ``fin`` (question_id, doc_key, final_rank)."""
    base = _cut(rerank_sql, "SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(prob, 12) DESC")
    k, lam = CFG.mmr_top_k, CFG.mmr_lambda
    worth = (f"round({lam} * it[i].p - {1 - lam} * list_max(list_transform(acc, lambda j: "
             "list_inner_product(it[i].e, it[j].e))), 9)")
    return base + f""",
rk2 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(prob, 12) DESC, doc_key) AS r FROM p2),
low AS (SELECT *, max(CASE WHEN is_anchor AND r > {k} THEN r END) OVER (PARTITION BY question_id) AS la,
               least({k}, max(r) OVER (PARTITION BY question_id)) AS sw FROM rk2),
r2t AS (SELECT *, CASE WHEN la IS NULL THEN r WHEN r = la THEN sw WHEN r = sw THEN la ELSE r END AS r2 FROM low),
vb AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {CFG.dense_dim} AS INTEGER) AS dim, sum(w) AS v
       FROM dw JOIN pdocs USING (doc_id) GROUP BY ALL),
vn AS (SELECT doc_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM vb),
vecs AS (SELECT pdocs.doc_id, list(coalesce(vn.value, CAST(0 AS DOUBLE)) ORDER BY d.range) AS e
         FROM pdocs CROSS JOIN range({CFG.dense_dim}) d LEFT JOIN vn ON vn.doc_id = pdocs.doc_id AND vn.dim = d.range GROUP BY pdocs.doc_id),
mit AS (SELECT question_id, list(struct_pack(doc_key := doc_key, p := prob, e := e) ORDER BY r2) AS it
        FROM r2t JOIN vecs USING (doc_id) WHERE r2 <= {k} GROUP BY question_id),
mor AS (SELECT question_id, it, list_reduce(list_transform(range(2, len(it) + 1), lambda t: [t]), lambda acc, t: acc || [
               -(list_reverse_sort(list_transform(list_filter(range(1, len(it) + 1), lambda i: NOT list_contains(acc, i)),
                                                  lambda i: struct_pack(v := {worth}, k := -i)))[1].k)],
               [CAST(1 AS BIGINT)]) AS ord FROM mit),
fin AS (SELECT question_id, it[ord[u.n]].doc_key AS doc_key, u.n AS final_rank FROM mor, unnest(range(1, len(ord) + 1)) u(n)
        UNION ALL SELECT question_id, doc_key, r2 FROM r2t WHERE r2 > {k})"""


def sql_mmr(rerank_sql: str) -> str:
    return mmr_ctes(rerank_sql) + """
SELECT question_id, CAST(final_rank AS INTEGER) AS final_rank, doc_key, round(prob, 6) AS prob
FROM fin JOIN p2 USING (question_id, doc_key)"""


def selection_ctes(rerank_sql: str) -> str:
    """... up to ``picked`` (question_id, doc_key, doc_id, prob, tokens, sel_rank) and ``folded``
    (question_id, anchors, cov, mass of the whole pool)."""
    norm = lambda c: (f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
    none = ("sel := CAST([] AS BIGINT[]), total := CAST(0 AS BIGINT), mass := CAST(0 AS DOUBLE), cov := CAST([] AS VARCHAR[])")
    steps = lambda n: f"list_transform(range(1, {n} + 1), lambda i: struct_pack(i := i, {none}))"
    room = lambda i: (f"(NOT list_contains(s.sel, {i}) AND len(s.sel) < max_docs "  # noqa: E731
                      f"AND s.total + it[{i}].tokens <= {CFG.max_tokens})")
    take = lambda i, cov: (f"struct_pack(i := x.i, sel := s.sel || [{i}], total := s.total + it[{i}].tokens, "  # noqa: E731
                           f"mass := s.mass + it[{i}].prob, cov := {cov})")
    cover = "CASE WHEN list_contains(s.cov, anchors[x.i]) THEN s.cov ELSE s.cov || [anchors[x.i]] END"
    hit = f"list_filter(range(1, len(it) + 1), lambda i: it[i].nh[x.i] AND {room('i')})[1]"
    short = f"(s.mass / mass < {CFG.relevance_threshold} OR len(s.sel) < {CFG.min_docs})"
    fold = lambda items, start, body: f"list_reduce({items}, lambda s, x: {body}, {start})"
    begin = f"struct_pack(i := CAST(0 AS BIGINT), {none})"
    g4 = fold(steps("len(anchors)"), begin,
              f"CASE WHEN bests[x.i] IS NULL THEN s WHEN list_contains(s.sel, bests[x.i]) THEN struct_pack(i := x.i, sel := s.sel, "
              f"total := s.total, mass := s.mass, cov := {cover}) WHEN {room('bests[x.i]')} THEN {take('bests[x.i]', cover)} ELSE s END")
    g5 = fold(steps("len(anchors)"), "s4", f"CASE WHEN list_contains(s.cov, anchors[x.i]) OR {hit} IS NULL THEN s ELSE {take(hit, cover)} END")
    g6 = fold(steps("len(it)"), "s5", f"CASE WHEN {short} AND it[x.i].prob >= {CFG.anchor_min_prob} AND {room('x.i')} THEN {take('x.i', 's.cov')} ELSE s END")
    g7 = fold(steps("len(it)"), "s6", f"CASE WHEN len(s.sel) < {CFG.min_docs} AND {room('x.i')} THEN {take('x.i', 's.cov')} ELSE s END")
    complex_ = (f"(len(list_filter({S._sql_list(C.COMPLEX_WORDS)}, lambda w: contains(lower(e.question), w))) > 0 OR len(e.ents) > 2)")
    return mmr_ctes(rerank_sql) + f""",
ga AS (SELECT question_id, list_transform(ents, lambda t: lower(t)) AS anchors,
              CASE WHEN {complex_} THEN {CFG.max_docs_complex} ELSE {CFG.max_docs_simple} END AS max_docs FROM e),
gx AS (SELECT fin.question_id, final_rank, fin.doc_key, p2.doc_id, p2.prob, ga.anchors, ga.max_docs,
              CAST(greatest(1, length(coalesce(kbk.content, '')) // 4) AS BIGINT) AS tokens,
              list_transform(ga.anchors, lambda t: {norm('t')} = {norm("coalesce(kbk.name, '')")}) AS km,
              list_transform(ga.anchors, lambda t: contains(lower(coalesce(kbk.name, '')), t)) AS nh
       FROM fin JOIN p2 USING (question_id, doc_key) JOIN kbk ON kbk.doc_id = p2.doc_id JOIN ga ON ga.question_id = fin.question_id),
gi AS (SELECT question_id, any_value(anchors) AS anchors, any_value(max_docs) AS max_docs, sum(prob) AS pool_mass,
              CASE WHEN sum(prob) > 0 THEN sum(prob) ELSE 1.0 END AS mass, list(prob ORDER BY prob DESC) AS ps,
              list(struct_pack(doc_key := doc_key, doc_id := doc_id, prob := prob, tokens := tokens, km := km, nh := nh) ORDER BY final_rank) AS it
       FROM gx GROUP BY question_id),
gk AS (SELECT * FROM gi WHERE NOT (ps[1] < {CFG.abstain_top1} AND list_sum(ps[1:5]) < {CFG.abstain_top5_sum}
                                   AND ps[1] - coalesce(ps[2], 0) < {CFG.abstain_gap})),
gb AS (SELECT *, list_transform(range(1, len(anchors) + 1), lambda a: -(list_reverse_sort(list_transform(
              list_filter(range(1, len(it) + 1), lambda i: it[i].km[a] AND it[i].prob >= {CFG.anchor_min_prob}),
              lambda i: struct_pack(p := it[i].prob, k := -i)))[1].k)) AS bests FROM gk),
g4 AS (SELECT *, {g4} AS s4 FROM gb),
g5 AS (SELECT *, {g5} AS s5 FROM g4),
g6 AS (SELECT *, {g6} AS s6 FROM g5),
folded AS (SELECT *, {g7} AS s7 FROM g6),
ranked AS (SELECT question_id, it, list_sort(list_transform(s7.sel, lambda i, n: struct_pack(p := -it[i].prob, n := n, i := i))) AS ord FROM folded),
picked AS (SELECT question_id, it[ord[u.n].i].doc_key AS doc_key, it[ord[u.n].i].doc_id AS doc_id, it[ord[u.n].i].prob AS prob,
                  it[ord[u.n].i].tokens AS tokens, u.n AS sel_rank FROM ranked, unnest(range(1, len(ord) + 1)) u(n))"""


def sql_select(rerank_sql: str) -> str:
    return selection_ctes(rerank_sql) + """
SELECT question_id, CAST(sel_rank AS INTEGER) AS sel_rank, doc_key, round(prob, 6) AS prob, CAST(tokens AS INTEGER) AS tokens FROM picked"""


def sql_coverage(rerank_sql: str) -> str:
    return selection_ctes(rerank_sql) + """
SELECT ga.question_id, CAST(len(cov) AS INTEGER) AS n_covered, CAST(len(anchors) AS INTEGER) AS n_entities,
       array_to_string(list_filter(anchors, lambda t: NOT list_contains(cov, t)), '|') AS missing
FROM (SELECT ga.question_id, ga.anchors, CASE WHEN s7 IS NULL OR len(s7.sel) = 0 THEN CAST([] AS VARCHAR[]) ELSE s7.cov END AS cov
      FROM ga LEFT JOIN folded USING (question_id)) ga"""


def sql_summary(rerank_sql: str) -> str:
    return selection_ctes(rerank_sql) + """
SELECT gi.question_id, count(picked.doc_id) AS n_selected,
       round(coalesce(sum(picked.prob), 0.0) / CASE WHEN any_value(pool_mass) > 0 THEN any_value(pool_mass) ELSE 1.0 END, 6) AS mass_share,
       CAST(coalesce(sum(picked.tokens), 0) AS BIGINT) AS tokens, coalesce(arg_min(substr(kbk.content, 1, 200), sel_rank), '') AS preview
FROM gi LEFT JOIN picked USING (question_id) LEFT JOIN kbk ON kbk.doc_id = picked.doc_id GROUP BY gi.question_id"""


def sql_evaluation(rerank_sql: str, text_eval_sql: str) -> str:
    """J14 on the selected documents: continues with the evaluation part of the text oracle."""
    return selection_ctes(rerank_sql) + """,
gold AS (SELECT b.item_id AS question_id, k.doc_key AS doc_id FROM benchmark b JOIN kbk k ON contains(k.content, b.text) WHERE b.text <> ''),
res AS (SELECT question_id, sel_rank AS rank, doc_key AS doc_id, prob AS score FROM picked),
""" + text_eval_sql[text_eval_sql.index("fl AS (SELECT r.question_id"):].replace("\npq AS (", "\nmeasured AS (")
