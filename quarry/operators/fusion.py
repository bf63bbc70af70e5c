"""Candidate generation and fusion, "step 1" (operators E1-E15).

Long tables keyed by ``question_id``: sub-queries ``(question_id, list_name,
subq_no, text)``, raw hits ``(question_id, list_name, subq_no, doc_key, score,
rank0)`` and the fused pool ``(question_id, doc_key, fused, provenance)``. All
per-question state is bounded by the candidate pool (lists x k rows), so the
greedy coverage step is a higher-order ``aggregate`` inside one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, RetrievalConfig
from quarry.operators.text_index import rows_of
from quarry.operators.questions import (alias_table, doc_mentions, extract_entities, mention_terms, parse_alt_names,
                                        quoted_phrases, relation_profile)

LIST_ORDER = ["full", "entity", "name_boost", "pair", "rel", "vs"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# --------------------------------------------------------------------------- E1, E2


def fan_out(questions: DataFrame, use_pairs: bool = False) -> DataFrame:
    """E1 (+E2 when ``use_pairs``): sub-queries per question.
    -> question_id, list_name, list_order, subq_no, text."""
    q = extract_entities(questions.select("question_id", "question"))
    quoted = F.filter(F.transform(quoted_phrases(F.col("question")), _strip), lambda t: t != "")
    lists = [F.struct(F.lit("full").alias("list_name"), F.array(F.col("question")).alias("texts")),
             F.struct(F.lit("entity").alias("list_name"),
                      F.flatten(F.transform("entities", lambda e: F.array(e, F.concat(e, F.lit("."))))).alias("texts")),
             F.struct(F.lit("name_boost").alias("list_name"),
                      F.array_distinct(F.filter(F.concat(F.col("entities"), quoted), lambda t: t != "")).alias("texts"))]
    if use_pairs:
        srt = F.array_sort(F.col("entities"))
        a, b = F.try_element_at(srt, F.lit(1)), F.try_element_at(srt, F.lit(2))
        two = F.size("entities") >= 2
        mk = lambda *xs: F.when(two, F.array(*xs)).otherwise(F.array().cast("array<string>"))
        lists += [
            F.struct(F.lit("pair").alias("list_name"), mk(F.concat_ws(" ", a, b), F.concat_ws(" ", b, a)).alias("texts")),
            F.struct(F.lit("rel").alias("list_name"),
                     mk(F.concat(F.lit("relation between "), a, F.lit(" and "), b),
                        F.concat(F.lit("relationship of "), a, F.lit(" to "), b),
                        F.concat(F.lit("how are "), a, F.lit(" and "), b, F.lit(" related?"))).alias("texts")),
            F.struct(F.lit("vs").alias("list_name"),
                     mk(F.concat(a, F.lit(" vs "), b), F.concat(b, F.lit(" vs "), a)).alias("texts"))]
    x = q.select("question_id", F.explode(F.array(*lists)).alias("l"))
    order = reduce(lambda acc, kv: acc.when(F.col("l.list_name") == kv[1], F.lit(kv[0])),
                   list(enumerate(LIST_ORDER))[1:], F.when(F.col("l.list_name") == "full", F.lit(0)))
    return x.select("question_id", F.col("l.list_name").alias("list_name"), order.alias("list_order"),
                    F.posexplode("l.texts").alias("subq_no", "text"))


# --------------------------------------------------------------------------- E3


def search_lists(subqs: DataFrame, search, kb: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """One search over every sub-query with k = max(k_init, pool_cap).
    ``search(queries(sq_key, text), k) -> (sq_key, rank, doc_id, score)``.
    -> question_id, list_name, list_order, subq_no, doc_id, doc_key, score, rank0."""
    k = max(cfg.k_init, cfg.pool_cap)
    keyed = subqs.withColumn("sq_key", F.concat_ws("\u0001", F.col("question_id").cast("string"), "list_name",
                                                   F.col("subq_no").cast("string")))
    hits = search(keyed.select("sq_key", "text"), k)
    return (hits.join(keyed.drop("text"), "sq_key").join(rows_of(kb.select("doc_id", "doc_key"), hits), "doc_id")
            .select("question_id", "list_name", "list_order", "subq_no", "doc_id", "doc_key", "score",
                    (F.col("rank") - 1).alias("rank0")))


# --------------------------------------------------------------------------- E4-E7


def list_weight(list_name: Column, relation: Column, cfg: RetrievalConfig = DEFAULT) -> Column:
    """E6 weight of a list: relation profile or default; unknown lists 1.0."""
    rel = reduce(lambda acc, kv: acc.when(list_name == kv[0], F.lit(kv[1])), cfg.relation_weights.items(), F)
    dfl = reduce(lambda acc, kv: acc.when(list_name == kv[0], F.lit(kv[1])), cfg.default_weights.items(), F)
    return F.when(relation, rel.otherwise(F.lit(1.0))).otherwise(dfl.otherwise(F.lit(1.0)))


def normalised_lists(hits: DataFrame) -> DataFrame:
    """E4 + E5: best score per (question, list, doc) floored at 0, then min-max per list."""
    best = hits.groupBy("question_id", "list_name", "doc_key").agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("s"))
    w = Window.partitionBy("question_id", "list_name")
    mn, mx = F.min("s").over(w), F.max("s").over(w)
    return best.withColumn("ns", F.when(mx > mn, (F.col("s") - mn) / (mx - mn)).otherwise(F.lit(0.0)))


def weighted_fusion(normed: DataFrame, questions: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Sum of list weight x normalised score. -> question_id, doc_key, wsum, lists."""
    prof = questions.select("question_id", relation_profile("question").alias("relation"))
    return (normed.join(prof, "question_id")
            .groupBy("question_id", "doc_key").agg(
                F.sum(list_weight(F.col("list_name"), F.col("relation"), cfg) * F.col("ns")).alias("wsum"),
                F.collect_set("list_name").alias("lists")))


def rrf_term(hits: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """rrf_weight / (rrf_k + rank0 + 1) summed over every raw hit."""
    return hits.groupBy("question_id", "doc_key").agg(
        F.sum(F.lit(cfg.rrf_weight) / (F.lit(cfg.rrf_k) + F.col("rank0") + 1)).alias("rrf"),
        F.collect_set(F.concat(F.lit("rrf:"), F.col("list_name"))).alias("rrf_lists"))


# --------------------------------------------------------------------------- E8, E9


def type_prior(type_col: Column, cfg: RetrievalConfig = DEFAULT) -> Column:
    """Multiplier per document type (1.0 if not listed)."""
    return reduce(lambda acc, kv: acc.when(type_col == kv[0], F.lit(kv[1])), cfg.type_prior.items(), F).otherwise(
        F.lit(1.0))


def subfamily_prior(question: Column, subfamilies: Column, cfg: RetrievalConfig = DEFAULT) -> Column:
    """Product of multipliers whose hint is in both the question and the doc's subfamilies."""
    ql, sl = F.lower(question), F.lower(F.coalesce(subfamilies, F.lit("")))
    out = F.lit(1.0)
    for hint, mult in cfg.subfamily_prior.items():
        out = out * F.when(ql.contains(hint) & sl.contains(hint), F.lit(mult)).otherwise(F.lit(1.0))
    return out


# --------------------------------------------------------------------------- E10-E13


def candidate_docs(hits: DataFrame, kb: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Representative document per (question, doc_key): the first hit in list,
    sub-query and rank order (the reference keeps the first document it saw), with the question's columns
    of ``asked``, if given."""
    first = hits.groupBy("question_id", "doc_key").agg(
        F.min_by("doc_id", F.struct("list_order", "subq_no", "rank0", "doc_id")).alias("doc_id"))
    meta = kb.select("doc_id", "type", "name", "source", "content", "alternative_names", "bsc_subfamilies")
    return (first if asked is None else first.join(asked, "question_id")).join(meta, "doc_id")


def entity_terms(questions_e: DataFrame, hits: DataFrame, kb: DataFrame) -> DataFrame:
    """E10 helper: per question, the ordered entity list with each entity's mention
    terms (itself + aliases, C6, of the touched documents whose name equals it).
    -> question_id, ents array<struct<e, terms>>."""
    touched = hits.select("question_id", "doc_id").distinct().join(
        kb.select("doc_id", "name", "alternative_names"), "doc_id")
    alias = (touched.select("question_id", F.lower(_strip(F.coalesce("name", F.lit("")))).alias("nl"),
                            F.explode(parse_alt_names("alternative_names")).alias("alias"))
             .where(F.col("nl") != "")
             .groupBy("question_id", "nl").agg(F.array_sort(F.collect_set("alias")).alias("aliases")))
    ents = questions_e.select("question_id", F.posexplode("entities").alias("ei", "e"))
    with_alias = ents.join(alias, (ents.question_id == alias.question_id) & (F.lower(ents.e) == alias.nl), "left") \
        .select(ents.question_id, "ei", "e", mention_terms(F.col("e"), F.col("aliases")).alias("terms"))
    return with_alias.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ei", "e", "terms"))),
                    lambda x: F.struct(x["e"].alias("e"), x["terms"].alias("terms"))).alias("ents"))


def blob(content: Column, source: Column, type_: Column, name: Column) -> Column:
    """Lower-cased content and metadata values (source, type, name)."""
    return F.concat(F.lower(F.coalesce(content, F.lit(""))), F.lit(" "),
                    F.lower(F.concat_ws(" ", source, type_, name)))


def fuse(questions: DataFrame, hits: DataFrame, kb: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Fused, prior-adjusted, co-mention-boosted candidates, capped at
    pool_cap with coverage promotion. -> question_id, doc_key, doc_id, fused,
    provenance (sorted array), pool_rank."""
    qe = extract_entities(questions.select("question_id", "question"))
    fused = weighted_fusion(normalised_lists(hits), questions, cfg).join(rrf_term(hits, cfg),
                                                                         ["question_id", "doc_key"])
    ents = entity_terms(qe, hits, kb)
    asked = questions.select("question_id", "question").join(ents, "question_id", "left").withColumn(
        "ents", F.coalesce("ents", F.array().cast("array<struct<e:string,terms:array<string>>>")))
    # per-entity mention flags of this document (E10, E13), taken where the text is, which goes no further
    x = candidate_docs(hits, kb, asked)
    x = x.withColumn("_blob", blob(F.col("content"), F.col("source"), F.col("type"), F.col("name")))
    x = x.withColumn("mentions", F.transform("ents", lambda en: doc_mentions(F.col("_blob"), en["terms"]))).drop("_blob", "content")
    x = fused.join(x, ["question_id", "doc_key"])
    score = ((F.col("wsum") + F.col("rrf")) * type_prior(F.col("type"), cfg) *
             subfamily_prior(F.col("question"), F.col("bsc_subfamilies"), cfg))
    co = (F.size("ents") > 0) & F.forall("mentions", lambda m: m)
    x = x.withColumn("fused", score + F.when(co, F.lit(cfg.co_mention_bonus)).otherwise(F.lit(0.0)))
    x = x.withColumn("provenance", F.array_sort(F.array_distinct(F.concat(
        "lists", "rrf_lists", F.when(co, F.array(F.lit("co_mention"))).otherwise(F.array().cast("array<string>"))))))
    w = Window.partitionBy("question_id").orderBy(F.round("fused", 9).desc(), F.col("doc_key"))
    x = x.withColumn("r", F.row_number().over(w))
    return coverage_promotion(x.select("question_id", "doc_key", "doc_id", "fused", "provenance", "r", "mentions",
                                       F.transform("ents", lambda en: en["e"]).alias("entity_names")), cfg)


def coverage_promotion(ranked: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """E12 + E13: keep the top pool_cap; for each entity (in order) that no pool
    document mentions, the best tail document mentioning it (not already promoted)
    replaces the worst remaining pool row. Greedy fold over a bounded array."""
    cap = cfg.pool_cap
    per_q = ranked.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "doc_key", "doc_id", "fused", "provenance", "mentions"))).alias("c"),
        F.first("entity_names").alias("entity_names"))
    top = F.filter("c", lambda z: z["r"] <= cap)
    tail = F.filter("c", lambda z: z["r"] > cap)
    per_q = per_q.withColumn("top", top).withColumn("tail", tail)
    n_ent = F.size("entity_names")
    missing = F.filter(F.sequence(F.lit(0), n_ent - 1),
                       lambda i: (n_ent > 0) & ~F.exists(F.col("top"), lambda z: F.try_element_at(z["mentions"], i + 1)))
    per_q = per_q.withColumn("missing", F.when(n_ent > 0, missing).otherwise(F.array().cast("array<int>")))
    empty = F.array().cast("array<struct<doc_key:string,ei:int>>")
    picks = F.aggregate(
        "missing", empty,
        lambda acc, i: F.concat(acc, F.transform(F.slice(F.filter(
            F.col("tail"), lambda z: F.try_element_at(z["mentions"], i + 1) &
            ~F.exists(acc, lambda p: p["doc_key"] == z["doc_key"])), 1, 1),
            lambda z: F.struct(z["doc_key"].alias("doc_key"), i.alias("ei")))))
    per_q = per_q.withColumn("picks", picks)
    n_keep = F.size("top") - F.least(F.size("picks"), F.size("top"))
    kept = F.transform(F.slice("top", 1, n_keep), lambda z: F.struct(
        z["doc_key"].alias("doc_key"), z["doc_id"].alias("doc_id"), z["fused"].alias("fused"),
        z["provenance"].alias("provenance")))
    promoted = F.transform("picks", lambda p: F.struct(
        p["doc_key"].alias("doc_key"),
        F.filter(F.col("tail"), lambda z: z["doc_key"] == p["doc_key"])[0]["doc_id"].alias("doc_id"),
        F.filter(F.col("tail"), lambda z: z["doc_key"] == p["doc_key"])[0]["fused"].alias("fused"),
        F.array_sort(F.concat(F.filter(F.col("tail"), lambda z: z["doc_key"] == p["doc_key"])[0]["provenance"],
                              F.array(F.concat(F.lit("coverage:"), F.col("entity_names")[p["ei"]])))).alias(
            "provenance")))
    pool = per_q.select("question_id", F.explode(F.concat(kept, promoted)).alias("p")).select("question_id", "p.*")
    w = Window.partitionBy("question_id").orderBy(F.round("fused", 9).desc(), F.col("doc_key"))
    return pool.withColumn("pool_rank", F.row_number().over(w))


# --------------------------------------------------------------------------- E14


def fusion_stats(pool: DataFrame, hits: DataFrame) -> DataFrame:
    """Raw hits, unique candidates, pool size, fused min/max/mean/std (population),
    top1 - top2 gap and its band."""
    raw = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("raw_hits"),
                                          F.countDistinct("doc_key").alias("unique_candidates"))
    st = pool.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("pool_size"), F.min("fused").alias("fused_min"), F.max("fused").alias("fused_max"),
        F.avg("fused").alias("fused_mean"), F.stddev_pop("fused").alias("fused_std"),
        F.max(F.when(F.col("pool_rank") == 1, F.col("fused"))).alias("top1"),
        F.max(F.when(F.col("pool_rank") == 2, F.col("fused"))).alias("top2"))
    gap = F.col("top1") - F.col("top2")
    return raw.join(st, "question_id", "left").select(
        "question_id", "raw_hits", "unique_candidates", F.coalesce("pool_size", F.lit(0)).alias("pool_size"),
        "fused_min", "fused_max", "fused_mean", "fused_std", gap.alias("gap"),
        F.when(gap > 0.2, "strong").when(gap > 0.1, "clear").when(gap.isNotNull(), "multiple").alias("gap_band"))


# --------------------------------------------------------------------------- E15

# ---- fixed values: title bonuses of the weighted RRF
NAME_BOOST = 0.35
BOTH_NAMES_BOOST = 0.20


def weighted_rrf(hits: DataFrame, kb: DataFrame, questions_e: DataFrame, list_weights: dict | None = None,
                 rrf_k: int = 60, aliases: DataFrame | None = None) -> DataFrame:
    """Sum of w / (rrf_k + rank) with 1-based rank per list; ``name_boost`` if the
    document's title contains an entity of the question or one of that entity's aliases,
    ``both_names`` on top if it does so for two different entities; contributions per list and
    bonus as a map. ``aliases``: (name_lc, aliases), the KB's own by default."""
    lw = list_weights or {}
    w = reduce(lambda acc, kv: acc.when(F.col("list_name") == kv[0], F.lit(kv[1])), lw.items(), F).otherwise(
        F.lit(1.0)) if lw else F.lit(1.0)
    contrib = hits.select("question_id", "doc_key", "list_name", (w / (F.lit(rrf_k) + F.col("rank0") + 1)).alias("c"))
    order = [c for c in ("list_order", "subq_no", "rank0", "doc_id") if c in hits.columns]
    titles = hits.groupBy("question_id", "doc_key").agg(F.min_by("doc_id", F.struct(*order)).alias("doc_id")).join(
        kb.select("doc_id", F.lower(F.coalesce("name", F.lit(""))).alias("title")), "doc_id")
    known = aliases if aliases is not None else alias_table(kb)
    ents = questions_e.select("question_id", F.explode(F.array_distinct("entities")).alias("e"))
    terms = ents.join(known, F.lower("e") == F.col("name_lc"), "left").groupBy("question_id").agg(
        F.collect_list(mention_terms(F.col("e"), F.col("aliases"))).alias("terms"))  # one row per entity of a question
    named = titles.join(terms, "question_id").withColumn(
        "n_named", F.size(F.filter("terms", lambda ts: F.exists(ts, lambda t: (t != "") & F.col("title").contains(t)))))
    bonus = F.array(F.when(F.col("n_named") >= 1, F.struct(F.lit("name_boost").alias("list_name"), F.lit(NAME_BOOST).alias("c"))),
                    F.when(F.col("n_named") >= 2, F.struct(F.lit("both_names").alias("list_name"), F.lit(BOTH_NAMES_BOOST).alias("c"))))
    extra = named.select("question_id", "doc_key", F.explode(F.array_compact(bonus)).alias("b")).select("question_id", "doc_key", "b.*")
    per_list = contrib.unionByName(extra).groupBy("question_id", "doc_key", "list_name").agg(F.sum("c").alias("c"))
    return per_list.groupBy("question_id", "doc_key").agg(
        F.sum("c").alias("score"), F.map_from_entries(F.collect_list(F.struct("list_name", "c"))).alias("contributions"))
