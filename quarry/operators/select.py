"""Adaptive selection, "step 3" (operators G1-G10).

The selection is order dependent, but a question holds at most ``pool_cap`` rows. So each
question is one array row, and the passes are SQL folds (``aggregate``) over it inside the
JVM: each pass is a list of places to look at and a condition to take one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT, RetrievalConfig
from quarry.functions.text import norm_key, token_estimate
from quarry.operators.questions import extract_entities, is_complex
from quarry.operators.rerank import name_keys

def doc_cap(complex_col, cfg: RetrievalConfig = DEFAULT):
    """5 documents for complex questions, else 2."""
    return F.when(complex_col, F.lit(cfg.max_docs_complex)).otherwise(F.lit(cfg.max_docs_simple))


def selection_inputs(final: DataFrame, questions: DataFrame, kb: DataFrame, cfg: RetrievalConfig = DEFAULT
                     ) -> DataFrame:
    """Per (question, document): order, probability, G1 token estimate, and per-entity
    flags (name/alias key equals the entity; name contains the entity)."""
    qe = extract_entities(questions.select("question_id", "question"))
    qe = qe.select("question_id", F.transform("entities", F.lower).alias("anchors"),
                   doc_cap(is_complex("question", "entities"), cfg).alias("max_docs"))
    x = (final.select("question_id", "doc_key", "doc_id", "prob", "final_rank")
         .join(kb.select("doc_id", "name", "alternative_names", "content"), "doc_id").join(qe, "question_id"))
    keys = name_keys()
    nm = F.lower(F.coalesce("name", F.lit("")))
    return x.select("question_id", "doc_key", "doc_id", "prob", "final_rank", "anchors", "max_docs",
                    token_estimate("content").alias("tokens"),
                    F.transform("anchors", lambda a: F.array_contains(keys, norm_key(a))).alias("key_match"),
                    F.transform("anchors", lambda a: nm.contains(a)).alias("name_has"))


STATE = "struct<sel:array<int>,total:bigint,mass:double,covered:array<string>>"


def _state(sel: Column, total: Column, mass: Column, covered: Column) -> Column:
    return F.struct(sel.alias("sel"), total.cast("long").alias("total"), mass.cast("double").alias("mass"), covered.alias("covered"))


def _fold(places: Column, start: Column, step) -> Column:
    return F.aggregate(places, start, lambda s, i: step(s, i).cast(STATE))


class _Places:
    """The rows of one question as an array ``items``; places count from 1 in final order."""

    def __init__(self, cfg: RetrievalConfig):
        self.cfg = cfg
        self.items, self.max_docs = F.col("items"), F.col("max_docs")
        self.all = F.sequence(F.lit(1), F.size("items"))

    def at(self, i: Column) -> Column:
        return F.element_at(self.items, i)

    def room(self, s: Column, i: Column) -> Column:
        """Place ``i`` is free and fits the document and token limits."""
        return (~F.array_contains(s["sel"], i) & (F.size(s["sel"]) < self.max_docs)
                & (s["total"] + self.at(i)["tokens"] <= self.cfg.max_tokens))

    def take(self, s: Column, i: Column, covered: Column | None = None) -> Column:
        row = self.at(i)
        return _state(F.concat(s["sel"], F.array(i)), s["total"] + row["tokens"], s["mass"] + row["prob"],
                      s["covered"] if covered is None else covered)

    def cover(self, s: Column, anchor: Column) -> Column:
        return F.array_union(s["covered"], F.array(anchor))

    def anchor_pass(self, s: Column, a: Column) -> Column:
        """The most probable row whose name or alias is the entity (earlier on ties)."""
        named = F.filter(self.all, lambda i: F.element_at(self.at(i)["key_match"], a) & (self.at(i)["prob"] >= self.cfg.anchor_min_prob))
        best = -F.array_max(F.transform(named, lambda i: F.struct(self.at(i)["prob"].alias("p"), (-i).alias("back"))))["back"]
        covered = self.cover(s, F.element_at("anchors", a))
        return (F.when(best.isNull(), s)
                .when(F.array_contains(s["sel"], best), _state(s["sel"], s["total"], s["mass"], covered))
                .when(self.room(s, best), self.take(s, best, covered)).otherwise(s))

    def entity_pass(self, s: Column, a: Column) -> Column:
        """An entity without a document takes the first row that names it and fits."""
        fits = F.filter(self.all, lambda i: F.element_at(self.at(i)["name_has"], a) & self.room(s, i))
        anchor = F.element_at("anchors", a)
        return F.when(F.array_contains(s["covered"], anchor) | (F.size(fits) == 0), s).otherwise(
            self.take(s, F.element_at(fits, F.lit(1)), self.cover(s, anchor)))

    def mass_pass(self, s: Column, i: Column) -> Column:
        """In order, until the wanted share of the probability is reached."""
        mass = F.aggregate(self.items, F.lit(0.0), lambda t, row: t + row["prob"])
        short = (s["mass"] / F.when(mass > 0, mass).otherwise(F.lit(1.0)) < self.cfg.relevance_threshold) | (F.size(s["sel"]) < self.cfg.min_docs)
        return F.when(short & (self.at(i)["prob"] >= self.cfg.anchor_min_prob) & self.room(s, i), self.take(s, i)).otherwise(s)

    def least_pass(self, s: Column, i: Column) -> Column:
        """In order, until the minimum number of documents is reached."""
        return F.when((F.size(s["sel"]) < self.cfg.min_docs) & self.room(s, i), self.take(s, i)).otherwise(s)

    def abstains(self) -> Column:
        """No row stands out."""
        p = F.reverse(F.array_sort(F.transform(self.items, lambda row: row["prob"])))
        nth = lambda n: F.coalesce(F.try_element_at(p, F.lit(n)), F.lit(0.0))
        five = F.aggregate(F.slice(p, 1, 5), F.lit(0.0), lambda t, x: t + x)
        return (nth(1) < self.cfg.abstain_top1) & (five < self.cfg.abstain_top5_sum) & (nth(1) - nth(2) < self.cfg.abstain_gap)


def adaptive_select(final: DataFrame, questions: DataFrame, kb: DataFrame, cfg: RetrievalConfig = DEFAULT
                    ) -> DataFrame:
    """Abstain gate, anchor pass, forced entity documents, mass fill, minimum
    documents; a document is never taken twice; result ordered by probability (the order of
    taking on ties). -> question_id, doc_key, doc_id, prob, tokens, sel_rank, covered."""
    inp = selection_inputs(final, questions, kb, cfg)
    per_q = inp.groupBy("question_id").agg(
        F.first("anchors").alias("anchors"), F.first("max_docs").alias("max_docs"),
        F.array_sort(F.collect_list(F.struct("final_rank", "doc_key", "doc_id", "prob", "tokens", "key_match",
                                             "name_has"))).alias("items"))
    return fold_selection(per_q, cfg)


def fold_selection(per_q: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """G3-G8 over (question_id, anchors, max_docs, items in final order)."""
    p = _Places(cfg)
    per_q = per_q.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>"))).where(~p.abstains())
    none = _state(F.array().cast("array<int>"), F.lit(0), F.lit(0.0), F.array().cast("array<string>")).cast(STATE)
    entities = F.when(F.size("anchors") > 0, F.sequence(F.lit(1), F.size("anchors"))).otherwise(F.array().cast("array<int>"))
    for name, places, step in (("s4", entities, p.anchor_pass), ("s5", entities, p.entity_pass),
                               ("s6", p.all, p.mass_pass), ("s7", p.all, p.least_pass)):
        per_q = per_q.withColumn(name, _fold(places, none, step))
        none = F.col(name)
    taken = F.array_sort(F.transform("s7.sel", lambda i, n: F.struct((-p.at(i)["prob"]).alias("p"), n.alias("n"), i.alias("i"))))
    return per_q.select("question_id", "items", F.col("s7.covered").alias("covered"), F.posexplode(taken).alias("pos", "t")) \
        .select("question_id", F.element_at("items", F.col("t.i")).alias("row"), (F.col("pos") + 1).alias("sel_rank"), "covered") \
        .select("question_id", "row.doc_key", "row.doc_id", "row.prob", F.col("row.tokens").cast("int").alias("tokens"), "sel_rank", "covered")


def coverage_report(selected: DataFrame, questions: DataFrame) -> DataFrame:
    """Covered / total entities and the missing ones, per question."""
    qe = extract_entities(questions.select("question_id", "question")).select(
        "question_id", F.transform("entities", F.lower).alias("anchors"))
    cov = selected.groupBy("question_id").agg(F.first("covered").alias("covered"))
    x = qe.join(cov, "question_id", "left").withColumn("covered", F.coalesce("covered", F.array().cast(
        "array<string>")))
    return x.select("question_id", F.size("covered").alias("n_covered"), F.size("anchors").alias("n_entities"),
                    F.array_join(F.array_except("anchors", "covered"), "|").alias("missing"))


def selection_summary(selected: DataFrame, final: DataFrame, kb: DataFrame) -> DataFrame:
    """Documents selected, share of the probability mass, tokens, 200-char preview; a
    question that abstained has 0 documents."""
    mass = final.groupBy("question_id").agg(F.sum("prob").alias("mass"))
    s = selected.join(kb.select("doc_id", "content"), "doc_id")
    agg = s.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_selected"), F.sum("prob").alias("p_sel"), F.sum("tokens").alias("tokens"),
        F.min_by(F.substring("content", 1, 200), "sel_rank").alias("preview"))
    none = F.lit(0).cast("long")
    p_sel = F.coalesce("p_sel", F.lit(0.0))
    return mass.join(agg, "question_id", "left").select(
        "question_id", F.coalesce("n_selected", none).alias("n_selected"),
        F.when(F.col("mass") > 0, p_sel / F.col("mass")).otherwise(p_sel).alias("mass_share"),
        F.coalesce("tokens", none).alias("tokens"), F.coalesce("preview", F.lit("")).alias("preview"))
