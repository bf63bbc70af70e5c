"""The composed job: questions in, nested and validated answers out.

Every question is spelling-corrected and split; each of its sub-questions then goes through adaptive
retrieval, context, answer and validation as a question of its own, keyed by (question, number). The four
parts are separated by tables in the shared checkpoint folder, so a lost executor redoes one part at most. At
the end the sub-questions, at most ``max_subqs``, are nested again under their question in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT, RetrievalConfig
from quarry.operators import answers as H
from quarry.operators import decompose as C
from quarry.operators import spelling as D
from quarry.operators.text_index import stored
from quarry.plans.adaptive import KnowledgeBase, retrieve_adaptive


@dataclass
class AdaptiveAnswers:
    """``items``: one row per sub-question; ``nested``: one row per question."""

    items: DataFrame
    nested: DataFrame

    def report(self) -> DataFrame:
        """C14: preview, status and confidence of each sub-question."""
        status = self.items.select("question_id", "sub_no", "validation_status", "confidence")
        return C.decomposition_report(self.items.select("question_id", "mode", "sub_no", "sub_question"), status)


def sub_key():
    """The key of a sub-question within the job."""
    return F.concat_ws("\u0001", F.col("question_id").cast("string"), F.col("sub_no").cast("string"))


def answer_adaptive(questions: DataFrame, kb: KnowledgeBase, make_model, dictionary: DataFrame | None = None,
                    terms: DataFrame | None = None, max_subqs: int = 3, cfg: RetrievalConfig = DEFAULT) -> AdaptiveAnswers:
    """questions (question_id, question) -> their nested answers. ``make_model`` gives the answer function
    (:func:`quarry.operators.answers.generate_answers`). Without a dictionary spelling stays as it is. A blank
    question has one item without context. A sub-question for which nothing is selected gets the canned answer and
    fails validation, as it has no documents to agree with."""
    asked = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"))
    if dictionary is None:
        fixed = asked.select("question_id", F.col("question").alias("original"), F.col("question").alias("corrected"),
                             F.lit(1.0).alias("spelling_confidence"))
    else:
        fixed = D.spell_correct(asked, dictionary, terms).select("question_id", "original", "corrected",
                                                                F.col("confidence").alias("spelling_confidence"))
    fixed = stored(fixed, "corrected")

    subs = stored(C.decompose(fixed.select("question_id", F.col("corrected").alias("question")), max_subqs)
                  .withColumn("key", sub_key()), "sub-questions")
    single = subs.select(F.col("key").alias("question_id"), F.col("sub_question").alias("question"))

    selected = stored(retrieve_adaptive(single, kb, cfg).selected.select(
        "question_id", "doc_id", F.col("sel_rank").alias("rank"), F.col("prob").alias("score")), "selected")
    context = H.build_context(selected, kb.docs)
    prompts = single.join(context, "question_id").select("question_id", H.build_prompt("question", "context").alias("prompt"))
    found = H.generate_answers(prompts, make_model)
    answers = stored(single.join(found, "question_id", "left").select(
        "question_id", F.coalesce("answer", F.lit(H.NO_INFO_ANSWER)).alias("answer")), "answers")

    validation = H.validation_search(answers, selected.select("question_id", "doc_id"), kb.tfidf, kb.index, kb.docs)
    payload = H.answer_payload(single, answers, H.source_items(selected, kb.docs), validation)
    items = stored(subs.join(payload.drop("question").withColumnRenamed("question_id", "key"), "key"), "items").drop("key")

    result = F.struct("answer", "sources", "quality_check", "validation", "confidence", "validation_status", "semantic_scores", "meta")
    by_no = F.array_sort(F.collect_list(F.struct("sub_no", F.col("sub_question").alias("question"), result.alias("result"))),
                         lambda a, b: a["sub_no"] - b["sub_no"])
    nested = items.groupBy("question_id").agg(F.first("mode").alias("mode"), by_no.alias("items"))
    return AdaptiveAnswers(items, fixed.join(nested, "question_id").select(
        "question_id", "original", "corrected", "spelling_confidence", "mode", "items"))
