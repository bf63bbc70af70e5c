"""Question-set files (A15) and out-of-domain questions from a trivia feed."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("question", T.StringType()),
    T.StructField("entity_type", T.StringType()), T.StructField("entity_name", T.StringType()),
    T.StructField("expected_document_type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("ground_truth_docs", T.ArrayType(T.StringType())),
    T.StructField("trivia_category", T.IntegerType()), T.StructField("original_question", T.StringType()),
    T.StructField("entity_name_with_typo", T.StringType()), T.StructField("typo_subcategory", T.StringType()),
    T.StructField("typo_details", T.StringType()), T.StructField("entity1_name", T.StringType()),
    T.StructField("entity2_name", T.StringType()),
])

# ---- fixed values: trivia category names by id (28 is the default category to avoid)
TRIVIA_CATEGORIES = {
    9: "General Knowledge", 10: "Entertainment: Books", 11: "Entertainment: Film",
    12: "Entertainment: Music", 13: "Entertainment: Musicals & Theatres",
    14: "Entertainment: Television", 15: "Entertainment: Video Games",
    16: "Entertainment: Board Games", 17: "Science & Nature", 18: "Science: Computers",
    19: "Science: Mathematics", 20: "Mythology", 21: "Sports", 22: "Geography",
    23: "History", 24: "Politics", 25: "Art", 26: "Celebrities", 27: "Animals",
    29: "Entertainment: Comics", 30: "Science: Gadgets", 31: "Entertainment: Japanese Anime & Manga",
    32: "Entertainment: Cartoon & Animations",
}
DEFAULT_AVOID = (28,)


def read_questions(spark: SparkSession, paths) -> DataFrame:
    """Question sets as JSON arrays of records (several files are
    concatenated); JSON Lines files are read as well. A file whose top level is an
    object (not a list) is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract("value", r"^\s*(\S)", 1).alias("c"))
    if heads.where(F.col("c") == "{").limit(1).count() and \
            heads.where(F.col("c") == "[").limit(1).count() == 0:
        lines = spark.read.schema(QUESTION_SCHEMA).json(paths)
        return lines
    bad = heads.where((F.col("c") != "[") & (F.col("c") != "")).limit(1).count()
    if bad:
        raise ValueError("a question set file is not a JSON list")
    return spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).json(paths)


def write_questions(df: DataFrame, path: str) -> None:
    """A15 sink: JSON Lines, one file per partition (no single-task gather)."""
    df.write.mode("overwrite").json(path)


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """HTML entities decoded (named and numeric), vectorised per Arrow batch."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def category_name(cat) -> F.Column:
    expr = F.concat(F.lit("Category "), cat.cast("string"))
    for k in sorted(TRIVIA_CATEGORIES, reverse=True):
        expr = F.when(cat == k, F.lit(TRIVIA_CATEGORIES[k])).otherwise(expr)
    return expr


def ood_questions(feed: DataFrame, num_questions: int = 500, avoid=DEFAULT_AVOID, order_col: str = "item_id"
                  ) -> DataFrame:
    """Trivia items (question, category, order_col) -> out-of-domain questions:
    HTML-unescaped, avoided categories dropped, capped at ``num_questions`` (the
    feature: a fixed-size test set, taken as a distributed top-n), 1-based ids,
    empty ground truth."""
    kept = feed.where(~F.col("category").isin(list(avoid))) if avoid else feed
    top = kept.orderBy(order_col).limit(num_questions)
    w = Window.orderBy(order_col)  # over at most num_questions rows
    return top.select(
        F.row_number().over(w).cast("long").alias("question_id"), html_unescape(F.col("question")).alias("question"),
        F.lit("General Knowledge").alias("entity_type"),
        F.concat(category_name(F.col("category")), F.lit(" Question")).alias("entity_name"),
        F.lit("None").alias("expected_document_type"), F.lit("out_of_domain").alias("category"),
        F.array().cast("array<string>").alias("ground_truth_docs"),
        F.col("category").cast("int").alias("trivia_category"))
