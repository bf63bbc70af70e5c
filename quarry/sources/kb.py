"""Knowledge-base tables built from the driver tables.

A KB row is ``doc_id, doc_key, type, name, content`` (+ optional alias/subfamily
arrays). ``documents_kb`` maps the ``documents`` table (type = source, name = first
three words, key = source, name and id); ``verbatim_gold`` finds, for each question text, the documents that
contain it verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import doc_key
from quarry.operators.block_index import TermBlocks
from quarry.operators.text_index import rows_of, stored
from quarry.operators.vectors import tokens
from quarry.sources.tables import table

#: Characters of a short question that a text must share before it is compared.
GRAM = 3

FIRST_WORDS = r"^\s*(\S+(?:\s+\S+){0,2})"


def first_words(text) -> F.Column:
    """The first three blank-separated words, joined by one blank."""
    return F.regexp_replace(F.regexp_extract(text, FIRST_WORDS, 1), r"\s+", " ")


def documents_kb(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    title = F.coalesce(first_words(F.col("text")), F.lit(""))
    # the id makes the document key unique; the name stays the title, which anchors are compared with
    unique = F.trim(F.concat(title, F.lit(" #"), F.col("doc_id").cast("string")))
    return d.select("doc_id", F.col("source").alias("type"), title.alias("name"), F.col("text").alias("content"),
                    "lang", "source", doc_key(F.col("source"), unique, F.col("text")).alias("doc_key"))


def benchmark_questions(spark, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def postings(kb: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """Distinct (id, token) pairs: the inverted index without weights."""
    return kb.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))


def verbatim_gold(questions: DataFrame, kb: DataFrame, q_key: str = "question_id", q_text: str = "question",
                  kb_key: str = "doc_id", kb_text: str = "content", terms: TermBlocks | None = None) -> DataFrame:
    """(q_key, kb_key) for every KB text that contains the question text verbatim.

    Candidates come from an equi-join on the question's rarest *interior* token
    (a token that is neither first nor last is a whole token of any text containing
    the question); ``contains`` on the whole texts then verifies. How many texts hold a token, and the documents that hold an
    anchor, come from ``terms``, the texts counted by block (made here if not given); only these documents' texts are
    tokenized and compared. Tokens, anchors and candidates are stored. Questions of fewer than
    three tokens may sit inside words: their candidates share the first ``GRAM`` characters
    (or all, if fewer) as a character gram. An empty question has no gold.
    """
    asked = questions.select(q_key, q_text, tokens(F.col(q_text)).alias("toks")).where(F.col(q_text) != "")
    cand_tok = stored(asked.where(F.size("toks") >= 3).select(
        q_key, F.explode(F.array_distinct(F.slice("toks", 2, F.size("toks") - 2))).alias("token")), "gold-tokens")
    terms = terms or TermBlocks.count(kb, kb_key, kb_text)
    # only the questions' tokens; the small sides are stored, so that Spark knows their size and broadcasts them
    dfreq = terms.rows.join(cand_tok.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("texts").alias("df"))
    w = Window.partitionBy(q_key).orderBy(F.col("df").asc(), F.length("token").desc(), F.col("token"))
    anchor = stored(cand_tok.join(dfreq, "token").withColumn("_r", F.row_number().over(w))
                    .where(F.col("_r") == 1).select(q_key, "token"), "gold-anchors")
    holders = terms.rows.join(anchor.select("token").distinct(), "token", "left_semi").select(F.explode("keys").alias(kb_key))
    cands = postings(rows_of(kb, holders, kb_key), kb_key, kb_text).join(anchor, "token").select(q_key, kb_key)
    short = asked.where(F.size("toks") < 3).select(q_key, F.substring(q_text, 1, GRAM).alias("gram"))
    lengths = [r[0] for r in short.select(F.length("gram")).distinct().collect()]  # at most GRAM rows
    for n in lengths:
        grams = kb.select(kb_key, F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(kb_text) - n + 1)), lambda i: F.substr(F.col(kb_text), i, F.lit(n))))).alias("gram"))
        cands = cands.unionByName(short.where(F.length("gram") == n).join(grams, "gram").select(q_key, kb_key))
    cands = stored(cands, "gold-candidates")
    near = rows_of(kb.select(kb_key, kb_text), cands, kb_key)
    return (cands.join(questions.select(q_key, q_text), q_key).join(near, kb_key)
            .where(F.col(kb_text).contains(F.col(q_text))).select(q_key, kb_key))


def build_or_load_kb(spark, path: str, build, force: bool = False) -> DataFrame:
    """Reuse the KB stored at ``path`` (a written Parquet table, partitioned by
    ``type``) unless ``force``; otherwise run ``build() -> DataFrame``, write it there
    and read it back. A folder without its ``_SUCCESS`` mark was not finished and is
    written again. ``path`` should live in shared storage (e.g. under the session's
    ``spark.checkpoint.dir``)."""
    if force or not _finished(spark, path):
        build().write.mode("overwrite").partitionBy("type").parquet(path)
    return spark.read.parquet(path)


def _finished(spark, path: str) -> bool:
    """Whether the folder holds Spark's mark of a completed write (asked of the path's own file system)."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
