"""Spelling variant grouping (op 12): asymmetric q-chunks.

Words. The maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of a text, A-Z lower-cased; a run whose crc32 with its
document's id is divisible by 31 loses a code point (:func:`damaged`). Words are the distinct
results of at least 7 code points and 2 occurrences.

Near words (one code point inserted, deleted or replaced). Of two words the shorter one (of equal
ones the smaller) is cut into two disjoint chunks that cover it; the other gives its positional grams of the
chunks' sizes. One edit leaves a chunk whole: the front one in its place if the edit comes behind it, else the
back one, moved by the difference in length, which is one at most. So of the positional grams only
those two can decide, for each of the two lengths the partner may have, and only they are sent.
They meet in an equi-join; candidates are verified by edit distance.

Hot chunks. A chunk that more than ``HOT`` words share is not joined as it is: what is left of both words beside
it must be near in the same sense, so its rows are cut once more by the same rule and joined on chunk and
sub-chunk. A gram thus meets at most ``HOT`` words through a plain chunk, and three quarters of a
word agree elsewhere. No pair is lost: the rule is exact at either level.

Defined cases: null or empty texts have no words, a null ``doc_id`` counts as an empty one,
repeated rows count again, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import store, text_rows

SHORTEST = 7
FEWEST = 2
#: A form occurs this many times as often as the word.
RATIO = 10
HOT = 100
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)
LOWER = {ord("A") + i: ord("a") + i for i in range(26)}
FLUSH = 6_000_000


def damaged(doc_id: int | None, run: str) -> str:
    """The run as it counts: without one code point if 31 divides its crc32 with the id."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> words with their occurrences, added up until ``FLUSH`` characters are held."""
    found, size = Counter(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            doc_id = doc_id.as_py()
            for run, n in Counter(RUN.findall(text.as_py())).items():
                word = damaged(doc_id, run.lower() if run.isascii() else run.translate(LOWER))
                if len(word) >= SHORTEST:
                    if word not in found:
                        size += len(word) + 80
                    found[word] += n
            if size > FLUSH * 8:
                yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=_COUNTS)
                found, size = Counter(), 0
    yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=_COUNTS)


def words(docs: DataFrame) -> DataFrame:
    """word and n (occurrences in all documents, at least ``FEWEST``)."""
    return text_rows(docs).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= FEWEST)


def _chunk(text: Column, which: Column, length: Column) -> tuple[Column, Column]:
    """The chunk ``which`` (0 front, 1 back) for a word of ``length`` that ``text`` is or is near to, and
    the rest of ``text``."""
    front = F.floor((length + 1) / 2).cast("int")
    size = F.char_length(text)
    cut = F.when(which == 0, front).otherwise(size - (length - front)).cast("int")
    left, right = F.substr(text, F.lit(1), cut), F.substr(text, cut + 1, size)
    return F.when(which == 0, left).otherwise(right), F.when(which == 0, right).otherwise(left)


def _sides(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of chunks and of grams: key, word, n, rest, and the length of the rest's partner."""
    length = F.char_length("word")
    rows = vocabulary.select("word", "n", F.explode(F.expr("array(0, 1)")).alias("which"), length.alias("length"))
    grams = vocabulary.select("word", "n", F.explode(F.expr("array(0, 1)")).alias("which"),
                              F.explode(F.filter(F.array(length, length - 1), lambda x: x >= SHORTEST)).alias("length"))

    def keyed(df: DataFrame) -> DataFrame:
        chunk, rest = _chunk(F.col("word"), F.col("which"), F.col("length"))
        front = F.floor((F.col("length") + 1) / 2)
        partner = F.when(F.col("which") == 0, F.col("length") - front).otherwise(front).cast("int")
        return df.select(F.xxhash64("length", "which", chunk).alias("key"), "word", "n", rest.alias("rest"), partner.alias("partner"))
    return keyed(rows), keyed(grams)


def _refined(side: DataFrame) -> DataFrame:
    """The same rule once more, on what is left beside the chunk."""
    rows = side.withColumn("which", F.explode(F.expr("array(0, 1)")))
    sub, _ = _chunk(F.col("rest"), F.col("which"), F.col("partner"))
    return rows.select(F.xxhash64("key", "which", sub).alias("key"), "word", "n", "rest", "partner")


def near_pairs(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """The pairs (a, n_a, b, n_b) of near words, each once."""
    chunks, grams = _sides(vocabulary)
    shared = store(chunks.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-chunks")

    def joined(c: DataFrame, g: DataFrame) -> DataFrame:
        c = c.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        g = g.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        longer = F.char_length("b") - F.char_length("a")
        return c.join(g, "key").where((longer.between(0, 1)) & ((longer == 1) | (F.col("a") < F.col("b")))
                                      & (F.levenshtein("a", "b", 1) == 1)).drop("key")
    plain = joined(chunks.join(shared, "key", "left_anti"), grams.join(shared, "key", "left_anti"))
    fine = joined(_refined(chunks.join(shared, "key", "left_semi")), _refined(grams.join(shared, "key", "left_semi")))
    return plain.unionByName(fine).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Of (word, form) without circles: (word, root), the last form. Each round doubles the steps taken."""
    hops = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = hops.alias("a"), hops.select(F.col("word").alias("at"), F.col("root").alias("next")).alias("b")
        step = store(a.join(b, F.col("a.root") == F.col("b.at"), "left")
                     .select("a.word", F.coalesce("next", "a.root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        hops = step.select("word", "root")
        if step.where("moved").isEmpty():
            return hops


def group(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """word, form (its near word of largest n, ties to the smallest, if that has ``RATIO`` times the word's n, else
    null), root (the last form, or the word), n, n_near, form_n."""
    vocabulary = store(words(docs), "vocabulary")
    pairs = store(near_pairs(vocabulary, hot), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")) \
        .unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= RATIO * F.col("n")
    best = store(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"),
                             F.when(enough, -F.col("best.less")).alias("form_n")), "best")
    root = roots(best.where("form is not null").select("word", "form"))
    return vocabulary.join(best, "word", "left").join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
