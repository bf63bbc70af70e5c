"""Exact text search with upper bounds over an inverted index (B2).

The index is written once as Parquet in the shared checkpoint folder. Tokens are put into *tiers* by the share
of documents that hold them. Beside its postings a document has, per tier, the norm of its weights there, so the
inequality of Cauchy and Schwarz bounds what any question can still gain from the frequent tokens.

A search goes in four steps:

1. *Threshold.* The postings of a question's rarest tokens, as many tokens as give ``SEEDS * k`` postings, are added
   up, and the best 3 k documents are scored in full; the k-th of them is a lower bound ``theta`` of the
   question's k-th score.
2. *Cut.* Each question leaves out the tiers from some cut on: the cut with the fewest postings to join and
   documents to look at, by the tokens' counts and a histogram of the documents' norms.
3. *Candidates.* The tokens of the rarer tiers are joined with their postings. A document stays if what it
   gained, and the bound for the tiers left out, reach ``theta``. A document without any of these tokens can
   only get there by a large norm in the tiers left out: those come from the histogram's upper levels.
4. *Completion.* What stays gets its full score.

So a question meets a token that a large share of the documents hold only in documents that may
be in its result. The rows are those of the plain join of all postings.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, shuffles_freed

SEEDS = 1_000
#: Shares of the documents that part the tiers; tier 0 is below all of them.
TIERS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.4)
#: Steps of the histogram of norms.
LEVELS = 64
#: Looking a document up costs about as much as this many postings.
LOOKUP = 10
#: Scores are ranked by nine decimals; a bound must miss the threshold by more than that.
MARGIN = 1e-8


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back; the shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Distinct ids up to which :func:`rows_of` broadcasts them.
FEW_IDS = 1_000_000


def rows_of(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids``. The distinct ids are stored and counted (one action): up to
    ``FEW_IDS`` they are broadcast, so that the texts stay where they are read; more of them are joined by shuffle."""
    few = stored(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    return df.join(F.broadcast(few) if few.count() <= FEW_IDS else few, key, "left_semi")


def _gain(cut: Column, ours: Column, theirs: Column) -> Column:
    """Sum over the tiers from ``cut`` on of the products of two arrays of norms."""
    products = F.zip_with(ours, theirs, lambda x, y: x * y)
    return F.aggregate(F.slice(products, cut, F.lit(len(TIERS) + 1)), F.lit(0.0), lambda a, x: a + x)


def _norms(weight: Column) -> Column:
    """Aggregate: norm of the weights in each tier from 1 on."""
    return F.array(*(F.sqrt(F.coalesce(F.sum(F.when(F.col("tier") == t, weight * weight)), F.lit(0.0))) for t in range(1, len(TIERS) + 1)))


def _tail(norms: Column, cut: Column) -> Column:
    """Norm over the tiers from ``cut`` on."""
    return F.sqrt(F.aggregate(F.slice(norms, cut, F.lit(len(TIERS) + 1)), F.lit(0.0), lambda a, x: a + x * x))


@dataclass
class ImpactIndex:
    """postings (token, key, w), tokens (token, df, tier) and norms (key, norms per tier)."""

    postings: DataFrame
    tokens: DataFrame
    norms: DataFrame
    key: str

    @classmethod
    def build(cls, kb_terms: DataFrame, n_docs: int | None = None, key: str = "doc_id") -> "ImpactIndex":
        """From (key, token, w) with unit vectors of positive weights."""
        postings = stored(kb_terms.select("token", key, "w"), "postings")
        n_docs = postings.select(key).distinct().count() if n_docs is None else n_docs
        df = F.count(F.lit(1))
        tier = sum(((df > share * n_docs).cast("int") for share in TIERS), F.lit(0))
        tokens = stored(postings.groupBy("token").agg(df.alias("df"), tier.alias("tier")), "tokens")
        norms = stored(postings.join(tokens, "token").groupBy(key).agg(_norms(F.col("w")).alias("norms")), "norms")
        return cls(postings, tokens, norms, key)

    def levels(self) -> DataFrame:
        """(cut, level, key): the norm over the tiers from cut on, in ``LEVELS`` steps."""
        each = self.norms.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(len(TIERS)))))
        level = F.floor(LEVELS * _tail(F.col("norms"), F.col("cut")))
        return each.select("cut", F.least(F.lit(LEVELS), level).cast("int").alias("level"), self.key, "norms").where("level > 0")

    def above(self) -> DataFrame:
        """(cut, level, n): how many documents reach a level (at most one row per cut and level)."""
        counts = self.levels().groupBy("cut", "level").agg(F.count(F.lit(1)).alias("n"))
        return counts.select("cut", F.explode(F.sequence(F.lit(1), "level")).alias("level"), "n").groupBy("cut", "level").agg(F.sum("n").alias("n"))

    def full_scores(self, pairs: DataFrame, terms: DataFrame, q_key: str) -> DataFrame:
        """(q_key, key) -> with the score over all tokens of the question."""
        postings = self.postings.join(pairs.select(self.key).distinct(), self.key, "left_semi").select(self.key, "token", "w")
        return pairs.select(q_key, self.key).join(terms.select(q_key, "token", "wq"), q_key).join(postings, [self.key, "token"]) \
            .groupBy(q_key, self.key).agg(F.sum(F.col("wq") * F.col("w")).alias("score"))

    def thresholds(self, terms: DataFrame, k: int, q_key: str) -> DataFrame:
        """Per question theta: a lower bound of the k-th score, less the margin; 0 where fewer are known."""
        rarest = Window.partitionBy(q_key).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
        few = terms.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < SEEDS * k)
        seen = few.select(q_key, "token", "wq").join(self.postings, "token") \
            .groupBy(q_key, self.key).agg(F.sum(F.col("wq") * F.col("w")).alias("part"))
        best = Window.partitionBy(q_key).orderBy(F.desc("part"), self.key)
        seeds = seen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 3 * k)
        scores = self.full_scores(stored(seeds.select(q_key, self.key), "seeds"), terms, q_key)
        kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))  # 3 k scores at most
        return scores.groupBy(q_key).agg(F.greatest(F.coalesce(kth, F.lit(0.0)) - MARGIN, F.lit(0.0)).alias("theta"))

    def cuts(self, terms: DataFrame, thresholds: DataFrame, q_key: str) -> DataFrame:
        """Per question: theta, its norms per tier, and the cheapest cut, with the least level of the norm over the
        tiers left out that may reach theta by itself. Without a threshold nothing is left out."""
        none = len(TIERS) + 1
        sizes = F.array(*(F.coalesce(F.sum(F.when(F.col("tier") < cut, F.col("df"))), F.lit(0)) for cut in range(1, none + 1)))
        own = terms.groupBy(q_key).agg(_norms(F.col("wq")).alias("norms"), sizes.alias("sizes")).join(thresholds, q_key)
        each = own.withColumn("cut", F.explode(F.when(F.col("theta") > 0, F.sequence(F.lit(1), F.lit(none))).otherwise(F.array(F.lit(none)))))
        tail = _tail(F.col("norms"), F.col("cut"))
        level = F.when((F.col("cut") == none) | (tail * (1 + 1e-9) < F.col("theta")), F.lit(LEVELS + 1)) \
            .otherwise(F.floor(LEVELS * F.col("theta") / tail)).cast("int")
        each = each.withColumn("level", F.greatest(level, F.lit(1)))
        cost = F.element_at("sizes", F.col("cut")) + LOOKUP * F.coalesce("n", F.lit(0))
        return each.join(F.broadcast(self.above()), ["cut", "level"], "left") \
            .groupBy(q_key).agg(F.min_by(F.struct("theta", "norms", "cut", "level"), F.struct(cost, F.col("cut"))).alias("best")).select(q_key, "best.*")

    def candidates(self, terms: DataFrame, cuts: DataFrame, q_key: str) -> DataFrame:
        """The (q_key, key) that may reach theta."""
        ours, theirs = F.col("c.norms"), F.col("n.norms")
        bound = _gain(F.col("cut"), ours, theirs)
        parts = terms.join(cuts.select(q_key, "cut"), q_key).where("tier < cut").select(q_key, "token", "wq") \
            .join(self.postings, "token").groupBy(q_key, self.key).agg(F.sum(F.col("wq") * F.col("w")).alias("part"))
        seen = parts.join(cuts.alias("c"), q_key).join(self.norms.alias("n"), self.key).where(F.col("part") + bound >= F.col("theta"))
        high = cuts.where(F.col("level") <= LEVELS).withColumn("level", F.explode(F.sequence(F.col("level"), F.lit(LEVELS)))) \
            .select(q_key, "theta", "norms", "cut", "level").alias("c")
        other = high.join(self.levels().select(F.col("cut").alias("c2"), F.col("level").alias("l2"), self.key, "norms").alias("n"),
                          (F.col("c.cut") == F.col("c2")) & (F.col("c.level") == F.col("l2"))).where(bound >= F.col("theta"))
        return seen.select(q_key, self.key).unionByName(other.select(q_key, self.key)).distinct()

    def search(self, q_terms: DataFrame, k: int, q_key: str = "question_id") -> DataFrame:
        """(q_key, token, w) -> (q_key, rank, key, score) of the k best by (round(score, 9) desc, key)."""
        terms = stored(q_terms.select(q_key, "token", F.col("w").alias("wq")).join(self.tokens, "token"), "question-terms")
        cuts = stored(self.cuts(terms, self.thresholds(terms, k, q_key), q_key), "cuts")
        found = stored(self.candidates(terms, cuts, q_key), "candidates")
        order = Window.partitionBy(q_key).orderBy(F.round("score", 9).desc(), F.col(self.key).asc())
        return self.full_scores(found, terms, q_key).withColumn("rank", F.row_number().over(order)) \
            .where(F.col("rank") <= k).select(q_key, "rank", self.key, "score")
