"""Exact text search over blocks of documents (B2).

A text is tokenized once. Documents are dealt into blocks by a hash of their key, and a block's counts are kept as one
row per token: the documents that hold it and how often. So a table of postings travels as arrays, never as a
row per posting, and what a task holds is a block of bounded size:

1. ``TermBlocks.count`` deals the texts by block and counts, batch by batch (the only pass over the texts).
2. ``BlockIndex.build`` adds each document's norm, from the counts joined with the tokens' weights (of the most frequent
   tokens, by broadcast).
3. ``BlockIndex.search`` meets every chunk of questions with every cell (a few blocks), some questions at a time: the rarer tokens' postings
   are added up exactly, the frequent tokens' rows in single precision. The k-th best of the largest sums of groups of documents, less the
   error that single precision can make, bounds the result from below; only the documents above it get their exact score. A window
   merges the cells' best k.

Every token counts; the rows are those of the plain join of all postings. With as many questions as documents
the work is their product by nature; memory stays that of a cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN_PATTERN
from quarry.operators.text_index import stored

#: Characters of the texts of a block, on average.
BLOCK_CHARS = 4_000_000
#: Blocks of a cell where there are more than FEW questions: these, or as many as make CELLS cells, at most MOST_BLOCKS. So a question is
#: sent to few cells. Questions of a chunk.
CELL_BLOCKS, MOST_BLOCKS, CELLS, CHUNK, FEW = 4, 12, 24, 65_536, 1_000
#: Rows of question terms up to which their distinct tokens are broadcast to leave out other tokens' counts.
FEW_TERMS = 50_000
#: Rows into which the tokens of a block are packed for a search: to hand a row to Python costs more than what is in it.
PACKS = 8
#: The most frequent tokens, whose weights are broadcast.
OFTEN = 50_000
#: A token in more than this share of a cell's documents is frequent there.
FREQUENT = 1 / 8
#: Sums of a step of a search (questions times documents), and products of a step of the exact scores.
SUMS, PRODUCTS = 160_000, 1_000_000
#: Scores are ranked by nine decimals; a bound must miss the threshold by more than that.
MARGIN = 1e-8


def _lists(values, starts) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the distinct values (null is one of them), and the values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = whole.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _pairs(tokens, keys, counts, texts) -> pa.Table:
    """One row per (token, key), by token: counts and texts added up."""
    (t, tokens), (k, keys) = _codes(tokens), _codes(keys)
    pair, at = np.unique(t.astype(np.int64) * max(1, len(keys)) + k, return_inverse=True)
    add = lambda x: np.bincount(at, weights=x, minlength=len(pair)).astype(np.int64)
    return pa.table({"token": tokens.take(pa.array(pair // max(1, len(keys)))), "key": keys.take(pa.array(pair % max(1, len(keys)))),
                     "tf": add(counts), "texts": add(texts)})


def _count_blocks(batches):
    """Batches of (block, key, toks), sorted by block -> batches of (block, token, keys, tfs, texts)."""
    held, block = [], None

    def ended():
        x = pa.concat_tables(held).combine_chunks()
        x = _pairs(x["token"], x["key"], x["tf"].to_numpy(), x["texts"].to_numpy())
        t, tokens = _codes(x["token"])
        starts = np.flatnonzero(np.diff(t, prepend=-1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), block), pa.int32()), tokens, _lists(x["key"].combine_chunks(), starts),
             _lists(pa.array(x["tf"].to_numpy(), pa.int32()), starts), pa.array(np.add.reduceat(x["texts"].to_numpy(), starts))],
            names=["block", "token", "keys", "tfs", "texts"])

    for b in batches:
        blocks = b["block"].to_numpy()
        for lo, hi in zip(edges := [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()], [*edges[1:], len(blocks)]):
            if hi == lo:
                continue
            if held and blocks[lo] != block:
                yield from ended()
                held = []
            block, part = blocks[lo], b.slice(lo, hi - lo)
            toks = part["toks"]
            row = pc.list_parent_indices(toks).to_numpy()
            once = _pairs(toks.flatten(), pa.array(row), np.ones(len(row)), np.zeros(len(row)))  # per text
            if len(once):
                held.append(_pairs(once["token"], part["key"].take(once["key"]), once["tf"].to_numpy(), np.ones(len(once))))
    if held:
        yield from ended()


@dataclass
class TermBlocks:
    """``rows``: block, token, keys, tfs, texts (how many texts hold the token)."""

    rows: DataFrame
    key: str
    n_texts: int
    n_blocks: int

    @classmethod
    def count(cls, kb: DataFrame, key: str = "doc_id", text_col: str = "content") -> "TermBlocks":
        """The texts tokenized once. One action for their number and length."""
        n, chars = kb.agg(F.count(F.lit(1)), F.sum(F.length(text_col).cast("long"))).first()
        blocks = max(1, math.ceil((chars or 0) / BLOCK_CHARS))
        kind = kb.schema[key].dataType.simpleString()
        dealt = kb.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), F.col(text_col).alias("text")) \
            .where(F.col("text").isNotNull()).repartition("block").sortWithinPartitions("block")
        toks = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0)
        rows = dealt.select("block", "key", toks.alias("toks")).mapInArrow(
            _count_blocks, f"block int, token string, keys array<{kind}>, tfs array<int>, texts long")
        return cls(stored(rows, "counts"), key, n, blocks)

    def counts(self) -> DataFrame:
        """(key, token, tf), a row per posting."""
        return self.rows.select("token", F.explode(F.arrays_zip("keys", "tfs")).alias("x")).select(
            F.col("x.keys").alias(self.key), "token", F.col("x.tfs").cast("long").alias("tf"))

    def weights(self, vocab: DataFrame) -> DataFrame:
        """(block, key, w) and the vocabulary's other columns: tf * idf, not normalised. The ``OFTEN`` most frequent tokens are
        broadcast, so most postings stay with their block and only those of the other tokens are shuffled."""
        often = F.broadcast(vocab.orderBy("idf", "token").limit(OFTEN))
        rows = self.rows.select("block", "token", "keys", "tfs")
        x = rows.join(often, "token").unionByName(rows.join(often.select("token"), "token", "left_anti").join(vocab, "token"))
        return x.select("block", *vocab.columns, F.explode(F.arrays_zip("keys", "tfs")).alias("x")).select(
            "block", F.col("x.keys").alias(self.key), (F.col("x.tfs") * F.col("idf")).alias("w"), *vocab.columns)

    def n_tokens(self) -> int:
        return self.rows.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0

    def dfreq(self, of_texts: bool = False) -> DataFrame:
        """(token, df): how many documents hold a token; or texts, where several may share a key."""
        n = F.col("texts") if of_texts else F.size("keys").cast("long")
        return self.rows.groupBy("token").agg(F.sum(n).alias("df"))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of several ranges in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


class _Cell:
    """The documents of a cell: per token its documents and weights (tf / norm), frequent tokens as whole rows."""

    def __init__(self, x: pa.Table, asked: pa.Array):
        names, norm, token, keys, tfs = (x[c].combine_chunks().flatten() for c in ("names", "norms", "tokens", "keys", "tfs"))
        order = pc.sort_indices(names)
        self.names, norm = names.take(order), norm.take(order).to_numpy()
        rows = pa.table({"token": token, "keys": keys, "tfs": tfs}).filter(pc.is_in(token, value_set=asked))
        keys, tfs = rows["keys"].combine_chunks(), rows["tfs"].combine_chunks()
        t, tokens = _codes(rows["token"])
        t = t[pc.list_parent_indices(tfs).to_numpy()]
        d = pc.index_in(keys.flatten(), value_set=self.names).fill_null(-1).to_numpy()
        order = np.argsort(t, kind="stable")
        order = order[d[order] >= 0]  # a document without a key is never found
        t, d, w = t[order], d[order], tfs.flatten().to_numpy()[order]
        w = w / norm[d]
        self.tokens = tokens
        starts = np.searchsorted(t, np.arange(len(tokens) + 1))
        self.most = np.maximum.reduceat(np.append(w, 0.0), starts[:-1]) if len(tokens) else np.zeros(0)  # largest weight of a token
        often = np.flatnonzero(np.diff(starts) > FREQUENT * len(self.names))
        self.place = np.full(len(tokens), -1)
        self.place[often] = np.arange(len(often))
        place = self.place[t]
        self.whole = np.zeros((len(often), len(self.names)))
        self.whole[place[place >= 0], d[place >= 0]] = w[place >= 0]
        self.single = self.whole.astype(np.float32)
        t, self.docs, self.weights = t[place < 0], d[place < 0], w[place < 0]
        self.starts = np.searchsorted(t, np.arange(len(tokens) + 1))
        self.df = np.diff(self.starts)

    def best(self, at: np.ndarray, tokens: np.ndarray, w: np.ndarray, k: int):
        """Questions, documents and scores of the k best of each question by (round(score, 9) desc, key). The tokens
        and weights of question i are those from ``at[i]`` to ``at[i + 1]``."""
        n, step = len(self.names), max(1, SUMS // max(1, len(self.names)))
        for lo in range(0, (len(at) - 1) if n else 0, step):
            here = at[lo:lo + step + 1]
            one = slice(here[0], here[-1])
            q, d, s = self._best(here - here[0], tokens[one], w[one], k)
            yield q + lo, d, s

    def _best(self, at, tokens, w, k):
        n_q, n = len(at) - 1, len(self.names)
        q, place = np.repeat(np.arange(n_q), np.diff(at)), self.place[tokens]
        rare, often = place < 0, place >= 0
        df = self.df[tokens[rare]]
        posting = _spread(self.starts[tokens[rare]], df)
        exact = np.bincount(np.repeat(q[rare] * n, df) + self.docs[posting], weights=np.repeat(w[rare], df) * self.weights[posting],
                            minlength=n_q * n).astype(np.float64, copy=False).reshape(n_q, n)  # of nothing: whole numbers
        place, wo, first = place[often], w[often], np.searchsorted(q[often], np.arange(n_q + 1))
        sums, single = exact.astype(np.float32), wo.astype(np.float32)
        for i in np.flatnonzero(np.diff(first)):
            sums[i] += single[first[i]:first[i + 1]] @ self.single[place[first[i]:first[i + 1]]]
        # error of the sums: at most that of so many roundings of the sum of the largest products
        wrong = (np.diff(at) + 4) * 2.0 ** -24 * np.bincount(q, weights=np.abs(w) * self.most[tokens], minlength=n_q)
        groups = min(n, max(64, 16 * k))
        if k <= groups:
            largest = sums[:, :n // groups * groups].reshape(n_q, -1, groups).max(axis=1)
            kth = np.partition(largest, -k, axis=1)[:, -k] - 2 * wrong - MARGIN
        else:
            kth = np.zeros(n_q)
        near = np.flatnonzero((sums >= np.maximum(kth, np.finfo(np.float32).tiny).astype(np.float32)[:, None]).ravel())
        q, d = np.divmod(near, n)
        score = exact.ravel()[near]
        many = np.diff(first)[q]
        each = max(1, PRODUCTS // max(1, many.max(initial=0)))
        for lo in range(0, len(q), each):
            some, length = slice(lo, lo + each), many[lo:lo + each]
            product, pair = _spread(first[:-1][q[some]], length), np.repeat(np.arange(len(length)), length)
            score[some] += np.bincount(pair, weights=wo[product] * self.whole[place[product], d[some][pair]], minlength=len(length))
        order = np.lexsort((d, -np.round(score, 9), q))
        order = order[score[order] > 0]
        q, d, score = q[order], d[order], score[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[few], d[few], score[few]


@dataclass
class BlockIndex:
    """The counts, tokens (token, idf) and norms (block, key, norm) of a knowledge base."""

    terms: TermBlocks
    vocab: DataFrame
    norms: DataFrame
    packed: DataFrame | None = None

    @classmethod
    def build(cls, terms: TermBlocks, vocab: DataFrame) -> "BlockIndex":
        norms = terms.weights(vocab.select("token", "idf")).groupBy("block", F.col(terms.key).alias("key")).agg(
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return cls(terms, vocab, stored(norms, "norms"))

    @staticmethod
    def pack(rows: DataFrame) -> DataFrame:
        """(block, token, keys, tfs) -> (block, tokens, keys, tfs), ``PACKS`` rows a block."""
        pack = F.pmod(F.xxhash64("token"), F.lit(PACKS)).alias("pack")
        return rows.groupBy("block", pack).agg(F.collect_list(F.struct("token", "keys", "tfs")).alias("x")).select(
            "block", F.col("x.token").alias("tokens"), F.col("x.keys").alias("keys"), F.col("x.tfs").alias("tfs"))

    def search(self, q_terms: DataFrame, k: int, q_key: str = "question_id") -> DataFrame:
        """(q_key, token, w) -> (q_key, rank, key, score) of the k best by (round(score, 9) desc, key).
        One action for the number of questions and terms."""
        key, kind = self.terms.key, self.norms.schema["key"].dataType.simpleString()
        q_kind = q_terms.schema[q_key].dataType.simpleString()
        asked = stored(q_terms.where(F.col(q_key).isNotNull()).select(F.col(q_key).alias("q"), "token", F.col("w").alias("wq")), "question-terms")
        n_q, n_terms = asked.agg(F.count_distinct("q"), F.count(F.lit(1))).first()
        wide = max(CELL_BLOCKS, min(MOST_BLOCKS, self.terms.n_blocks // CELLS)) if n_q > FEW else 1
        cells = max(1, math.ceil(self.terms.n_blocks / wide))
        chunks = max(1, math.ceil(n_q / CHUNK))
        to_chunks = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
        to_cells = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
        cell = F.pmod(F.col("block"), F.lit(cells)).alias("cell")

        if n_terms <= FEW_TERMS:
            rows = self.pack(self.terms.rows.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi"))
        else:
            if self.packed is None:
                self.packed = stored(self.pack(self.terms.rows), "packed-counts")
            rows = self.packed
        rows = rows.select(cell, "tokens", "keys", "tfs", F.lit(None).cast(f"array<{kind}>").alias("names"),
                           F.lit(None).cast("array<double>").alias("norms"))
        known = self.norms.where(F.col("key").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("key", "norm")).alias("x"))
        known = known.select(cell, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("tokens", "keys", "tfs")),
                             F.col("x.key").alias("names"), F.col("x.norm").alias("norms"))
        theirs = rows.unionByName(known).select("*", to_chunks)
        ours = asked.join(self.vocab.select("token", "idf"), "token") \
            .groupBy("q").agg(F.collect_list(F.struct("token", (F.col("wq") * F.col("idf")).alias("wq"))).alias("x")) \
            .select(F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("chunk"), "q", F.col("x.token").alias("tokens"),
                    F.col("x.wq").alias("wq"), to_cells)

        def score(q: pa.Table, x: pa.Table) -> pa.Table:
            found, near, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            keys = pa.array([], x["names"].type.value_type)
            if len(q) and len(x):
                tokens, wq = (q[c].combine_chunks() for c in ("tokens", "wq"))
                flat = tokens.flatten()
                here = _Cell(x, flat.unique())
                keys = here.names
                code = pc.index_in(flat, value_set=here.tokens).fill_null(-1).to_numpy()
                known = code >= 0
                at = np.append(0, np.cumsum(known))[np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))]
                for i, d, s in here.best(at, code[known], wq.flatten().to_numpy()[known], k):
                    found.append(i)
                    near.append(d)
                    scores.append(s)
            return pa.table({"q": q["q"].combine_chunks().take(pa.array(np.concatenate(found), pa.int64())),
                             "key": keys.take(pa.array(np.concatenate(near), pa.int64())), "score": np.concatenate(scores)})

        best = ours.groupBy("cell", "chunk").cogroup(theirs.groupBy("cell", "chunk")).applyInArrow(
            score, f"q {q_kind}, key {kind}, score double")
        order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), F.col("key").asc())
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            F.col("q").alias(q_key), "rank", F.col("key").alias(key), "score")
