"""Approximate nearest neighbours by inner product (op 3): adaptive dimension scan.

Vectors get one more component, so that the largest inner product is the smallest distance, and
are rotated at random: then the distance over the first dimensions estimates the whole one.
They are dealt to lists around centres fitted on a bounded sample; every vector is in a list, and
a list is cut into blocks of at most about ``block_rows`` rows by a hash of the id, however
many rows are near one centre or equal.

A query scans its nearest lists first. Their k-th distance is the threshold for the other lists it
probes: a block is scanned in groups of columns, and after each group a hypothesis test
(partial distance, scaled, beyond (1 + e / sqrt(dimensions)) times the threshold) abandons the
candidates that are very unlikely to be near. Survivors are scored exactly, in double
precision, on the original vectors.

The share of lists to probe is measured: on the sample, the smallest share at which sample queries
find ``recall`` of their true neighbours; more lists are probed until they hold k candidates.

Defined cases: null, zero, empty, odd-length vectors and those with null or non-finite components take
no part, nor do rows with a null id; rows with the query's id are no candidates for it; other
repeated rows are candidates each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors as V
from quarry.llm.common import map_batches, store

FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
GROUP = 16      # columns scanned between two tests
SURE = 2.1      # e of the test


class Index:
    """Rotation, centres and the share of lists to probe, fitted on a sample."""

    def __init__(self, x: np.ndarray, most: float, n_lists: int, k: int, recall: float, seed: int = 11):
        d = x.shape[1] + 1
        self.most = most
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
        y = self.rows(x)
        self.centre = V.kmeans(y, min(n_lists, len(y))) if len(y) else np.zeros((0, d))
        self.probes = self._measure(x, y, k, recall) if len(y) else 0

    def rows(self, x: np.ndarray) -> np.ndarray:
        return V.lifted(x, self.most) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries, scaled to the vectors' norm (which changes no order)."""
        scaled = q * (np.sqrt(self.most) / np.linalg.norm(q, axis=1))[:, None]
        return np.hstack([scaled, np.zeros((len(q), 1))]) @ self.rotation

    def _measure(self, x: np.ndarray, y: np.ndarray, k: int, recall: float) -> int:
        ask = np.linspace(0, len(x) - 1, min(300, len(x))).astype(int)
        own = V.nearest(y, self.centre)
        scores = x[ask] @ x.T
        scores[np.arange(len(ask)), ask] = -np.inf
        near = np.argsort(-scores, axis=1)[:, :k]
        rank = np.argsort(np.argsort(V.distances(self.asked(x[ask]), self.centre), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())  # lists before a neighbour's
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def scan(y: np.ndarray, asked: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that no test abandoned. ``limit`` is each query's squared threshold distance."""
    d, n = y.shape[1], GROUP
    part = V.distances(asked[:, :n], y[:, :n])
    q, r = np.nonzero(part * (d / n) <= ((1 + SURE / np.sqrt(n)) ** 2 * limit)[:, None])
    part = part[q, r]
    while n < d:
        end = min(n + GROUP, d)
        for lo in range(0, len(q), 500_000):
            here = slice(lo, lo + 500_000)
            gap = asked[q[here], n:end] - y[r[here], n:end]
            part[here] += np.einsum("ij,ij->i", gap, gap)
        n = end
        slack = (1 + SURE / np.sqrt(n)) ** 2 if n < d else 1 + 1e-4
        keep = part * (d / n) <= slack * limit[q]
        q, r, part = q[keep], r[keep], part[keep]
    return q, r


def _probe(k: int, most: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _FOUND.empty_table()
        ids = left.column("vec_id").to_numpy()
        y, v = V.packed(left.column("y")).astype(np.float64), V.packed(left.column("v"), np.float64)
        ask_ids = right.column("query_id").to_numpy()
        asked, w = V.packed(right.column("y")).astype(np.float64), V.packed(right.column("v"), np.float64)
        floor = right.column("floor").to_numpy(zero_copy_only=False)  # k-th score so far, NaN if none
        norm = np.linalg.norm(w, axis=1)
        limit = np.where(np.isnan(floor), np.inf, np.maximum(2 * most - 2 * np.nan_to_num(floor) * np.sqrt(most) / norm, 0) + 1e-5 * most)  # rounding
        out = []
        for lo in range(0, len(ask_ids), 256):
            here = slice(lo, lo + 256)
            q, r = scan(y, asked[here], limit[here])
            order = np.argsort(q, kind="stable")
            q, r = q[order], r[order]
            ends = np.searchsorted(q, np.arange(len(ask_ids[here]) + 1))
            for i in range(len(ask_ids[here])):
                at = r[ends[i]:ends[i + 1]]
                at = at[ids[at] != ask_ids[lo + i]]
                scores = v[at] @ w[lo + i]
                top = V.best(scores, ids[at], k)
                out.append((np.full(len(top), ask_ids[lo + i]), ids[at][top], scores[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)
    return run


def search(rows: DataFrame, k: int = 20, query_mod: int = 20, sample_rows: int = 20_000, list_rows: int = 1_000,
           most_lists: int = 4_096, block_rows: int = 8_192, ask_rows: int = 8_192, recall: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest found."""
    spark = rows.sparkSession
    found, d = V.checked(rows, zero=False)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).head()
    n, most = stats["n"], stats["most"] or 1.0
    n_lists = max(1, min(most_lists, n // list_rows))
    index = Index(V.sample(found, sample_rows, n, d, "ann"), most, n_lists, k, recall)
    shared = spark.sparkContext.broadcast(index)  # at most ``most_lists`` centres

    def assign():
        def step(batch: pa.RecordBatch):
            v = V.matrix(batch.column("v"), d)
            y = shared.value.rows(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(V.nearest(y, shared.value.centre).astype(np.int32)),
                 V.rows_of(y.astype(np.float32)), V.rows_of(v)], ["vec_id", "list", "y", "v"])
        return step

    listed = store(map_batches(found, assign, "vec_id long, list int, y binary, v binary"), "lists")
    sizes = dict(listed.groupBy("list").count().collect())  # at most ``most_lists`` rows
    size = np.array([sizes.get(i, 0) for i in range(len(index.centre))])
    first = -(-index.probes // 6)

    def route():
        def step(batch: pa.RecordBatch):
            v = V.matrix(batch.column("v"), d)
            asked = shared.value.asked(v)
            order = np.argsort(V.distances(asked, shared.value.centre), axis=1, kind="stable")
            enough = np.cumsum(size[order], axis=1)
            n_probed = np.minimum(np.maximum(shared.value.probes, (enough <= k).sum(1) + 1), order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([o[:m].tolist() for o, m in zip(order, n_probed)], pa.list_(pa.int32())),
                 V.rows_of(asked.astype(np.float32)), V.rows_of(v)], ["query_id", "lists", "y", "v"])
        return step

    asked = store(map_batches(V.queries_of(found, query_mod), route, "query_id long, lists array<int>, y binary, v binary"), "queries")
    n_asked = asked.count()
    chunks = max(1, -(-n_asked // ask_rows))
    cut = F.coalesce(*(F.when(F.col("list") == i, F.lit(int(-(-s // block_rows)))) for i, s in enumerate(size) if s > block_rows), F.lit(1))
    blocks = listed.withColumn("block", F.pmod(F.xxhash64("vec_id"), cut).cast("int"))
    if chunks > 1:  # many queries: each chunk of them meets every block
        blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    else:
        blocks = blocks.withColumn("chunk", F.lit(0))

    def probe(part: DataFrame) -> DataFrame:
        """Scores found in the lists (query_id, list, y, v, floor)."""
        spread = part.withColumn("block", F.explode(F.sequence(F.lit(0), cut - 1))) \
            .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        keys = ("list", "block", "chunk")
        return blocks.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_probe(k, most), FOUND)

    near = asked.select("query_id", "y", "v", F.explode(F.slice("lists", 1, max(1, first))).alias("list")).withColumn("floor", F.lit(float("nan")))
    one = store(V.ranked(probe(near), k, F.col("score"), "double"), "near")
    floor = one.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = asked.select("query_id", "y", "v", F.explode(F.expr(f"slice(lists, {max(1, first) + 1}, greatest(size(lists) - {max(1, first)}, 0))")).alias("list"))
    rest = rest.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("nan"))))
    return V.ranked(one.select("query_id", "vec_id", "score").unionByName(probe(rest)), k, F.col("score"), "double")
