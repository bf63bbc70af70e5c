"""Vectors of a table (vec_id, embedding) as checked rows of one dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(rows: DataFrame, zero: bool) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, and their dimension.

    Left out: null vectors, vectors with null or non-finite components, empty ones, with ``zero`` false
    those without a component but 0, rows with a null id, and vectors of another length than most
    have (the longer one on ties): no inner product exists with them.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")) \
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    if not zero:
        found = found.where(F.exists("v", lambda x: x != 0))
    lengths = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    d = lengths["d"] if lengths else 0
    return found.where(F.size("v") == d), d


def matrix(column: pa.Array | pa.ChunkedArray, d: int, kind=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), kind).reshape(-1, d)


def rows_of(m: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    m = np.ascontiguousarray(m)
    return pa.array([r.tobytes() for r in m], pa.binary())


def packed(column: pa.Array | pa.ChunkedArray, kind=np.float32) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1) if data else np.zeros((0, 1), kind)


def queries_of(found: DataFrame, query_mod: int) -> DataFrame:
    """The rows whose id is divisible by ``query_mod``; a repeated id is asked once, with its smallest vector."""
    return found.where(F.pmod("vec_id", F.lit(query_mod)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def sample(found: DataFrame, rows: int, n: int, d: int, salt: str) -> np.ndarray:
    """About ``rows`` vectors drawn by a hash of their id (twice as many at most), in order of id."""
    share = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, rows / max(1, n)) * (1 << 30))
    table = found.where(share).limit(2 * rows).toArrow().sort_by("vec_id")
    return matrix(table.column("v"), d) if len(table) else np.zeros((0, d))


def ranked(found: DataFrame, k: int, score: Column, type_: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", score.cast(type_).alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of ``k`` clusters of the sample ``x``; a cluster left empty starts again at a sample row."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * (x @ centre.T), 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = [distances(x[i:i + 8192], centre).argmin(1) for i in range(0, len(x), 8192)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared norm ``most``: then the largest
    inner product with (q, 0) is the smallest distance to it."""
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]])
