"""Exact top-k by integer inner product (op 5): best-first search of M-trees.

Vectors of integers floor(scale * x) get one more component, so that the largest inner product with a
query is the smallest (Euclidean, so metric) distance. Routing objects fitted on a bounded sample
deal the vectors out; a routing object's vectors are cut into shards of bounded size by a hash
of the id. In each shard an M-tree is bulk-loaded: pages hold a matrix of entries with their
distances to the parent object, and, above the leaves, covering radii. A query visits pages best first
by the lower bound max(0, d(q, object) - radius), and before it computes a distance it tries the stored
bound |d(q, parent) - d(entry, parent)| - radius.

A query searches the shards of its nearest routing object first; its k-th distance there then
excludes whole routing objects by their covering radius and starts the search of the others.
Bounds are compared with a small slack above rounding errors; scores are exact integers. So
the result is exact, ties included (smaller id first).

Defined cases: null vectors, empty ones, those of another length than most and those with null
or non-finite components take no part, nor do rows with a null id; zero vectors do; rows with the
query's id are no candidates for it; other repeated rows are candidates each; an empty table
gives an empty result; other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors as V
from quarry.llm.common import map_batches, store

FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
PAGE, FANOUT = 1_024, 16  # a page is scored by one matrix product, so pages are large
SLACK = 1e-7


class Page:
    """A node with its entries' distances to the parent object. A leaf holds the vectors ``lo`` to ``hi``
    of the tree's order; an inner page holds routing objects with covering radii and children."""

    __slots__ = ("lo", "hi", "to_parent", "objects", "radius", "children")

    def __init__(self, lo, hi, to_parent, objects=None, radius=None, children=None):
        self.lo, self.hi, self.to_parent = lo, hi, to_parent
        self.objects, self.radius, self.children = objects, radius, children


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to the vector ``y``."""
    gap = x - y
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class MTree:
    """Bulk-loaded over the rows of ``x``; ``order`` lays the rows of a leaf next to each other."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.root = self._build(x, np.arange(len(x)), None)
        self.order = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)

    def _build(self, x: np.ndarray, rows: np.ndarray, parent: np.ndarray | None) -> Page:
        own_x = x[rows]
        if len(rows) <= PAGE:
            lo = self.size
            self.parts.append(rows)
            self.size += len(rows)
            return Page(lo, self.size, apart(own_x, parent) if parent is not None else np.zeros(len(rows)))
        fanout = min(FANOUT, 2 * -(-len(rows) // PAGE))
        seeds = own_x[self.rng.choice(len(rows), fanout, replace=False)]
        own = V.nearest(own_x, seeds)
        if np.bincount(own).max() > 0.9 * len(rows):  # equal or nearly equal vectors: any cut is as good
            own = np.arange(len(rows)) * fanout // len(rows)
        lo, objects, children, radius = self.size, [], [], []
        for g in np.unique(own):
            part = rows[own == g]
            centre = own_x[own == g].mean(0)
            objects.append(centre)
            radius.append(apart(x[part], centre).max())
            children.append(self._build(x, part, centre))
        objects = np.array(objects)
        to_parent = apart(objects, parent) if parent is not None else np.zeros(len(objects))
        return Page(lo, self.size, to_parent, objects, np.array(radius), children)

    def search(self, q: np.ndarray, limit: float, take) -> None:
        """Visit pages best first. ``take(rows)`` scores vectors (a slice or places in ``order``) and
        returns the new limit distance; ``limit`` is the first one."""
        heap = [(0.0, 0, self.root, None)]
        order = 0
        while heap:
            low, _, page, d_parent = heapq.heappop(heap)
            if low > limit:
                return
            near = np.abs(page.to_parent - d_parent) if d_parent is not None else None
            if page.children is None:
                if near is None or (keep := near <= limit).all():
                    limit = take(slice(page.lo, page.hi))
                elif keep.any():
                    limit = take(page.lo + np.flatnonzero(keep))
                continue
            at = np.arange(len(page.children)) if near is None else np.flatnonzero(near - page.radius <= limit)
            d = apart(page.objects[at], q)
            for i, dist, bound in zip(at.tolist(), d.tolist(), np.maximum(d - page.radius[at], low).tolist()):
                if bound <= limit:
                    order += 1
                    heapq.heappush(heap, (bound, order, page.children[i], dist))


def exact_in_doubles(v: np.ndarray, asked: np.ndarray) -> bool:
    """Whether all inner products of integer rows are exact in double precision."""
    return float(np.abs(v).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, v.shape[1]) < 2 ** 53


def dots(v: np.ndarray, q: np.ndarray, doubles: bool) -> np.ndarray:
    """Exact inner products of integer rows held as doubles."""
    return v @ q if doubles else np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in v], object)


class Best:
    """The k best (score, id) of one query so far, as a limit distance. ``ids`` and ``v`` are in the
    tree's order."""

    def __init__(self, k: int, own: int, q: np.ndarray, ids: np.ndarray, v: np.ndarray, most: float, floor: int | None, doubles: bool):
        self.k, self.own, self.q, self.ids, self.v, self.most, self.doubles = k, own, q, ids, v, most, doubles
        self.floor = floor  # scores below it are of no use
        self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.float64 if doubles else object)
        self.norm = float(q @ q)
        self.slack = np.sqrt((self.norm + most) * 1e-13) + SLACK
        self.limit = self._distance(floor) if floor is not None else float("inf")

    def _distance(self, score) -> float:
        squared = max(0.0, self.norm + self.most - 2.0 * float(score))
        return float(np.sqrt(squared)) * (1 + SLACK) + self.slack

    def take(self, rows) -> float:
        scores = dots(self.v[rows], self.q, self.doubles)
        better = np.flatnonzero(scores >= self.floor) if self.floor is not None else np.arange(len(scores))
        if len(better):
            ids = self.ids[rows][better]
            other = ids != self.own
            found, scores = np.concatenate([self.found, ids[other]]), np.concatenate([self.scores, scores[better][other]])
            top = V.best(scores, found, self.k)
            self.found, self.scores = found[top], scores[top]
            if len(top) == self.k and (self.floor is None or self.scores[-1] > self.floor):
                self.floor = self.scores[-1]
                self.limit = self._distance(self.floor)
        return self.limit


def _search(k: int, most: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _FOUND.empty_table()
        ids, v = left.column("vec_id").to_numpy(), V.packed(left.column("v"), np.float64)
        tree = MTree(V.lifted(v, most))
        ids, v = ids[tree.order], v[tree.order]
        out = {"query_id": [], "vec_id": [], "score": []}
        ask = V.packed(right.column("v"), np.float64)
        doubles = exact_in_doubles(v, ask)
        for own, q, floor in zip(right.column("query_id").to_pylist(), ask, right.column("floor").to_pylist()):
            best = Best(k, own, q, ids, v, most, floor, doubles)
            tree.search(np.append(q, 0.0), best.limit, best.take)
            out["query_id"] += [own] * len(best.found)
            out["vec_id"] += best.found.tolist()
            out["score"] += [int(s) for s in best.scores]
        return pa.table([pa.array(c, pa.int64()) for c in out.values()], schema=_FOUND)
    return run


def search(rows: DataFrame, k: int = 20, query_mod: int = 20, scale: int = 64, sample_rows: int = 8_000, routing: int = 16,
           shard_rows: int = 16_384, ask_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` highest integer inner products."""
    spark = rows.sparkSession
    found, d = V.checked(rows, zero=True)
    whole = found.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = whole.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).head()
    n, most = stats["n"], stats["most"] or 0.0
    drawn = V.lifted(V.sample(whole, sample_rows, n, d, "mtree"), most)
    centre = V.kmeans(drawn, min(routing, len(drawn))) if len(drawn) else np.zeros((1, d + 1))
    shared = spark.sparkContext.broadcast(centre)  # ``routing`` objects

    def deal():
        def step(batch: pa.RecordBatch):
            v = V.matrix(batch.column("v"), d)
            x = V.lifted(v, most)
            own = V.nearest(x, shared.value)
            gap = x - shared.value[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(np.sqrt((gap * gap).sum(1))), V.rows_of(v)],
                ["vec_id", "object", "apart", "v"])
        return step

    dealt = store(map_batches(whole, deal, "vec_id long, object int, apart double, v binary"), "objects")
    covers = {r["object"]: (r["n"], r["radius"]) for r in
              dealt.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}  # ``routing`` rows
    cut = F.coalesce(*(F.when(F.col("object") == i, F.lit(-(-m // shard_rows))) for i, (m, _) in covers.items()), F.lit(1)).cast("int")
    shards = dealt.select("vec_id", "v", "object", F.pmod(F.xxhash64("vec_id"), cut).cast("int").alias("shard"))

    def route():
        def step(batch: pa.RecordBatch):
            v = V.matrix(batch.column("v"), d)
            far = np.sqrt(V.distances(np.hstack([v, np.zeros((len(v), 1))]), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), V.rows_of(v), pa.array(list(far), pa.list_(pa.float64()))],
                                             ["query_id", "v", "far"])
        return step

    asked = store(map_batches(V.queries_of(whole, query_mod), route, "query_id long, v binary, far array<double>"), "queries")
    chunks = max(1, -(-asked.count() // ask_rows))
    shards = shards.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else shards.withColumn("chunk", F.lit(0))

    def visit(part: DataFrame) -> DataFrame:
        """The best of each (query_id, v, object, floor) in the object's shards."""
        spread = part.withColumn("shard", F.explode(F.sequence(F.lit(0), cut - 1))) \
            .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        keys = ("object", "shard", "chunk")
        return shards.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_search(k, most), FOUND)

    used = F.array(*(F.struct((F.col("far")[i] - radius).alias("low"), F.col("far")[i].alias("far"), F.lit(i).alias("object"))
                     for i, (_, radius) in sorted(covers.items()))) if covers else F.expr("cast(array() as array<struct<low:double,far:double,object:int>>)")
    routed = asked.select("query_id", "v", F.array_sort(F.transform(used, lambda e: F.struct(e["far"].alias("far"), e["low"].alias("low"), e["object"].alias("object")))).alias("ways"))
    near = routed.where(F.size("ways") > 0).select("query_id", "v", F.col("ways")[0]["object"].alias("object"), F.lit(None).cast("long").alias("floor"))
    one = store(V.ranked(visit(near), k, F.col("score"), "long"), "near")
    floor = one.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    size = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    rest = routed.select("query_id", "v", F.explode(F.expr("slice(ways, 2, greatest(size(ways) - 1, 0))")).alias("way")) \
        .join(floor, "query_id", "left").join(V.queries_of(whole, query_mod).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    # no vector of a routing object is nearer than its distance less its radius
    limit = F.sqrt(F.greatest(F.lit(0.0), size + most - 2 * F.col("floor"))) * (1 + SLACK) + F.sqrt((size + most) * 1e-13) + SLACK
    rest = rest.where(F.col("floor").isNull() | (F.col("way.low") <= limit)).select("query_id", "v", F.col("way.object").alias("object"), "floor")
    return V.ranked(one.select("query_id", "vec_id", "score").unionByName(visit(rest)), k, F.col("score"), "long")
