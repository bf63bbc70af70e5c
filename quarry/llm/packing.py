"""Best-fit packing of documents into fixed-size sequences (op 1): exact-complement hashing.

1. Every document's ids plus one end id; only a longer one than the capacity is cut.
2. The number of pieces per length (at most ``capacity`` rows) is all the planner sees.
   It opens a sequence with the largest length left and looks its gap up in an index of
   single lengths, pair sums and triple sums under the counts still available: a hit fills
   the sequence exactly. Otherwise the largest length that fits goes in (best fit) and
   the smaller gap is looked up again. A pattern is repeated as often as the counts
   allow, so the plan has a few patterns per length whatever the number of documents.
3. Pieces are numbered within their length: by (length, bucket), with buckets of bounded
   size, plus the rows of the earlier buckets, so a length that a third of all
   documents share is numbered by many tasks. A piece finds its sequence and offset from its
   number by searching the plan.

Defined cases: null or empty text is a piece of one end id; a null ``doc_id`` is kept;
repeated rows are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import pieces
from quarry.llm.common import map_batches, store, text_rows, text_slices

CUT = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "sequence_id long, offset long"


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def make():
        enc = pieces.PieceIds.of(path)

        def step(batch: pa.RecordBatch):
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for lo, hi in text_slices(texts):
                for doc_id, ids in zip(doc_ids[lo:hi], enc.ids(texts[lo:hi])):
                    ids += end
                    out += [(doc_id, n, at // 4, len(p := ids[at:at + width]) // 4, zlib.crc32(p))
                            for n, at in enumerate(range(0, len(ids), width))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5,
                                                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        return step
    return make


class SumIndex:
    """Which lengths are left, and which one, two or three of them add up to a gap.

    ``pairs[s]`` is the smallest length that, with the length s - it, adds up to s. Counts only fall, so an
    entry only rises: it is moved on when a look-up finds it used up, and ``NONE`` stays ``NONE``. A triple is
    a length whose rest has an entry there.
    """

    NONE = 1 << 30

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.pairs = np.full(2 * len(self.left), self.NONE, np.int64)
        lengths = np.flatnonzero(self.left[1:] > 0) + 1
        for i in range(len(lengths) - 1, -1, -1):  # the smallest is written last
            a = lengths[i]
            self.pairs[a + lengths[i + (self.left[a] < 2):]] = a

    def pair(self, total: int, used: dict[int, int]) -> tuple[int, int] | None:
        """The pair with the largest first part."""
        first, half = int(self.pairs[total]), total // 2
        if first > half:
            return None
        there = (self.left[first:half + 1] > 0) & (self.left[total - first:total - half - 1:-1] > 0)
        if 2 * half == total and self.left[half] < 2:
            there[-1] = False
        found = np.flatnonzero(there) + first
        self.pairs[total] = found[0] if len(found) else self.NONE
        for a in found:  # only the few lengths in use can stand in the way
            if self._free(used, (int(a), total - int(a))):
                return total - int(a), int(a)
        return None

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        if self._free(used, (gap,)):
            return (gap,)
        if found := self.pair(gap, used):
            return found
        # each third part is the largest of the three, so it holds a third of the gap at least
        low = -(-gap // 3)
        third = np.flatnonzero((self.left[low:gap] > 0) & (self.pairs[gap - low:0:-1] < self.NONE))[::-1] + low
        for c in third:
            if self._free(used, (int(c),)) and (found := self.pair(gap - int(c), used | {int(c): used.get(int(c), 0) + 1})):
                return (int(c), *found)
        return None

    def largest(self, gap: int, used: dict[int, int]) -> int | None:
        free = self.left[:gap + 1].copy()
        for a, n in used.items():
            if a <= gap:
                free[a] -= n
        found = np.flatnonzero(free > 0)
        return int(found[-1]) if len(found) else None

    def _free(self, used: dict[int, int], more: tuple[int, ...]) -> bool:
        return all(self.left[a] >= used.get(a, 0) + more.count(a) for a in more)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, number of sequences) that use every piece up.

    Every pattern is repeated until one of its lengths is short, so there are few.
    """
    index, patterns = SumIndex(counts), []
    while (first := index.largest(capacity, {})) is not None:
        used, gap = {first: 1}, capacity - first
        while gap > 0:
            take = index.exact(gap, used)
            if take is None:
                fit = index.largest(gap, used)
                if fit is None:
                    break
                take = (fit,)
            for a in take:
                used[a] = used.get(a, 0) + 1
                gap -= a
        times = min(int(index.left[a]) // n for a, n in used.items())
        for a, n in used.items():
            index.left[a] -= times * n
        patterns.append((used, times))
    return patterns


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs of piece numbers: pieces ``first`` and on of ``length`` go to sequences
    ``base`` .. ``base + times - 1`` in turn, each round one length further from ``offset``."""
    rows, taken, base = [], {}, 0
    for used, times in patterns:
        offset = 0
        for a, n in sorted(used.items(), reverse=True):
            rows.append((a, taken.get(a, 0), base, times, offset))
            taken[a] = taken.get(a, 0) + times * n
            offset += a * n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "times", "offset"), table.T))


def _place(columns: dict[str, np.ndarray]):
    def make():
        key = (columns["length"].astype(object) * (1 << 48) + columns["first"]).astype(np.int64)

        def step(batch: pa.RecordBatch):
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            at = np.searchsorted(key, length * (1 << 48) + number, "right") - 1
            times = columns["times"][at]
            nth = number - columns["first"][at]
            named = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            named["sequence_id"] = pa.array(columns["base"][at] + nth % times)
            named["offset"] = pa.array(columns["offset"][at] + nth // times * length)
            yield pa.RecordBatch.from_arrays(list(named.values()), list(named))
        return step
    return make


def cut_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    return map_batches(text_rows(docs), _cut(path, capacity, end_id), CUT)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = store(cut_documents(docs, path, capacity, end_id), "pieces")
    histogram = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    n_buckets = max(1, -(-int(counts.sum()) // bucket_rows))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (keyed.groupBy("length", "bucket").count()
              .select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")))
    numbered = ranked.join(before, ["length", "bucket"]).withColumn("number", F.col("rank") + F.col("before"))
    columns = slots(plan(counts, capacity))
    return map_batches(numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number"),
                       _place(columns), f"{CUT}, {PLACED}")
