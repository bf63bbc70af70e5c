"""SuperMinHash near-duplicates (op 11).

Sets. A text is lower-cased (A-Z), split at ASCII white space and turned into the set of its hashed
four-word shingles (one for a shorter text). Texts with one set are one class.

Signatures. Every element of a set draws a random permutation of the slots, one position a step; at step j it
offers ``j + u`` (u uniform) to the slot at position j, and a slot keeps the least offer. So within one set an
element's ranks in the slots are all different, which makes the estimate less noisy than with independent
hash functions. Offers of later steps are larger, so a set is done as soon as its largest slot is
below the next step: one to three steps for usual texts. All sets of a slice take a step at once.

Banding. The first ``BANDS`` x ``ROWS`` slots are cut into bands; equal bands make classes candidates. Two sets of
similarity 0.8 share none of the bands with probability (1 - 0.8^4)^28 = 4e-7. Candidates travel with four
bits of each of ``SLOTS`` slots; a pair that agrees in fewer of them than five standard deviations below what
similarity 0.8 gives (3e-7) goes unverified, so passages in common cost little.

Verification. Candidates are compared on their full sets, which are made again for them alone. Only
components are asked for: in ``TURNS`` rounds, over a share of the bands each, a class is compared with the
likeliest of its buckets' leaders, and linked ones are merged by a distributed union-find. Then the classes of
buckets with different components travel with their sets and are compared block by block, which gives true links only. A bucket that then still has more than
``HOT`` classes is cut by second bands first: a linked pair agrees in two bands (all but 8e-6 of pairs
at 0.8 exactly, fewer above).

Defined cases: null, empty or blank text has an empty set and is linked with nothing; a null ``doc_id``
gets the component of its copies, or null, and is kept only in the second case; repeated rows have one
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import mix
from quarry.llm.common import store, text_rows
from quarry.llm.components import components
from quarry.llm.ngram_join import shingles

WIDTH = 4
PERCENT = 80
BANDS, ROWS = 28, 4
SLOTS = 224
TURNS = 4
#: Elements that take their steps at once.
SLICE = 100_000
#: Classes of a bucket that are compared at once, and postings of small buckets in a task's group.
BLOCK, GROUP = 1_000, 5_000
#: Buckets of more classes, of different components still, are cut by second bands.
HOT = 20_000
#: Classes of more copies get their component by a broadcast (at most rows / COPIES of them).
COPIES = 100_000
STEP = np.uint64(32)
_GOLD = 0x9E3779B97F4A7C15


def _salt(j: int) -> np.uint64:
    """A different odd multiple per step."""
    return np.uint64((j + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF)


def _offer(signatures: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Let elements ``h`` of the sets ``owner`` (rows of ``signatures``) make their offers."""
    slots = signatures.shape[1]
    flat = signatures.reshape(-1)
    order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(h), slots)).copy()
    for j in range(slots):
        draw = mix(h + _salt(j))
        at = np.arange(len(h))
        other = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> STEP).astype(np.int64)
        slot = order[at, other]
        order[at, other] = order[:, j]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << STEP) | (draw >> STEP))
        open_ = signatures.max(axis=1) >= (np.uint64(j + 1) << STEP)
        stay = open_[owner]
        if not stay.any():
            return
        if not stay.all():
            h, owner, order = h[stay], owner[stay], order[stay]


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` least offers per set; an empty set keeps the largest value everywhere."""
    out = np.full((len(sets), slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    start, size = 0, 0
    for i, s in enumerate([*sets, np.zeros(SLICE + 1, np.uint64)]):
        if size and size + len(s) > SLICE:
            some = sets[start:i]
            h = np.concatenate(some)
            owner = np.repeat(np.arange(len(some)), list(map(len, some)))
            for lo in range(0, len(h), SLICE):  # more than one step only for a single large set
                _offer(out[start:i], h[lo:lo + SLICE], owner[lo:lo + SLICE])
            start, size = i, 0
        size += len(s)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Hashes of the bands, different for each band number."""
    parts = signature[:, :BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out + parts[:, :, r])
    return out


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of every slot, 16 slots in a number."""
    bits = (mix(signature) & np.uint64(15)).reshape(len(signature), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def agreement(a: str, b: str) -> Column:
    """Slots whose bits agree in the sketches ``a`` and ``b``."""
    nibbles = f"zip_with({a}, {b}, (x, y) -> x ^ y)"
    pairs = f"transform({nibbles}, x -> (x | shiftrightunsigned(x, 2)) & 3689348814741910323L)"  # 0x3333...
    differ = "bit_count((p | shiftrightunsigned(p, 1)) & 1229782938247303441L)"  # 0x1111...
    return F.expr(f"aggregate({pairs}, {SLOTS}, (n, p) -> n - {differ})")


def likely(percent: int) -> int:
    """Fewest agreeing slots that a pair at the threshold shows, but for five standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 16
    return math.floor(p * SLOTS - 5 * math.sqrt(p * (1 - p) * SLOTS))


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


SIGNED = "doc_id long, key binary, n long, bands array<long>, sketch array<long>"


def _lists(table: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(table.view(np.int64).ravel()))


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo in range(0, batch.num_rows, 500):
                sets = [shingles(t, width) for t in batch.column("text").slice(lo, 500).to_pylist()]
                signed = signatures(sets, SLOTS)
                yield pa.record_batch({
                    "doc_id": ids.slice(lo, 500), "key": pa.array(map(_key, sets), pa.binary()),
                    "n": pa.array(map(len, sets), pa.int64()),
                    "bands": _lists(bands(signed)), "sketch": _lists(sketch(signed))})
    return run


SETS = "key binary, n long, elements array<long>"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                sets = [shingles(t, width) for t in batch.column("text").slice(lo, 200).to_pylist()]
                yield pa.record_batch({
                    "key": pa.array(map(_key, sets), pa.binary()), "n": pa.array(map(len, sets), pa.int64()),
                    "elements": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})
    return run


def _agreements(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """:func:`agreement` of a sketch with the rows of ``many``."""
    x = one ^ many
    x = (x | (x >> np.uint64(2))) & np.uint64(0x3333333333333333)
    x = (x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)
    return SLOTS - np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _compare(percent: int):
    """The postings of some cells (a bucket, or two blocks of one) -> the pairs of keys that are links. A pair
    is compared in the first of its common buckets."""
    least = likely(percent)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        chunk = column.combine_chunks()
        values, ends = chunk.flatten().to_numpy(zero_copy_only=False), np.cumsum(chunk.value_lengths().to_numpy())
        return np.split(values, ends[:-1])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending")])
        bucket, low, high, block, n, comp = (group.column(c).to_numpy() for c in ("bucket", "low", "high", "block", "n", "comp"))
        keys = group.column("key").to_pylist()
        sketches = np.stack(lists(group.column("sketch"))).view(np.uint64)
        mine, elements = lists(group.column("mine")), lists(group.column("elements"))
        new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        found = ([], [])
        for start, end in zip([0, *new], [*new, len(bucket)]):
            whole = low[start] == high[start]
            for i in range(start, end):
                if whole:
                    at = np.arange(i + 1, end)
                elif block[i] == low[i]:
                    at = np.flatnonzero(block[start:end] == high[i]) + start
                else:
                    continue
                at = at[(comp[at] != comp[i]) & (100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))]
                at = at[_agreements(sketches[i], sketches[at]) >= least]
                for j in at:
                    if np.intersect1d(mine[i], mine[j], assume_unique=True)[0] != bucket[i]:
                        continue
                    overlap = len(np.intersect1d(elements[i], elements[j], assume_unique=True))
                    if 100 * overlap >= percent * (n[i] + n[j] - overlap):
                        found[0].append(keys[i])
                        found[1].append(keys[j])
        return pa.table([pa.array(x, pa.binary()) for x in found], schema=schema)
    return run


class Linker:
    """Verifies candidates and keeps the labels (key, comp) of the classes that have any."""

    def __init__(self, sets: DataFrame, sketches: DataFrame, percent: int):
        self.sets, self.sketches, self.percent = sets, sketches, percent
        self.labels = sets.select("key", F.col("key").alias("comp"))

    def same(self, x: str, y: str) -> Column:
        """Whether the full sets of two rows reach the threshold."""
        n_x, n_y, overlap = F.col(f"{x}.n"), F.col(f"{y}.n"), F.size(F.array_intersect(f"{x}.elements", f"{y}.elements"))
        return 100 * overlap >= self.percent * (n_x + n_y - overlap)

    def link(self, pairs: DataFrame) -> None:
        """Merge the components that verified ones of the pairs (a, b) connect."""
        x, y = self.sets.alias("x"), self.sets.alias("y")
        self.merge(pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key")).where(self.same("x", "y")).select("a", "b"))

    def merge(self, links: DataFrame) -> None:
        links = store(links, "links")
        at = lambda c: self.labels.select(F.col("key").alias(c), F.col("comp").alias(f"comp_{c}"))
        between = store(links.join(at("a"), "a").join(at("b"), "b").where("comp_a != comp_b")
                        .select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "merges")
        if between.isEmpty():
            return
        roots = components(between).select(F.col("node").alias("comp"), "root")
        self.labels = store(self.labels.join(roots, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp")), "labels")

    def unsettled(self, postings: DataFrame) -> DataFrame:
        """The postings (bucket, band, key, n), now with comp and the bucket's size, of buckets that hold
        several components."""
        named = postings.select("bucket", "band", "key", "n").join(self.labels, "key")
        mixed = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")) \
            .where("low != high").select("bucket", "size")
        return store(named.join(mixed, "bucket").select("bucket", "band", "key", "n", "comp", "size"), "unsettled")

    def may_link(self, x: str, y: str) -> Column:
        """For two postings of a bucket: different components, sizes that fit, sketches that agree enough."""
        n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & (100 * F.least(n_x, n_y) >= self.percent * F.greatest(n_x, n_y)) \
            & (agreement(f"{x}.sketch", f"{y}.sketch") >= likely(self.percent))

    def leaders(self, postings: DataFrame, turn: int) -> None:
        """Compare every class with the likeliest leader of its buckets."""
        rows = postings.join(self.sketches, "key")
        lead = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("rank"), "key", "n", "comp", "sketch")).alias("lead"))
        pairs = rows.alias("x").join(lead.select("bucket", "lead.*").alias("y"), "bucket").where(self.may_link("x", "y"))
        best = pairs.groupBy(F.col("x.key").alias("b")).agg(
            F.max(F.struct(agreement("x.sketch", "y.sketch").alias("agree"), F.col("y.key").alias("a"))).alias("best"))
        self.link(best.select("best.a", "b"))

    def listed(self, postings: DataFrame) -> None:
        """Find the links between different components among the pairs that share a bucket. The sets travel
        with the postings, so that pairs that are none are never written. Buckets of more than ``BLOCK`` classes are
        cut into blocks and met block by block, smaller ones share tasks."""
        mine = postings.groupBy("key").agg(F.collect_list("bucket").alias("mine"))  # at most one per band
        rows = postings.join(self.sketches, "key").join(self.sets.select("key", "elements"), "key").join(mine, "key")
        groups = -(-postings.count() // GROUP)
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")) \
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(max(1, groups)))).otherwise(F.xxhash64("bucket", "low", "high"))
        cells = rows.select(cell.alias("cell"), "bucket", "low", "high", "block", "key", "n", F.xxhash64("comp").alias("comp"),
                            "sketch", "mine", "elements")
        self.merge(cells.groupBy("cell").applyInArrow(_compare(self.percent), "a binary, b binary").distinct())


def class_components(docs: DataFrame, classes: DataFrame, width: int, percent: int, hot: int = HOT) -> DataFrame:
    """(key, comp) of the classes with candidates: comp is the smallest key reachable by links.
    ``classes``: key, doc_id (of one of its documents), n, bands, sketch."""
    all_ = classes.select("key", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    postings = store(all_.join(shared, "bucket"), "postings")
    candidates = store(classes.join(postings.select("key").distinct(), "key", "left_semi"), "candidates")
    ids = store(candidates.select("doc_id").distinct(), "candidate-ids")  # stored, so its size is known to the join
    again = text_rows(docs).alias("t").join(ids.alias("i"), F.expr("t.doc_id <=> i.doc_id"), "left_semi").mapInArrow(_sets(width), SETS)
    sets = store(again.join(candidates.select("key"), "key", "left_semi").groupBy("key")
                 .agg(F.first("n").alias("n"), F.first("elements").alias("elements")), "full-sets")
    linker = Linker(sets, candidates.select("key", "sketch"), percent)

    def rounds(some: DataFrame) -> DataFrame:
        some = linker.unsettled(some)
        for turn in range(TURNS):
            linker.leaders(some.where(F.col("band") % TURNS == turn), turn)
            some = linker.unsettled(some)
        return some

    left = rounds(postings)
    linker.listed(left.where(F.col("size") <= hot))
    large = left.where(F.col("size") > hot)
    if not large.isEmpty():
        bands_ = candidates.select("key", F.posexplode("bands").alias("second", "other"))
        cut = large.join(bands_, "key").where("band < second").select(
            F.xxhash64("bucket", "other").alias("bucket"), "band", "key", "n")
        linker.listed(rounds(store(cut, "second-bands")))
    return linker.labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) and
    kept (whether that is its own)."""
    signed = store(text_rows(docs).mapInArrow(_signed(width), SIGNED), "signed")
    classes = store(signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                                           F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "classes")
    labels = class_components(docs, classes, width, percent, hot)
    named = classes.select("key", "doc_id", "copies").join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    ends = store(named.join(least, "comp").select("key", "component_id", "copies"), "components")
    docs_ = signed.select("doc_id", "key", "n")
    many = F.broadcast(ends.where(F.col("copies") > COPIES).select("key", "component_id"))
    few = ends.where(F.col("copies") <= COPIES).select("key", "component_id")
    full = docs_.where("n > 0")
    found = full.join(many, "key").unionByName(full.join(many.select("key"), "key", "left_anti").join(few, "key")) \
        .select("doc_id", "n", "component_id") \
        .unionByName(docs_.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))
