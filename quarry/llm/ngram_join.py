"""N-gram Jaccard join (op 10): grouped prefix join over word shingles.

Sets. A text is lower-cased (A-Z), split at ASCII white space and turned into the set of its
hashed five-word shingles (one shingle for a shorter text). Texts with one set are one class.

Order. Shingles are ordered by the number of documents that hold them. Only shared ones
(two documents at least) can count for an overlap, so only they are kept. Counts travel as
sorted blocks, one per input block and hash range, and go back to the block they came
from; a shingle is sent once a block however many of its documents hold it, so a passage found
in a third of all documents is no hot key.

Join. The prefix of a set of size n is its n - ceil(0.8 n) + 1 rarest shingles; sets that
reach the threshold share one. A class whose prefix holds no shared shingle is done. Classes
with equal size and prefix form a group; groups that share a prefix shingle are paired under size
and position filters; a pair of groups is expanded to members, and the sets of members
are compared.

Hot shingles. Only components are asked for, so pairs inside a component need no check.
In a few rounds each group is paired with one leader per shingle (first the group with the
fewest unshared shingles, the likeliest original of many near copies), and linked classes
are merged. Only then the pairs left, those of different components, are listed. So thousands of
near copies cost a few pairs each, and no link between different components is missed.

Shingles travel with 48 bits, groups and components are compared by 64-bit hashes, classes by 128
bits; sizes count 64-bit hashes.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; a null
``doc_id`` gets the component of its copies, or null; repeated rows have one result each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import cuts, deltas, planes, range_start, undeltas, unplanes
from quarry.llm.bpe import mix
from quarry.llm.common import release, store, text_rows
from quarry.llm.components import components

#: Hashes are cut to this many bits where they travel; sizes and classes use all 64.
BITS = 48
FLUSH = 1_500_000
PER_RANGE = 2_500_000
MULTI = 0xFFFF


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out + h[j:len(h) - k + 1 + j])
    return np.unique(out)


BLOCK = ("part long, block long, doc_ids array<long>, keys binary, sizes binary, multi binary, "
         "hashes binary, idx binary, counts binary")
_BLOCK = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    *((c, pa.binary()) for c in ("keys", "sizes", "multi", "hashes", "idx", "counts"))])


def _blocks(parts: int, width: int):
    """Texts -> blocks. A block of documents gives one row with its documents and the shingles that
    several of them hold, and one row per hash range with its distinct shingles."""
    def emit(doc_ids: list, keys: list[bytes], sizes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        which = np.repeat(np.arange(len(sets), dtype=np.uint64), list(map(len, sets)))
        packed = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - BITS) << np.uint64(16) | which
        packed = np.unique(packed)
        h = packed >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        value, idx = h[first], (packed[first] & np.uint64(0xFFFF)).astype("<u2")
        idx[n > 1] = MULTI
        multi = packed[np.repeat(n > 1, n)]
        block = xxhash.xxh3_64_intdigest(b"".join(keys) + repr(doc_ids).encode()) >> 1
        rows = {c: [] for c in _BLOCK.names}

        def add(**values):
            for c in rows:
                rows[c].append(values.get(c))

        add(part=-1 - block, block=block, doc_ids=doc_ids, keys=b"".join(keys),
            sizes=planes(np.array(sizes, np.uint64), 4), multi=planes(multi, 8))
        for part, lo, hi in cuts(value, parts, BITS):
            many = n[lo:hi]
            add(part=part, block=block, hashes=deltas(value[lo:hi], range_start(part, parts, BITS), BITS),
                idx=planes(idx[lo:hi], 2), counts=planes(many[many > 1], 2))
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _BLOCK], schema=_BLOCK)

    def run(batches):
        doc_ids, keys, sizes, sets, total = [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = shingles(text, width)
                doc_ids.append(doc_id)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                sets.append(s)
                total += len(s)
                if total >= FLUSH or len(sets) >= MULTI - 1:
                    yield emit(doc_ids, keys, sizes, sets)
                    doc_ids, keys, sizes, sets, total = [], [], [], [], 0
        if sets:
            yield emit(doc_ids, keys, sizes, sets)
        doc_ids, keys, sizes, sets = [], [], [], []
        release()
    return run


REPLY = "block long, doc_ids array<long>, keys binary, sizes binary, multi binary, part long, hashes binary, idx binary, counts binary"
_REPLY = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.binary()), ("sizes", pa.binary()),
                    ("multi", pa.binary()), ("part", pa.int64()), ("hashes", pa.binary()), ("idx", pa.binary()), ("counts", pa.binary())])


def _count(parts: int):
    """One hash range of all blocks -> per block its shared shingles with their document counts."""
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        if part < 0:  # a block's own row travels along
            return group.select(_REPLY.names).cast(_REPLY)
        low = range_start(part, parts, BITS)
        hashes = [undeltas(b, low, BITS) for b in group.column("hashes").to_pylist()]
        idx = [unplanes(b, 2) for b in group.column("idx").to_pylist()]
        n = []
        for i, c in zip(idx, group.column("counts").to_pylist()):
            own = np.ones(len(i), np.int64)
            own[i == MULTI] = unplanes(c, 2)
            n.append(own)
        ends = np.cumsum(list(map(len, hashes)))
        value, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(n), len(value)).astype(np.int64)[inverse]
        del value, inverse
        out = {c: [] for c in _REPLY.names}
        for block, h, i, lo, hi in zip(group.column("block").to_pylist(), hashes, idx, ends - list(map(len, hashes)), ends):
            shared = df[lo:hi] > 1
            if shared.any():
                values = {"block": block, "part": part, "hashes": deltas(h[shared], low, BITS), "idx": planes(i[shared], 2),
                          "counts": planes(df[lo:hi][shared], 5)}
                for c in out:
                    out[c].append(values.get(c))
        found = pa.table([pa.array(out[f.name], f.type) for f in _REPLY], schema=_REPLY)
        del hashes, idx, n, df, out
        release()
        return found
    return run


SETS = "doc_id long, key binary, n long, shared array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("shared", pa.list_(pa.int64()))])


def prefix_length(n, percent: int):
    """Size of the prefix that sets reaching the threshold must share a shingle of (numbers or columns)."""
    return n - (n * percent + 99) // 100 + 1


def _gather(parts: int, percent: int):
    """A block's rows -> its documents: class key, set size and, where the prefix reaches them, the
    shared shingles from rare to frequent."""
    def run(group: pa.Table) -> pa.Table:
        own = [r for r in group.to_pylist() if r["keys"] is not None]
        doc_ids = [i for r in own[:1] for i in r["doc_ids"]]
        keys = np.frombuffer(b"".join(r["keys"] for r in own[:1]), "S1").reshape(-1, 16) if own else []
        size = unplanes(own[0]["sizes"], 4).astype(np.int64) if own else np.zeros(0, np.int64)
        multi = unplanes(own[0]["multi"], 8) if own else np.zeros(0, np.uint64)
        seen, h_all, d_all, f_all = set(), [], [], []
        multi_h = multi >> np.uint64(16)
        for r in group.select(["part", "hashes", "idx", "counts"]).to_pylist():
            if r["hashes"] is None or r["part"] in seen:
                continue  # two equal blocks have equal replies
            seen.add(r["part"])
            h = undeltas(r["hashes"], range_start(r["part"], parts, BITS), BITS)
            idx = unplanes(r["idx"], 2)
            df = unplanes(r["counts"], 5).astype(np.int64)
            many = idx == MULTI
            lo, hi = np.searchsorted(multi_h, h[many], "left"), np.searchsorted(multi_h, h[many], "right")
            reps = hi - lo
            at = np.repeat(lo - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            h_all += [h[~many], np.repeat(h[many], reps)]
            d_all += [idx[~many].astype(np.int64), (multi[at] & np.uint64(0xFFFF)).astype(np.int64)]
            f_all += [df[~many], np.repeat(df[many], reps)]
        h, d, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h_all, d_all, f_all))
        n_shared = np.bincount(d, minlength=len(size))
        open_ = prefix_length(size, percent) > size - n_shared  # some shared shingle lies in the prefix
        keep = open_[d] if len(d) else np.zeros(0, bool)
        h, d, f = h[keep], d[keep], f[keep]
        order = np.lexsort((h, f, d))
        ends = np.cumsum(np.where(open_, n_shared, 0))
        flat = h[order].astype(np.int64)
        shared = [flat[e - k:e] if o and k else None for e, k, o in zip(ends.tolist(), n_shared.tolist(), open_.tolist())]
        table = pa.table([pa.array(doc_ids, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()),
                          pa.array(size), pa.array(shared, pa.list_(pa.int64()))], schema=_SETS)
        return pa.concat_tables([table] * max(1, len(own)))
    return run


def shared_sets(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: class key (equal sets), set size n, and the shared shingles from rare to frequent
    where the prefix reaches them, else null."""
    rows = text_rows(docs)
    words = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0  # about one shingle in six bytes
    parts = max(12, -(-(words // 6) // PER_RANGE))
    run = _blocks(parts, width)
    blocks = rows.mapInArrow(run, BLOCK)
    replies = blocks.groupBy("part").applyInArrow(_count(parts), REPLY)
    return replies.groupBy("block").applyInArrow(_gather(parts, percent), SETS)


def similar(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


class Classes:
    """The classes that may link, their groups and prefix postings."""

    def __init__(self, sets: DataFrame, percent: int):
        self.percent = percent
        base = (sets.where("shared is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
                .withColumn("alone", F.col("n") - F.size("shared"))
                .withColumn("length", F.expr(f"n - div(n * {percent} + 99, 100) + 1 - alone").cast("int"))
                .withColumn("prefix", F.slice("shared", F.lit(1), F.col("length"))))
        tag = F.xxhash64(F.col("n"), F.col("prefix"))
        self.members = store(base.withColumn("gid", tag).select("key", "gid", "n", "alone", "shared", "length"), "classes")
        groups = self.members.groupBy("gid").agg(
            F.first("n").alias("n"), F.first("alone").alias("alone"), F.min("key").alias("head"), F.count(F.lit(1)).alias("n_members"),
            F.first(F.expr("slice(shared, 1, length)")).alias("prefix"))
        self.groups = groups.select("gid", "head", "n_members")
        postings = groups.select("gid", "n", "alone", F.posexplode("prefix").alias("at", "token"))
        # what may still match behind the token, itself included
        self.postings = store(postings.select("token", "gid", F.col("n").cast("int").alias("n"), F.col("alone").cast("int").alias("alone"),
                                              (F.col("n") - F.col("alone") - F.col("at")).cast("int").alias("rest")), "postings")

    def fits(self, a: str, b: str) -> Column:
        """Size and position filters for two postings of one token."""
        n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
        most = F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest"), n_a, n_b)
        return (100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)) & ((100 + self.percent) * most >= self.percent * (n_a + n_b))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs of class keys (a, b), those whose sets reach the threshold."""
        sets = self.members.select("key", "n", "shared")
        left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
        right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
        both = pairs.join(left, "a").join(right, "b")
        overlap = F.size(F.array_intersect("s_a", "s_b"))
        return both.where(similar(overlap, F.col("n_a"), F.col("n_b"), self.percent)).select("a", "b")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (key, comp) after joining the components that ``links`` connect."""
    at = lambda c: labels.select(F.col("key").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = store(links.join(at("a"), "a").join(at("b"), "b").where("comp_a != comp_b")
                    .select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "merges")
    if between.isEmpty():
        return labels
    roots = components(between).select(F.col("node").alias("comp"), "root")
    return store(labels.join(roots, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp")), "labels")


def class_components(classes: Classes, rounds: int = 3) -> DataFrame:
    """(key, comp) of the classes that may link: comp is the smallest key reachable by links."""
    members = classes.members.select("key", "gid")
    labels = members.select("key", F.col("key").alias("comp"))
    open_ = classes.postings.withColumn("state", F.col("gid"))  # at first every group is a component of its own
    mixed = classes.groups.where("n_members > 1").select("gid", "head")
    for r in range(rounds + 1):
        ranked = F.struct(F.col("alone"), F.col("gid")) if r == 0 else F.struct(F.xxhash64("token", F.lit(r), "gid"), F.col("gid"))
        buckets = open_.groupBy("token").agg(F.min("state").alias("low"), F.max("state").alias("high"),
                                             F.min_by(F.struct("gid", "n", "rest", "state"), ranked).alias("lead")) \
            .where("low != high").select("token", "lead.*")
        # components only grow: a shingle whose groups are all in one stays settled
        open_ = store(open_.join(buckets.select("token"), "token", "left_semi"), "open")
        if r < rounds:
            pairs = open_.alias("x").join(buckets.alias("y"), "token") \
                .where(classes.fits("x", "y") & (F.col("x.state") != F.col("y.state"))) \
                .select(F.col("y.gid").alias("lead"), F.col("x.gid").alias("gid")).distinct() \
                .join(classes.groups.select(F.col("gid").alias("lead"), F.col("head").alias("a")), "lead").select("a", "gid")
            pairs = pairs.unionByName(mixed.select(F.col("head").alias("a"), "gid")) \
                .join(members.select(F.col("key").alias("b"), "gid"), "gid").select("a", "b")
        else:
            pairs = open_.alias("x").join(open_.alias("y"), "token") \
                .where((F.col("x.gid") < F.col("y.gid")) & (F.col("x.state") != F.col("y.state")) & classes.fits("x", "y")) \
                .select(F.col("x.gid").alias("g"), F.col("y.gid").alias("gid")).distinct() \
                .unionByName(mixed.select(F.col("gid").alias("g"), "gid"))
            pairs = pairs.join(members.select(F.col("key").alias("a"), F.col("gid").alias("g")), "g") \
                .join(members.select(F.col("key").alias("b"), "gid"), "gid").select("a", "b")
        named = labels.select(F.col("key").alias("a"), F.col("comp").alias("comp_a"))
        other = labels.select(F.col("key").alias("b"), F.col("comp").alias("comp_b"))
        pairs = pairs.where("a != b").join(named, "a").join(other, "b").where("comp_a != comp_b") \
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = _merge(labels, store(classes.links(pairs), "links"))
        if r == rounds:
            return labels
        # a group whose members are in several components differs from every other one
        state = members.join(labels, "key").groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("key").alias("head"))
        state = store(state.select("gid", "head", F.when(F.col("low") == F.col("high"), F.xxhash64("low")).otherwise(F.col("gid")).alias("state"),
                                   (F.col("low") != F.col("high")).alias("mixed")), "states")
        mixed = state.where("mixed").select("gid", "head")
        open_ = open_.drop("state").join(state.select("gid", "state"), "gid")
    return labels


def join(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included)."""
    sets = store(shared_sets(docs, width, percent), "sets")
    labels = class_components(Classes(sets, percent), rounds)
    # copies are pre-aggregated to classes before anything is joined
    first = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    named = first.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "comp").select("key", "component_id")
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sets.where("n > 0").join(by_class, "key") \
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) without near duplicates: of each component the row
    with the smallest ``doc_id`` stays, once (two texts of one id both stay). A row without words is in no component and
    stays; of rows without an id, one of each text stays."""
    found = join(docs, width, percent, rounds)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where("doc_id is not null")
    unnamed = docs.where("doc_id is null").dropDuplicates(["text"])
    return named.join(kept, named["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(unnamed)
