"""Conversation structure repair (op 13): cheapest edits by scalar big-integer weights.

Rows. The rows of a conversation are taken by turn (nulls first), then role, then MD5 of the text; rows
equal in all of these stand together. A row's first fault counts: *blank* (nothing but ASCII white
space), *duplicate* (role and text seen earlier in the conversation), *truncated* (the last visible
character is none of ``.!?``).

Edits. Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit for blank and duplicate rows),
Insert an empty user or assistant row anywhere 5; a truncated row that stays costs 5 more. The
role initials left must read ``(s?(ua)+)?``. Of the cheapest edit lists the one whose initials (the
*audit*) come first in ASCII order is taken; it fixes the repaired rows, since a rerole or an
insert can only give the role that is due.

Weights. A state of the grammar before a row is a node of a DAG; a way to the end is one integer: the
cost in the high digits, the audit in the low ones, three bits a letter (D I K R as 1 2 3 4), first letter
highest, zeros behind the last. Going one edit back adds to the high digits and pushes its letter in
front of the low ones. So the minimum of integers decides both cost and ties.

Scale. Damage, faults and counts are DataFrame expressions. The rows are then ranged over (conversation,
order), so that a conversation of any size spans many tasks: each computes the least weight of its
stretch from every state to every state, and stretches are put together per conversation. (Two equal
costs over one stretch never have an audit that begins with the other one, since letters more are
inserts that cost more; so stretches can be decided before what follows is known.) Texts travel once,
to apply the audit; the digest of one conversation is one SHA-256 and therefore one stream, of
which a task holds one record batch and the audit.

Defined cases: null ``conv_id`` is a conversation of its own, a null role or text is one space;
an empty role has no initial and cannot be kept; a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Audit letters by digit, in ASCII order.
LETTERS = {"1": "D", "2": "I", "3": "K", "4": "R"}
_D, _I, _K, _R = 1, 2, 3, 4
#: States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
ACCEPT = (0, 3)
#: Where a kept row with this initial leads from a state.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The state behind the user or assistant row that is due in a state.
DUE = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
BLOCK = 96
SPACE = r"[\x20\x09-\x0D]"

#: One byte a row: 0 must go, 1-4 initial s, u, a, other; 4 more where truncated.
INITIALS = "sua"


def _step(initial: str, truncated: bool) -> int:
    return (INITIALS.index(initial) if initial and initial in INITIALS else 3) + 1 + (4 if truncated else 0)


class Weight:
    """Integers for audits of at most ``width`` letters."""

    def __init__(self, width: int):
        self.width, self.shift, self.front = width, 3 * width, 3 * (width - 1)
        self.mask = (1 << self.shift) - 1
        self.never = 1 << (self.shift + 48)

    def before(self, rest: int, cost: int, letter: int) -> int:
        """The weight of an edit followed by ``rest``."""
        return ((rest >> self.shift) + cost << self.shift) | (letter << self.front) | ((rest & self.mask) >> 3)

    def read(self, value: int) -> tuple[int, str] | None:
        if value >= self.never:
            return None
        digits = format(value & self.mask, f"0{self.width}o").rstrip("0")
        return value >> self.shift, digits.translate(str.maketrans(LETTERS))


@lru_cache(maxsize=20_000)
def block_ways(steps: bytes) -> tuple:
    """ways[state][end]: the least (cost, audit) that leads through ``steps`` from state to end, or None."""
    w = Weight(3 * len(steps) + 2)
    ways = [[None] * 4 for _ in STATES]

    def inserts(least: list[int]) -> list[int]:
        one = [w.before(least[DUE[q]], INSERT, _I) for q in STATES]
        return [min(least[q], one[q], w.before(one[DUE[q]], INSERT, _I)) for q in STATES]

    for end in STATES:
        least = inserts([0 if q == end else w.never for q in STATES])
        for step in reversed(steps):
            extra = TRUNCATED if step > 4 else 0
            leads = NEXT.get((INITIALS + "?")[(step - 1) % 4], {}) if step else {}
            row = []
            for q in STATES:
                value = w.before(least[q], DELETE, _D)
                if step:
                    value = min(value, w.before(least[DUE[q]], REROLE + extra, _R))
                if q in leads:
                    value = min(value, w.before(least[leads[q]], KEEP + extra, _K))
                row.append(value)
            least = inserts(row)
        for q in STATES:
            ways[q][end] = w.read(least[q])
    return tuple(map(tuple, ways))


def _join(a: tuple, b: tuple) -> tuple:
    """The ways through two stretches in a row."""
    def best(q: int, end: int):
        via = [(a[q][m], b[m][end]) for m in STATES if a[q][m] and b[m][end]]
        if not via:
            return None
        cost = min(x[0] + y[0] for x, y in via)
        return cost, min(x[1] + y[1] for x, y in via if x[0] + y[0] == cost)
    return tuple(tuple(best(q, end) for end in STATES) for q in STATES)


def stretch_ways(steps: bytes) -> tuple:
    """Ways through any number of rows: blocks, put together pairwise."""
    parts = [block_ways(steps[i:i + BLOCK]) for i in range(0, max(1, len(steps)), BLOCK)]
    while len(parts) > 1:
        parts = [_join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def cheapest(ways: tuple) -> tuple[int, str]:
    """(cost, audit) of the whole conversation."""
    return min(ways[0][q] for q in ACCEPT if ways[0][q])


def edits(audit: str, initials: Iterable[str]) -> Iterator[tuple[str, str | None]]:
    """(letter, new role or None) in order; ``initials`` are drawn for rows, not for inserts."""
    state, rows = 0, iter(initials)
    for letter in audit:
        if letter == "D":
            next(rows)
            yield letter, None
        elif letter == "K":
            state = NEXT[next(rows)][state]
            yield letter, None
        else:
            if letter == "R":
                next(rows)
            state = DUE[state]
            yield letter, ROLE[state]


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with one space for a null role or text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                filled("role"), filled("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) mod 20 (a null is one space): 0 drops the row, 1 empties
    its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user row."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    drawn = rows_of(conversations).withColumn("draw", draw.cast("int")).where("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")


ORDER = ("conv_id", "turn", "role", "key")


def faults(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text): its ``copies``, and whether it is blank, truncated,
    and the first with its role and text (then its first copy is no duplicate)."""
    visible = F.regexp_replace("text", SPACE + "+$", "")
    flagged = rows.select("conv_id", "turn", "role", _key(), (visible == "").alias("blank"),
                          (~visible.rlike(r"[.!?]\z")).alias("truncated"))
    distinct = flagged.groupBy(*ORDER).agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"),
                                           F.first("truncated").alias("truncated"))
    # nulls come first: -1 where the turn is null, so the pair (known, turn) orders them
    first = distinct.groupBy("conv_id", "role", "key").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    d, f = distinct.alias("d"), first.alias("f")
    same = F.expr("d.conv_id <=> f.conv_id") & (F.col("d.role") == F.col("f.role")) & (F.col("d.key") == F.col("f.key"))
    return d.join(f, same).select("d.*", F.expr("d.turn <=> f.at.turn").alias("first"))


STRETCH = ("conv_id long, task long, first string, last string, illegal long, costs array<long>, audits array<string>")
_STRETCH = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                      ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
LEGAL = {"su", "ua", "au"}
OUT_ROWS = 2_000


def _out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows of a range -> one row per conversation in it."""
    task, out, conv, now = TaskContext.get().partitionId(), [], object(), None

    def close():
        ways = [way for row in stretch_ways(bytes(now["steps"])) for way in row]
        out.append({"conv_id": conv, "task": task, "first": now["first"], "last": now["last"], "illegal": now["illegal"],
                    "costs": [way and way[0] for way in ways], "audits": [way and way[1] for way in ways]})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "initial", "blank", "truncated", "first", "copies")]
        for conv_id, initial, blank, truncated, first, copies in zip(*columns):
            if now is None or conv_id != conv:
                if now is not None:
                    close()
                    if len(out) >= OUT_ROWS:
                        yield _out(out, _STRETCH)
                        out = []
                conv, now = conv_id, {"steps": bytearray(), "first": initial, "last": None, "illegal": 0}
            if now["last"] is not None:
                now["illegal"] += now["last"] + initial not in LEGAL
            now["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
            now["last"] = initial
            stays = not blank and first
            now["steps"] += (bytes([_step(initial, truncated)]) if stays else b"\0") + bytes(copies - 1)
    if now is not None:
        close()
        yield _out(out, _STRETCH)


PLAN = "conv_id long, illegal long, cost long, audit string"
_PLAN = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches by conversation and task -> cost and audit of each conversation."""
    out, conv, parts = [], None, []

    def close():
        matrices = [tuple(tuple(None if r["costs"][4 * q + e] is None else (r["costs"][4 * q + e], r["audits"][4 * q + e])
                                for e in STATES) for q in STATES) for r in parts]
        cost, audit = cheapest(reduce(_join, matrices))
        between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
        out.append({"conv_id": conv, "illegal": sum(r["illegal"] for r in parts) + between, "cost": cost, "audit": audit})

    for batch in batches:
        for row in batch.to_pylist():
            if parts and row["conv_id"] != conv:
                close()
                parts = []
                if len(out) >= OUT_ROWS:
                    yield _out(out, _PLAN)
                    out = []
            conv = row["conv_id"]
            parts.append(row)
    if parts:
        close()
        yield _out(out, _PLAN)


def plans(faulty: DataFrame) -> DataFrame:
    """conv_id, illegal, cost and audit from :func:`faults`."""
    ranged = faulty.withColumn("initial", F.substring("role", 1, 1)).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows = ranged.select("conv_id", "initial", "blank", "truncated", "first", "copies")
    stretches = rows.mapInArrow(_stretches, STRETCH)
    return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "task").mapInArrow(_plans, PLAN)


REPAIRED = "conv_id long, position long, edit string, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                       ("text", pa.string())])
DIGEST = "conv_id long, repaired_sha256 string"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Streams (conv_id, letter, role, text) of the repaired rows; a conversation starts with (conv_id,
    None, None, None). Each conversation's audit comes before its rows."""
    conv, audit, at, state = None, "", 0, 0

    def added():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, DUE[state]
            yield conv, "I", ROLE[state], ""

    for batch in batches:
        for conv_id, audit_, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit_ is not None:
                yield from added()
                conv, audit, at, state = conv_id, audit_, 0, 0
                yield conv, None, None, None
                continue
            yield from added()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = NEXT[role[0]][state]
                yield conv, letter, role, text
            elif letter == "R":
                state = DUE[state]
                yield conv, letter, ROLE[state], text
    yield from added()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, position, size = [], 0, 0
    for conv_id, letter, role, text in _applied(batches):
        if letter is None:
            position = 0
            continue
        out.append({"conv_id": conv_id, "position": position, "edit": letter, "role": role, "text": text})
        position, size = position + 1, size + len(text)
        if len(out) >= OUT_ROWS or size > 4_000_000:
            yield _out(out, _REPAIRED)
            out, size = [], 0
    yield _out(out, _REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, digest, conv, start = [], None, None, True
    for conv_id, letter, role, text in _applied(batches):
        if letter is None:
            if digest is not None:
                out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                if len(out) >= OUT_ROWS:
                    yield _out(out, _DIGEST)
                    out = []
            digest, conv, start = hashlib.sha256(), conv_id, True
            continue
        digest.update((f"{role}:{text}" if start else f"\n{role}:{text}").encode())
        start = False
    if digest is not None:
        out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
    yield _out(out, _DIGEST)


def _streams(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    lines = rows.select("conv_id", F.lit(1).alias("line"), "turn", "role", _key(), "text", F.lit(None).cast("string").alias("audit"))
    heads = planned.select("conv_id", F.lit(0).alias("line"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), "audit")
    return heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "line", "turn", "role", "key") \
        .select("conv_id", "audit", "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows of every conversation: conv_id, position (from 0), edit (K, R or I), role, text."""
    rows = rows_of(conversations)
    planned = store(plans(store(faults(rows), "faults")), "plans")
    return _streams(rows, planned).mapInArrow(_repaired, REPAIRED)


def report(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """Per ``conv_id`` of ``conversations`` what is wrong with its rows in ``damaged`` (rows as of
    :func:`rows_of`) and how they are mended: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of the repaired ``role:text`` joined by newlines)."""
    found = store(faults(damaged), "faults")
    count = lambda c: F.sum(c).cast("long")
    fresh = F.col("first") & ~F.col("blank")
    turns = found.groupBy("conv_id", "turn").agg(
        count(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        count(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("first").cast("int"))).alias("duplicate"),
        count((fresh & F.col("truncated")).cast("int")).alias("truncated"))
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    planned = store(plans(found), "plans")
    digests = _streams(damaged, planned).mapInArrow(_digests, DIGEST)
    known = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = known.alias("k")
    for name, other in (("c", counts), ("p", planned), ("d", digests)):
        out = out.join(other.alias(name), F.expr(f"k.conv_id <=> {name}.conv_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("k.conv_id", *(zero(f"c.{c}").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")),
                      zero("p.illegal").alias("illegal"), zero("p.cost").alias("cost"),
                      F.coalesce("p.audit", F.lit("")).alias("audit"),
                      F.coalesce("d.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged_report(conversations: DataFrame) -> DataFrame:
    """:func:`report` of :func:`damage`."""
    return report(conversations, damage(conversations))
