"""Conversation repair against an exhaustive search over edit lists."""

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))


def fault(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(BLANKS)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, faults, most_inserts=2):
    """Least (cost, audit, repaired rows) over all edit lists with at most ``most_inserts`` inserts a gap."""
    best = None

    def go(i, cost, audit, done, gap):
        nonlocal best
        if best and cost > best[0]:  # deleting all rows comes first, so this bounds the search
            return
        if i == len(rows) and GOOD.match("".join(r[:1] or "?" for r, _ in done)):
            best = min(best or (cost, audit, done), (cost, audit, done))
        if i < len(rows):
            role, text = rows[i][2:]
            go(i + 1, cost + 2, audit + "D", done, 0)
            if faults[i] in ("", "truncated"):
                extra = 5 if faults[i] else 0
                go(i + 1, cost + extra, audit + "K", done + [(role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", done + [(new, text)], 0)
        if gap < most_inserts:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", done + [(role, "")], gap + 1)
    go(0, 0, "", [], 0)
    return best


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = damaged([r for r in table if r[0] == conv])
        faults = fault(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        initials = [r[2][:1] for r in rows]
        cost, audit, done = exhaustive(rows, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "What? ", "fine.\t", "again.", None, "é ü."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    out = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 6)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    return out + out[:2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_an_exhaustive_search(spark, seed):
    table = conversations(seed)
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as key", "2 as copies", "3 as first")
    got = {r[0]: tuple(r)[1:] for r in repair.damaged_report(df).collect()}
    assert got == brute(table)


def test_inserts_are_weighed_when_nothing_else_is_left():
    ways = repair.block_ways(b"")
    assert ways[0][3] == (10, "II") and ways[2][3] == (5, "I") and ways[3][0] is None
    assert repair.block_ways(bytes([1]))[0][3] == (6, "IR")  # a system row as assistant row


def test_a_stretch_equals_its_blocks(monkeypatch):
    rng = random.Random(7)
    for _ in range(30):
        steps = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 40)))
        whole = repair.block_ways(steps)
        monkeypatch.setattr(repair, "BLOCK", rng.randrange(1, 7))
        assert repair.stretch_ways(steps) == whole


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"text {t}.", "cut", "  "])) for t in range(3000)]
    table = rows + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(table, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: r for r in repair.damaged_report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = damaged(rows)
    faults = fault(rows)
    steps = bytes(0 if f in ("blank", "duplicate") else repair._step(r[2][:1], f == "truncated") for r, f in zip(rows, faults))
    cost, audit = repair.cheapest(repair.block_ways(steps))
    done = []
    role_of = iter(rows)
    for letter, role in repair.edits(audit, (r[2][:1] for r in rows)):
        row = next(role_of) if letter != "I" else None
        if letter != "D":
            done.append(f"{role or row[2]}:{row[3] if row else ''}")
    assert (got[7]["cost"], got[7]["audit"]) == (cost, audit)
    assert got[7]["repaired_sha256"] == hashlib.sha256("\n".join(done).encode()).hexdigest()
    assert GOOD.match("".join(line[0] for line in done))


def test_repaired_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "How?"), (2, 0, "user", "cut")], SCHEMA)
    got = [tuple(r) for r in repair.repair(df).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "R", "user", "Hello."), (1, 1, "K", "assistant", "How?")]
    assert repair.damaged_report(df.limit(0)).collect() == []
    assert repair.repair(df.limit(0)).collect() == []


def test_a_conversation_that_lost_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi." * 100_000)], SCHEMA)
    assert tuple(repair.damaged_report(df).head()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
