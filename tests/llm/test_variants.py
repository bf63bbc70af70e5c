"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import variants


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = vocabulary(rows)
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = len(others)
    result = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, out[w], words.get(form[w])))
    return result


def corpus(seed):
    rng = random.Random(seed)
    letters = "abÀéÿ×"
    base = ["".join(rng.choices(letters, k=rng.randrange(7, 13))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "Station", "STATION"]

    def typo(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w, w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]])
    texts = [None, "", "short words only", "x" * 50_000, "x" * 50_000 + "y"]
    for _ in range(60):
        picked = rng.choices(base[:8], k=30) + rng.choices(base, k=20)
        texts.append(rng.choice([" ", "-1 ", "\n"]).join(typo(w) for w in picked))
    texts += texts[5:12] + texts[3:5]
    return list(enumerate(texts)) + [(7, texts[7])]


@pytest.mark.parametrize("seed,hot", [(1, 100), (2, 3), (3, 0)])
def test_equal_to_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "'w' as word", "0 as n")
    got = [tuple(r) for r in variants.group(df, hot).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in got)


def test_chains_of_forms_end_at_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("v", "w4")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.roots(forms).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "v": "w11"}


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(none).collect() == []
    rows = spark.createDataFrame([(None, "station station")], "doc_id long, text string")
    assert variants.group(rows).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [r["n"] for r in variants.group(rows).collect()] == [2]
