"""Language ID and toxicity: exact inner parts and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest

from quarry.llm import langid, toxicity
from quarry.llm.common import id_remainder_py


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 70, 0, 33, 32, 2])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    start, move = rng.normal(size=3), rng.normal(size=(3, 3))
    got, pairs = langid.posteriors(scores, lengths, start, move, pairs=True)
    lse = lambda x, axis: np.log(np.exp(x).sum(axis))
    want, expected, at = [], np.zeros((3, 3)), 0
    for n in lengths[lengths > 0]:
        s = scores[at:at + n]
        at += n
        alpha = [start + s[0]]
        for t in range(1, n):
            alpha.append(lse(alpha[-1][:, None] + move, 0) + s[t])
        beta = [np.zeros(3)]
        for t in range(n - 1, 0, -1):
            beta.insert(0, lse(move + s[t] + beta[0], 1))
        total = lse(alpha[-1], 0)
        want.append(np.exp(np.array(alpha) + np.array(beta) - total))
        for t in range(1, n):
            expected += np.exp(alpha[t - 1][:, None] + move + s[t] + beta[t] - total)
    assert np.allclose(got, np.concatenate(want)) and np.allclose(pairs, expected)


def language_docs():
    rng = np.random.default_rng(2)
    parts = {"xa": ["ka", "to", "ri", "mu"], "xb": ["sch", "ü", "ber", "ach"], "xc": ["ción", "ez", "llo", "ña"]}
    word = lambda lang: "".join(rng.choice(parts[lang], 3))
    docs = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(list(parts), 400).tolist())]
    return docs, word


def test_language_held_out_and_cases(spark):
    docs, word = language_docs()
    mixed = " ".join([*(word("xa") for _ in range(12)), *(word("xb") for _ in range(12))])
    extra = [(1001, None, "xa"), (1002, "", "xa"), (1003, "12 ² !", "xa"), (1004, mixed, None), (1005, "x" * 100_000, "xb"), (None, docs[0][1], "xb")]
    df = spark.createDataFrame([(*r, 1) for r in docs + extra], "doc_id long, text string, lang string, score int")
    model = langid.train(df)
    rows = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [d for d in docs if id_remainder_py(d[0], 5) == 0]
    assert all(rows[i]["held_out"] for i, *_ in held) and len(held) > 50
    assert np.mean([rows[i]["lang_pred"] == lang for i, _, lang in held]) > 0.97
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (1001, 1002, 1003))
    assert rows[None]["lang_pred"] == docs[0][2] and 0 <= rows[1005]["score"] <= 1
    labelled = {r["doc_id"]: r for r in langid.label_words(df.where("doc_id = 1004"), model).collect()}[1004]
    assert [(r["lang"], r["n_words"]) for r in labelled["runs"]] == [("xa", 12), ("xb", 12)]
    kept = {r["doc_id"] for r in langid.accepted(df, model).collect()}
    assert not kept & {1001, 1002, 1003} and {i for i, *_ in docs} <= kept
    assert langid.accepted(df, model).columns == df.columns


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.predict(df, langid.train(df)).collect()] == ["und"]
    assert langid.predict(df.where("false"), langid.train(df.where("false"))).count() == 0


def toxic_docs(n=1500):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdeilmnorstu"), 6)) for _ in range(800)]
    out = []
    for i in range(n):
        words = rng.choice(vocabulary, 60).tolist()
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(3):
                cue = rng.choice(["vilest", "rotten", "grubba" + str(rng.choice(list("xyz"))), "grubbb"])
                words[rng.integers(60)] = cue.upper() if rng.random() < 0.3 else cue
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_held_out_and_cases(spark):
    rows = toxic_docs()
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows] + [(5001, None, 1), (5002, "", 1), (None, "vilest rotten grubbax", 1), (5003, "a " * 90_000, 1)],
                                 "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5003, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if id_remainder_py(i, 5) == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.99
    assert got[None]["predicted"] == 1 and got[5001]["score"] == got[5002]["score"] < 0.5
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()] == [0.0]
    assert toxicity.score(docs.where("false"), toxicity.train(docs, labels)).count() == 0


def test_cue_finder_equals_words():
    cues = ["bad", "badl*", "ugl*", "gly"]
    text = "Bad badly bad-ly ugly gly uglyness BADLAND xbad badé"
    words = [w for w in toxicity.WORD.findall(text.lower())]
    want = Counter({i: sum(w.startswith(c[:-1]) and len(w) > len(c) - 1 if c.endswith("*") else w == c for w in words) for i, c in enumerate(cues)})
    assert toxicity.CueFinder(cues).hits(text) == +want


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(6)
    y = rng.random(4000) < 0.3
    voter = lambda: np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.2)
    one, two, copied = voter(), voter(), voter()
    x = np.stack([one, two, copied, copied, copied], 1).astype(float)
    model = toxicity.fit_label_model(x, y, 0.3)
    assert model.share[2] < 0.5 < model.share[0] and model.correlation[2, 3] == pytest.approx(1, abs=0.05)
    assert np.mean((model.posterior(x) >= 0.5) == y) > 0.75
