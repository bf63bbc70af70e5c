"""The pipeline against a plain version of its decisions, and the registration."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import langid, pieces, pii, toxicity
from test_bpe_pii import brute as brute_spans
from test_ngram_join import brute as brute_components

SMALL = "/root/testdata/sf0.001"


def test_names_and_stages():
    names = entry.queries().keys()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.language_id, corpus_pipeline.toxic, corpus_pipeline.near_duplicates,
                                                      corpus_pipeline.personal_data, corpus_pipeline.packed]


def extended(spark):
    """Documents of the smallest tables with nulls, repeated rows, copies and personal data."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5),
             (9004, "write to me at a.b@c.de or +49 30 1234567 about the thing and the other thing", "en", "s", 77),
             (9004, "write to me at a.b@c.de or +49 30 1234567 about the thing and the other thing", "en", "s", 77)]
    copies = docs.where("doc_id % 7 = 0").selectExpr("doc_id + 5000 as doc_id", "upper(text) as text", "lang", "source", "n_chars")
    return docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(copies)


def test_stages_equal_the_plain_version(spark, tmp_path):
    docs = extended(spark)
    rows = {}
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, left, SMALL).write.parquet(out)
        rows[name] = left.collect()
        left = spark.read.parquet(out)
        if name != "packing":
            assert left.columns == docs.columns

    # language ID: what the model does not place goes
    model = langid.train(docs)
    plain = {(r["doc_id"], r["text"]) for r in rows["language_id"] if r["text"] and len(langid.words_of(r["text"]))
             and langid.masses(model, [r["text"]])[3].max() >= 0.4 * len(langid.words_of(r["text"]))}
    assert {(r["doc_id"], r["text"]) for r in rows["toxicity"]} == plain
    assert not {9001, 9002, 9003} & {i for i, _ in plain} and len(plain) >= 200

    # toxicity
    voters = toxicity.train(spark.createDataFrame(rows["toxicity"], docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet"))
    finder = voters.finder()
    clean = {(r["doc_id"], r["text"]) for r in rows["toxicity"] if voters.score(finder, r["text"]) < 0.5}
    assert {(r["doc_id"], r["text"]) for r in rows["near_duplicates"]} == clean

    # near duplicates: the smallest id of each component, once
    members = [(r["doc_id"], r["text"]) for r in rows["near_duplicates"]]
    stay = {i for i, _, c in brute_components(members) if i == c}
    kept = [r["doc_id"] for r in rows["pii"]]
    assert sorted(kept) == sorted(stay) and len(kept) < len(members)

    # PII: base spans found by scanning whole texts are gone
    before = {r["doc_id"]: r["text"] for r in rows["pii"]}
    for r in rows["packing"]:
        spans = brute_spans(before[r["doc_id"]])
        assert set(spans) <= set(pii.Finder().spans(before[r["doc_id"]]))
        assert r["text"] == pii.masked(before[r["doc_id"]], pii.Finder().spans(before[r["doc_id"]]))
        assert not re.search(r"[a-z]@[a-z]+\.[a-z]", r["text"]) and r["n_chars"] == len(r["text"])

    # packing: every text, whole and gapless
    tok = pieces.load(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tok.encode(r["text"], add_special_tokens=False).ids, 1] for r in rows["packing"]}
    packed = left.collect()
    sequences = {}
    for r in packed:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in packed) == sum(map(len, ids.values()))
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(parts)] and ends[-1] <= 4096


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < got.select("doc_id").distinct().count() <= pq.read_table(f"{SMALL}/documents.parquet").num_rows
