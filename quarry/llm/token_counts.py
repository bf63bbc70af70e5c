"""Token counts of whole texts (op 2): overlap resynchronisation.

Texts up to ``huge`` characters are encoded as they are. Longer ones are cut into chunks
of ``chunk`` characters, each read ``overlap`` characters beyond its end, so one huge
document is spread over tasks. Every chunk is encoded with offsets. Two neighbours are
spliced at the first position of their overlap where both have a token that starts there
and the text proves that no token can cross it; the tokens before it are counted in the left
chunk and the rest in the right one. Where the overlap holds no such position, it is
widened fourfold for that document, until the overlap reaches the document's end.

Proof of a position p (word_bpe_49k.json): its pre-tokens are runs of letters, single
numbers, runs of other characters and English contractions, white space is dropped, and
merges stay inside a pre-token. So no pre-token crosses ASCII white space, and
none goes on after an ASCII digit or into one; normalisation (NFC, lower case) changes
nothing across a position whose two neighbours are ASCII. Special strings hold neither
white space nor digits.

Defined cases: null or empty text has 0 tokens and 0 bytes; a null ``doc_id`` is kept;
repeated rows give repeated results; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import pieces
from quarry.llm.common import map_batches, store, text_rows, text_slices

#: Positions between ASCII neighbours that no token can cross.
STABLE = re.compile(r"(?<=[ \t\n\r])(?=[\x21-\x7e])|(?<=[0-9])(?=[\x21-\x7e])|(?<=[\x21-\x7e])(?=[0-9])")


def _count_small(path: str):
    def make():
        enc = pieces.PieceIds.of(path)

        def step(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            n: list[int] = []
            for lo, hi in text_slices(texts):
                n += [len(b) // 4 for b in enc.ids(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
        return step
    return make


def seams(tok, part: str, start: int, chunk: int, overlap: int) -> tuple[list[int], list[int], list[int], list[int], int]:
    """Encode the text ``part`` that starts at ``start``; positions of proven token starts (and
    tokens before them) in its first ``overlap`` characters and beyond its ``chunk`` first
    ones, and the number of all its tokens."""
    starts = [a for a, _ in tok.encode(part, add_special_tokens=False).offsets]
    proven = {m.start() for m in STABLE.finditer(part[:overlap + 1])} | \
             {m.start() + max(0, chunk - 1) for m in STABLE.finditer(part[max(0, chunk - 1):])}
    left_p, left_n, right_p, right_n = [], [], [], []
    for n, p in enumerate(starts):
        if p not in proven or (n and starts[n - 1] == p):
            continue
        if p < overlap:
            left_p.append(start + p)
            left_n.append(n)
        if p >= chunk:
            right_p.append(start + p)
            right_n.append(n)
    return left_p, left_n, right_p, right_n, len(starts)


SEAM = "key string, n_chunks int, k int, lp array<int>, ln array<int>, rp array<int>, rn array<int>, n int"


def _encode_chunks(path: str, chunk: int):
    def make():
        tok = pieces.load(path)

        def step(batch: pa.RecordBatch):
            rows = {n: [] for n in ("lp", "ln", "rp", "rn", "n")}
            for part, k, overlap in zip(*(batch.column(c).to_pylist() for c in ("part", "k", "overlap"))):
                for name, v in zip(rows, seams(tok, part, k * chunk, chunk, overlap)):
                    rows[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_chunks"), batch.column("k"),
                 *(pa.array(rows[c], pa.list_(pa.int32())) for c in ("lp", "ln", "rp", "rn")),
                 pa.array(rows["n"], pa.int32())],
                ["key", "n_chunks", "k", "lp", "ln", "rp", "rn", "n"])
        return step
    return make


def _splice(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens) per document; n_tokens is null where some seam has no common position.

    A chunk counts from its splice with the left neighbour to its splice with the right
    one, so the joins below are between chunk ``k`` and ``k + 1`` of the same text only.
    """
    right = encoded.select("key", (F.col("k") - 1).alias("k"), F.col("lp").alias("next_lp"), F.col("ln").alias("next_ln"))
    at = F.array_min(F.array_intersect("rp", "next_lp"))
    n_of = lambda p, n: F.element_at(F.col(n), F.array_position(F.col(p), F.col("at")).cast("int"))
    last = F.col("k") == F.col("n_chunks") - 1
    pairs = (encoded.join(right, ["key", "k"], "left").withColumn("at", at)
             .select("key",
                     F.when(last, F.col("n")).when(F.col("at").isNotNull(), n_of("rp", "rn")).alias("upto"),
                     F.when(last, F.lit(0)).when(F.col("at").isNotNull(), n_of("next_lp", "next_ln")).alias("from_next")))
    whole = F.count("upto") == F.count(F.lit(1))
    return pairs.groupBy("key").agg(F.when(whole, F.sum(F.col("upto").cast("long") - F.col("from_next"))).alias("n_tokens"))


def resynchronised(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of the texts (key, text), by overlapping chunks."""
    done, left, most = None, texts, None
    while True:
        n = F.char_length("text")
        # a document's last chunk always reaches its end, and a wider overlap reaches over more chunks
        chunks = (left.select("key", "text", F.greatest(F.lit(1), F.ceil(n / chunk)).cast("int").alias("n_chunks"))
                  .select("key", "n_chunks", "text", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("k"))
                  .select("key", "n_chunks", "k", F.lit(overlap).alias("overlap"),
                          F.col("text").substr((F.col("k") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("part"))
                  .repartition(F.col("key"), F.col("k")))
        encoded = store(map_batches(chunks, _encode_chunks(path, chunk), SEAM), "chunks")  # read twice by the splice
        counted = store(_splice(encoded), "splice")
        good = counted.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = counted.where("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        most = most or texts.agg(F.max(F.char_length("text"))).head()[0]
        left = texts.join(failed, "key", "left_semi")
        overlap = min(overlap * 4, most)
        chunk = max(chunk, overlap)  # an overlap of the whole text leaves one chunk


def token_counts(docs: DataFrame, path: str, limit: int = 2048, huge: int = 32_768, chunk: int = 32_768,
                 overlap: int = 1_024) -> DataFrame:
    """Tokens of every text as the library at ``path`` gives them.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).
    """
    rows = text_rows(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_huge = F.char_length("text") > huge
    small = map_batches(rows.where(~is_huge), _count_small(path), "doc_id long, n_bytes long, n_tokens long")
    key = F.sha2("text", 256)
    big = rows.where(is_huge).withColumn("key", key)
    counts = resynchronised(big.select("key", "text").dropDuplicates(["key"]), path, chunk, overlap)
    joined = big.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
