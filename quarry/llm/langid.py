"""Language ID of code-switched text (op 7): linear-chain conditional random field.

A text is its words (runs of letters, lower-cased) in order. A word's emission score per
language is the sum of learned weights of its hashed character 1- to 4-grams with word edges
(the ones at an edge are its affixes) and of its entry in a lexicon of words seen
often in training. Learned transitions tie neighbours together. Forward-backward gives every word
its posterior; the words of a document vote with it.

Forward-backward runs over all words of a slice at once: chains are cut into blocks, each block's
transfer matrix is built in parallel, one short pass carries vectors from block to block,
and a second parallel pass gives the posteriors. It is the exact recursion whatever the
length of a text, and no Python loop goes over single words.

Fit: on the driver, on a sample bounded by ``per_lang`` documents a language and
``words_per_doc`` words a document (in evenly spaced windows). Windows of several
documents are spliced into one chain, so that language switches occur in training.

Defined cases: null text or text without a letter is ``und`` with score 0 and no words; a
null ``doc_id`` is in no fold (it is never learned from) and kept; repeated rows give
repeated results; without labelled rows every text is ``und``; an empty table gives an
empty result; equal masses go to the first language in alphabetical order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_remainder, map_batches, text_rows, text_slices

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
BLOCK = 32


def words_of(text: str) -> list[str]:
    """Runs of letters; none if the text has no letter (numerals such as ² alone)."""
    words = WORD.findall(text.lower())
    if words and not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
        return []
    return words


@dataclass
class Features:
    """Hashed n-grams of distinct words: one (feature, word) pair per n-gram, and word hashes."""
    feature: list[np.ndarray]
    word: list[np.ndarray]
    whole: np.ndarray


def featurize(words: list[str], bits: int) -> Features:
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    own = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(chars))  # characters up to the word's end
    features, belongs = [], []
    code = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[:len(chars) - n + 1] = chars[n - 1:]
        code = (code + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        if n in ORDERS:
            inside = left >= n
            features.append((code[inside] >> np.uint64(64 - bits)).astype(np.int64))
            belongs.append(own[inside])
    powers = np.cumprod(np.full(int(size.max(initial=1)), 0xD6E8FEB86659FD93, np.uint64))
    spread = chars * powers[np.arange(len(chars)) - np.repeat(first, size)]
    whole = np.add.reduceat(spread, first) if len(words) else np.zeros(0, np.uint64)
    return Features(features, belongs, whole)


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray       # hashed n-grams x languages
    lexicon: np.ndarray       # sorted word hashes
    lexical: np.ndarray       # lexicon x languages
    start: np.ndarray
    transition: np.ndarray
    bits: int

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (word, language) of distinct words."""
        f = featurize(words, self.bits)
        out = np.empty((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            column = np.ascontiguousarray(self.weights[:, j])
            out[:, j] = sum(np.bincount(w, column[x], len(words)) for x, w in zip(f.feature, f.word))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, f.whole), len(self.lexicon) - 1)
            out += np.where((self.lexicon[at] == f.whole)[:, None], self.lexical[at], 0)
        return out


def posteriors(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, transition: np.ndarray,
               pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors (N, L) of chains of ``lengths`` laid end to end, and, with ``pairs``, the
    expected number of transitions (L, L)."""
    n, m = scores.shape
    lengths = lengths[lengths > 0]
    per = -(-lengths // BLOCK)                                   # blocks of each chain
    rows, chain_first = int(per.sum()), np.cumsum(per) - per     # first block of each chain
    begin = np.cumsum(lengths) - lengths
    nth = np.arange(rows) - np.repeat(chain_first, per)
    size = np.minimum(BLOCK, np.repeat(lengths, per) - nth * BLOCK)
    place = np.repeat(begin, per) + nth * BLOCK
    step = place[:, None] + np.arange(BLOCK)
    valid = np.arange(BLOCK) < size[:, None]
    e = np.exp(scores - scores.max(1, keepdims=True))
    e = np.concatenate([e, np.ones((1, m))])[np.where(valid, step, n)]   # (rows, BLOCK, m); 1 beyond a chain
    a = np.exp(transition - transition.max())
    # rows where A_t is the identity: a chain's first word has no transition before it, and nothing is beyond its end
    stay = [chain_first if t == 0 else np.flatnonzero(size <= t) for t in range(BLOCK)]

    def move(x: np.ndarray, t: int) -> np.ndarray:
        """x A_t"""
        y = x @ a
        y[stay[t]] = x[stay[t]]
        return y

    transfer = np.broadcast_to(np.eye(m), (rows, m, m)).copy()
    for t in range(BLOCK):
        transfer = move(transfer, t) * e[:, t, None, :]
        if t % 8 == 7:
            transfer /= transfer.max((1, 2), keepdims=True)
    enter, leave = np.empty((rows, m)), np.empty((rows, m))      # before a block; after it
    order = np.argsort(-per, kind="stable")
    firsts, count = chain_first[order], per[order]
    vector = np.broadcast_to(np.exp(start - start.max()), (len(order), m)).copy()
    back = np.ones((len(order), m))
    for k in range(int(per.max(initial=0))):
        active = int(np.searchsorted(-count, -k, "left"))        # chains with a block k
        r = firsts[:active] + k
        enter[r] = vector[:active]
        vector = np.einsum("ri,rij->rj", vector[:active], transfer[r])
        vector /= vector.sum(1, keepdims=True)
        r = firsts[:active] + count[:active] - 1 - k
        leave[r] = back[:active]
        back = np.einsum("rij,rj->ri", transfer[r], back[:active])
        back /= back.sum(1, keepdims=True)
    alpha = np.empty((rows, BLOCK, m))
    x = enter
    for t in range(BLOCK):
        x = move(x, t) * e[:, t]
        x /= x.sum(1, keepdims=True)
        alpha[:, t] = x
    post, expected = np.empty((rows, BLOCK, m)), np.zeros((m, m))
    beta = leave
    for t in range(BLOCK - 1, -1, -1):
        p = alpha[:, t] * beta
        post[:, t] = p / p.sum(1, keepdims=True)
        emitted = beta * e[:, t]
        if pairs:
            before = alpha[:, t - 1] if t else enter
            pair = before[:, :, None] * a * emitted[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            pair[stay[t]] = 0
            expected += pair.sum(0)
        y = emitted @ a.T
        y[stay[t]] = (emitted if t == 0 else beta)[stay[t]]
        beta = y / y.sum(1, keepdims=True)
    return post[valid], expected


def chains(rows: list[tuple[str, str]], langs: list[str], words_per_doc: int, window: int, seed: int = 7):
    """Training chains: windows of all documents, shuffled and spliced two to four at a time."""
    rng = np.random.default_rng(seed)
    parts: list[tuple[int, list[str]]] = []
    for text, lang in rows:
        words = words_of(text)
        n = min(-(-len(words) // window), max(1, words_per_doc // window))
        for at in np.linspace(0, max(0, len(words) - window), n).astype(int) if words else ():
            parts.append((langs.index(lang), words[at:at + window]))
    rng.shuffle(parts)
    out, at = [], 0
    while at < len(parts):
        n = int(rng.integers(1, 5))
        out.append(parts[at:at + n])
        at += n
    return out


def fit(rows: list[tuple[str, str]], bits: int = 16, words_per_doc: int = 96, window: int = 24, rounds: int = 40,
        min_count: int = 8, decay: float = 1e-6) -> Crf:
    """Maximise the conditional likelihood of the labels by Adam on the whole sample."""
    langs = sorted({lang for _, lang in rows})
    m = len(langs)
    spliced = chains(rows, langs, words_per_doc, window)
    flat = [w for c in spliced for _, part in c for w in part]
    label = np.array([k for c in spliced for k, part in c for _ in part], np.int64)
    lengths = np.array([sum(len(part) for _, part in c) for c in spliced], np.int64)
    distinct = sorted(set(flat))
    index = {w: i for i, w in enumerate(distinct)}
    word = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    f = featurize(distinct, bits)
    feature, owner = (np.concatenate(x) if distinct else np.zeros(0, np.int64) for x in (f.feature, f.word))
    often = np.bincount(word, minlength=len(distinct)) >= min_count
    lexicon, slot = np.unique(f.whole[often], return_inverse=True)
    slot_of = np.flatnonzero(often)
    theta = {"w": np.zeros((1 << bits, m)), "l": np.zeros((len(lexicon), m)), "s": np.zeros(m), "t": np.zeros((m, m))}
    if m > 1:
        gold_pairs = np.ones(len(label), bool)
        gold_pairs[np.cumsum(lengths) - lengths] = False
        inner = np.flatnonzero(gold_pairs)
        gold_t = np.zeros((m, m))
        np.add.at(gold_t, (label[inner - 1], label[inner]), 1)
        first = label[np.cumsum(lengths) - lengths]
        gold_e = np.eye(m)[label]
        mean, var = ({k: np.zeros_like(v) for k, v in theta.items()} for _ in range(2))
        for r in range(1, rounds + 1):
            scores = np.stack([np.bincount(owner, theta["w"][feature, j], len(distinct)) for j in range(m)], 1)
            scores[slot_of] += theta["l"][slot]
            post, expected = posteriors(scores[word], lengths, theta["s"], theta["t"], pairs=True)
            gap = gold_e - post
            per_word = np.stack([np.bincount(word, gap[:, j], len(distinct)) for j in range(m)], 1)
            grad = {"w": np.stack([np.bincount(feature, per_word[owner, j], 1 << bits) for j in range(m)], 1),
                    "l": np.zeros_like(theta["l"]), "t": gold_t - expected,
                    "s": gold_e[np.cumsum(lengths) - lengths].sum(0) - post[np.cumsum(lengths) - lengths].sum(0)}
            np.add.at(grad["l"], slot, per_word[slot_of])
            for k, g in grad.items():
                g = g / len(first) - decay * theta[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                theta[k] += 0.15 * (mean[k] / (1 - 0.9 ** r)) / (np.sqrt(var[k] / (1 - 0.99 ** r)) + 1e-6)
    return Crf(langs, theta["w"].astype(np.float32), lexicon, theta["l"].astype(np.float32), theta["s"], theta["t"], bits)


def train(docs: DataFrame, per_lang: int = 400, held_out_mod: int = 5, **kw) -> Crf:
    """Fit on about ``per_lang`` documents a language, drawn by a hash of the id from the rows
    outside the held-out fold that have id and language (a null text has no words)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")) \
                .where((id_remainder(F.col("doc_id"), held_out_mod) != 0) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit([], **kw)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    limit = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_lang / n) * (1 << 30)))) for lang, n in counts.items()))
    rows = known.where(draw < limit).orderBy("doc_id", "lang", "text").limit(2 * per_lang * len(counts))
    return fit([(r["text"] or "", r["lang"]) for r in rows.select("text", "lang").collect()], **kw)


def masses(crf: Crf, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, their numbers, word posteriors, and posterior mass (text, language)."""
    m = len(crf.langs)
    split = [words_of(t) if m else [] for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for s in split for w in s]
    if not flat:
        return split, lengths, np.zeros((0, m)), np.zeros((len(split), m))
    distinct = list(dict.fromkeys(flat))
    index = dict(zip(distinct, range(len(distinct))))
    word = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    post, _ = posteriors(crf.emissions(distinct)[word], lengths, crf.start, crf.transition)
    doc = np.repeat(np.arange(len(split)), lengths)
    return split, lengths, post, np.stack([np.bincount(doc, post[:, j], len(split)) for j in range(m)], 1)


RUNS = "array<struct<lang:string,first_word:int,n_words:int>>"


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, n_words, mass (posterior mass per language, in the order of ``model.langs``) and
    runs (consecutive words of one most probable language)."""
    langs = pa.array(model.langs, pa.string())
    m = len(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^bits rows and a bounded lexicon

    def make():
        crf = shared.value

        def step(batch: pa.RecordBatch):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in text_slices(texts, 1_500_000):
                split, lengths, post, mass = masses(crf, texts[lo:hi])
                flat = [w for s in split for w in s]
                doc = np.repeat(np.arange(len(split)), lengths)
                best = post.argmax(1) if m else np.zeros(0, np.int64)
                new = np.ones(len(flat), bool)
                new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                runs = pa.StructArray.from_arrays(
                    [langs.take(pa.array(best[at])), pa.array((at - (np.cumsum(lengths) - lengths)[doc[at]]).astype(np.int32)),
                     pa.array(np.diff(np.append(at, len(flat))).astype(np.int32))], ["lang", "first_word", "n_words"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(split)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(lengths),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(split) + 1, dtype=np.int32) * m), pa.array(mass.ravel(), pa.float64())),
                     pa.ListArray.from_arrays(pa.array(offsets), runs)], ["doc_id", "n_words", "mass", "runs"])
        return step
    return map_batches(text_rows(docs), make, f"doc_id long, n_words long, mass array<double>, runs {RUNS}")


def predict(docs: DataFrame, model: Crf, held_out_mod: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the posterior mass)."""
    most = F.array_max("mass")
    named = F.element_at(F.array(*map(F.lit, model.langs or ["und"])), F.array_position("mass", most).cast("int"))
    has = (F.col("n_words") > 0) & F.lit(bool(model.langs))
    return label_words(docs, model).select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), held_out_mod) == 0, F.lit(False)).alias("held_out"),
        F.when(has, named).otherwise("und").alias("lang_pred"),
        F.when(has, F.least(F.lit(1.0), most / F.col("n_words"))).otherwise(0.0).alias("score"))


def accepted(docs: DataFrame, model: Crf, min_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) whose text has words and one language with at least
    ``min_score`` of the posterior mass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        crf = shared.value

        def step(batch: pa.RecordBatch):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for lo, hi in text_slices(texts, 1_500_000):
                split, lengths, _, mass = masses(crf, texts[lo:hi])
                keep = mass.max(1, initial=0) >= min_score * np.maximum(lengths, 1)
                yield batch.slice(lo, hi - lo).filter(pa.array(keep & (lengths > 0)))
        return step
    return map_batches(docs, make, docs.schema)
