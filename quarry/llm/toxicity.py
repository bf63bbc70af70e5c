"""Toxicity of whole texts (op 6): weak supervision.

1. Voters. In a bounded sample of labelled training rows, words and word stems (prefixes of
   4 to 6 letters) that occur far more often in toxic documents become lexicon voters,
   chosen greedily so that each brings documents the chosen ones do not cover; nested
   stems are left out. Pattern voters look at the hits together: two different cues, three
   hits, hits per word, and silence (no cue), which votes clean.
2. Label model. A generative model (class prior, and per voter the rates of firing given each
   class, its accuracies) is fitted by expectation-maximisation. Voters that fire together
   given the class are counted by 1 / (1 + sum of their positive correlations), estimated in
   each round, so ten forms of one cue do not count ten times.
3. Classifier. A linear model is trained on the label model's posteriors, with voter firings
   and hit statistics as features. It scores every document in one pass; an Aho-Corasick
   automaton finds the cues at word starts.

The sample holds at most ``per_class`` rows a class (drawn by a hash of the id), the
vocabulary of candidate cues at most ``max_cues``; both are parameters of the fit only.
Labels, language, source and id are no inputs of a score.

Defined cases: null or empty text has no cue and gets the score of silence; a null ``doc_id``
is never learned from, and kept; repeated rows give repeated results; labels with a null
or repeated id count as they stand; without toxic or without clean training rows every score
is the prior (0 if nothing is known); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_remainder, map_batches, store, text_rows

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
PATTERNS = ("two_cues", "three_hits", "dense", "silent")


def cues_of(text: str) -> set[str]:
    """Distinct words and, marked by a trailing ``*``, stems of longer words."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class CueFinder:
    """Counts of each cue in a text: words as a whole, stems where a longer word starts."""

    def __init__(self, cues: list[str]):
        self.n = len(cues)
        self.found = ahocorasick.Automaton()
        meanings: dict[str, list[tuple[int, bool]]] = {}
        for i, cue in enumerate(cues):
            meanings.setdefault(cue.rstrip("*"), []).append((i, cue.endswith("*")))
        for text, own in meanings.items():
            self.found.add_word(text, (len(text), own))
        if cues:
            self.found.make_automaton()

    def hits(self, text: str) -> Counter:
        out: Counter = Counter()
        if not self.n:
            return out
        low = text.lower()
        for last, (size, own) in self.found.iter(low):
            start = last - size + 1
            if start and WORD.match(low, start - 1):
                continue
            goes_on = bool(WORD.match(low, last + 1, last + 2))
            for i, stem in own:
                if stem == goes_on:
                    out[i] += 1
        return out


def features(hits: Counter, n_chars: int, n_cues: int) -> np.ndarray:
    """Firings of lexicon and pattern voters, then hit statistics."""
    x = np.zeros(n_cues + len(PATTERNS) + 2)
    x[list(hits)] = 1
    total = sum(hits.values())
    x[n_cues:n_cues + len(PATTERNS)] = (len(hits) >= 2, total >= 3, total * 600 >= max(1, n_chars), not total)
    x[-2:] = (min(total, 10) / 10, min(len(hits), 5) / 5)
    return x


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray           # voter x class (clean, toxic): probability of firing
    share: np.ndarray           # weight of each voter after correlations
    correlation: np.ndarray     # voter x voter, within classes

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return posterior(x, self.prior, self.fires, self.share)


def posterior(x: np.ndarray, prior: float, fires: np.ndarray, share: np.ndarray) -> np.ndarray:
    on = np.log(fires[:, 1] / fires[:, 0])
    off = np.log((1 - fires[:, 1]) / (1 - fires[:, 0]))
    z = np.log(prior / (1 - prior)) + x @ (share * on) + (1 - x) @ (share * off)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(x: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """EM from the rates that ``start`` (a first guess of each row's class) gives. ``prior`` is
    kept: the sample's class shares are those of the drawing, not of the corpus."""
    q = start.astype(float)
    share, correlation = np.ones(x.shape[1]), np.zeros((x.shape[1],) * 2)
    fires = np.empty((x.shape[1], 2))
    for _ in range(rounds):
        weights = np.stack([1 - q, q], 1)
        mass = weights.sum(0)
        fires = (x.T @ weights + 0.5) / (mass + 1)
        spread = np.zeros_like(correlation)
        for c in (0, 1):
            d = x - fires[:, c]
            spread += (d * weights[:, c:c + 1]).T @ d
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        correlation = spread / np.outer(scale, scale)
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + np.maximum(correlation, 0).sum(1))
        q = posterior(x, prior, fires, share)
    return LabelModel(prior, fires, share, correlation)


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, decay: float = 1e-4, rounds: int = 600) -> np.ndarray:
    """Logistic regression on soft targets by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 4 / ((x * x).sum(1).max() + 1e-9)
    weight = weight / weight.sum()
    before = w
    for r in range(rounds):
        v = w + r / (r + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        grad = x.T @ (weight * (p - target)) + decay * v
        before, w = w, v - step * grad
    return w


@dataclass
class ToxicModel:
    cues: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0
    labels: LabelModel | None = None

    def finder(self) -> CueFinder:
        return CueFinder(self.cues)

    def score(self, finder: CueFinder, text: str) -> float:
        if self.labels is None:
            return self.prior
        x = features(finder.hits(text), len(text), len(self.cues))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40))))


def choose(cues: list[str], hits: list[dict[int, int]], toxic: np.ndarray, most: int, least: int, depth: int = 4) -> list[str]:
    """Greedy cover: the cue with the most log-odds over toxic rows not yet covered ``depth``
    times; cues nested in a chosen one are left out."""
    rows_of: list[list[int]] = [[] for _ in cues]
    for row, own in enumerate(hits):
        for c in own:
            rows_of[c].append(row)
    rows = [np.array(r, np.int64) for r in rows_of]
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    t = np.array([int(toxic[r].sum()) for r in rows])
    odds = np.log(((t + 0.5) / (n1 + 1)) / ((np.array([len(r) for r in rows]) - t + 0.5) / (n0 + 1))) if cues else np.zeros(0)
    left = np.where(toxic, depth, 0)
    alive, out = np.ones(len(cues), bool), []
    while len(out) < most and alive.any():
        gain = np.array([(left[r] > 0).sum() if a else 0 for r, a in zip(rows, alive)])
        if gain.max(initial=0) < least:
            break
        value = gain * odds + 1e-6 * np.array([len(c) for c in cues])
        best = int(np.argmax(np.where(alive & (gain >= least), value, -np.inf)))
        out.append(cues[best])
        left[rows[best]] = np.maximum(0, left[rows[best]] - 1)
        stem = cues[best].rstrip("*")
        alive &= [not (c.rstrip("*").startswith(stem) or stem.startswith(c.rstrip("*"))) for c in cues]
    return out


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, held_out_mod: int) -> tuple[DataFrame, float] | None:
    """(text, toxic) of at most about ``per_class`` rows a class, and the share of toxic rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("toxic").isin(0, 1) & (id_remainder(F.col("doc_id"), held_out_mod) != 0))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    limit = F.coalesce(*(F.when(F.col("toxic") == c, F.lit(int(min(1.0, per_class / n) * (1 << 30)))) for c, n in counts.items()))
    drawn = known.where(draw < limit).limit(3 * per_class)  # bounded by the parameter, so it may be broadcast
    rows = text_rows(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")
    return store(rows, "toxic-sample"), counts.get(1, 0) / sum(counts.values())


def _count_cues(rows: DataFrame) -> DataFrame:
    """(cue, toxic rows, clean rows); added up within a batch before they are shuffled."""
    def make():
        def step(batch: pa.RecordBatch):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[toxic].update(cues_of(text))
            cues = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cues, pa.string()), *(pa.array([found[c][x] for x in cues], pa.int64()) for c in (1, 0))],
                ["cue", "n_toxic", "n_clean"])
        return step
    return map_batches(rows.select("text", "toxic"), make, "cue string, n_toxic long, n_clean long") \
        .groupBy("cue").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _hits(rows: DataFrame, cues: list[str]) -> DataFrame:
    def make():
        finder = CueFinder(cues)

        def step(batch: pa.RecordBatch):
            hits = [finder.hits(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([list(h) for h in hits], pa.list_(pa.int32())),
                 pa.array([list(h.values()) for h in hits], pa.list_(pa.int32())),
                 pa.array(list(map(len, batch.column("text").to_pylist())), pa.int64())],
                ["doc_id", "toxic", "cues", "times", "n_chars"])
        return step
    return map_batches(rows, make, "doc_id long, toxic int, cues array<int>, times array<int>, n_chars long")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 5_000, max_cues: int = 3_000, voters: int = 96,
          min_share: float = 0.01, least_odds: float = 20.0, held_out_mod: int = 5) -> ToxicModel:
    """Fit voters, label model and classifier on a bounded sample of labelled training rows."""
    drawn = _sample(docs, labels, per_class, held_out_mod)
    if drawn is None:
        return ToxicModel()
    rows, prior = drawn
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return ToxicModel(prior=prior)
    odds = (F.col("n_toxic") + 0.5) / sizes[1] / ((F.col("n_clean") + 0.5) / sizes[0])
    support = max(8, int(min_share * sizes[1]))
    top = (_count_cues(rows).where((F.col("n_toxic") >= support) & (odds >= least_odds))
           .orderBy((F.col("n_toxic") * F.log(odds)).desc(), "cue").limit(max_cues).collect())
    cues = [r["cue"] for r in top]
    found = sorted(_hits(rows, cues).collect())  # at most 3 * per_class short rows
    toxic = np.array([r["toxic"] == 1 for r in found])
    chosen = choose(cues, [dict(zip(r["cues"], r["times"])) for r in found], toxic, voters, least=support)
    number = {cues.index(c): i for i, c in enumerate(chosen)}
    x = np.array([features(Counter({number[c]: n for c, n in zip(r["cues"], r["times"]) if c in number}), r["n_chars"], len(chosen))
                  for r in found])
    votes = x[:, :len(chosen) + len(PATTERNS)]
    model = fit_label_model(votes, toxic, min(max(prior, 0.01), 0.99))
    target = model.posterior(votes)
    # rows stand for their class's share of the corpus
    weight = np.where(toxic, prior / sizes[1], (1 - prior) / sizes[0])
    return ToxicModel(chosen, fit_linear(x, target, weight), prior, model)


def score(docs: DataFrame, model: ToxicModel, held_out_mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``voters`` cues

    def make():
        own = shared.value
        finder = own.finder()

        def step(batch: pa.RecordBatch):
            scores = [own.score(finder, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
        return step
    return map_batches(text_rows(docs), make, "doc_id long, score double").select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), held_out_mod) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        own = shared.value
        finder = own.finder()

        def step(batch: pa.RecordBatch):
            keep = [own.score(finder, t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        return step
    return map_batches(docs, make, docs.schema)
