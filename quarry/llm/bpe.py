"""Byte-level BPE of whole texts and back (op 8): two-tier lookup.

Tier 1 is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary
entry as a whole gets its id by one probe. Its levels are bit arrays; a key rests on the
first level where it collides with no other key, and its number is the count of set bits
before it, so the table has one entry a key. Tier 2 merges the misses: the bytes are a
linked list, a heap holds the adjacent pairs by (rank, position), and stale pairs are
skipped when popped, which is the order of the rank-by-rank merge (leftmost first on ties).

Both work on distinct pieces (white space with the word after it, the places where the pattern
always breaks), in a bounded memo. Decoding maps the ids back to their bytes.

Defined cases: null or empty text has no ids and decodes to no bytes; a null ``doc_id`` is
kept; repeated rows give repeated results; an empty table gives an empty result; a lone
surrogate cannot occur in a Spark string; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.common import Memo, map_batches, text_rows, text_slices

#: White space (as the pattern's ``\s`` has it) and the word that follows: no match of the
#: pattern goes on from a word into white space, so each piece is matched alone.
PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")

_WORKER: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of ``x`` (uint64, wraps around)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """key -> its number 0 .. n-1 without gaps, or -1 for what is no key."""

    def __init__(self, keys: list[bytes], spread: float = 1.5):
        left = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        if len(np.unique(left)) < len(keys):
            raise ValueError("two keys are equal or have one hash")
        self.levels: list[np.ndarray] = []  # number of the key at a place, or -1
        numbered = 0
        while len(left):
            at = self._places(left, len(self.levels), size := int(len(left) * spread) + 1)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.where(alone, numbered + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            numbered += int(alone.sum())
            left = left[~alone[at]]
        number = self._numbers(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        for n, key in zip(number.tolist(), keys):
            self.keys[n] = key

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    def _numbers(self, keys: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, ranks in enumerate(self.levels):
            hit = ranks[self._places(hashes[open_], level, len(ranks))]
            found[open_] = hit
            open_ = open_[hit < 0]
        return found

    def numbers(self, keys: list[bytes]) -> list[int]:
        return [n if n >= 0 and self.keys[n] == key else -1 for n, key in zip(self._numbers(keys).tolist(), keys)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by merging adjacent parts in order of (rank, position)."""
    n = len(piece)
    end = list(range(1, n + 1))     # a part is piece[i:end[i]], the next part starts at its end
    before = list(range(-1, n))     # start of the part before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if dead[i] or (mid := end[i]) >= n or end[mid] != stop or mid >= stop:
            continue
        end[i] = stop
        dead[mid] = 1
        before[stop] = i
        if stop < n and (r := ranks.get(piece[i:end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class TwoTierBpe:
    """Encoder and decoder for a ``.tiktoken`` rank file and its pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = {b: a for a, b in self.ranks.items()}
        self.whole = PerfectHash(list(self.ranks))
        self.id_of = [self.ranks[k] for k in self.whole.keys]
        self.memo = Memo(self._encode)

    @classmethod
    def of(cls, path: str, pattern: str) -> TwoTierBpe:
        if (path, pattern) not in _WORKER:
            _WORKER[path, pattern] = cls(path, pattern)
        return _WORKER[path, pattern]

    def _encode(self, pieces: list[str]):
        for lo in range(0, len(pieces), 50_000):
            cut = [[t.encode() for t in self.pattern.findall(p)] for p in pieces[lo:lo + 50_000]]
            flat = list({t for c in cut for t in c})
            ids = {t: [self.id_of[n]] if n >= 0 else merge(t, self.ranks) for t, n in zip(flat, self.whole.numbers(flat))}
            for c in cut:
                own = [i for t in c for i in ids[t]]
                yield len(own), ",".join(map(str, own)), self.decode(own)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        tokens = [t.encode() for t in self.pattern.findall(text)]
        pairs = zip(tokens, self.whole.numbers(tokens))
        return [i for t, n in pairs for i in ([self.id_of[n]] if n >= 0 else merge(t, self.ranks))]

    def batch(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Per text: number of ids, ids joined by commas, decoded bytes."""
        cut = [PIECE.findall(t) for t in texts]
        self.memo.need({p for c in cut for p in c})
        out = []
        for c in cut:
            own = list(map(self.memo.__getitem__, c))
            out.append((sum(o[0] for o in own), ",".join([o[1] for o in own]), b"".join([o[2] for o in own])))
        return out


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (as decimal numbers joined by commas) and decoded (their bytes)."""
    def make():
        bpe = TwoTierBpe.of(path, pattern)

        def step(batch: pa.RecordBatch):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in text_slices(texts):
                _, joined, decoded = zip(*bpe.batch(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(joined, pa.string()), pa.array(decoded, pa.binary())],
                    ["doc_id", "ids", "decoded"])
        return step
    return map_batches(text_rows(docs), make, "doc_id long, ids string, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; hashed where the ids are, so they do not travel."""
    def make():
        bpe = TwoTierBpe.of(path, pattern)

        def step(batch: pa.RecordBatch):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in text_slices(texts):
                n, a, b = zip(*((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                                for n, joined, decoded in bpe.batch(texts[lo:hi])))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return step
    return map_batches(text_rows(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
