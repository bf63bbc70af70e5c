"""Ids of texts under word_bpe_49k.json as the ``tokenizers`` library gives them, memoised by
white-space piece.

The file's normaliser and pre-tokenizer never join across white space and drop it, so the ids
of a text are the ids of its blank-separated pieces one after the other. Likewise a full stop or
comma after a letter is a pre-token of its own. The library encodes each new piece; pieces are
handed over in strings with a special token between them, which it never joins with its
neighbours.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from quarry.llm.common import Memo, quiet_tokenizers

_WORKER: dict = {}


def load(path: str):
    """The library's tokenizer with its own defaults, without truncation and padding."""
    quiet_tokenizers()
    from tokenizers import Tokenizer
    key = ("tokenizer", path)
    if key not in _WORKER:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _WORKER[key] = tok
    return _WORKER[key]


def ends_in_letter(text: str) -> bool:
    """Is the last code point a letter still when it is normalised and lower-cased? (A dotted capital I
    ends in a combining dot, which joins with the stop after it.)"""
    return text[-1:].isalpha() and (text[-1].isascii() or unicodedata.normalize("NFC", text[-1]).lower()[-1].isalpha())


def split(text: str) -> list[str]:
    """Pieces between blanks and line feeds. The tokenizer lower-cases; doing so here makes
    fewer distinct pieces. Only Latin-1 text is lower-cased, where both agree letter by letter, and
    none that may hold a special string, which is matched before lower-casing."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").split(" ")


class PieceIds:
    """Per piece its ids as little-endian unsigned 32-bit bytes. Kept between the tasks of a
    Python worker."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.between, self.between_id = min(self.special.items())
        self.memo = Memo(self._encode, capacity=5_000_000)
        self.stops = dict(zip(".,", self._library([".", ","])))

    @classmethod
    def of(cls, path: str) -> PieceIds:
        key = ("pieces", path)
        if key not in _WORKER:
            _WORKER[key] = cls(path)
        return _WORKER[key]

    def _library(self, pieces: list[str], together: int = 64) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(pieces), 16_384):
            part = pieces[lo:lo + 16_384]
            joined = [self.between.join(part[i:i + together]) for i in range(0, len(part), together)]
            for e in self.tok.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(e.ids, "<u4")
                flat, at = ids.tobytes(), 0
                for cut in (np.flatnonzero(ids == self.between_id) * 4).tolist():
                    out.append(flat[at:cut])
                    at = cut + 4
                out.append(flat[at:])
        return out

    def _encode(self, pieces: list[str]):
        memo, stops = self.memo, self.stops
        stem = {p: p[:-1] for p in pieces if p[-1:] in stops and ends_in_letter(p[:-1])}
        alone = [p for p in pieces if "<|" in p]  # may hold the special string that separates
        wanted = list({stem.get(p, p) for p in pieces}.difference(memo).difference(alone))
        ids = dict(zip(wanted, self._library(wanted)))
        ids.update((p, np.array(self.tok.encode(p, add_special_tokens=False).ids, "<u4").tobytes()) for p in alone)
        for p in pieces:
            if (s := stem.get(p)) is None or p in ids:
                yield ids[p]
            else:
                yield (ids[s] if s in ids else memo[s]) + stops[p[-1]]

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [split(t) for t in texts]
        self.memo.need(set().union(*cut))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]
