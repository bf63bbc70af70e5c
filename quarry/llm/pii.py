"""Personal data in whole texts (op 4): anchor expansion.

One Aho-Corasick pass over the text with A-Z folded finds the anchors: at-signs, plus signs, digits,
colons, ``://``, spelled-out dots and identifier cues. A deterministic local parser expands each anchor to its boundaries and
validates it. Nothing else of a text is looked at by Python.

Base kinds are the leftmost non-overlapping matches of fixed patterns, then validated, with
no retry inside a match that fails:

* email: the local part is the run of its characters before the at-sign that no earlier
  match has taken (an at-sign is none of them, so the run is what the pattern starts with);
* ip: tried where a run of digits starts (inside a run it fails as at its start); parts <= 255;
* card: 16 to 19 digits with single blanks or hyphens, Luhn;
* phone: from a plus sign, 8 to 15 digits.

The method adds: ``url`` (``scheme://user:password@host``: an address that holds a login),
``iban`` (mod-97 check), ``account`` (6 to 17 digits after an account cue), ``secret`` (the value
assigned with ``=`` or ``:`` to a token, key, secret or password: 8 characters or more, with a digit and a letter;
and access keys and signed tokens of published formats), ``ipv6`` (a valid address of three groups or more)
and ``spelled`` (``name at host dot tld``, also in brackets). Base spans stay.

Defined cases: null or empty text has no spans; a null ``doc_id`` is kept; repeated rows
give repeated results; an empty table gives an empty result; other columns are kept by
``mask`` and ignored by ``find``.
"""

from __future__ import annotations

import ipaddress
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, text_rows

# fixed values: the base patterns, each tried at its anchors only
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"

LOGIN = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"\s?(?:no|nr|number)?[\s.:#=]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)

#: what may stand between a cue and its value: the rest of the name, a closing quote, the sign, an opening quote
ASSIGNED = re.compile(r"(?:[_-]?(?:key|token|secret|id|value))?[\"']?[ \t]{0,4}(?::=|=>|[=:])[ \t]{0,4}(?:bearer[ \t]+)?[\"'`]?"
                      r"([^\s\"'`,;<>(){}\[\]]{8,})", re.I)
#: published formats, each from its fixed beginning on
FORMATS = {"akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
           "eyj": re.compile(r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}")}
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "api key",
               "access_key", "access-key", "private_key", "private-key", "credential")
HEX_OR_COLON = frozenset("0123456789abcdefABCDEF:")
AT = re.compile(r"(?:[ \t]+at[ \t]+|[ \t]?[\[(]at[\])][ \t]?)\Z", re.I)
DOT = r"(?:[ \t]+dot[ \t]+|[ \t]?[\[(]dot[\])][ \t]?)"
DOT_BEFORE = re.compile(DOT + r"\Z", re.I)
ENDINGS = re.compile(rf"(?:(?:\.|{DOT})[A-Za-z0-9-]+)+", re.I)
NAME_WIDTH, HOST_WIDTH, SIGN_WIDTH = 64, 253, 8  # longest local part and host of an address; a spelled sign with its blanks

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret", "ipv6", "spelled")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = {"@": "at", "+": "plus", ":": "colon", "://": "scheme", "iban": "iban"} | dict.fromkeys(DIGITS, "digit")
    anchors |= dict.fromkeys(("account", "acct", "konto"), "account") | dict.fromkeys(SECRET_CUES, "secret")
    anchors |= dict.fromkeys((" dot ", "[dot]", "(dot)", "\tdot\t"), "dot") | {f: f for f in FORMATS}
    for text, kind in anchors.items():
        found.add_word(text, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def folded(text: str) -> str:
    """A-Z in lower case; every code point keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def secret_valid(value: str) -> bool:
    """Not a word and not a number: letters and digits, and no address or path."""
    return (any(c in DIGITS for c in value) and any(c.isalpha() for c in value)
            and "://" not in value and not value.startswith(("/", "./", "www.")))


def ipv6_valid(text: str) -> bool:
    if sum(bool(g) for g in text.split(":")) < 3:
        return False
    try:
        return ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


class Finder:
    """All spans (kind, start, end) of a text by one pass over its anchors."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
        over = dict.fromkeys(KINDS, 0)  # end of the last match, valid or not
        last_digit = -2

        def take(kind: str, start: int, end: int, valid: bool) -> None:
            over[kind] = end
            if valid:
                out[kind].append((kind, start, end))

        for last, kind in self.anchors.iter(folded(text)):
            if kind == "digit":
                run_starts, last_digit = last_digit != last - 1, last
                if last >= over["card"] and (m := CARD.match(text, last)):
                    digits = only_digits(m[0])
                    take("card", last, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
                if run_starts and (m := IP.match(text, last)) and last >= over["ip"]:
                    take("ip", last, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
            elif kind == "at":
                start = last
                while start > over["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last + 1)):
                    take("email", start, m.end(), True)
            elif kind == "plus":
                if m := PHONE.match(text, last):
                    take("phone", last, m.end(), 8 <= len(only_digits(m[0])) <= 15)
            elif kind == "colon":
                if last >= over["ipv6"]:
                    start, end = last, self._hex_end(text, last + 1)
                    while start > max(over["ipv6"], last - 5) and text[start - 1] in HEX_OR_COLON:
                        start -= 1
                    stop = end - (text[end - 1] == ":" and text[end - 2:end] != "::")
                    apart = not (start and (text[start - 1].isalnum() or text[start - 1] in "_.")) and \
                        not (end < len(text) and (text[end].isalnum() or text[end] == "_"))
                    take("ipv6", start, stop, apart and stop - start <= 39 and ipv6_valid(text[start:stop]))
                    over["ipv6"] = end  # one try for each run
            elif kind == "scheme":
                if (s := SCHEME.search(text[max(0, last - 22):last - 2])) and (m := LOGIN.match(text, last + 1)):
                    take("url", last - 2 - len(s[0]), m.end(), True)
            elif kind == "iban":
                if m := IBAN.match(text, last + 1):
                    take("iban", m.start(1), m.end(1), iban_valid(m[1]))
            elif kind == "account":
                if m := ACCOUNT.match(text, last + 1):
                    take("account", m.start(1), m.end(1), True)
            elif kind == "secret":
                if last >= over["secret"] and (m := ASSIGNED.match(text, last + 1)):
                    end = m.start(1) + len(m[1].rstrip(".!?:"))
                    take("secret", m.start(1), end, end - m.start(1) >= 8 and secret_valid(text[m.start(1):end]))
            elif kind == "dot":
                at = last - 4  # an anchor has five characters
                if text[at] != " " and at and text[at - 1] in " \t":
                    at -= 1
                if at >= over["spelled"] and (start := self._name_start(text, at, over["spelled"])) < at and (m := ENDINGS.match(text, at)):
                    take("spelled", start, m.end(), True)
            else:
                start = last + 1 - len(kind)
                if start >= over["secret"] and (start == 0 or not text[start - 1].isalnum()) and (m := FORMATS[kind].match(text, start)):
                    take("secret", start, m.end(), True)
        return [s for k in KINDS for s in out[k]]


    @staticmethod
    def _hex_end(text: str, at: int) -> int:
        while at < len(text) and text[at] in HEX_OR_COLON:
            at += 1
        return at

    @staticmethod
    def _back(text: str, at: int, low: int) -> int:
        while at > low and text[at - 1] in LOCAL:
            at -= 1
        return at

    def _name_start(self, text: str, at: int, low: int) -> int:
        """Where the name of ``name at host`` before ``at`` starts; ``at`` if there is none."""
        host = self._back(text, at, max(low, at - HOST_WIDTH))
        if host == at or not (m := AT.search(text[max(low, host - SIGN_WIDTH):host])):
            return at
        end = host - len(m[0])
        least = max(low, end - NAME_WIDTH)
        start = self._back(text, end, least)
        if start == end:
            return at
        while m := DOT_BEFORE.search(text[max(least, start - SIGN_WIDTH):start]):
            more = self._back(text, start - len(m[0]), least)
            if more == start - len(m[0]):
                break
            start = more
        return start


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans joined where they overlap, in order; a joined span has the kind of its first."""
    out: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if out and start < out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end])
    return [tuple(s) for s in out]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, start, end in merged(spans):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: kind, start and end (code points, end exclusive), by kind, then start."""
    def make():
        finder = Finder()

        def step(batch: pa.RecordBatch):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in finder.spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN)], ["doc_id", "spans"])
        return step
    return map_batches(text_rows(docs), make, f"doc_id long, spans {SPANS}")


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by ``[KIND]``; null text stays null."""
    at = docs.columns.index("text")

    def make():
        finder = Finder()

        def step(batch: pa.RecordBatch):
            clean = [None if t is None else masked(t, s) if (s := finder.spans(t)) else t
                     for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(clean, pa.string()))
        return step
    return map_batches(docs, make, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, base_sha256, spans as text and the number of all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
