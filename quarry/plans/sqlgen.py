"""DuckDB spellings of the column expressions, for the SQL oracles only."""

from __future__ import annotations

from quarry.functions.typos import KEYBOARD_NEIGHBORS, TYPO_KINDS


def strip_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_value(x: str) -> str:
    v = f"CAST({x} AS VARCHAR)"
    body = (rf"""regexp_replace(regexp_replace(regexp_replace({v}, '^[\[\]]+|[\[\]]+$', '', 'g'), '\\\\', '', 'g'),"""
            rf""" '\\"', '"', 'g')""")
    parts = (f"list_transform(string_split({body}, ','), lambda p: regexp_replace({strip_ws('p')}, "
             f"'^[\"'']+|[\"'']+$', '', 'g'))")
    manual = f"array_to_string(list_filter({parts}, lambda p: p <> ''), ', ')"
    quoted = (f"""(({v} LIKE '"%' AND {v} LIKE '%"') OR ({v} LIKE '''%' AND {v} LIKE '%'''))""")
    unq = f"CASE WHEN {quoted} THEN {strip_ws(f'substr({v}, 2, greatest(length({v}) - 2, 0))')} ELSE {v} END"
    plain = rf"""regexp_replace(regexp_replace({unq}, '\\\\', '', 'g'), '\\"', '"', 'g')"""
    is_list = f"({v} LIKE '[%' AND {v} LIKE '%]')"
    js_ok = f"(json_valid({v}) AND json_type({v}) = 'ARRAY')"
    js = f"array_to_string(from_json({v}, '[\"VARCHAR\"]'), ', ')"
    return (f"(CASE WHEN {v} IS NULL OR {strip_ws(v)} = '' THEN '' WHEN {is_list} AND {js_ok} THEN {js} "
            f"WHEN {is_list} THEN {manual} ELSE {plain} END)")


def doc_key(t: str, n: str, c: str) -> str:
    return (f"(CASE WHEN coalesce({t}, '') <> '' AND coalesce({n}, '') <> '' THEN {t} || '::' || {n} "
            f"ELSE 'content::' || substr(sha256(coalesce({c}, '')), 1, 16) END)")


def hash60(key: str, tag: str) -> str:
    return f"CAST(('0x' || substr(md5({key} || '#{tag}'), 1, 15)) AS BIGINT)"


def pick(key: str, tag: str, n: str) -> str:
    return f"CAST({hash60(key, tag)} % greatest({n}, 1) AS INTEGER)"


def _neighbors(ch: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN [{', '.join(repr(x) for x in nb)}]" for c, nb in KEYBOARD_NEIGHBORS.items())
    return f"(CASE {ch} {cases} END)"


def typo_of_kind(s: str, kind: str, key: str) -> str:
    n = f"length({s})"
    if kind == "swap_adjacent":
        i = pick(key, "pos", f"{n} - 1")
        return (f"(substr({s}, 1, {i}) || substr({s}, {i} + 2, 1) || substr({s}, {i} + 1, 1) || "
                f"substr({s}, {i} + 3))")
    if kind == "delete_char":
        i = f"({pick(key, 'pos', f'{n} - 1')} + 1)"
        return f"(substr({s}, 1, {i}) || substr({s}, {i} + 2))"
    if kind == "duplicate_char":
        i = pick(key, "pos", n)
        return f"(substr({s}, 1, {i} + 1) || substr({s}, {i} + 1))"
    alpha = f"list_filter(range(1, {n} + 1), lambda i: regexp_matches(lower(substr({s}, i, 1)), '^[a-z]$'))"
    p = f"{alpha}[{pick(key, 'alpha', f'len({alpha})')} + 1]"
    ch = f"substr({s}, {p}, 1)"
    nb = _neighbors(f"lower({ch})")
    rep0 = f"{nb}[{pick(key, 'nb', f'len({nb})')} + 1]"
    rep = f"(CASE WHEN {ch} = upper({ch}) AND {ch} <> lower({ch}) THEN upper({rep0}) ELSE {rep0} END)"
    return (f"(CASE WHEN len({alpha}) > 0 THEN substr({s}, 1, {p} - 1) || {rep} || substr({s}, {p} + 1) "
            f"ELSE {s} END)")


def inject_typo(s: str, key: str) -> str:
    k = pick(key, "kind", str(len(TYPO_KINDS)))
    branches = " ".join(f"WHEN {k} = {i} THEN {typo_of_kind(s, kind, key)}" for i, kind in enumerate(TYPO_KINDS))
    return f"(CASE WHEN length({s}) < 2 THEN {s} ELSE (CASE {branches} END) END)"


# DuckDB's levenshtein counts UTF-8 bytes; Python and Spark count characters. The
# oracle maps the non-ASCII letters that occur in the driver's text (21 of them, all
# listed below) to unused single-byte control characters first.
NON_ASCII_LETTERS = "ßéÉÇêüÖÍÜñèÑöÈÓóçäÄíÊ"
_CONTROL = "".join(chr(c) for c in list(range(1, 9)) + list(range(14, 32)))[:len(NON_ASCII_LETTERS)]


def char_levenshtein(a: str, b: str) -> str:
    ctrl = "".join(f"\\x{ord(c):02x}" for c in _CONTROL)
    tr = lambda x: f"translate({x}, '{NON_ASCII_LETTERS}', {_ctrl_literal()})"
    return f"levenshtein({tr(a)}, {tr(b)})"


def _ctrl_literal() -> str:
    return " || ".join(f"chr({ord(c)})" for c in _CONTROL)


# ---------------------------------------------------------------- question analysis

def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_strip(x: str) -> str:
    return strip_ws(x)


def entities_sql(q: str) -> str:
    """C1 over the text column ``q``: a DuckDB list expression."""
    from quarry.operators import questions as C
    # RE2's \\b is ASCII-only; Java's and Python's count accented letters as word
    # characters. '_' is a word character in every engine and never part of a match.
    q_ascii = f"translate({q}, '{NON_ASCII_LETTERS}', '{'_' * len(NON_ASCII_LETTERS)}')"
    caps = (f"list_filter(regexp_extract_all({q_ascii}, '{C.CAPITALISED_RUN}'), "
            f"lambda m: NOT list_contains({_sql_list(C.CAPITALISED_STOP)}, lower(m)))")

    def pairs(p):
        return (f"flatten(list_transform(range(1, len(regexp_extract_all({q}, '{p}', 1)) + 1), lambda i: "
                f"[regexp_extract_all({q}, '{p}', 1)[i], regexp_extract_all({q}, '{p}', 2)[i]]))")

    def clean(e):
        return strip_ws(f"regexp_replace({strip_ws(e)}, '{C.TRAILING_CONNECTIVE}', '')")

    between = f"list_filter(list_transform({pairs(C.BETWEEN_C1)}, lambda e: {clean('e')}), lambda e: e <> '')"
    vs = (f"list_filter(list_transform({pairs(C.VS_C1)}, lambda e: {clean('e')}), "
          f"lambda e: e <> '' AND len(string_split_regex({strip_ws('e')}, '\\s+')) <= 5)")
    return f"({caps} || {between} || {vs})"


def dedup_entities_sql(all_list: str) -> str:
    from quarry.operators import questions as C
    return (f"list_filter({all_list}, lambda e, i: NOT list_contains(list_transform({all_list}[1:i - 1], "
            f"lambda x: lower(x)), lower(e)) AND NOT list_contains({_sql_list(C.NOISE_WORDS)}, lower(e)))")


# ---------------------------------------------------------------- decomposition

def _t(q: str) -> str:
    return strip_ws(f"substr({q}, 1, 6000)")


def detect_sql(q: str) -> str:
    from quarry.operators import decompose as D
    t = _t(q)
    lines = f"string_split({t}, chr(10))"
    qmarks = f"(length({t}) - length(replace({t}, '?', '')))"
    conj = f"regexp_matches({t}, '{D.CONJUNCTION_DETECT}')"
    bullets = (f"(len(list_filter({lines}, lambda ln: regexp_matches(ln, '{D.BULLET_LINE[0]}') OR "
               f"regexp_matches(ln, '{D.BULLET_LINE[1]}'))) > 0)")
    clauses = f"flatten(list_transform({lines}, lambda ln: list_transform(string_split(ln, ';'), lambda c: {strip_ws('c')})))"
    q_clauses = f"len(list_filter({clauses}, lambda c: c LIKE '%?'))"
    semi = f"len(list_filter(list_transform(string_split({t}, ';'), lambda p: {strip_ws('p')}), lambda p: p <> ''))"
    analytical = f"(len(list_filter({_sql_list(D.ANALYTICAL_KEYWORDS)}, lambda k: contains(lower({t}), k))) > 0)"
    return (f"((({qmarks} >= 2) AND NOT ({analytical} AND {qmarks} = 2)) OR {bullets} OR ({q_clauses} >= 2) OR "
            f"(({semi} >= 2) AND contains({t}, '?')) OR {conj})")


def split_sql(q: str, max_parts: int = 5) -> str:
    from quarry.operators import decompose as D
    t = _t(q)
    parts = f"string_split_regex({t}, '{D.CONJUNCTION_SPLIT}')"
    conj_splits = (f"([{strip_ws(f'{parts}[1]')}] || list_transform({parts}[2:], lambda p: CASE WHEN "
                   f"{strip_ws('p')} LIKE '%?' THEN {strip_ws('p')} ELSE {strip_ws('p')} || '?' END))")
    use_conj = f"(regexp_matches({t}, '{D.CONJUNCTION_SPLIT}') AND len({parts}) > 1)"
    q_parts = f"list_transform(list_filter(string_split({t}, '?'), lambda p: {strip_ws('p')} <> ''), lambda p: {strip_ws('p')} || '?')"
    lines = f"list_transform(string_split({t}, chr(10)), lambda ln: {strip_ws('ln')})"
    markers = " OR ".join(f"contains(ln, '{m}')" for m in D.LINE_MARKERS)
    marked = f"list_filter({lines}, lambda ln: ln <> '' AND (ln LIKE '%?' OR {markers}))"
    cleaned = (f"list_filter(list_transform({marked}, lambda ln: regexp_replace(regexp_replace(ln, '^\\s*[-•]\\s*', ''), "
               f"'^\\s*\\d+[\\.)]\\s*', '')), lambda ln: ln <> '')")
    fallback = (f"list_filter(list_transform(string_split(replace({t}, ';', chr(10)), chr(10)), lambda p: {strip_ws('p')}), "
                f"lambda p: p <> '')")
    other = f"(CASE WHEN len({q_parts}) > 1 THEN {q_parts} WHEN len({cleaned}) > 0 THEN {cleaned} ELSE {fallback} END)"
    def capped(splits):
        return (f"(CASE WHEN len({splits}) > {max_parts} THEN {splits}[1:{max_parts - 1}] || "
                f"['Additionally: ' || array_to_string({splits}[{max_parts}:], '; ')] ELSE {splits} END)")

    out = f"(CASE WHEN {use_conj} THEN {capped(conj_splits)} ELSE {capped(other)} END)"
    return f"(CASE WHEN len({out}) > 0 THEN {out} ELSE [{t}] END)"


# ---------------------------------------------------------------- anchors

def anchors_sql(text: str) -> tuple[str, str]:
    """C2 as (CTE expression for the prepared lower-cased text, list expression over
    a column named ``qc``)."""
    from quarry.operators import questions as C
    q = f"(' ' || lower({text}) || ' ')"
    for ph in C.CONTEXT_PHRASES:
        q = f"replace({q}, ' {ph} ', ' ')"

    def pairs(p):
        return (f"flatten(list_transform(range(1, len(regexp_extract_all(qc, '{p}', 1)) + 1), lambda i: "
                f"[regexp_extract_all(qc, '{p}', 1)[i], regexp_extract_all(qc, '{p}', 2)[i]]))")

    quoted = "regexp_extract_all(qc, '\"([^\"]+)\"', 1)"
    sides = f"list_transform({pairs(C.BETWEEN_C2)} || {pairs(C.VS_C2)}, lambda e: {strip_ws('e')})"
    chunks = (f"list_filter(list_transform(string_split_regex(qc, '{C.ANCHOR_SPLIT}'), lambda t: "
              f"{strip_ws(f"regexp_replace({strip_ws('t')}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")}), "
              f"lambda t: length(t) >= 2 AND length(t) <= 48)")
    normed = (f"list_transform(list_filter({quoted} || {sides} || {chunks}, lambda a: a <> ''), lambda a: "
              f"trim(regexp_replace(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))")
    res = f"list_sort(list_distinct(list_filter({normed}, lambda a: NOT list_contains({_sql_list(C.ANCHOR_BLACKLIST)}, a))))"
    return q, res
