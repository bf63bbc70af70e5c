"""Question analysis (operators C1-C9): question table in, analysed columns out.

Regex-heavy intermediate arrays are selected into their own columns before any
lambda refers to them; a lambda that mentions an outer expression re-evaluates it
for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import norm_key
from quarry.operators.text_index import stored

# ---- fixed values: entity extraction
CAPITALISED_RUN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
BETWEEN_C1 = r"(?i)between\s+(.+?)\s+and\s+(.+?)(?:\s+(?:in|when|while|for)|[?.!,;]|$)"
VS_C1 = r"(?i)\b(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\s+(?:in|when|while|for)|[?.!,;]|$)"
TRAILING_CONNECTIVE = r"(?i)\s+(in|when|while|for)$"
CAPITALISED_STOP = ["explain", "how", "what", "the", "in"]
NOISE_WORDS = ["if", "when", "where", "then", "else", "while", "for", "compare", "explain", "describe", "what",
               "how", "why", "which", "tell", "show", "define"]
# ---- fixed values: anchor extraction
CONTEXT_PHRASES = ["in the context of", "in terms of", "with respect to", "regarding", "related to",
                   "as it relates to", "from the perspective of", "in relation to", "trade-offs between",
                   "tradeoffs between", "trade-offs", "tradeoffs", "connection between", "relation between",
                   "relationship between"]
BETWEEN_C2 = r"between\s+(.+?)\s+and\s+(.+?)(?:[?.!,;]|$)"
VS_C2 = r"\b(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:[?.!,;]|$)"
ANCHOR_SPLIT = r"[,/]| and | or "
ANCHOR_BLACKLIST = ["how", "why", "what", "which", "explain", "compare", "vs", "versus", "relation", "relationship",
                    "difference", "trade", "trade offs", "tradeoffs", "cost", "quality", "context", "dataset",
                    "datasets"]
# ---- fixed values: relation profile (C8) and complexity words
RELATION_MARKERS = ["relation", "between", "trade-off", "tradeoff", "versus", " vs "]
COMPLEX_WORDS = ["how", "why", "compare", "relation", "between", "explain", "difference", "versus", "vs"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pairs(q: Column, pattern: str) -> Column:
    """Groups 1 and 2 of every match, flattened in match order."""
    g1 = F.regexp_extract_all(q, F.lit(pattern), 1)
    g2 = F.regexp_extract_all(q, F.lit(pattern), 2)
    return F.flatten(F.transform(F.arrays_zip(g1.alias("a"), g2.alias("b")), lambda z: F.array(z["a"], z["b"])))


def extract_entities(df: DataFrame, text_col: str = "question", out: str = "entities") -> DataFrame:
    """Capitalised runs, ``between X and Y``, ``X vs Y`` (each side <= 5 words);
    case-insensitive de-dup keeping the first; noise words dropped. Adds ``out``."""
    q = F.col(text_col)
    caps = F.filter(F.regexp_extract_all(q, F.lit(CAPITALISED_RUN), 0),
                    lambda m: ~F.array_contains(_lit_array(CAPITALISED_STOP), F.lower(m)))
    clean = lambda e: _strip(F.regexp_replace(_strip(e), TRAILING_CONNECTIVE, ""))
    between = F.filter(F.transform(_pairs(q, BETWEEN_C1), clean), lambda e: e != "")
    vs = F.filter(F.transform(_pairs(q, VS_C1), clean),
                  lambda e: (e != "") & (F.size(F.split(_strip(e), r"\s+")) <= 5))
    tmp = f"_{out}_all"
    df = df.withColumn(tmp, F.concat(caps, between, vs))
    allc = F.col(tmp)
    dedup = F.filter(F.transform(allc, lambda e, i: F.when(
        ~F.exists(F.slice(allc, 1, i), lambda x: F.lower(x) == F.lower(e)), e)), lambda e: e.isNotNull())
    res = F.filter(dedup, lambda e: ~F.array_contains(_lit_array(NOISE_WORDS), F.lower(e)))
    return df.withColumn(out, res).drop(tmp)


def quoted_phrases(q: Column) -> Column:
    """C4: text inside double quotes."""
    return F.regexp_extract_all(q, F.lit(r'"([^"]+)"'), 1)


def extract_anchors(df: DataFrame, text_col: str = "question", out: str = "anchors") -> DataFrame:
    """C2 (the active definition): lower-cased, context phrases removed, quoted spans,
    between / vs sides, and every ``,`` ``/`` `` and `` `` or `` chunk of 2-48 chars;
    all normalised (C5), blacklist removed; a sorted distinct array."""
    q = F.concat(F.lit(" "), F.lower(F.col(text_col)), F.lit(" "))
    for ph in CONTEXT_PHRASES:
        q = F.replace(q, F.lit(" " + ph + " "), F.lit(" "))
    tmp = f"_{out}_q"
    df = df.withColumn(tmp, q)
    qc = F.col(tmp)
    quoted = quoted_phrases(qc)
    sides = F.transform(F.concat(_pairs(qc, BETWEEN_C2), _pairs(qc, VS_C2)), _strip)
    chunks = F.transform(F.split(qc, ANCHOR_SPLIT),
                         lambda t: _strip(F.regexp_replace(_strip(t), r"[^\p{L}\p{N}_\s]", " ")))
    chunks = F.filter(chunks, lambda t: (F.length(t) >= 2) & (F.length(t) <= 48))
    cand = F.filter(F.concat(quoted, sides, chunks), lambda a: a != "")
    normed = F.transform(cand, lambda a: norm_key(a))
    res = F.array_sort(F.array_distinct(F.filter(normed, lambda a: ~F.array_contains(_lit_array(ANCHOR_BLACKLIST), a))))
    return df.withColumn(out, res).drop(tmp)


def parse_alt_names(c) -> Column:
    """List-like string -> list: outer brackets stripped, backslashes removed,
    split on ",", quotes stripped, empties dropped."""
    v = _strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    v = F.replace(F.regexp_replace(v, r"^[\[\]]+|[\[\]]+$", ""), F.lit("\\"), F.lit(""))
    parts = F.transform(F.split(v, ","), lambda p: F.regexp_replace(F.regexp_replace(_strip(p), "^'+|'+$", ""),
                                                                     '^"+|"+$', ""))
    return F.filter(parts, lambda p: p != "")


def alias_table(docs: DataFrame) -> DataFrame:
    """lower(name) -> sorted distinct aliases, over documents with aliases."""
    named = docs.select(F.lower(_strip(F.coalesce("name", F.lit("")))).alias("name_lc"),
                        F.explode(parse_alt_names("alternative_names")).alias("alias"))
    return named.where(F.col("name_lc") != "").groupBy("name_lc").agg(
        F.array_sort(F.collect_set("alias")).alias("aliases"))


def mention_terms(entity: Column, aliases: Column) -> Column:
    """C7 helper: the entity and its aliases, lower-cased."""
    return F.array_distinct(F.concat(F.array(F.lower(entity)),
                                     F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower)))


def doc_mentions(blob: Column, terms: Column) -> Column:
    """Any term (non-empty) is a substring of the lower-cased text blob."""
    return F.exists(terms, lambda t: (t != "") & blob.contains(t))


def relation_profile(q) -> Column:
    """Relation-style question."""
    ql = F.lower(F.col(q) if isinstance(q, str) else q)
    return F.exists(_lit_array(RELATION_MARKERS), lambda m: ql.contains(m))


def is_complex(q, entities) -> Column:
    """A complexity word as a substring, or more than two entities."""
    ql = F.lower(F.col(q) if isinstance(q, str) else q)
    ents = F.col(entities) if isinstance(entities, str) else entities
    return F.exists(_lit_array(COMPLEX_WORDS), lambda w: ql.contains(w)) | (F.size(ents) > 2)


# ---- fixed values: extended anchor extraction (C3, shadowed by C2 in the reference)
CAPITALISED_PHRASE = r"\b[A-Z][a-z]*(?:\s+(?:of|on|in|for|and|to|the)?\s*[A-Z]?[a-z]*)*\b"
C3_CAP_STOP = ["explain", "how", "what", "when", "where", "why", "the", "in", "of", "for", "and", "or"]
C3_BETWEEN = r"between\s+([^.?,;!]+?)\s+and\s+([^.?,;!]+?)(?:\s+(?:in|for|when|while|during)|[.?,;!]|$)"
C3_TRADEOFF = r"trade[\s-]?off?s?\s+between\s+([^.?,;!]+?)\s+and\s+([^.?,;!]+?)(?:\s|[.?,;!]|$)"
C3_VS = r"\b([^.?,;!\s]+(?:\s+[^.?,;!\s]+)*)\s+(?:vs\.?|versus)\s+([^.?,;!\s]+(?:\s+[^.?,;!\s]+)*)"
C3_OR = r"\b([^.?,;!\s]+(?:\s+[^.?,;!\s]+)*)\s+or\s+([^.?,;!\s]+(?:\s+[^.?,;!\s]+)*)"
C3_COMPARISON = ["compare", "difference", "choose", "decision", "trade-off", "versus", "between"]
C3_INDICATORS = ["quality", "cost", "value", "performance", "efficiency", "accuracy", "speed", "reliability",
                 "availability"]
C3_INDICATOR_STOP = ["the", "a", "an", "and", "or", "in", "of", "for"]
C3_BLACKLIST = ["how", "what", "when", "where", "why", "which", "who", "whom", "whose",
                "explain", "describe", "define", "tell", "show", "give", "provide",
                "analyze", "compare", "evaluate", "assess",
                "the", "a", "an", "and", "or", "but", "with", "without", "between",
                "in", "on", "at", "to", "for", "of", "from", "by", "about", "into",
                "good", "bad", "best", "worst", "better", "worse", "new", "old",
                "terms", "context", "perspective", "relation", "relationship",
                "i", "me", "my", "we", "us", "our", "you", "your",
                "vs", "versus"]
C3_DOMAIN_KEYWORDS = ["accuracy", "adaptability", "accessibility", "access cost", "data quality", "data monetization",
                      "completeness", "consistency", "precision", "reliability", "scalability", "performance",
                      "cost", "value", "efficiency", "roi", "return on investment"]
WORD = r"[\p{L}\p{N}_]"


def _grams(text: Column) -> Column:
    """Distinct character 3-grams."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)),
                                        lambda i: F.substr(text, i, F.lit(3))))


def extract_anchors_extended(df: DataFrame, text_col: str = "question", out: str = "anchors_ext",
                             known: DataFrame | None = None) -> DataFrame:
    """Quoted spans, capitalised phrases, between / trade-off / vs / (comparison)
    or sides, known entities, indicator contexts when fewer than two were found;
    normalised, blacklist and > 4-word anchors dropped, domain keywords added.
    ``known`` (name column): a one-word name must be a blank-separated word of the question, a longer
    one a substring (candidates by an equi-join on character 3-grams, then verified)."""
    q = F.col(text_col)
    ql_name, q_name = f"_{out}_ql", f"_{out}_raw"
    df = df.withColumn(ql_name, F.lower(q))
    ql = F.col(ql_name)
    quoted = F.transform(F.filter(quoted_phrases(q), lambda t: _strip(t) != ""), lambda t: F.lower(_strip(t)))
    caps = F.transform(F.filter(F.transform(F.regexp_extract_all(q, F.lit(CAPITALISED_PHRASE), 0), _strip),
                                lambda m: ~F.array_contains(_lit_array(C3_CAP_STOP), F.lower(m)) & (F.length(m) > 1)),
                       F.lower)
    between = F.transform(_pairs(ql, C3_BETWEEN), lambda e: _strip(F.regexp_replace(F.regexp_replace(
        _strip(e), r"^(the|a|an)\s+", ""), r"\s+(in|for|when|while|during|with).*$", "")))
    tradeoff = F.transform(_pairs(ql, C3_TRADEOFF), lambda e: _strip(F.regexp_replace(_strip(e), r"^(the|a|an)\s+", "")))
    vs = F.transform(_pairs(ql, C3_VS), _strip)
    comparison = F.exists(_lit_array(C3_COMPARISON), lambda k: ql.contains(k))
    ors = F.filter(F.transform(_pairs(ql, C3_OR), _strip), lambda e: (F.size(F.split(e, r"\s+")) <= 3) & F.exists(
        F.split(e, r"\s+"), lambda w: (w != "") & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))))
    ors = F.when(comparison, ors).otherwise(F.array().cast("array<string>"))
    structural = F.filter(F.concat(between, tradeoff, vs, ors), lambda e: (e != "") & (F.length(e) > 1))
    df = df.withColumn(q_name, F.array_distinct(F.concat(quoted, caps, structural)))
    if known is not None:
        # stored, so that Spark knows the size of the two small sides and does not shuffle the questions' grams
        names = stored(known.select(F.lower(F.col("name")).alias("kn")).where(_strip(F.col("kn")) != "").distinct(), "known-names")
        single = F.size(F.filter(F.split("kn", r"\s+"), lambda w: w != "")) == 1
        asked = df.select("question_id", ql_name)
        in_words = asked.select("question_id", F.explode(F.array_distinct(F.split(ql, r"\s+"))).alias("w"))
        one = in_words.join(names.where(single), F.col("w") == _strip(F.col("kn"))).select("question_id", "kn")
        # longer names are substrings: candidates share the name's rarest character gram
        longer = names.where(~single).select("kn", F.explode(_grams(F.col("kn"))).alias("gram"))
        rare = stored(longer.join(longer.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").groupBy("kn").agg(
            F.min_by("gram", F.struct("n", "gram")).alias("gram")), "known-grams")
        phrase = asked.select("question_id", ql_name, F.explode(_grams(ql)).alias("gram")).join(rare, "gram") \
            .where(F.col(ql_name).contains(F.col("kn"))).select("question_id", "kn")
        hit = one.unionByName(phrase).distinct()
        kn = hit.groupBy("question_id").agg(F.collect_set("kn").alias("_kn"))
        df = df.join(kn, "question_id", "left").withColumn(
            q_name, F.array_distinct(F.concat(F.col(q_name), F.coalesce("_kn", F.array().cast("array<string>")))))
        df = df.drop("_kn")
    ctx = []
    for ind in C3_INDICATORS:
        pat = rf"({WORD}+(?:\s+{WORD}+)?)\s+{ind}|{ind}\s+({WORD}+(?:\s+{WORD}+)?)"
        grp = F.concat(F.regexp_extract_all(ql, F.lit(pat), 1), F.regexp_extract_all(ql, F.lit(pat), 2))
        ctx.append(F.when(ql.contains(ind), grp).otherwise(F.array().cast("array<string>")))
    ctx_all = F.filter(F.transform(F.flatten(F.array(*ctx)), _strip),
                       lambda g: (F.length(g) > 1) & ~F.array_contains(_lit_array(C3_INDICATOR_STOP), g))
    raw = F.when(F.size(q_name) < 2, F.concat(F.col(q_name), ctx_all)).otherwise(F.col(q_name))
    norm = F.transform(raw, lambda a: F.regexp_replace(F.regexp_replace(_strip(F.lower(a)), r"\s+", " "),
                                                       rf"^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$", ""))
    kept = F.filter(norm, lambda a: (a != "") & ~F.array_contains(_lit_array(C3_BLACKLIST), a) &
                    (F.size(F.split(a, " ")) <= 4))
    domain = F.filter(_lit_array(C3_DOMAIN_KEYWORDS), lambda k: ql.contains(k))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.concat(kept, domain)))).drop(ql_name, q_name)
