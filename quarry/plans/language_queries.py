"""Spelling (D1-D10, A18) and decomposition (C10-C14) queries.

Dictionary corpus = ``documents`` text; custom terms = the distinct part names,
brands and types. Multi-questions are composed from part names and brands in six
shapes (single, two questions, conjunction, bullets, analytical, semicolons); the
shape is chosen per row, no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import decompose as C
from quarry.operators import spelling as D
from quarry.plans import sqlgen as S
from quarry.plans import entity_queries  # noqa: F401  (its oracles are used below)
from quarry.plans.registry import ORACLES, register, rounded
from quarry.session import materialize
from quarry.sources.kb import benchmark_questions
from quarry.sources.tables import spread, table

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"

SQL_TERMS = """
terms AS (SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT p_brand FROM part
                                     UNION ALL SELECT p_type FROM part)),
forms AS (SELECT DISTINCT term, CAST(CASE WHEN length(term) <= 3 THEN 100000 ELSE 1000000 END AS BIGINT) AS freq, word
          FROM terms, (SELECT unnest([term, upper(term), lower(term)]) AS word) f)
"""

SQL_DICT = "WITH " + SQL_TERMS.strip() + f""",
corpus AS (SELECT unnest({TOK.format(c='text')}) AS word FROM documents),
counts AS (SELECT word, count(*) AS freq FROM corpus GROUP BY word),
dict AS (SELECT word, max(freq) AS freq FROM (SELECT word, freq FROM counts UNION ALL SELECT word, freq FROM forms)
         GROUP BY word)
"""


def custom_terms(spark, sf):
    p = table(spark, sf, "part")
    return (p.select(F.col("p_name").alias("term")).union(p.select("p_brand")).union(p.select("p_type"))
            .distinct())


def dictionary(spark, sf):
    return materialize(D.build_dictionary(table(spark, sf, "documents"), "text", custom_terms(spark, sf)))


# ---------------------------------------------------------------- A18, D1, D10


@register("load_terms", "WITH " + SQL_TERMS.strip() + " SELECT word, freq, term FROM forms")
def q_load_terms(spark, sf):
    """Custom terms in three case forms with their frequencies."""
    return D.term_forms(custom_terms(spark, sf)).select("word", "freq", "term").distinct()


@register("build_dictionary", SQL_DICT + " SELECT word, freq FROM dict")
def q_build_dictionary(spark, sf):
    """Corpus token counts merged with custom terms."""
    return dictionary(spark, sf)


@register("add_terms", SQL_DICT + """,
extra AS (SELECT DISTINCT unnest([s_name, upper(s_name), lower(s_name)]) AS word, CAST(1000000 AS BIGINT) AS freq
          FROM supplier)
SELECT word, max(freq) AS freq FROM (SELECT * FROM dict UNION ALL SELECT * FROM extra) GROUP BY word""")
def q_add_terms(spark, sf):
    """Supplier names added as domain terms."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("term"))
    return D.add_terms(dictionary(spark, sf), s)


# ---------------------------------------------------------------- D2, D3


_PROT_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(D.PROTECTED_WORDS)) + "]"


@register("protected_words", f"""
WITH w AS (SELECT item_id AS question_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word
           FROM benchmark)
SELECT question_id, word, count(*) AS n, list_contains({_PROT_SQL}, lower(word)) AS protected
FROM w GROUP BY question_id, word""")
def q_protected_words(spark, sf):
    """Protected-word flags of the benchmark words."""
    w = D.split_words(benchmark_questions(spark, sf)).select("question_id", "word")
    return w.groupBy("question_id", "word").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "protected", D.is_protected(F.col("word")))


@register("edit_distance", """
SELECT p_partkey, c_custkey, levenshtein(p_name, c_mktsegment) AS distance, levenshtein(p_name, p_type) AS type_distance
FROM part LEFT JOIN customer ON p_partkey = c_custkey""")
def q_edit_distance(spark, sf):
    """D3: Levenshtein distance of paired strings: the name of every part and the segment of the customer of the
    same key (null where there is none), and the part's name and type."""
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    return p.join(c, p.p_partkey == c.c_custkey, "left").select(
        "p_partkey", "c_custkey", F.levenshtein("p_name", "c_mktsegment").alias("distance"),
        F.levenshtein("p_name", "p_type").alias("type_distance"))


# ---------------------------------------------------------------- D4, D5

SQL_OOV = SQL_DICT + f""",
w AS (SELECT DISTINCT CASE WHEN right(word, 1) IN ('.', ',', '!', '?', ';', ':') THEN left(word, length(word) - 1)
                           ELSE word END AS token
      FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word FROM benchmark)),
oov AS (SELECT token FROM w WHERE token <> '' AND NOT list_contains({_PROT_SQL}, lower(token))
        AND token NOT IN (SELECT word FROM dict))
"""


def benchmark_oov(spark, sf, d=None):
    w = D.split_words(benchmark_questions(spark, sf)).select("token").distinct()
    d = d if d is not None else dictionary(spark, sf)
    return (w.where((F.col("token") != "") & ~D.is_protected(F.col("token")))
            .join(d.select(F.col("word").alias("token")), "token", "left_anti"))


# Distances with swaps: the unrestricted one bounds the restricted one from below, which is then built row by row.
SQL_NEAR = """,
near AS (SELECT token, word, freq, length(token) AS la, length(word) AS lb FROM oov, dict
         WHERE abs(length(token) - length(word)) <= 3 AND """ + S.char_levenshtein("token", "word").replace("levenshtein(", "damerau_levenshtein(") + """ <= 3),
dp AS (SELECT token, word, freq, la, lb, 0 AS i, range(0, lb + 1) AS last, range(0, lb + 1) AS before FROM near
       UNION ALL
       SELECT token, word, freq, la, lb, i + 1, list_transform(range(0, lb + 1), lambda j: j + list_min(
                  list_transform(range(0, j + 1), lambda k: down[k + 1] - k))), last
       FROM (SELECT *, list_transform(range(0, lb + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(
                 last[j + 1] + 1, last[j] + CASE WHEN substr(token, i + 1, 1) = substr(word, j, 1) THEN 0 ELSE 1 END,
                 CASE WHEN i > 0 AND j > 1 AND substr(token, i + 1, 1) = substr(word, j - 1, 1)
                           AND substr(token, i, 1) = substr(word, j, 1) THEN before[j - 1] + 1 ELSE 1000 END) END) AS down
             FROM dp WHERE i < la)),
c AS (SELECT token, word, freq, CAST(last[lb + 1] AS INTEGER) AS distance FROM dp WHERE i = la AND last[lb + 1] <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, freq DESC, word) AS rn FROM c)
"""


@register("closest_word", SQL_OOV.replace("WITH ", "WITH RECURSIVE ", 1) + SQL_NEAR
          + " SELECT token, word AS best, distance, freq AS best_freq FROM r WHERE rn = 1")
def q_closest_word(spark, sf):
    """Nearest dictionary word of every out-of-dictionary benchmark word, a swap being one edit
    (symmetric-delete joins in rounds; the oracle is a brute-force scan)."""
    d = dictionary(spark, sf)
    return D.closest_words(benchmark_oov(spark, sf, d), d)


@register("word_splits", SQL_DICT + f""",
b AS (SELECT {TOK.format(c='text')} AS l FROM benchmark),
two AS (SELECT DISTINCT unnest(list_transform(range(1, len(l)), lambda i: {{'a': l[i], 'b': l[i + 1]}})) AS w FROM b),
lost AS (SELECT DISTINCT w.a || w.b AS token FROM two WHERE w.a IN (SELECT word FROM dict) AND w.b IN (SELECT word FROM dict)
         AND w.a || w.b NOT IN (SELECT word FROM dict) AND length(w.a || w.b) <= {D.SPLIT_CHARS}),
p AS (SELECT token, x.word || ' ' || y.word AS split, round(round(-ln(x.freq), 9) - ln(y.freq), 9) AS cost
      FROM (SELECT token, unnest(range(1, length(token))) AS i FROM lost)
      JOIN dict x ON x.word = left(token, i) JOIN dict y ON y.word = substr(token, i + 1))
SELECT token, split, 2 AS parts FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY cost, split) AS rn FROM p)
WHERE rn = 1""")
def q_word_splits(spark, sf):
    """Neighbouring known words of the benchmark items written without their blank, split again."""
    d = dictionary(spark, sf)
    words = F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)")
    pairs = table(spark, sf, "benchmark").select(words.alias("l")).select(F.explode(F.transform(
        F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))),
        lambda x, i: F.struct(F.get("l", i).alias("a"), x.alias("b")))).alias("w")).select("w.a", "w.b").distinct()
    known = d.select("word")
    lost = pairs.join(known.withColumnRenamed("word", "a"), "a").join(known.withColumnRenamed("word", "b"), "b")
    lost = lost.select(F.concat("a", "b").alias("token")).distinct().join(known.withColumnRenamed("word", "token"), "token", "left_anti")
    return D.word_splits(lost, d)


@register("match_custom_terms", SQL_OOV + """,
tf AS (SELECT word AS cterm, min(CASE WHEN word = term THEN 0 ELSE 1 END) AS form FROM forms GROUP BY word),
c AS (SELECT token, cterm, form, CASE WHEN upper(token) = upper(cterm) THEN 0 ELSE 1 END AS d FROM oov, tf
      WHERE upper(token) = upper(cterm) OR (length(cterm) >= 4 AND """ + S.char_levenshtein("upper(token)", "upper(cterm)") + """ = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, form, cterm) AS rn FROM c)
SELECT token, cterm AS custom, d AS custom_distance FROM r WHERE rn = 1""")
def q_match_custom_terms(spark, sf):
    """Custom-term matches (case-insensitive equal, or one edit from a term of 4+ chars)."""
    return D.match_custom_terms(benchmark_oov(spark, sf), custom_terms(spark, sf))


def typo_names(spark, sf):
    from quarry.operators import generate as I
    from quarry.plans.entity_queries import direct_questions_all
    return materialize(I.entity_name_typo(direct_questions_all(spark, sf)).select("entity_name", "entity_name_with_typo"))


def _words(names, col):
    return names.select(F.explode(F.split(col, r"\s+")).alias("w")).where("w <> ''").distinct()


@register("match_typo_terms", f"""
WITH names AS ({ORACLES["entity_name_typo"]}),
terms AS (SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(entity_name, '\\s+')) AS term FROM names) WHERE term <> ''),
tok AS (SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(entity_name_with_typo, '\\s+')) AS token FROM names)
        WHERE token <> ''),
forms AS (SELECT word AS cterm, min(CASE WHEN word = term THEN 0 ELSE 1 END) AS form
          FROM (SELECT term, unnest([term, upper(term), lower(term)]) AS word FROM terms) GROUP BY word),
c AS (SELECT token, cterm, form, CASE WHEN upper(token) = upper(cterm) THEN 0 ELSE 1 END AS d FROM tok, forms
      WHERE abs(length(token) - length(cterm)) <= 1 AND (upper(token) = upper(cterm) OR (length(cterm) >= 4 AND """
          + S.char_levenshtein("upper(token)", "upper(cterm)") + """ = 1))),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, form, cterm) AS rn FROM c)
SELECT token, cterm AS custom, d AS custom_distance FROM r WHERE rn = 1""")
def q_match_typo_terms(spark, sf):
    """Words of the entity names with a typo against the words of the names as custom terms."""
    names = typo_names(spark, sf)
    return D.match_custom_terms(_words(names, "entity_name_with_typo").withColumnRenamed("w", "token"),
                                _words(names, "entity_name").withColumnRenamed("w", "term"))


# ---------------------------------------------------------------- D6-D9


def typo_questions(spark, sf):
    from quarry.operators import generate as I
    from quarry.plans.entity_queries import direct_questions_all
    # a generated question set is an input: written once, not made again for every step that reads it
    return materialize(I.entity_name_typo(direct_questions_all(spark, sf)).select("question_id", "question"))


@register("correct_words")
def q_correct_words(spark, sf):
    """Word-level correction of the entity-name typo questions."""
    return rounded(D.correct_words(typo_questions(spark, sf), dictionary(spark, sf), custom_terms(spark, sf)))


@register("correct_compound")
def q_correct_compound(spark, sf):
    """Whole-query correction (merge / nearest word) of the typo questions."""
    return D.correct_compound(typo_questions(spark, sf), dictionary(spark, sf))


@register("spell_correct")
def q_spell_correct(spark, sf):
    """D8 + D9: corrected query, variants, confidence, needs_correction."""
    return rounded(D.spell_correct(typo_questions(spark, sf), dictionary(spark, sf), custom_terms(spark, sf)))


# ---------------------------------------------------------------- C10-C14


def multi_questions(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"))
    n, b = F.col("p_name"), F.col("p_brand")
    shape = F.pmod(F.col("p_partkey"), F.lit(6))
    q = (F.when(shape == 0, F.concat(F.lit("What is "), n, F.lit("?")))
         .when(shape == 1, F.concat(F.lit("What is "), n, F.lit("? What does "), n, F.lit(" measure?")))
         .when(shape == 2, F.concat(F.lit("What is "), n, F.lit("? And how is "), b, F.lit(" related to it")))
         .when(shape == 3, F.concat(F.lit("- What is "), n, F.lit("\n- Explain "), b))
         .when(shape == 4, F.concat(F.lit("Compare "), n, F.lit(" versus "), b, F.lit("? Which is larger?")))
         .otherwise(F.concat(F.lit("What is "), n, F.lit("; define "), b, F.lit("; explain "), n, F.lit("?"))))
    return p.select(F.col("p_partkey").alias("question_id"), q.alias("question"))


SQL_MQ = """
mq AS (SELECT p_partkey AS question_id, CASE p_partkey % 6
    WHEN 0 THEN 'What is ' || p_name || '?'
    WHEN 1 THEN 'What is ' || p_name || '? What does ' || p_name || ' measure?'
    WHEN 2 THEN 'What is ' || p_name || '? And how is ' || p_brand || ' related to it'
    WHEN 3 THEN '- What is ' || p_name || chr(10) || '- Explain ' || p_brand
    WHEN 4 THEN 'Compare ' || p_name || ' versus ' || p_brand || '? Which is larger?'
    ELSE 'What is ' || p_name || '; define ' || p_brand || '; explain ' || p_name || '?' END AS question FROM part)
"""
SQL_MQ_SPLIT = "WITH " + SQL_MQ.strip() + f""",
sp AS (SELECT question_id, question, {S.detect_sql('question')} AS multi, {S.split_sql('question')} AS parts FROM mq),
dc AS (SELECT question_id, CASE WHEN multi THEN 'multi' ELSE 'single' END AS mode,
              CASE WHEN multi THEN parts[1:3] ELSE [question] END AS subs,
              coalesce(multi AND (len(parts) > 3 OR length(question) > 6000), false) AS truncated FROM sp)
"""


@register("detect_multi_question", SQL_MQ_SPLIT + " SELECT question_id, multi FROM sp")
def q_detect_multi_question(spark, sf):
    """Multi-question flag."""
    return multi_questions(spark, sf).select("question_id", C.detect_multi_question(F.col("question")).alias("multi"))


@register("split_questions", SQL_MQ_SPLIT + """
SELECT question_id, CAST(unnest(generate_series(0, len(parts) - 1)) AS INTEGER) AS part_no, unnest(parts) AS part
FROM sp""")
def q_split_questions(spark, sf):
    """C11: candidate splits (max_parts 5)."""
    return multi_questions(spark, sf).select("question_id", F.posexplode(
        C.split_questions(F.col("question"), 5)).alias("part_no", "part"))


def _sql_parse_json() -> str:
    st = S.strip_ws
    r = st("coalesce(resp, '')")
    body = st(f"""(CASE WHEN contains(lower({r}), '```json') AND regexp_matches({r}, '(?is)```json.*?```')
                       THEN regexp_extract({r}, '(?is)```json(.*?)```', 1)
                       WHEN contains({r}, '```') AND regexp_matches({r}, '(?s)```.*?```')
                       THEN regexp_extract({r}, '(?s)```(.*?)```', 1) ELSE {r} END)""")
    subs = "from_json(json_extract(body, '$.sub_questions'), '[\"VARCHAR\"]')"
    clean = (f"list_transform(list_filter(coalesce({subs}, [])[1:5], lambda q: q IS NOT NULL AND {st('q')} <> ''), "
             f"lambda q: substr({st('q')}, 1, 200))")
    fallback = f"(CASE WHEN {S.detect_sql('question')} THEN {S.split_sql('question')} ELSE [{S._t('question')}] END)"
    return "WITH " + SQL_MQ.strip() + f""",
rs AS (SELECT question_id, question, CASE question_id % 3
          WHEN 0 THEN '```json' || chr(10) || to_json({{'sub_questions': {S.split_sql('question')}}}) || chr(10) || '```'
          WHEN 1 THEN CAST(to_json({{'sub_questions': {S.split_sql('question')}}}) AS VARCHAR)
          ELSE question END AS resp FROM mq),
bd AS (SELECT question_id, question, {body} AS body FROM rs),
ps AS (SELECT question_id, question, body, json_valid(body) AND body LIKE '{{%' AS ok FROM bd),
out AS (SELECT question_id, CASE WHEN ok AND len({clean}) > 0 THEN {clean} WHEN ok THEN [question]
                                 ELSE {fallback} END AS subs FROM ps)
SELECT question_id, CAST(unnest(generate_series(0, len(subs) - 1)) AS INTEGER) AS sub_no, unnest(subs) AS sub_question
FROM out"""


@register("parse_subquestion_json", _sql_parse_json())
def q_parse_subquestion_json(spark, sf):
    """Responses in three forms (fenced JSON, bare JSON, plain text) parsed."""
    m = multi_questions(spark, sf)
    js = F.to_json(F.struct(C.split_questions(F.col("question"), 5).alias("sub_questions")))
    form = F.pmod(F.col("question_id"), F.lit(3))
    resp = F.when(form == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(form == 1, js).otherwise(
        F.col("question"))
    return m.select("question_id", F.posexplode(C.parse_subquestion_json(resp, F.col("question"))).alias(
        "sub_no", "sub_question"))


@register("decompose", SQL_MQ_SPLIT + """
SELECT question_id, mode, truncated, CAST(unnest(generate_series(0, len(subs) - 1)) AS INTEGER) AS sub_no,
       unnest(subs) AS sub_question FROM dc""")
def q_decompose(spark, sf):
    """Sub-questions (at most 3) with the mode flag."""
    return C.decompose(multi_questions(spark, sf))


@register("decomposition_report", SQL_MQ_SPLIT + """
SELECT question_id, mode, sub_no, substr(sub_question, 1, 80) AS preview FROM (
  SELECT question_id, mode, CAST(unnest(generate_series(0, len(subs) - 1)) AS INTEGER) AS sub_no,
         unnest(subs) AS sub_question FROM dc)""")
def q_decomposition_report(spark, sf):
    """C14: 80-character previews per sub-question."""
    return C.decomposition_report(C.decompose(multi_questions(spark, sf)))
