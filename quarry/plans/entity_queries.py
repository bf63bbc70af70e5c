"""Queries over the entity tables (part, customer, region, nation, supplier):
document assembly (A7-A13) and labelled question generation (I1-I13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.operators import generate as I
from quarry.plans import sqlgen as S
from quarry.plans.registry import register
from quarry.sources import entities as A
from quarry.sources.tables import spread

# ---------------------------------------------------------------- SQL spellings of the entity feeds

SQL_ENTITIES = {
    "KPI": """SELECT p_partkey AS entity_key, p_name AS name, '["' || p_brand || '"]' AS alternative_names,
       '[''' || p_type || ''']' AS bsc_subfamilies, 'Size ' || CAST(p_size AS VARCHAR) AS short_definition,
       'Retail price ' || CAST(p_retailprice AS VARCHAR) AS explanation FROM part""",
    "Objective": """SELECT c_custkey AS entity_key, c_name AS name, c_mktsegment AS short_definition,
       'Account balance ' || CAST(c_acctbal AS VARCHAR) AS explanation FROM customer""",
    "BSC Family": """SELECT CAST(r_regionkey AS BIGINT) AS entity_key, r_name AS name, substr(r_name, 1, 3) AS short_name,
       'Region ' || CAST(r_regionkey AS VARCHAR) AS short_definition, '' AS explanation FROM region""",
    "BSC Subfamily": """SELECT CAST(n_nationkey AS BIGINT) AS entity_key, n_name AS name, r_name AS bsc_family,
       'Nation ' || CAST(n_nationkey AS VARCHAR) AS short_definition, '' AS explanation
       FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "Criteria": """SELECT s_suppkey AS entity_key, s_name AS name,
       'Account balance ' || CAST(s_acctbal AS VARCHAR) AS explanation FROM supplier""",
}
SQL_COLUMNS = {"KPI": ["name", "alternative_names", "bsc_subfamilies", "short_definition", "explanation"],
               "Objective": ["name", "short_definition", "explanation"],
               "BSC Family": ["name", "short_name", "short_definition", "explanation"],
               "BSC Subfamily": ["name", "bsc_family", "short_definition", "explanation"],
               "Criteria": ["name", "explanation"]}


def sql_documents(kind: str) -> str:
    lines = " || chr(10) || ".join(f"'{label}: ' || {S.clean_value(col)}" for label, col in A.LAYOUTS[kind])
    content = S.strip_ws(f"({lines})")
    name = S.clean_value("name")
    return (f"SELECT '{kind}:' || CAST(entity_key AS VARCHAR) AS doc_id, '{kind}' AS type, {name} AS name, "
            f"{content} AS content, {S.doc_key(repr(kind), name, content)} AS doc_key "
            f"FROM ({SQL_ENTITIES[kind]}) e")


def sql_direct_questions(kind: str) -> str:
    rows = []
    for i, t in enumerate(I.TEMPLATES[kind]):
        pre, _, post = t.partition("{name}")
        q = f"'{pre}' || trim(name) || '{post}'"
        rows.append(f"SELECT entity_key, {i} AS template_no, {q} AS question, '{I.ENTITY_TYPE_LABEL[kind]}' AS entity_type,"
                    f" trim(name) AS entity_name, '{kind}' AS expected_document_type,"
                    f" 'direct_domain_relevant' AS category FROM ({SQL_ENTITIES[kind]}) e")
    return " UNION ALL ".join(rows)


SQL_NUMBERED = "(" + " UNION ALL ".join(
    "SELECT CAST(('0x' || substr(md5(concat_ws('|', entity_type, CAST(entity_key AS VARCHAR), "
    f"CAST(template_no AS VARCHAR))), 1, 15)) AS BIGINT) AS question_id, question, entity_type, entity_name, "
    f"expected_document_type, category FROM ({sql_direct_questions(k)}) q" for k in I.TEMPLATES) + ")"


# ---------------------------------------------------------------- A7


@register("clean_value", f"""
SELECT entity_key, {S.clean_value('alternative_names')} AS alternative_names,
       {S.clean_value('bsc_subfamilies')} AS bsc_subfamilies,
       {S.clean_value("'  \"' || name || '\"  '")} AS quoted_name
FROM ({SQL_ENTITIES['KPI']}) e""")
def q_clean_value(spark, sf):
    """A7 on list-like (JSON and not), quoted and plain fields."""
    e = A.kpi_entities(spark, sf)
    return e.select("entity_key", A.clean_value("alternative_names").alias("alternative_names"),
                    A.clean_value("bsc_subfamilies").alias("bsc_subfamilies"),
                    A.clean_value(F.concat(F.lit('  "'), F.col("name"), F.lit('"  '))).alias("quoted_name"))


# ---------------------------------------------------------------- A8-A12


def _assemble_query(kind):
    def q(spark, sf):
        fn, source = A.ENTITY_SOURCES[kind]
        return A.assemble(fn(spark, sf), kind, source).select("doc_id", "type", "name", "content", "doc_key")
    q.__doc__ = f"A8-A12: {kind} documents."
    return q


for _qname, _kind in (("assemble_kpi", "KPI"), ("assemble_objective", "Objective"),
                      ("assemble_bsc_family", "BSC Family"), ("assemble_bsc_subfamily", "BSC Subfamily"),
                      ("assemble_criteria", "Criteria")):
    register(_qname, sql_documents(_kind))(_assemble_query(_kind))


@register("union_documents", "SELECT type, count(*) AS n FROM (" +
          " UNION ALL ".join(sql_documents(k) for k in A.LAYOUTS) + ") d GROUP BY type")
def q_union_documents(spark, sf):
    """The five entity kinds unioned, counted per type."""
    return A.count_by_type(A.entity_documents(spark, sf))


# ---------------------------------------------------------------- I1-I5, I13


def _questions_query(kind):
    def q(spark, sf):
        fn, _ = A.ENTITY_SOURCES[kind]
        return I.direct_questions(fn(spark, sf), kind)
    q.__doc__ = f"I1-I5: template questions for {kind}."
    return q


for _qname, _kind in (("kpi_questions", "KPI"), ("objective_questions", "Objective"),
                      ("bsc_family_questions", "BSC Family"), ("bsc_subfamily_questions", "BSC Subfamily"),
                      ("criteria_questions", "Criteria")):
    register(_qname, sql_direct_questions(_kind))(_questions_query(_kind))


def direct_questions_all(spark, sf):
    qs = [I.direct_questions(A.ENTITY_SOURCES[k][0](spark, sf), k) for k in I.TEMPLATES]
    return I.number_questions(spread(reduce(lambda a, b: a.unionByName(b), qs)))


@register("number_questions", f"""
SELECT question_id, question, entity_type, entity_name, expected_document_type, category,
       expected_document_type || '::' || entity_name AS ground_truth_docs FROM {SQL_NUMBERED} n""")
def q_number_questions(spark, sf):
    """Every direct question with its id and ground truth."""
    return direct_questions_all(spark, sf).withColumn("ground_truth_docs",
                                                      F.array_join("ground_truth_docs", "|"))


# ---------------------------------------------------------------- I6-I8

_KEY = "concat_ws('|', '42', CAST(question_id AS VARCHAR))"


@register("entity_name_typo", f"""
WITH t AS (SELECT question_id, question, entity_name, {S.inject_typo('entity_name', _KEY)} AS typo FROM {SQL_NUMBERED} n)
SELECT question_id, replace(question, entity_name, typo) AS question, entity_name, typo AS entity_name_with_typo,
       '''' || entity_name || ''' → ''' || typo || '''' AS typo_details FROM t""")
def q_entity_name_typo(spark, sf):
    """I6 + I7: one deterministic typo inside the entity name of every direct question."""
    return I.entity_name_typo(direct_questions_all(spark, sf)).select(
        "question_id", "question", "entity_name", "entity_name_with_typo", "typo_details")


def _sql_word_typo() -> str:
    words = "list_filter(string_split_regex(substr(question, 1, st - 1), '\\s+'), lambda w: w <> '')"
    q1 = "''''"
    arrow = "' → '"
    return f"""
WITH n AS (SELECT question_id, question, entity_name, {_KEY} AS k, instr(question, entity_name) AS st
           FROM {SQL_NUMBERED} n0),
w AS (SELECT *, {words} AS words FROM n),
p AS (SELECT *, st > 1 AND len(words) > 0 AS ok, {S.pick('k', 'word', 'len(words)')} AS idx FROM w),
q AS (SELECT *, words[idx + 1] AS word, k || '|w' AS wk FROM p),
t AS (SELECT *, {S.inject_typo('word', 'wk')} AS tw, {S.inject_typo('question', 'k')} AS anywhere FROM q)
SELECT question_id,
       CASE WHEN ok THEN array_to_string(list_transform(words, lambda x, i: CASE WHEN i - 1 = idx THEN tw ELSE x END),
                                         ' ') || ' ' || substr(question, st) ELSE anywhere END AS question,
       question AS original_question,
       CASE WHEN ok THEN {q1} || word || '{arrow.replace("'", "''")}' || tw || {q1}
            ELSE 'General typo introduced' END AS typo_details
FROM t"""


@register("question_word_typo", _sql_word_typo())
def q_question_word_typo(spark, sf):
    """I8: one deterministic typo in a question word before the entity."""
    return I.question_word_typos(direct_questions_all(spark, sf)).select(
        "question_id", "question", "original_question", "typo_details")


# ---------------------------------------------------------------- I9-I12


def entity_pool(spark, sf):
    parts = [fn(spark, sf).select(F.lit(k).alias("type"), "entity_key", F.trim("name").alias("name"))
             for k, (fn, _) in A.ENTITY_SOURCES.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("relationship_questions")
def q_relationship_questions(spark, sf):
    """Pairs sampled uniformly without listing all pairs; 3 templates each."""
    pairs = I.sample_relationship_pairs(entity_pool(spark, sf), target_questions=980)
    return I.relationship_questions(pairs).withColumn("ground_truth_docs", F.array_join("ground_truth_docs", "|"))


# ---------------------------------------------------------------- A1-A5


def dirty_part_lines(spark, sf):
    """Dirty CSV lines derived from ``part``: quoted fields spanning lines, a blank
    before quotes, list-like fields, long rows and short rows."""
    from quarry.sources.tables import table
    p = table(spark, sf, "part")
    shape = F.pmod(F.col("p_partkey"), F.lit(3))
    base = F.concat(F.col("p_partkey").cast("string"), F.lit(", "), F.col("p_name"))
    full = F.concat(base, F.lit(', "[""'), F.col("p_brand"), F.lit('""]", "'), F.col("p_brand"),
                    F.lit("\n   size "), F.col("p_size").cast("string"), F.lit('"'))
    line = (F.when(shape == 0, full).when(shape == 1, F.concat(full, F.lit(", extra one, extra two")))
            .otherwise(base))
    return p.select(line.alias("value"))


@register("csv_roundtrip", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
       CASE WHEN p_partkey % 3 = 2 THEN '' ELSE '[' || p_brand || ']' END AS aliases,
       CASE p_partkey % 3 WHEN 0 THEN p_brand || ' size ' || CAST(p_size AS VARCHAR)
                          WHEN 1 THEN p_brand || ' size ' || CAST(p_size AS VARCHAR) || ', extra one, extra two'
                          ELSE '' END AS explanation
FROM part""")
def q_csv_roundtrip(spark, sf):
    """A1-A5: dirty CSV written from ``part`` (a header per file) into the shared
    checkpoint folder, read back with the dirty-CSV reader, cleaned, written as clean
    CSV (A4) by ``clean_all`` (A5) and read again."""
    import uuid

    import pandas as pd

    from quarry.session import ensure_checkpoint_dir
    from quarry.sources import csv_clean as CSV

    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-roundtrip-{uuid.uuid4().hex[:12]}"
    header = "id, name, aliases, explanation"

    def with_header(batches):
        first = True
        for b in batches:
            if first:
                b = pd.concat([pd.DataFrame({"value": [header]}), b], ignore_index=True)
                first = False
            yield b

    dirty_part_lines(spark, sf).mapInPandas(with_header, "value string").write.mode("overwrite").text(f"{run}/raw")
    status = CSV.clean_all(spark, {"part": f"{run}/raw"}, f"{run}/clean").first()
    if not status.ok:
        raise RuntimeError("csv cleaning failed")
    back = spark.read.option("header", True).option("escape", "\\").csv(status.out_path)
    # the CSV sink writes "" as an empty field, which the reader returns as null
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("id", "name", "aliases", "explanation")])
