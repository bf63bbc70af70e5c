"""Labelled question generation (operators I1-I13).

All random choices are ``md5`` arithmetic on (seed, row identity), so runs repeat
and a SQL engine can reproduce them. Relationship pairs are *sampled* without ever
listing all pairs of a type: entities are Bernoulli-sampled at one common rate
(every pair then has the same inclusion probability), pairs are formed only among
the sampled entities, and the final draw orders them by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.typos import inject_typo, question_word_typo

# ---- fixed values: question templates per entity kind, and the kinds' labels
TEMPLATES = {
    "KPI": ["What is {name}?", "Define {name}.", "Explain {name}.", "What does {name} measure?"],
    "Objective": ["What is the {name} objective?", "Explain {name}.", "Define the objective {name}."],
    "BSC Family": ["What is {name}?", "Explain the {name} perspective.", "Define {name}."],
    "BSC Subfamily": ["What is {name}?", "Define {name}.", "Explain {name}."],
    "Criteria": ["What is {name}?", "Explain the {name} criteria."],
}
ENTITY_TYPE_LABEL = {"KPI": "KPI", "Objective": "Objective", "BSC Family": "BSC_Family",
                     "BSC Subfamily": "BSC_Subfamily", "Criteria": "Criteria"}
RELATION_TEMPLATES = ["What is the relation between {name1} and {name2}?",
                      "Explain the relation between {name1} and {name2}.",
                      "How are {name1} and {name2} related?"]


def hash_id(*cols) -> F.Column:
    """Deterministic 60-bit id from md5 of the joined columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols])), 1, 15),
                  16, 10).cast("long")


def _fill(template: str, **names) -> F.Column:
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(pre), names[key]]
    parts.append(F.lit(rest))
    return F.concat(*[p for p in parts])


def direct_questions(entities: DataFrame, kind: str) -> DataFrame:
    """Every template for every entity of ``kind``.
    -> entity_key, template_no, question, entity_type, entity_name, expected_document_type, category."""
    name = F.trim(F.col("name"))
    rows = F.array(*[F.struct(F.lit(i).alias("template_no"), _fill(t, name=name).alias("question"))
                     for i, t in enumerate(TEMPLATES[kind])])
    return entities.select("entity_key", name.alias("entity_name"), F.explode(rows).alias("t")).select(
        "entity_key", "t.template_no", "t.question", F.lit(ENTITY_TYPE_LABEL[kind]).alias("entity_type"),
        "entity_name", F.lit(kind).alias("expected_document_type"),
        F.lit("direct_domain_relevant").alias("category"))


def number_questions(questions: DataFrame) -> DataFrame:
    """Stable id and ``type::name`` ground truth for direct questions."""
    return questions.select(
        hash_id("entity_type", F.col("entity_key").cast("string"), F.col("template_no").cast("string")).alias(
            "question_id"),
        "question", "entity_type", "entity_name", "expected_document_type", "category",
        F.array(F.concat_ws("::", "expected_document_type", "entity_name")).alias("ground_truth_docs"))


def entity_name_typo(questions: DataFrame, seed: int = 42) -> DataFrame:
    """A typo inside the entity name, replaced in the question text."""
    typo = inject_typo(F.col("entity_name"), F.concat_ws("|", F.lit(str(seed)), F.col("question_id").cast("string")))
    return questions.withColumn("entity_name_with_typo", typo).select(
        "question_id", F.replace(F.col("question"), F.col("entity_name"), F.col("entity_name_with_typo")).alias(
            "question"),
        F.col("question").alias("original_question"), "entity_type", "entity_name", "entity_name_with_typo",
        "expected_document_type", F.lit("domain_relevant_with_typos").alias("category"),
        F.lit("entity_name_typo").alias("typo_subcategory"),
        F.concat(F.lit("'"), F.col("entity_name"), F.lit("' → '"), F.col("entity_name_with_typo"),
                 F.lit("'")).alias("typo_details"),
        "ground_truth_docs")


def question_word_typos(questions: DataFrame, seed: int = 42) -> DataFrame:
    """I8: a typo in one word before the entity name (anywhere if the entity is first
    or absent). The blank before the entity is kept."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("question_id").cast("string"))
    typo = question_word_typo(F.col("question"), F.col("entity_name"), key)
    return questions.withColumn("_typo", typo).select(
        "question_id", F.col("_typo.question").alias("question"), F.col("question").alias("original_question"), "entity_type",
        "entity_name", "expected_document_type", F.lit("domain_relevant_with_typos").alias("category"),
        F.lit("question_word_typo").alias("typo_subcategory"), F.col("_typo.details").alias("typo_details"), "ground_truth_docs")


# ---------------------------------------------------------------- I9-I12


def number_within_type(entities: DataFrame, bucket_rows: int = 50_000, n_rows: int = 0) -> DataFrame:
    """(type, ek, name, no): entities numbered from 0 within their type. Numbers are ranks within
    (type, bucket) plus the rows of the type's earlier buckets, so a large type is no single task."""
    e = entities.select("type", F.col("entity_key").cast("string").alias("ek"), "name")
    e = e.withColumn("b", F.pmod(F.xxhash64("ek"), F.lit(max(1, -(-n_rows // bucket_rows)))))
    before = Window.partitionBy("type").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = e.groupBy("type", "b").count().select("type", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("type", "b").orderBy("ek", "name")) - 1
    return e.withColumn("r", rank).join(start, ["type", "b"]).select("type", "ek", "name", (F.col("r") + F.col("start")).alias("no"))


def sample_relationship_pairs(entities: DataFrame, target_questions: int = 980, seed: int = 42) -> DataFrame:
    """``target_questions // 3`` pairs drawn uniformly, without replacement,
    from within-type pairs plus min(10, n1, n2) random cross-type pairs per type pair.

    All pairs are numbered without being listed: distinct pair numbers are drawn by hash, each
    is turned into two entity numbers, and these are joined to the numbered entities.
    ``entities``: (type, entity_key, name). Runs one small aggregate action (entity
    counts per type).
    """
    target = target_questions // 3
    counts = {r["type"]: r["n"] for r in entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    types = sorted(counts)
    # (first pair number, type 1, type 2): a range of pair numbers per type, then per pair of types
    ranges, total = [], 0
    for t in types:
        ranges.append((total, t, t))
        total += counts[t] * (counts[t] - 1) // 2
    for i, a in enumerate(types):
        for b in types[i + 1:]:
            ranges.append((total, a, b))
            total += min(10, counts[a], counts[b])
    spark = entities.sparkSession
    u = F.xxhash64(F.lit(seed), F.col("id"))
    if total <= 4 * target + 1_000:
        drawn = spark.range(total).select(F.col("id").alias("n"), u.alias("o"))
    else:  # enough draws that distinct numbers cannot run short
        drawn = spark.range(8 * target + 1_000).select(F.pmod(u, F.lit(total)).alias("n"), F.col("id").alias("o")) \
            .groupBy("n").agg(F.min("o").alias("o"))
    drawn = drawn.orderBy("o", "n").limit(target)  # the sample asked for
    at = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(a).alias("type1"), F.lit(b).alias("type2"), F.lit(counts[a]).cast("long").alias("n1"),
                            F.lit(counts[b]).cast("long").alias("n2")) for lo, a, b in ranges]) if total else F.array(F.expr("named_struct('lo', 0L, 'type1', '', 'type2', '', 'n1', 0L, 'n2', 0L)"))
    x = drawn.withColumn("at", F.element_at(F.filter(at, lambda g: g["lo"] <= F.col("n")), -1)).select("n", "o", "at.*") \
        .withColumn("k", F.col("n") - F.col("lo"))
    # pair k of a type is (i, j) with i < j and k = j (j - 1) / 2 + i; the root is corrected for rounding
    j0 = F.floor((1 + F.sqrt(1 + 8 * F.col("k").cast("double"))) / 2)
    below = lambda j: F.expr(f"{j} * ({j} - 1) div 2")
    x = x.withColumn("j0", j0).withColumn("j", F.col("j0") + F.when(below("j0") > F.col("k"), -1).when(F.expr("j0 * (j0 + 1) div 2") <= F.col("k"), 1).otherwise(0))
    same = F.col("type1") == F.col("type2")
    pick = lambda side, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "type1", "type2", "k"), F.greatest(F.col(n), F.lit(1)))
    x = x.select("type1", "type2", "o", F.when(same, F.lit(-1)).otherwise(F.col("k")).cast("int").alias("draw"),
                 F.when(same, F.col("k") - below("j")).otherwise(pick("a", "n1")).alias("no1"), F.when(same, F.col("j")).otherwise(pick("b", "n2")).alias("no2"))
    e = number_within_type(entities, n_rows=sum(counts.values()))
    side = lambda s: e.select(F.col("type").alias(f"type{s}"), F.col("no").alias(f"no{s}"), F.col("ek").alias(f"ek{s}"), F.col("name").alias(f"name{s}"))
    return x.join(side(1), ["type1", "no1"]).join(side(2), ["type2", "no2"]) \
        .select("type1", "ek1", "name1", "type2", "ek2", "name2", "draw")


def relationship_questions(pairs: DataFrame) -> DataFrame:
    """Three templates per pair; entity_name ``a::b``; gold [t1::a, t2::b]."""
    n1, n2 = F.col("name1"), F.col("name2")
    rows = F.array(*[F.struct(F.lit(i).alias("template_no"), _fill(t, name1=n1, name2=n2).alias("question"))
                     for i, t in enumerate(RELATION_TEMPLATES)])
    et = F.concat_ws("-", "type1", "type2")
    return pairs.select("*", F.explode(rows).alias("t")).select(
        hash_id(F.lit("rel"), "type1", "ek1", "type2", "ek2", F.col("draw").cast("string"),
                F.col("t.template_no").cast("string")).alias("question_id"),
        F.col("t.question").alias("question"), et.alias("entity_type"),
        F.concat_ws("::", n1, n2).alias("entity_name"), n1.alias("entity1_name"), n2.alias("entity2_name"),
        et.alias("expected_document_type"), F.lit("direct_domain_relevant_relationship").alias("category"),
        F.array(F.concat_ws("::", "type1", n1), F.concat_ws("::", "type2", n2)).alias("ground_truth_docs"))
