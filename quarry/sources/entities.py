"""Entity tables and their documents (operators A6-A13).

The five entity kinds keep the reference's document layouts. On the driver data
they are fed by: KPI <- part, Objective <- customer, BSC Family <- region,
BSC Subfamily <- nation (+ its region as family), Criteria <- supplier.
Every field goes through ``clean_value`` (A7) before it is written into the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import doc_key
from quarry.sources.tables import table

# ---- fixed values: document layouts (type, [(label, column)])
LAYOUTS = {
    "KPI": [("KPI Name", "name"), ("Alternative Names", "alternative_names"), ("BSC Subfamily", "bsc_subfamilies"),
            ("Short Definition", "short_definition"), ("Explanation", "explanation")],
    "Objective": [("Objective Name", "name"), ("Short Definition", "short_definition"), ("Explanation", "explanation")],
    "BSC Family": [("BSC Family Name", "name"), ("Short Name", "short_name"), ("Short Definition", "short_definition"),
                   ("Explanation", "explanation")],
    "BSC Subfamily": [("BSC Subfamily Name", "name"), ("BSC Family", "bsc_family"),
                      ("Short Definition", "short_definition"), ("Explanation", "explanation")],
    "Criteria": [("Criteria Name", "name"), ("Explanation", "explanation")],
}
# ---- fixed values: file-name markers for table types, in match order
TYPE_MARKERS = [("KPI", "KPI"), ("Objective", "Objective"), ("BSC_families", "BSC Family"),
                ("BSC_subfamilies", "BSC Subfamily"), ("Criteria", "Criteria")]


def strip_ws(c) -> F.Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_value(c) -> F.Column:
    """Null -> ""; JSON list -> items joined by ", "; a list that is not JSON ->
    brackets stripped, backslashes dropped, split on "," and quote-stripped; one pair
    of outer quotes removed; escaped quotes unescaped."""
    v = F.col(c) if isinstance(c, str) else c
    v = v.cast("string")
    js = F.try_from_json(v, "array<string>") if hasattr(F, "try_from_json") else F.from_json(v, "array<string>")
    is_list = v.startswith("[") & v.endswith("]")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"^[\[\]]+|[\[\]]+$", ""), r"\\\\", ""), r'\\"', '"')
    parts = F.transform(F.split(body, ","), lambda p: F.regexp_replace(strip_ws(p), "^[\"']+|[\"']+$", ""))
    manual = F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    quoted = (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
    unq = F.when(quoted, strip_ws(F.substring(v, 2, F.greatest(F.length(v) - 2, F.lit(0))))).otherwise(v)
    plain = F.regexp_replace(F.regexp_replace(unq, r"\\\\", ""), r'\\"', '"')
    return (F.when(v.isNull() | (strip_ws(v) == ""), F.lit(""))
            .when(is_list & js.isNotNull(), F.array_join(js, ", "))
            .when(is_list, manual)
            .otherwise(plain))


def assemble(entities: DataFrame, kind: str, source: str) -> DataFrame:
    """One document per entity row in the layout of ``kind``.
    -> doc_id, type, name, content, source, doc_key, alternative_names, bsc_subfamilies."""
    lines = [F.concat(F.lit(label + ": "), clean_value(col) if col in entities.columns else F.lit(""))
             for label, col in LAYOUTS[kind]]
    content = strip_ws(F.concat_ws("\n", *lines))
    name = clean_value("name")
    alt = F.col("alternative_names") if "alternative_names" in entities.columns else F.lit(None).cast("string")
    sub = F.col("bsc_subfamilies") if "bsc_subfamilies" in entities.columns else F.lit(None).cast("string")
    return entities.select(
        F.concat(F.lit(kind + ":"), F.col("entity_key").cast("string")).alias("doc_id"),
        F.lit(kind).alias("type"), name.alias("name"), content.alias("content"), F.lit(source).alias("source"),
        doc_key(F.lit(kind), name, content).alias("doc_key"),
        alt.alias("alternative_names"), sub.alias("bsc_subfamilies"))


def infer_table_type(file_name) -> F.Column:
    """First marker contained in the file name, else ``Unknown``."""
    fn = F.col(file_name) if isinstance(file_name, str) else file_name
    expr = F.lit("Unknown")
    for marker, kind in reversed(TYPE_MARKERS):
        expr = F.when(fn.contains(marker), F.lit(kind)).otherwise(expr)
    return expr


# ---------------------------------------------------------------- driver tables as entities


def kpi_entities(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("entity_key"), F.col("p_name").alias("name"),
                    F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]')).alias("alternative_names"),
                    F.concat(F.lit("['"), F.col("p_type"), F.lit("']")).alias("bsc_subfamilies"),
                    F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("short_definition"),
                    F.concat(F.lit("Retail price "), F.col("p_retailprice").cast("string")).alias("explanation"))


def objective_entities(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("short_definition"),
                    F.concat(F.lit("Account balance "), F.col("c_acctbal").cast("string")).alias("explanation"))


def family_entities(spark, sf) -> DataFrame:
    r = table(spark, sf, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("entity_key"), F.col("r_name").alias("name"),
                    F.substring("r_name", 1, 3).alias("short_name"),
                    F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("short_definition"),
                    F.lit("").alias("explanation"))


def subfamily_entities(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")  # a small dimension; Spark's size check picks the join
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_nationkey").cast("long").alias("entity_key"), F.col("n_name").alias("name"),
        F.col("r_name").alias("bsc_family"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("short_definition"),
        F.lit("").alias("explanation"))


def criteria_entities(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("entity_key"), F.col("s_name").alias("name"),
                    F.concat(F.lit("Account balance "), F.col("s_acctbal").cast("string")).alias("explanation"))


ENTITY_SOURCES = {
    "KPI": (kpi_entities, "part"),
    "Objective": (objective_entities, "customer"),
    "BSC Family": (family_entities, "region"),
    "BSC Subfamily": (subfamily_entities, "nation"),
    "Criteria": (criteria_entities, "supplier"),
}


def entity_documents(spark, sf, kinds=None) -> DataFrame:
    """Union of the assembled documents of every entity kind."""
    kinds = kinds or list(ENTITY_SOURCES)
    parts = [assemble(ENTITY_SOURCES[k][0](spark, sf), k, ENTITY_SOURCES[k][1]) for k in kinds]
    return reduce(lambda a, b: a.unionByName(b), parts)


def count_by_type(docs: DataFrame) -> DataFrame:
    """Documents per type; a missing type counts as ``Unknown``."""
    t = F.when(F.coalesce(F.col("type"), F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("type"))
    return docs.groupBy(t.alias("type")).agg(F.count(F.lit(1)).alias("n"))
