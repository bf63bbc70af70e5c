from pyspark.sql import functions as F

from quarry.operators import decompose as C
from quarry.operators.questions import extract_anchors, extract_entities


def test_extract_entities_golden(spark):
    q = spark.createDataFrame([(1, "How does Data Quality vs Access Cost differ?")], "question_id int, question string")
    ents = extract_entities(q).first().entities
    assert "Data Quality" in ents and "Access Cost" in ents and "How" not in ents


def test_extract_anchors_between_removed_by_context_phrase(spark):
    q = spark.createDataFrame([(1, "What are the trade-offs between Data Quality and Access Cost?")],
                              "question_id int, question string")
    anchors = extract_anchors(q).first().anchors
    assert "access cost" in anchors and "what are the data quality" in anchors
    assert "cost" not in anchors


def test_detect_multi_question_golden(spark):
    df = spark.createDataFrame([("Compare A and B?",), ("What is A? What is B?",), ("Compare A? Or B?",)], "t string")
    got = [r[0] for r in df.select(C.detect_multi_question(F.col("t"))).collect()]
    assert got == [False, True, False]


def test_split_questions_golden(spark):
    df = spark.createDataFrame([("What is A? And how is B measured",)], "t string")
    assert df.select(C.split_questions(F.col("t"))).first()[0] == ["What is A", "how is B measured?"]


def test_split_caps_and_merges(spark):
    df = spark.createDataFrame([("a? b? c? d? e? f? g?",)], "t string")
    parts = df.select(C.split_questions(F.col("t"), 5)).first()[0]
    assert parts == ["a?", "b?", "c?", "d?", "Additionally: e?; f?; g?"]


def test_conjunction_splits_are_merged_not_dropped(spark):
    text = "a? and b? also c? plus d? furthermore e? and f? and g"
    df = spark.createDataFrame([(1, text), (2, "a? and b"), (3, None)], "question_id int, question string")
    parts = df.select(C.split_questions(F.col("question"), 5)).first()[0]
    assert parts == ["a", "b?", "c?", "d?", "Additionally: e?; f?; g?"]
    flags = {r.question_id: r.truncated for r in C.decompose(df).collect()}
    assert flags[1] is True and flags[2] is False
    assert {r.truncated for r in C.decompose(df.where("question_id = 1"), max_subqs=5).collect()} == {False}
    long = spark.createDataFrame([(1, "x" * 6000 + "? and b? also c")], "question_id int, question string")
    assert {r.truncated for r in C.decompose(long, max_chars=7000).collect()} == {False}
    assert len(C.decompose(long, max_chars=7000).collect()) == 3


def test_parse_subquestion_json(spark):
    df = spark.createDataFrame([('```json\n{"sub_questions": ["x", " y "]}\n```', "q"), ("not json", "What? Why?")],
                               "r string, q string")
    got = [r[0] for r in df.select(C.parse_subquestion_json(F.col("r"), F.col("q"))).collect()]
    assert got == [["x", "y"], ["What?", "Why?"]]


def test_extract_anchors_extended(spark):
    from quarry.operators.questions import extract_anchors_extended
    q = spark.createDataFrame([(1, 'Compare the "Access Cost" of small ring between data quality and speed?')],
                              "question_id int, question string")
    known = spark.createDataFrame([("small ring",), ("zzz",)], "name string")
    a = extract_anchors_extended(q, known=known).first().anchors_ext
    assert "access cost" in a and "small ring" in a and "data quality" in a and "speed" in a
    assert "compare" not in a and "zzz" not in a
