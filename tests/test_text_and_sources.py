import hashlib


from quarry.functions.text import doc_key, norm_key
from quarry.sources.entities import assemble, clean_value, infer_table_type


def test_doc_key_golden(spark):
    df = spark.createDataFrame([("KPI", "Age", "t"), ("", "", "t")], "type string, name string, content string")
    got = [r[0] for r in df.select(doc_key("type", "name", "content")).collect()]
    assert got == ["KPI::Age", "content::" + hashlib.sha256(b"t").hexdigest()[:16]]


def test_clean_value_golden(spark):
    df = spark.createDataFrame([('["A", "B"]',), (None,), ('"x"',), ("['p', 'q']",), ('  a\\"b ',)], "v string")
    got = [r[0] for r in df.select(clean_value("v")).collect()]
    assert got == ["A, B", "", "x", "p, q", '  a"b ']


def test_norm_key(spark):
    df = spark.createDataFrame([("  Data-Quality,  Métrica! ",)], "v string")
    assert df.select(norm_key("v")).first()[0] == "data quality métrica"


def test_assemble_kpi_layout(spark):
    e = spark.createDataFrame([(1, "Age", '["Old"]', "['Fin']", "short", "long")],
                              "entity_key long, name string, alternative_names string, bsc_subfamilies string, "
                              "short_definition string, explanation string")
    r = assemble(e, "KPI", "part").first()
    assert r.content == ("KPI Name: Age\nAlternative Names: Old\nBSC Subfamily: Fin\nShort Definition: short\n"
                         "Explanation: long")
    assert r.doc_key == "KPI::Age"


def test_infer_table_type(spark):
    df = spark.createDataFrame([("clean_KPIs.csv",), ("clean_BSC_subfamilies.csv",), ("x.csv",)], "f string")
    assert [r[0] for r in df.select(infer_table_type("f")).collect()] == ["KPI", "BSC Subfamily", "Unknown"]


def test_read_dirty_csv_ragged_golden(spark, tmp_path):
    from quarry.sources.csv_clean import read_dirty_csv
    p = tmp_path / "t.csv"
    p.write_text('name, a, b\nAlpha, x, one, two, three\n\nGam, only\nBeta, "multi\n   line", ["p", "q"]\n')
    rows = [tuple(r) for r in read_dirty_csv(spark, str(p)).collect()]
    assert rows == [("Alpha", "x", "one, two, three"), ("Gam", "only", ""), ("Beta", "multi line", "[p, q]")]


def test_read_questions_json_array_and_error(spark, tmp_path):
    import json

    import pytest

    from quarry.sources.questions_io import read_questions
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"question": "What is A?", "question_id": 1, "ground_truth_docs": ["KPI::A"]},
                             {"question": "Q2", "question_id": 2, "ground_truth_docs": []}], indent=2))
    b = tmp_path / "b.json"
    b.write_text(json.dumps([{"question": "Q3", "question_id": 3}]))
    df = read_questions(spark, [str(a), str(b)])
    assert sorted(r.question_id for r in df.collect()) == [1, 2, 3]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"question": "not a list"}))
    with pytest.raises(ValueError):
        read_questions(spark, [str(a), str(bad)])
