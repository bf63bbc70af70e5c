"""Steps whose cost must follow the input: each held against a plain version."""

import random


from quarry.operators import generate as I
from quarry.operators import spelling as D
from quarry.plans.catalog import ORACLES, QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edit_distance_reads_parts_and_customers(spark, tmp_path):
    spark.createDataFrame([(1, "abc", "abd"), (2, "x", "xyz")], "p_partkey long, p_name string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "abcd")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["edit_distance"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 1), (2, None, None, 2)]
    assert "customer" in ORACLES["edit_distance"]


def test_word_typo_splits_a_question_once(spark):
    q = spark.createDataFrame([(7, "What does large ring measure?", "large ring", "KPI", "KPI", ["a"])],
                              "question_id long, question string, entity_name string, entity_type string, "
                              "expected_document_type string, ground_truth_docs array<string>")
    out = I.question_word_typos(q)
    assert plan_of(out).count("split(") <= 2  # in both fields of one struct at most
    r = out.first()
    assert r.question.endswith(" large ring measure?") and r.typo_details.startswith("'")


def test_custom_terms_meet_one_term_a_key(spark):
    rng = random.Random(3)
    make = lambda n: sorted({"".join(rng.choices("abcA", k=rng.randint(1, 6))) for _ in range(n)})
    words, terms = make(120), make(60)
    got = D.match_custom_terms(spark.createDataFrame([(w,) for w in words], "token string"),
                               spark.createDataFrame([(t,) for t in terms], "term string"))
    assert "levenshtein(" not in plan_of(got)

    def near(a, b):  # one edit, a != b
        if abs(len(a) - len(b)) == 1:
            short, long = sorted((a, b), key=len)
            return any(long[:i] + long[i + 1:] == short for i in range(len(long)))
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1

    forms = {}
    for t in terms:
        for f in (t, t.upper(), t.lower()):
            forms[f] = min(forms.get(f, 1), int(f != t))
    want = {}
    for w in words:
        found = [(0, f, c) for c, f in forms.items() if c.upper() == w.upper()]
        found += [(1, f, c) for c, f in forms.items() if len(c) >= 4 and near(w.upper(), c.upper())]
        if found:
            d, _, c = min(found)
            want[w] = (c, d)
    assert {r.token: (r.custom, r.custom_distance) for r in got.collect()} == want


def test_splitting_detects_once(spark):
    from quarry.operators import decompose as C
    q = spark.createDataFrame([(1, "What is a? What is b? c"), (2, None), (3, " one ")], "question_id long, question string")
    out = C.decompose(q)
    assert plan_of(out).count("(and|also|additionally") == 1
    assert [(r.question_id, r.mode, r.sub_question) for r in out.orderBy("question_id", "sub_no").collect()] == [
        (1, "multi", "What is a?"), (1, "multi", "What is b?"), (1, "multi", "c?"), (2, "single", None), (3, "single", " one ")]


def test_weighted_rrf_fits_one_knowledge_base(spark, monkeypatch):
    from types import SimpleNamespace

    from quarry.plans import adaptive_queries as A
    from tests.conftest import SF_SMALL
    hits = spark.createDataFrame([], "question_id long, list_name string, list_order int, subq_no int, doc_id long, "
                                     "doc_key string, score double, rank0 int")
    monkeypatch.setattr(A, "bench_run", lambda *a, **k: SimpleNamespace(hits=hits))

    def second(*a):
        raise AssertionError("a second knowledge base")

    monkeypatch.setattr(A, "bench_kb", second)
    assert QUERIES["weighted_rrf"](spark, SF_SMALL).columns == ["question_id", "doc_key", "score", "both_names"]
