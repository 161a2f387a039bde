"""Queries that once read parts of texts or tables do so no longer."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from docket import workload
from docket.functions import fuzzy

LATE = "w" * 30 + " é "


@pytest.fixture
def tables(spark, tmp_path):
    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOC = "doc_id long, text string"


def test_fee_and_visa(spark, tables):
    sf = tables(documents=([(5, LATE + "then un-paid, class med 3"), (11, "é"), (17, None), (2, None)], DOC))
    got = {r["doc_id"]: (r["fee"], r["visa"]) for r in workload.fee_and_visa(spark, sf).collect()}
    assert got == {5: ("unpaid", "MED-3"), 11: (None, None), 17: (None, None), 2: ("paid", "DIP-1")}


def test_respace_ngrams(spark, tables):
    sf = tables(documents=([(1, "one twox three four five six " + "İpsum é " * 60 + "two xthree"), (2, "é alpha beta c d e")], DOC))
    got = {r["doc_id"]: (r["squeezed"], r["repaired"]) for r in workload.respace_ngrams(spark, sf).collect()}
    assert got == {1: ("twoxthree", "twox three"), 2: ("alphabeta", "alpha beta")}
    sf2 = f"{sf}/late"
    text = "aa bigcat dogs four five six " + "İpsum é " * 60 + "big cat dogs"
    spark.createDataFrame([(1, text)], DOC).write.parquet(f"{sf2}/documents.parquet")
    from docket.operators.respace import respaced

    assert respaced("bigcatdogs", text) == "big cat dogs"  # the better run stands last
    assert workload.respace_ngrams(spark, sf2).count() == 0  # three words


def test_respace_ngrams_sends_a_text_to_python_once(spark, tables, capsys):
    docs = [(1, " a\tbig  cat d\ne f "), (2, "a big cat d e"), (3, "a bi cats d e f"), (4, "a 😀😀😀 cat d e f"), (5, "a 😀😀 cat d e f"), (6, ""), (7, None), (8, "a İİİ ΑΣΣ d e f bigcat"), (9, "a big cat d e f b igcat bigc at")]
    out = workload.respace_ngrams(spark, tables(documents=(docs, DOC)))
    assert {r["doc_id"]: r["repaired"] for r in out.collect()} == {1: "big cat", 4: "😀😀😀 cat", 8: "İİİ ΑΣΣ", 9: "big cat"}
    out.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_function_of_whole_texts_returns_value_or_error(spark):
    count = fuzzy.total(lambda t, by: (len(t) // by, [t]), T.StructType([T.StructField("n", T.IntegerType()), T.StructField("ts", T.ArrayType(T.StringType()))]), (None, []), [pa.int32(), pa.list_(pa.string())])
    rows = spark.createDataFrame([("é" * 5000, 2), ("a", 0), (None, 1)], "t string, by int").select(count("t", "by").alias("x")).select("x.*").collect()
    assert [(r["n"], [len(t) for t in r["ts"]]) for r in rows] == [(2500, [5000]), (None, []), (None, [])]
    assert rows[0]["error"] is None and "ZeroDivisionError" in rows[1]["error"] and "TypeError" in rows[2]["error"]


def test_hidden_agreement_and_redaction_filter(spark, tables):
    same = "twelve lettr"
    docs = [(1, "1é " + same), (2, same + " one"), (4, same + " two"), (3, None), (6, "x[")]
    sf = tables(documents=(docs, DOC), benchmark=([(1, "q"), (2, same + " other"), (4, same.upper() + " TWO"), (3, "q")], "item_id long, text string"))
    assert {r["doc_id"]: r["verdict"] for r in workload.hidden_agreement(spark, sf).collect()} == {1: "agree", 2: "other", 4: "agree", 3: "no_hidden", 6: "no_hidden"}
    sf2 = f"{sf}/redacted"
    spark.createDataFrame([(4, "long text with a [gap]"), (5, "a good long text"), (6, "- - lettered"), (11, "Name torn"), (12, None)], DOC).write.parquet(f"{sf2}/documents.parquet")
    assert {r["doc_id"]: r["redacted"] for r in workload.redaction_filter(spark, sf2).collect()} == {4: True, 5: False, 6: False, 11: True}


def test_predictions_of_all_customers(spark, tables):
    sf = tables(orders=([(i, i, "F") for i in range(1, 121)], "o_orderkey long, o_custkey long, o_orderstatus string"))
    got = [json.loads(r["value"]) for r in workload.predictions_document(spark, sf).collect()]
    assert sorted(int(r["case_id"]) for r in got) == list(range(1, 121)) and all(r["adjudication"] == "APPROVED" and list(r) == sorted(r) for r in got)


def test_fuzzy_ratio_topk_has_all_types(spark, tables):
    sf = tables(part=([(f"A{i:03}", "zebra") for i in range(230)] + [("ZEBRA", "zebra"), (None, "other")], "p_type string, p_name string"))
    assert {(r["a"], r["b"]) for r in workload.fuzzy_ratio_topk(spark, sf).collect() if r["rank"] == 1} >= {("zebra", "zebra")}
