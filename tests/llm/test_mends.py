"""Columns of users through language ID, reruns of sharding, and mixing targets by another way."""

import random

import pytest
from pyspark.sql import functions as F

from docket.llm import decontaminate, langid, mixing, sharding

WORDS = {"en": ["thing", "other", "where", "would"], "fr": ["cette", "pour", "dans", "tr\u00e8s"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "mine", True, (i,)) for i in range(120) for lang in [("en", "fr")[i % 2]]]
    rows += [(None, None, None, "mine", None, None), (1, "12 34", "en", "mine", False, (0,))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string, rejected boolean, `s t` struct<`x y`:int>")


def test_language_keeps_columns_of_any_name(spark, docs):
    out = langid.stage(spark, docs, "")
    rows = out.collect()
    assert out.columns == docs.columns and 115 < len(rows) <= 120
    assert all(r["Score"] == "mine" and r["rejected"] is True and r["s t"]["x y"] == r["doc_id"] for r in rows)
    more = langid.identify(docs)
    assert more.columns == [*docs.columns, "lang_pred", "_score", "_rejected"]
    assert all(r["lang_pred"] == r["lang"] for r in more.where("doc_id is not null and not _rejected").collect())
    assert langid.stage(spark, docs.limit(0), "").collect() == []


def test_spans_of_rows_with_any_struct(spark, docs):
    items = spark.createDataFrame([(1, "thing other where would")], "item_id long, text string")
    out = decontaminate.find_spans(docs.withColumn("Hits", F.lit(1)), items)
    assert out.columns == [*docs.columns, "n_words", "hits", "items"] and out.count() == 122


def test_sharding_of_repeated_ids_agrees_between_reruns(spark, tmp_path):
    rows = [(i % 7, f"text {i}", "en", "s", 0) for i in range(200)]
    got = []
    for n in (1, 5):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got.append(sorted(tuple(r) for r in sharding.op8_sharding(spark, f"{tmp_path}/{n}").collect()))
    assert got[0] == got[1]


def level(sizes, weights, budget, most):
    """Targets by bisection on the level at which all but full sources stand."""
    low, high = 0.0, budget + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * n, mid * w) for n, w in zip(sizes, weights, strict=True)) < budget else (low, mid)
    return [min(most * n, high * w) for n, w in zip(sizes, weights, strict=True)]


def test_targets_equal_bisection():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.choice((0, 1, 5, 100, 10_000)) for _ in range(rng.randint(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        budget = 1.5 * sum(sizes)
        assert mixing.targets(sizes, weights, budget, 2) == pytest.approx(level(sizes, weights, budget, 2), rel=1e-9, abs=1e-9)


def test_targets_of_many_sources_take_one_pass():
    n = 300_000
    got = mixing.targets(list(range(1, n + 1)), [1] * n, 1.5 * n * (n + 1) / 2, 2)
    assert sum(got) == pytest.approx(1.5 * n * (n + 1) / 2)
