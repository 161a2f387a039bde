"""One automaton against a search for each string."""

import random

import pytest
from pyspark.sql import functions as F

from docket.functions.scan import WORD, Literals, bits_of
from docket.operators import features


def test_scan_equals_a_search_for_each(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé😀") for _ in range(n))
    known = Literals([word(rnd.randint(1, 5)) for _ in range(150)] + ["a", "aa", "aaa"])
    assert len(known.patterns) > WORD
    texts = [None, "", "aaaa", *[word(rnd.randint(1, 60)) for _ in range(60)], "a" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", known.scan(F.col("t")).alias("b"))
    holds = known.holds(F.col("b"))
    for r in rows.select("i", F.array(*[holds(p) for p in known.patterns]).alias("x")).collect():
        t = texts[r["i"]]
        assert r["x"] == [None if t is None else p in t for p in known.patterns]
    with pytest.raises(ValueError):
        Literals(["a", ""])
    with pytest.raises(KeyError):
        holds("not among them")


def test_features_are_the_same_either_way(spark):
    names = features.TEXT_STRINGS.patterns
    rows = [(i, f"x {p[:4]}-{p[4:].upper()} y", "MED-3", "waived", "SPN-0007", "", "active_warrant") for i, p in enumerate([*names, "nothing"])]
    df = spark.createDataFrame(rows, "i int, t string, visa_class string, fee_status string, sponsor_id string, arrival_date string, risk_flags string")
    df = df.withColumn("held", features.TEXT_STRINGS.scan(features.squash(F.col("t"))))
    holds = features.TEXT_STRINGS.holds(F.col("held"))
    plain, scanned = ([c.alias(n) for n, c in (features.raw_form(F.col("t"), *h) | features.policy(F.col("t"), *h)).items()] for h in ((), (holds,)))
    assert df.select("i", *plain).orderBy("i").collect() == df.select("i", *scanned).orderBy("i").collect()
    assert bits_of(names, "") == [0] * len(bits_of(names, "x"))
