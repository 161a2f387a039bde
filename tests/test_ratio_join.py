"""Joins by ratio against all pairs."""

import random

import pytest

from docket.functions.fuzzy import matched
from docket.operators.ratio_join import ratio_join


@pytest.mark.parametrize("least", [0.3, 0.62, 0.8, 1.0])
def test_join_finds_what_all_pairs_hold(spark, least):
    rng = random.Random(int(least * 100))
    word = lambda: "".join(rng.choice("abcde\u00e9 ") for _ in range(rng.randint(0, 12)))
    left, right = [word() for _ in range(60)], [word() for _ in range(60)]
    right += [w[:-1] + "z" for w in left[:20]] + left[20:30] + [None, ""]
    tables = [spark.createDataFrame([(w,) for w in ws], f"{c} string") for ws, c in ((left, "x"), ([*right, right[0]], "y"))]
    got = {(r["a"], r["b"]): r["r"] for r in ratio_join(*tables, "x", "y", least).collect()}
    want = {(a, b): matched(a, b) for a in left for b in right if a and b and matched(a, b) >= least}
    assert got == want


def test_no_pair_is_met_by_a_loop(spark):
    df = spark.createDataFrame([("abc",)], "x string")
    plan = ratio_join(df, df, "x", "x", 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
