"""The decision model: fits against known answers, prediction in one call, saving and loading."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docket.constants import DECISIONS
from docket.operators import adjudicator, decide, model


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    out = []
    for i in range(120):
        y = i % 3
        out.append((f"C-{i}", y, y + rnd.gauss(0, 0.4), rnd.random(), (y == 1) * 1.0 if rnd.random() < 0.8 else 0.0, float(i % 2), i % 5 == 0 and 1 or 0, 0))
    return spark.createDataFrame(out, "case_id string, y int, a double, noise double, xs_c double, hidden_x double, disagree int, refused int").coalesce(1).persist()


def loss(data, scale, shift):
    total = 0.0
    for p, y in data:
        z = [math.log(max(x, 1e-9)) * s + b for x, s, b in zip(p, scale, shift, strict=True)]
        top = max(z)
        total -= z[y] - top - math.log(sum(math.exp(x - top) for x in z))
    return total / len(data)


def test_vector_fit_finds_the_least_loss(spark):
    rnd = random.Random(5)
    data = []
    for _ in range(300):
        z = [rnd.gauss(0, 1.5) for _ in range(3)]
        e = [math.exp(x) for x in z]
        p = [x / sum(e) for x in e]
        true = [math.exp(math.log(x) * s + b) for x, s, b in zip(p, (0.5, 0.9, 1.4), (0.4, -0.3, 0.0), strict=True)]
        data.append((p, rnd.choices(range(3), true)[0]))
    df = spark.createDataFrame(data, "p array<double>, y int").coalesce(1).persist()
    a, b = model.fit_vector(df, "y")
    best = loss(data, [math.exp(x) for x in a], b)
    assert best < loss(data, [1.0] * 3, [0.0] * 3) - 0.01
    for j in range(6):  # no neighbour is better
        for d in (-0.02, 0.02):
            near = [*a, *b]
            near[j] += d
            assert loss(data, [math.exp(x) for x in near[:3]], near[3:]) >= best - 1e-7
    got = df.select(decide.recalibrate(F.col("p"), "vector", a, b).alias("q"), "y").collect()
    assert abs(sum(-math.log(r["q"][r["y"]]) for r in got) / len(got) - best) < 1e-9


def test_recalibration_leaves_its_own_fold_out(spark):
    # folds that say opposite things: the fit of the others is seen, not the fold's own
    df = spark.createDataFrame([([0.6, 0.2, 0.2], 0, 0)] * 20 + [([0.6, 0.2, 0.2], 1, 1)] * 20, "p array<double>, y int, fold int").coalesce(1)
    got = {r["fold"]: r["q"] for r in model.recalibrate_held_out(df, "y", "vector", 2).dropDuplicates(["fold"]).collect()}
    assert got[0][1] > 0.9 and got[1][0] > 0.9
    assert model.recalibrate_held_out(df, "y", "none", 2).where("q <> p").count() == 0
    with pytest.raises(ValueError):
        model.fit_recalibration(df, "y", "other")


def test_one_call_predicts_and_survives_saving(spark, rows, tmp_path):
    columns = ["a", "noise", "xs_c", "hidden_x"]
    made = adjudicator.Adjudicator(recal="vector", trees=3, iterations=1)
    oof = made.out_of_fold(rows, "y", "case_id", columns, n=2).select("case_id", "y", "fold", "p").persist()
    assert oof.count() == 120 and oof.where("fold not in (0, 1)").count() == 0
    made.fit(rows, "y", columns, oof).select(oof, "y", 2, [-4.0, -16.0], [0.0, 8.0])
    assert made.false_approval in (-4.0, -16.0) and made.brier in (0.0, 8.0)
    assert made.a.columns == ["a", "noise"] and made.b.columns == ["a", "noise", "xs_c"]
    got = {r["case_id"]: r for r in made.predict(rows).collect()}
    assert len(got) == 120 and all(abs(sum(r["p"]) - 1) < 1e-9 and r["decision"] in DECISIONS and 0.01 <= r["confidence"] <= 0.99 for r in got.values())
    assert sum(r["decision"] == DECISIONS[r["y"]] for r in got.values() if not r["disagree"]) > 0.5 * sum(not r["disagree"] for r in got.values())
    assert all(r["decision"] != "APPROVED" for r in got.values() if r["disagree"])
    plain = {r["case_id"]: r for r in made.predict(rows.drop("disagree", "refused")).collect()}
    assert any(plain[c]["decision"] != r["decision"] for c, r in got.items()) and all(plain[c]["decision"] == r["decision"] for c, r in got.items() if not r["disagree"])
    made.save(spark, str(tmp_path / "m"))
    again = adjudicator.Adjudicator.load(spark, str(tmp_path / "m"))
    assert (again.false_approval, again.brier, again.fitted, again.options) == (made.false_approval, made.brier, made.fitted, made.options)
    assert {r["case_id"]: (r["p"], r["decision"], r["confidence"]) for r in again.predict(rows).collect()} == {c: (r["p"], r["decision"], r["confidence"]) for c, r in got.items()}
    other = rows.withColumn("hidden_x", F.lit(99.0))
    assert {r["case_id"]: r["p"] for r in again.predict_proba(other).collect()} == {c: r["p"] for c, r in got.items()}


@pytest.mark.parametrize("cell", ["A", "B"])
def test_one_cell(spark, rows, cell, tmp_path):
    made = adjudicator.Adjudicator(cell=cell, trees=2, iterations=1).fit(rows, "y", ["a", "xs_c"])
    made.save(spark, str(tmp_path / cell))
    again = adjudicator.Adjudicator.load(spark, str(tmp_path / cell))
    assert (again.a is None, again.b is None) == (cell == "B", cell == "A") and again.predict(rows).count() == 120
    with pytest.raises(ValueError):
        adjudicator.Adjudicator(cell="C")
