"""Histogram boosting and random-cut trees against plain numpy."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import trees
from docket.operators.trust import BANNED_PREFIXES

COLUMNS = ["a", "b", "c", "y"]  # a feature may be called as the working columns are


def table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack((rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 3, n), rng.integers(0, 5, n))).astype(float)
    label = (x[:, 0] > 5).astype(int) + ((x[:, 1] > 0.3) & (x[:, 2] < 2)) + (rng.random(n) < 0.1)
    label = np.minimum(label, 2)
    rows = [(i, int(label[i]), *map(float, x[i])) for i in range(n)]
    return x, label, spark.createDataFrame(rows, "id long, label int, a double, b double, c double, y double").repartition(3)


def brute_boost(bins, y, use, classes, iterations, rate, leaves, min_leaf, l2):
    raw = np.tile([math.log(max((y[use] == k).sum(), 1e-12) / use.sum()) for k in range(classes)], (len(y), 1))
    for _ in range(iterations):
        p, add = trees.softmax(raw), np.zeros_like(raw)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def best(mine, g=g, h=h):
                rows = mine & use
                G, H, found = g[rows].sum(), h[rows].sum(), None
                for f in range(bins.shape[1]):
                    for b in range(bins[:, f].max()):
                        left = rows & (bins[:, f] <= b)
                        right = rows & ~left
                        if min(left.sum(), right.sum()) < min_leaf or min(h[left].sum(), h[right].sum()) < 1e-3:
                            continue
                        gain = round(g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - G * G / (H + l2), 8)
                        if gain > 0 and (found is None or gain > found[0]):
                            found = (gain, f, b)
                return found

            parts = [(np.ones(len(y), bool), None)]
            parts[0] = (parts[0][0], best(parts[0][0]))
            while len(parts) < leaves and any(c for _, c in parts):
                i = max((j for j, (_, c) in enumerate(parts) if c), key=lambda j: parts[j][1][0])
                mine, (_, f, b) = parts.pop(i)
                for side in (mine & (bins[:, f] <= b), mine & (bins[:, f] > b)):
                    parts.append((side, best(side)))
            for mine, _ in parts:
                rows = mine & use
                add[mine, k] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        raw += add
    return trees.softmax(raw)


def probabilities(df, key="id"):
    return np.array([r["p"] for r in df.orderBy(key).collect()])


def binned(x, bounds):
    return np.column_stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(bounds)])


OPTIONS = {"iterations": 4, "rate": 0.3, "leaves": 5, "min_leaf": 5, "l2": 1.0}


def test_boosting_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trees, "ROUNDS", 2)
    x, y, df = table(spark)
    model = trees.boost(df, "label", COLUMNS, **OPTIONS)
    want = brute_boost(binned(x, model.bounds), y, np.ones(len(y), bool), 3, **OPTIONS)
    assert np.abs(probabilities(model.transform(df)) - want).max() < 1e-6
    assert model.scans <= OPTIONS["iterations"] * (OPTIONS["leaves"] - 1)  # all classes of a level share one


def test_fits_of_all_folds_share_scans_and_stay_apart(spark):
    x, y, df = table(spark, 150)
    options = OPTIONS | {"iterations": 2}
    dealt = trees.fold_columns(df, "label", "id", 3, [0, 9])
    folds = np.array([r["folds"] for r in dealt.orderBy("id").collect()])
    for s in range(2):
        for label in range(3):
            sizes = [((y == label) & (folds[:, s] == k)).sum() for k in range(3)]
            assert max(sizes) - min(sizes) <= 1
    model = trees.boost(dealt, "label", COLUMNS, folds=3, **options)
    got = probabilities(model.transform(dealt, own=True, folds=3))
    bins = binned(x, model.bounds)
    want = np.zeros((len(y), 3))
    for s in range(2):
        for k in range(3):
            p = brute_boost(bins, y, folds[:, s] != k, 3, **options)
            want[folds[:, s] == k] += p[folds[:, s] == k] / 2
    assert np.abs(got - want).max() < 1e-6
    assert model.scans <= options["iterations"] * (options["leaves"] - 1)  # as many as one fit may need, not six times that
    # A row's probability does not depend on labels of its own fold.
    other = dealt.withColumn("label", F.when(F.get("folds", F.lit(0)) == 1, 2 - F.col("label")).otherwise(F.col("label")))
    again = trees.boost(other.withColumn("folds", F.slice("folds", 1, 1)), "label", COLUMNS, folds=3, bounds=model.bounds, **options)
    first = trees.boost(dealt.withColumn("folds", F.slice("folds", 1, 1)), "label", COLUMNS, folds=3, bounds=model.bounds, **options)
    assert np.abs(np.array([t.value for t in again.trees[-1][1]], object)[0][0] - np.array([t.value for t in first.trees[-1][1]], object)[0][0]) < 1e-9
    assert np.allclose(again.raw(bins, 1), first.raw(bins, 1))


def test_boosted_model_is_saved_and_refuses_the_untrusted_layer(spark, tmp_path):
    _, _, df = table(spark, 80)
    banned = f"{BANNED_PREFIXES[0]}x"
    model = trees.boost(df.withColumn(banned, F.col("label")), "label", [*COLUMNS, banned], **(OPTIONS | {"iterations": 2}))
    model.save(spark, f"{tmp_path}/m")
    back = trees.Boosted.load(spark, f"{tmp_path}/m")
    assert back.columns == COLUMNS
    assert np.array_equal(probabilities(back.transform(df)), probabilities(model.transform(df)))
    none = trees.boost(df.limit(0), "label", COLUMNS, **OPTIONS)
    assert none.trees == [] and len(probabilities(none.transform(df))) == 80


def brute_cuts(x, y, trees_, tries, min_leaf, seed, classes=3):
    draw = lambda t, path, what: (zlib.crc32(f"{seed}:{t}:{path}:{what}".encode()) + 0.5) / 4294967296.0
    impure = lambda v: len(v) - (np.bincount(v, minlength=classes) ** 2).sum() / len(v)
    out = np.zeros((len(y), classes))
    for t in range(trees_):
        todo = [(np.arange(len(y)), 1)]
        while todo:
            rows, path = todo.pop()
            counts = np.bincount(y[rows], minlength=classes)
            found = None
            if counts.max() < len(rows) and len(rows) >= 2 * min_leaf:
                varied = [f for f in range(x.shape[1]) if x[rows, f].min() < x[rows, f].max()]
                for f in sorted(varied, key=lambda f: (draw(t, path, f"order{f}"), f))[:tries]:
                    lo, hi = x[rows, f].min(), x[rows, f].max()
                    cut = lo + draw(t, path, f"cut{f}") * (hi - lo)
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= min_leaf:
                        cost = (round(impure(y[left]) + impure(y[right]), 8), f)
                        if found is None or cost < found[0]:
                            found = (cost, left, right)
            if found:
                todo += [(found[1], 2 * path), (found[2], 2 * path + 1)]
            else:
                out[rows] += counts / len(rows)
    return out / trees_


@pytest.mark.parametrize("tries", [1, 3])
def test_random_cuts_equal_brute_force(spark, tries):
    x, y, df = table(spark, 160, 4)
    model = trees.random_cuts(df, "label", COLUMNS, trees=6, min_leaf=3, seed=100, tries=tries)
    assert np.abs(probabilities(model.transform(df)) - brute_cuts(x, y, 6, tries, 3, 100)).max() < 1e-9
    again = trees.random_cuts(df.repartition(5), "label", COLUMNS, trees=6, min_leaf=3, seed=100, tries=tries)
    assert [t.__dict__ for t in again.trees] == [t.__dict__ for t in model.trees]


def test_ensemble_is_the_mean_of_its_members(spark):
    _, y, df = table(spark, 120, 8)
    small = {"hgb": {"iterations": 1}, "ET2": {"trees": 2}, "LR": {"steps": 20}}
    model = trees.TreeEnsemble(overrides=small).fit(df, "label", COLUMNS)
    assert len(model.members) == 4
    p = probabilities(model.transform(df))
    assert np.allclose(p, np.mean([probabilities(m.transform(df, "p")) for m in model.members], axis=0)) and np.allclose(p.sum(1), 1)
    assert model.transform(df).columns == [*df.columns, "p"]
    with pytest.raises(ValueError, match="members are"):
        trees.TreeEnsemble("hgb+svm")
