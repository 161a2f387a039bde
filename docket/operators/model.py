"""Ensemble of Spark learners, out-of-fold prediction and recalibration.

The reference's learners do not exist here: three binary boosted-tree models with
normalised probabilities, a random forest and a multinomial regression take their
place, so probabilities are our own while everything around them follows the rules.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .trust import check_lineage, safe_columns


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `features` in the given order, missing values 0; columns of the untrusted layer are an error."""
    check_lineage(columns)
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


class Ensemble:
    """Mean of member probabilities over classes 0..classes-1.

    kind: mixed (forest, regression and boosted trees) or boosted (shallow boosted trees alone).
    """

    def __init__(self, classes: int = 3, trees: int = 40, iterations: int = 15, seed: int = 7, kind: str = "mixed"):
        if kind not in ("mixed", "boosted"):
            raise ValueError(f"an ensemble is mixed or boosted, not {kind}")
        self.classes, self.trees, self.iterations, self.seed, self.kind = classes, trees, iterations, seed, kind
        self.whole: list = []  # models of all classes
        self.boosted: list = []  # one model a class
        self.columns: list[str] = []

    def fit(self, df: DataFrame, label: str, columns: list[str]) -> Ensemble:
        self.columns = safe_columns(columns)
        data = assemble(df, self.columns).select("features", F.col(label).cast("double").alias("label")).persist()
        depth = 3 if self.kind == "mixed" else 2
        self.whole = []
        if self.kind == "mixed":
            self.whole = [RandomForestClassifier(numTrees=self.trees, maxDepth=8, seed=self.seed).fit(data), LogisticRegression(family="multinomial", regParam=0.01, standardization=True, maxIter=60).fit(data)]
        self.boosted = [GBTClassifier(maxIter=self.iterations, maxDepth=depth, stepSize=0.1, seed=self.seed).fit(data.withColumn("label", (F.col("label") == k).cast("double"))) for k in range(self.classes)]
        data.unpersist()
        return self

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with the probability array `out`."""
        rows, parts = assemble(df, self.columns), []
        for i, m in enumerate(self.whole):
            rows = m.setProbabilityCol(f"_v{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}").transform(rows).withColumn(f"_p{i}", self._padded(vector_to_array(f"_v{i}")))
            parts.append(f"_p{i}")
        for k, m in enumerate(self.boosted):
            rows = m.setProbabilityCol(f"_w{k}").setRawPredictionCol(f"_s{k}").setPredictionCol(f"_d{k}").transform(rows)
        rows = rows.withColumn("_g", F.array(*[vector_to_array(f"_w{k}")[1] for k in range(self.classes)]))
        rows = rows.withColumn("_q", F.transform("_g", lambda x: x / F.aggregate("_g", F.lit(0.0), lambda s, y: s + y)))
        parts.append("_q")
        mean = F.array(*[sum((F.col(n)[k] for n in parts), F.lit(0.0)) / len(parts) for k in range(self.classes)])
        return rows.withColumn(out, mean).select(*df.columns, out)

    def _padded(self, p):
        """Classes that were not seen have probability 0."""
        return F.slice(F.concat(p, F.array_repeat(F.lit(0.0), self.classes)), 1, self.classes)

    def save(self, spark: SparkSession, path: str) -> None:
        """Members and settings below path, a folder that driver and executors share; what stood there is replaced."""
        for i, m in enumerate([*self.whole, *self.boosted]):
            m.write().overwrite().save(f"{path}/member{i}")
        write_settings(spark, f"{path}/settings", {"classes": self.classes, "trees": self.trees, "iterations": self.iterations, "seed": self.seed, "kind": self.kind, "columns": self.columns})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        told = read_settings(spark, f"{path}/settings")
        columns = told.pop("columns")
        out = cls(**told)
        out.columns = safe_columns(columns)
        if out.kind == "mixed":
            out.whole = [RandomForestClassificationModel.load(f"{path}/member0"), LogisticRegressionModel.load(f"{path}/member1")]
        out.boosted = [GBTClassificationModel.load(f"{path}/member{len(out.whole) + k}") for k in range(out.classes)]
        return out


def write_settings(spark: SparkSession, path: str, settings: dict) -> None:
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def folds(df: DataFrame, label: str, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """df with fold 0..n-1, each label dealt evenly in the order of a hash."""
    w = W.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % n)


def out_of_fold(df: DataFrame, label: str, key: str, columns: list[str], n: int = 5, seed: int = 0, **options) -> DataFrame:
    """df with `fold` and `p` of a model that has not seen the row: n fits, a loop over models and not over rows.

    df is read for every fit, so it should be a written table.
    """
    return held_out(folds(df, label, key, n, seed), n, lambda rest, own: Ensemble(**options).fit(rest, label, columns).transform(own))


def held_out(parts: DataFrame, n: int, score) -> DataFrame:
    """Union over folds of score(rows of the other folds, rows of the fold)."""
    out = None
    for k in range(n):
        scored = score(parts.where(F.col("fold") != k), parts.where(F.col("fold") == k))
        out = scored if out is None else out.unionByName(scored)
    return out


def _totals(df: DataFrame, label: str, p: str, look) -> np.ndarray:
    """Sum over rows of look(logits, label), an array: one small row a partition, added up by place.  Rows without p or label do not count."""

    def run(frames):
        total = None
        for f in frames:
            if len(f):
                got = look(np.log(np.maximum(np.array(f["p"].tolist(), dtype="float64"), 1e-9)), f["y"].to_numpy())
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"s": [total.tolist()]})

    rows = df.select(F.col(p).alias("p"), F.col(label).cast("int").alias("y")).where("p is not null and y is not null")
    sums = rows.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in sums.orderBy("i").collect()])  # as many as look gives


def fit_temperature(df: DataFrame, label: str, p: str = "p", low: float = -2.0, high: float = 2.0, points: int = 33) -> float:
    """The a of `temperature` with least log loss, between points of a grid that narrows around the best; each look is one aggregation."""

    def losses(grid: np.ndarray):
        def look(logs, y):
            z = logs[:, None, :] / np.exp(grid)[None, :, None]
            z -= z.max(axis=2, keepdims=True)
            own = np.take_along_axis(z, y[:, None, None], axis=2)[:, :, 0]
            return (np.log(np.exp(z).sum(axis=2)) - own).sum(axis=0)

        return look

    while high - low > 1e-4:
        grid = np.linspace(low, high, points)
        sums = _totals(df, label, p, losses(grid))
        if not len(sums):
            return 0.0
        at = int(np.argmin(sums))
        low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return float((low + high) / 2)


def fit_vector(df: DataFrame, label: str, p: str = "p", steps: int = 40) -> tuple[list[float], list[float]]:
    """The a and b of `vector` with least log loss: damped Newton steps over scales e^a and shifts b; each look is one aggregation.

    Loss is convex in scales and shifts.  Shifts are known up to a constant, so the step is the least one.
    """
    first = df.select(p).where(F.col(p).isNotNull()).first()
    k = 3 if first is None else len(first[p])

    def sums(theta: np.ndarray):
        def look(logs, y):
            z = logs * theta[:k] + theta[k:]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            rows = np.arange(len(y))
            off = q.copy()
            off[rows, y] -= 1
            u, qq = np.hstack([logs, np.ones_like(logs)]), np.hstack([q, q])
            same = np.tile(np.eye(k), (2, 2))
            bend = np.einsum("rm,rn->mn", u * qq, u * qq)
            bend = np.einsum("rm,rn,mn->mn", u * qq, u, same) - bend
            return np.concatenate([[len(y), -np.log(np.maximum(q[rows, y], 1e-12)).sum()], (np.hstack([off, off]) * u).sum(axis=0), bend.ravel()])

        return look

    def look(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        got = _totals(df, label, p, sums(theta))
        if not len(got):
            return None
        got = got / got[0]
        return got[1], got[2 : 2 + 2 * k], got[2 + 2 * k :].reshape(2 * k, 2 * k)

    theta = np.array([1.0] * k + [0.0] * k)
    now, damp = look(theta), 1e-9
    for _ in range(steps if now is not None else 0):
        loss, slope, bend = now
        new = theta - np.linalg.lstsq(bend + damp * np.eye(2 * k), slope, rcond=None)[0]
        new[:k] = np.maximum(new[:k], 1e-4)
        then = look(new)
        if then[0] < loss:
            theta, now, damp = new, then, damp / 10
            if loss - then[0] < 1e-8:
                break
        elif damp > 1e3 or loss - then[0] > -1e-12:
            break
        else:
            damp = max(damp, 1e-6) * 100
    return [math.log(x) for x in theta[:k]], [float(x) for x in theta[k:]]


def fit_recalibration(df: DataFrame, label: str, kind: str, p: str = "p") -> dict:
    """Arguments of `decide.recalibrate`, fitted."""
    if kind == "none":
        return {"mode": "none"}
    if kind == "temperature":
        return {"mode": kind, "a": fit_temperature(df, label, p)}
    if kind == "vector":
        a, b = fit_vector(df, label, p)
        return {"mode": kind, "a": a, "b": b}
    raise ValueError(f"recalibration is none, temperature or vector, not {kind}")


def recalibrate_held_out(df: DataFrame, label: str, kind: str, n: int, p: str = "p", out: str = "q") -> DataFrame:
    """df (with fold) and `out`: p of each fold recalibrated by a fit on the other folds."""
    from .decide import recalibrate

    return held_out(df, n, lambda rest, own: own.withColumn(out, recalibrate(F.col(p), **fit_recalibration(rest, label, kind, p))))
