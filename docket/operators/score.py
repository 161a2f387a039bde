"""Evaluation as ordinary aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decide import decide


def points(truth: Column, action: Column) -> Column:
    """8 right, 2 for review, 1 where review was right, -4 for approving a denial, else 0."""
    return F.when(truth == action, 8).when(action == 2, 2).when(truth == 2, 1).when((truth == 1) & (action == 0), -4).otherwise(0)


def challenge_score(df: DataFrame, truth: str = "truth", action: str = "action", confidence: str = "confidence", by: list[str] | None = None) -> DataFrame:
    """classification, calibration, false_approvals, accuracy, brier in one aggregation; truth and action as places in DECISIONS."""
    t, a = F.col(truth), F.col(action)
    right = (t == a).cast("int")
    out = df.groupBy(*(by or [])).agg(
        (F.lit(80.0) * F.sum(points(t, a)) / (8 * F.count("*"))).alias("classification"),
        F.avg(F.pow(F.col(confidence) - right, 2)).alias("brier"),
        F.count_if((t == 1) & (a == 0)).alias("false_approvals"),
        F.avg(right).alias("accuracy"),
    )
    return out.withColumn("calibration", 20 * F.greatest(F.lit(0.0), 1 - 2 * F.col("brier")))


def param_sweep(df: DataFrame, penalties: list[float], briers: list[float], p: str = "p", truth: str = "truth") -> DataFrame:
    """challenge_score for each (false_approval, brier_weight): rows are expanded by the short grid and aggregated once."""
    grid = F.array(*[F.struct(F.lit(float(x)).alias("false_approval"), F.lit(float(b)).alias("brier_weight")) for x in penalties for b in briers])
    rows = df.select(truth, p, F.explode(grid).alias("g")).select(truth, p, "g.*").withColumn("d", decide(F.col(p), F.col("false_approval"), F.col("brier_weight")))
    return challenge_score(rows.select(truth, "false_approval", "brier_weight", "d.action", "d.confidence"), truth, by=["false_approval", "brier_weight"])


def select_config(sweep: DataFrame, slack: float = 0.5) -> DataFrame:
    """Of configurations within slack of the best total, the one with fewest false approvals, then the best total."""
    total = sweep.withColumn("total", F.col("classification") + F.col("calibration"))
    best = total.agg(F.max("total").alias("_best"))
    near = total.join(F.broadcast(best), F.col("total") >= F.col("_best") - slack)  # one row
    keys = F.struct("false_approvals", (-F.col("total")).alias("t"), "false_approval", "brier_weight")
    return near.agg(F.min_by(F.struct("false_approval", "brier_weight", "false_approvals", "total"), keys).alias("b")).select("b.*")


def set_scores(df: DataFrame, truth: str, found: str, vocabulary: list[str]) -> DataFrame:
    """flag, tp, fp, fn for array columns truth and found."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("flag"), F.array_contains(truth, v).alias("t"), F.array_contains(found, v).alias("f")) for v in vocabulary])).alias("x")).select("x.*")
    return rows.groupBy("flag").agg(F.count_if(F.col("t") & F.col("f")).alias("tp"), F.count_if(~F.col("t") & F.col("f")).alias("fp"), F.count_if(F.col("t") & ~F.col("f")).alias("fn"))


def per_field(df: DataFrame, truth: dict[str, str]) -> DataFrame:
    """field, accuracy: equality after normalisation, for pairs (found column, true column)."""
    from ..functions.text import eval_key

    rows = F.array(*[F.struct(F.lit(f).alias("field"), (eval_key(F.col(f)) == eval_key(F.col(t))).cast("int").alias("hit")) for f, t in truth.items()])
    return df.select(F.explode(rows).alias("x")).groupBy("x.field").agg(F.avg(F.coalesce("x.hit", F.lit(0))).alias("accuracy"))


def is_dev(case_id: Column) -> Column:
    """Every fifth case by number is held out."""
    return F.pmod(F.split(case_id, "-")[1].try_cast("long"), F.lit(5)) == 0
