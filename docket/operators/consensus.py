"""Competing readings of a field: the best supported value wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONFIDENCE_POWER, RANK_WEIGHT


def weight(rank: Column, ratio: Column, conf: Column) -> Column:
    """Evidence of one reading: rank's weight x label ratio x confidence cubed."""
    weights = F.create_map(*[F.lit(x) for kv in RANK_WEIGHT.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, rank.cast("int")), F.lit(0.3)) * ratio * F.pow(conf, CONFIDENCE_POWER)


def resolve(readings: DataFrame, keys: list[str], value: str = "value", score: str = "w", rank: str = "rank", seq: str = "seq") -> DataFrame:
    """keys, rep, score, n, rank: of equal values the one with most weight, then most readings, then the one seen first.

    One shuffle by (keys, value) with partial aggregation, then one max by keys;
    null values are no readings.
    """
    clusters = readings.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(score).alias("score"), F.count("*").alias("n"), F.min(rank).alias("rank"), F.min(seq).alias("first"))
    best = F.max_by(F.struct(F.col(value).alias("rep"), "score", "n", "rank"), F.struct("score", "n", (-F.col("first")).alias("first")))
    return clusters.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.rep", "b.score", "b.n", "b.rank")


def resolve_free(readings: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """keys, rep, score, n, rank, error of free texts: greedy clusters in order of falling weight, joined to the first representative that is near enough.

    The order decides, so a case's readings (a handful) are ordered in an array and folded by one Arrow function.
    """
    from ..functions.fuzzy import greedy_consensus

    rows = readings.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "seq", "key", "value", "rank"))).alias("xs"))
    return rows.select(*keys, greedy_consensus(ratio)(F.transform("xs", lambda x: x["key"]), F.transform("xs", lambda x: x["value"]), F.transform("xs", lambda x: -x["w"]), F.transform("xs", lambda x: x["rank"])).alias("b")).select(*keys, "b.*")
