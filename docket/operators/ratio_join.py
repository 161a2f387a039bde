"""Joins of texts by the ratio of their matching blocks, without comparing all pairs.

Matching blocks hold no more letters than two texts share, so ratio >= t needs a share of
numbered letters (first a, second a, ...) of t as well.  Then two texts share one of each other's rarest
letters: with letters ordered by rarity, a prefix long enough for the least share any partner could need holds it.  Prefixes
meet in an equi-join; whole sets bound what is left; only then is the ratio worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio


def numbered(text: Column) -> Column:
    """The letters of a text, each with its number among equal ones."""
    return F.transform(F.array_sort(F.split(text, "")), lambda c, i: F.concat(c, i + 1 - F.array_position(F.array_sort(F.split(text, "")), c)))


def overlap_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, overlap of all pairs of distinct texts of left.a and right.b whose share of numbered letters, 2 * shared / (both lengths), is `least` (above 0) or more.

    Null and empty texts have no partners.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    sides = [df.select(F.col(c).alias("text")).where(F.length(c) > 0).distinct().withColumn("letters", numbered(F.col("text"))) for df, c in ((left, a), (right, b))]
    letters = [side.select("text", "letters", F.explode("letters").alias("letter")) for side in sides]
    often = letters[0].select("letter").union(letters[1].select("letter")).groupBy("letter").agg(F.count("*").alias("often"))

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        ordered = rows.join(often, "letter").groupBy("text").agg(F.first("letters").alias("letters"), F.sort_array(F.collect_list(F.struct("often", "letter"))).alias("xs"))
        size = F.size("xs")
        # A partner is least / (2 - least) times as long at least, and so the letters shared with it.
        keep = size - F.ceil(size * F.lit(least / (2 - least)) - 1e-9).cast("int") + 1
        rare = F.explode(F.transform(F.slice("xs", F.lit(1), keep), lambda x: x["letter"])).alias("letter")
        return ordered.select(F.col("text").alias(name), F.col("letters").alias(f"{name}_letters"), rare)

    met = prefix(letters[0], "a").join(prefix(letters[1], "b"), "letter")
    sizes = F.size("a_letters") + F.size("b_letters")
    able = met.where(2 * F.least(F.size("a_letters"), F.size("b_letters")) >= least * sizes - 1e-9).dropDuplicates(["a", "b"])
    share = 2.0 * F.size(F.array_intersect("a_letters", "b_letters")) / sizes
    return able.select("a", "b", share.alias("overlap")).where(F.col("overlap") >= least - 1e-12)


def ratio_join(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, r: all pairs of distinct texts of left.a and right.b with ratio(a, b) of `least` or more."""
    near = overlap_pairs(left, right, a, b, least).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return near.withColumn("r", ratio(F.col("a"), F.col("b"))).where(F.col("r") >= least).select("a", "b", "r")
