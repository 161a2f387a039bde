"""Snapping noisy values to closed vocabularies, never inventing one.

The vocabulary is a few dozen constants, so each row is matched against its
field's entries in an array expression: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONTAINED_KEY, CONTAINING_KEY, NULLISH, SIMILARITY, SIMILARITY_ELSE, SIMILARITY_MARGIN, VOCABULARY
from ..functions.text import canon, eval_key, is_nullish, let, repair_name, repair_sponsor, similarity


def entries(field: str, values: list[str] | None = None) -> Column:
    """array<struct<value, key>> of a field's vocabulary."""
    values = VOCABULARY.get(field, []) if values is None else values
    return F.array(*[F.struct(F.lit(v).alias("value"), canon(F.lit(v)).alias("key")) for v in values]) if values else F.array().cast("array<struct<value:string,key:string>>")


def match_detail(c: Column, field: str, values: list[str] | None = None) -> Column:
    """struct<value, how, best, second>: exact, similar, contained or kept.

    Ties go to the larger value.  An empty vocabulary or a nullish text keeps the text.
    """
    key = canon(c)
    keep = F.struct(c.alias("value"), F.lit("none").alias("how"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("second"))

    def judged(x: Column) -> Column:
        best, second, inside = F.get(x["ranked"], F.lit(0)), F.get(x["ranked"], F.lit(1)), x["inside"]
        how = (
            F.when(best["s"] >= 1, "exact")
            .when((best["s"] >= SIMILARITY.get(field, SIMILARITY_ELSE)) & (best["s"] - F.coalesce(second["s"], F.lit(0.0)) >= SIMILARITY_MARGIN), "similar")
            .when(F.size(inside) == 1, "contained")
            .otherwise("kept")
        )
        value = let(how, lambda h: F.when(h.isin("exact", "similar"), best["value"]).when(h == "contained", F.get(inside, F.lit(0))).otherwise(c))
        return F.struct(value.alias("value"), how.alias("how"), best["s"].alias("best"), second["s"].alias("second"))

    def matched(k: Column) -> Column:
        ranked = F.sort_array(F.transform(entries(field, values), lambda e: F.struct(similarity(k, e["key"]).alias("s"), e["value"].alias("value"), e["key"].alias("key"))), asc=False)
        inside = F.transform(F.filter(entries(field, values), lambda e: (F.length(k) >= CONTAINED_KEY) & (F.length(e["key"]) >= CONTAINING_KEY) & e["key"].contains(k)), lambda e: e["value"])
        return F.when((k == "") | (F.size(ranked) == 0), keep).otherwise(let(F.struct(ranked.alias("ranked"), inside.alias("inside")), judged))

    return F.when(is_nullish(c), keep).otherwise(let(key, matched))


def snap(c: Column, field: str) -> Column:
    """A field's value after snapping; sponsor ids and names have rules of their own."""
    if field == "sponsor_id":
        return F.coalesce(repair_sponsor(c), c)
    if field == "applicant_name":
        return repair_name(c)
    return match_detail(c, field)["value"] if field in VOCABULARY else c


def find_in_text(text: Column, field: str, values: list[str] | None = None) -> Column:
    """The vocabulary value whose key the text contains, if all that it contains lie in the longest; else null."""
    hits = let(canon(text), lambda blob: F.filter(entries(field, values), lambda e: (F.length(e["key"]) >= CONTAINED_KEY) & blob.contains(e["key"])))
    longest = lambda hs: F.get(F.sort_array(F.transform(hs, lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value"))), asc=False), F.lit(0))
    only = lambda hs: let(longest(hs), lambda top: F.when(F.forall(hs, lambda e: top["key"].contains(e["key"])), top["value"]))
    return let(hits, lambda hs: F.when(F.size(hs) > 0, only(hs)))


def find_sponsor_in_text(text: Column) -> Column:
    """The only sponsor id that the text states, else null."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(SPN[\s\-_.:]*[A-Za-z0-9|!?]{4})"), F.lit(1))
    ids = F.array_distinct(F.filter(F.transform(found, repair_sponsor), lambda x: x.isNotNull()))
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))


def snap_fields(df: DataFrame, text: str = "visible_text") -> DataFrame:
    """All fields of a wide table snapped; what is nullish or not recognised is looked for in the text."""

    def settled(field: str) -> Column:
        rescue = F.coalesce(find_in_text(F.col(text), field), F.col(field))
        return let(match_detail(F.col(field), field), lambda d: F.when(d["how"].isin("none", "kept"), rescue).otherwise(d["value"]))

    out = {field: settled(field) for field in VOCABULARY}
    sponsor = repair_sponsor(F.col("sponsor_id"))
    out["sponsor_id"] = F.when(sponsor.isNull() | (sponsor == "SPN-0000"), F.coalesce(find_sponsor_in_text(F.col(text)), sponsor, F.col("sponsor_id"))).otherwise(sponsor)
    out["applicant_name"] = repair_name(F.col("applicant_name"))
    return df.withColumns(out)


def mine(df: DataFrame, value: str) -> DataFrame:
    """value, n, ord: a vocabulary from data, frequent values first, then by value; nullish values are none."""
    from pyspark.sql import Window as W

    counts = df.where(~is_nullish(F.col(value))).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("ord", F.row_number().over(W.orderBy(F.desc("n"), "value")))


def majority(df: DataFrame, value: str) -> DataFrame:
    """value, share, n_train: the most frequent value (ties: the smaller)."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return n.agg(F.max_by("value", F.struct("n", F.lit(0))).alias("_v"), F.sum("n").alias("n_train"), F.max("n").alias("m"), F.min_by("value", F.struct((-F.col("n")).alias("a"), "value")).alias("value")).select("value", (F.col("m") / F.col("n_train")).alias("share"), "n_train")


__all__ = ["NULLISH", "entries", "eval_key", "find_in_text", "find_sponsor_in_text", "majority", "match_detail", "mine", "snap", "snap_fields"]
