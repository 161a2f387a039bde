"""The untrusted text layer: measured, never used for a value or a model input.

`split` parts a record into two tables; only functions of this module take the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELD_ALIASES, NEAR_RATIO
from ..functions.fuzzy import bound, ratio
from ..functions.text import eval_key, is_nullish, squash

BANNED_PREFIXES = ("hidden_", "inj_")


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visible records without hidden_text, case_id with hidden text)."""
    line = "array<struct<t:string,s:string,x0:string,y0:string,x1:string,y1:string>>"
    visible = F.transform("pages", lambda p: F.when(p.isNotNull(), F.struct(*[p[c].alias(c) for c in ("page", "k", "w", "h")], p["lines"].cast(line).alias("lines"))))
    hidden = F.array_join(F.transform("pages", lambda p: F.coalesce(p["hidden_text"], F.lit(""))), " ")
    return records.withColumn("pages", visible), records.select("case_id", hidden.alias("hidden_text"))


def hidden_value(text: Column, field: str) -> Column:
    """Value that the layer gives a field: the first `alias: value` line, else the first line that begins with an alias."""
    lines = F.split(text, r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
    aliases = F.array(*[F.lit(a) for a in sorted(FIELD_ALIASES.get(field, []), key=len, reverse=True)])
    parted = F.transform(lines, lambda x: F.struct(squash(F.split(x, ":", 2)[0]).alias("k"), F.trim(F.get(F.split(x, ":", 2), F.lit(1))).alias("v")))
    colon = F.get(F.filter(parted, lambda x: F.array_contains(aliases, x["k"]) & x["v"].isNotNull() & (x["v"] != "")), F.lit(0))["v"]
    headed = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(3), F.lit(1), F.lit(-1)), lambda n: F.struct(squash(F.array_join(F.slice(F.split(F.trim(x), r"\s+"), F.lit(1), n), "")).alias("k"), F.array_join(F.slice(F.split(F.trim(x), r"\s+"), n + 1, F.lit(1000)), " ").alias("v")))))
    prefix = F.get(F.filter(headed, lambda x: F.array_contains(aliases, x["k"]) & (x["v"] != "")), F.lit(0))["v"]
    return F.coalesce(colon, prefix)


def agreement(visible: Column, hidden: Column) -> Column:
    """no_hidden, no_visible, agree, near or disagree; near pairs pass the native bound before the Arrow function."""
    a, b = eval_key(visible), eval_key(hidden)
    near = F.when(bound(a, b) >= NEAR_RATIO, ratio(a, b) >= NEAR_RATIO).otherwise(F.lit(False))
    return F.when(is_nullish(hidden), "no_hidden").when(is_nullish(visible), "no_visible").when(a == b, "agree").when(near, "near").otherwise("disagree")


def signals(fields: DataFrame, untrusted: DataFrame, names: list[str]) -> DataFrame:
    """case_id, disagree, refused: fields where the layer says otherwise, and fields that it alone would fill."""
    both = fields.join(untrusted, "case_id", "left")
    told = both.withColumns({f"_{n}": agreement(F.col(n), hidden_value(F.coalesce("hidden_text", F.lit("")), n)) for n in names})
    count = lambda what: sum(((F.col(f"_{n}") == what).cast("int") for n in names), F.lit(0))
    return told.select("case_id", count("disagree").alias("disagree"), count("no_visible").alias("refused"))


def safe_columns(columns: list[str]) -> list[str]:
    """Model inputs without those of the untrusted layer, at fitting and at prediction alike."""
    return [c for c in columns if not c.startswith(BANNED_PREFIXES)]


def check_lineage(columns: list[str]) -> None:
    if bad := [c for c in columns if c.startswith(BANNED_PREFIXES) or c == "hidden_text"]:
        raise ValueError(f"columns of the untrusted layer among values or inputs: {bad}")
