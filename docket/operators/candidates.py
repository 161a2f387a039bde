"""Labels to fields: every line, row and correction note yields candidate readings.

candidates: case_id, field, rank, ratio, conf, value, ptype, pg_pos, seq, error.  A row with an error is no reading: a label there could not be looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CORRECTION_RANK, CORRECTION_RATIO, CORRECTION_STEM, FIELD_ALIASES, FOREIGN_RANK
from ..functions.fuzzy import best_label, bound, over_distinct, ratio
from ..functions.text import clean, squash

SCHEMA = ["case_id", "field", "rank", "ratio", "conf", "value", "ptype", "pg_pos", "seq", "error"]
KNOWN = "l.field is not null or l.error is not null"


def cuts(text: Column) -> Column:
    """Places where a label may end, best first: at each of `: ; =`, then at one of the first three spaces.

    array<struct<label, value, ord>>; cuts without a value are left out.
    """
    marks = F.transform(F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).isin(":", ";", "=")), lambda i: F.struct(F.substring(text, F.lit(1), i - 1).alias("label"), F.substring(text, i + 1, F.length(text)).alias("value")))
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    spaces = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k < F.size(tokens)),
        lambda k: F.struct(F.array_join(F.slice(tokens, F.lit(1), k), " ").alias("label"), F.array_join(F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0))), " ").alias("value")),
    )
    every = F.transform(F.concat(marks, spaces), lambda c, i: F.struct(c["label"].alias("label"), clean(c["value"]).alias("value"), i.alias("ord")))
    return F.when(F.length(text) > 0, F.filter(every, lambda c: c["value"] != ""))


def inline(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, ratio, value, conf: the best labelled cut of each line, ties to the first.  Labels are looked up once each."""
    split = lines.select(*keys, "s", F.explode(cuts(F.col("t"))).alias("c")).select(*keys, "s", squash(F.col("c.label")).alias("key"), F.col("c.value").alias("value"), F.col("c.ord").alias("ord"))
    named = over_distinct(split.where(F.length("key").between(1, 40)), "key", best_label, "l").where(KNOWN)
    best = named.groupBy(*keys).agg(F.max("l.error").alias("error"), F.max_by(F.struct("l.field", "l.ratio", "value", F.col("s").alias("conf")), F.struct("l.ratio", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select(*keys, "b.*", "error")


def beside(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_id, field, ratio, value, conf: rows parted at one of their two widest gaps into a label and a value."""
    from .layout import widest_gaps

    own = [*keys, "row_id"]
    gaps = widest_gaps(rows, own, "x0", "x1", "row_pos").select(*own, F.col("pos").alias("cut"))
    both = rows.join(gaps, own)
    sides = both.groupBy(*own, "cut").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(side, F.struct("row_pos", "t")))), lambda x: x["t"]), " ").alias(n) for n, side in (("label", F.col("row_pos") <= F.col("cut")), ("value", F.col("row_pos") > F.col("cut")))], F.min(F.when(F.col("row_pos") > F.col("cut"), F.col("s"))).alias("conf"))
    named = over_distinct(sides.withColumn("key", squash(F.col("label"))).where(F.length("key").between(1, 40)), "key", best_label, "l").where(KNOWN)
    return named.select(*own, "l.field", "l.ratio", clean(F.col("value")).alias("value"), "conf", "l.error").where("value != '' or error is not null")


def below(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_id, field, ratio, value, conf: a row that is a label alone, over a row of one line that is none, at 0.95."""
    one = rows.groupBy(*keys, "row_id").agg(F.count("*").alias("n"), F.min_by("t", "row_pos").alias("t"), F.min("x0").alias("x0"), F.min_by("s", "row_pos").alias("s"))
    one = over_distinct(one.withColumn("key", squash(F.col("t"))), "key", best_label, "l")
    w = W.partitionBy(*keys).orderBy("row_id")
    nxt = one.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("n", "t", "x0", "s")} | {"next_like": F.lead("l.like").over(w)})
    fits = nxt.where("l.error is not null or (n = 1 and l.field is not null and next_n = 1 and abs(next_x0 - x0) < 120 and not next_like)")
    return fits.select(*keys, "row_id", "l.field", (F.col("l.ratio") * 0.95).alias("ratio"), clean(F.col("next_t")).alias("value"), F.col("next_s").alias("conf"), "l.error").where("value != '' or error is not null")


def corrected(texts: DataFrame) -> DataFrame:
    """t, field, value of texts (t) that read `Manual correction: <field> is <value>.`, however they were read.

    The stem begins at one of the first twelve letters, the nearest place and the first of equals.  A label may have lost two letters
    of its alias or gained three, but has three at least and `is` behind it; the nearest alias wins, of equals the first declared, then the shorter label.
    """
    size = len(CORRECTION_STEM)
    # Letters and digits in lower case, each with its place in the text; one letter can become two.
    marks = F.filter(F.transform(F.split("t", ""), lambda c, i: F.struct(F.lower(c).alias("c"), i.alias("i"))), lambda m: m["c"].rlike(r"^[\p{L}\p{N}]"))
    spots = F.flatten(F.transform("marks", lambda m: F.array_repeat(m["i"], F.length(m["c"]))))
    flat = F.array_join(F.transform("marks", lambda m: m["c"]), "")
    rows = texts.select("t").distinct().withColumn("marks", marks).select("t", flat.alias("flat"), spots.alias("spots")).where(F.length("flat") >= size + 4)
    places = rows.select("t", "flat", "spots", F.explode(F.sequence(F.lit(0), F.least(F.lit(11), F.length("flat") - 1))).alias("a"))
    places = _spread(places.withColumn("head", F.substring("flat", F.col("a") + 1, F.lit(size))))
    stems = places.where(bound(F.col("head"), F.lit(CORRECTION_STEM)) >= CORRECTION_RATIO).withColumn("r", ratio(F.col("head"), F.lit(CORRECTION_STEM))).where(F.col("r") >= CORRECTION_RATIO)
    begun = stems.groupBy("t").agg(F.max_by(F.struct("flat", "spots", (F.col("a") + size).alias("at")), F.struct("r", (-F.col("a")).alias("b"))).alias("x")).select("t", "x.*")
    # Labels end before an `is`; the aliases are few and fixed, so they multiply rows by a constant.
    aliases = [(field, alias) for field, names in FIELD_ALIASES.items() for alias in names]
    known = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(f).alias("field"), F.lit(a).alias("alias")) for o, (f, a) in enumerate(aliases)])
    rest = F.substring("flat", F.col("at") + 1, F.length("flat"))
    ends = F.filter(F.sequence(F.lit(3), F.lit(max(len(a) for _, a in aliases) + 3)), lambda n: F.substring(F.col("rest"), n + 1, F.lit(2)) == "is")
    pieces = begun.withColumn("rest", rest).select("t", "spots", "at", "rest", F.explode(ends).alias("n")).select("*", F.explode(known).alias("k")).select("t", "spots", "at", F.substring("rest", F.lit(1), F.col("n")).alias("piece"), "n", "k.*")
    near = pieces.where("n between length(alias) - 2 and length(alias) + 3").where(bound(F.col("piece"), F.col("alias")) >= CORRECTION_RATIO)
    near = near.withColumn("r", ratio(F.col("piece"), F.col("alias"))).where(F.col("r") >= CORRECTION_RATIO)
    best = near.groupBy("t").agg(F.max_by(F.struct("field", "spots", (F.col("at") + F.col("n") + 2).alias("begin")), F.struct("r", (-F.col("o")).alias("o"), (-F.col("n")).alias("m"))).alias("x"))
    value = F.regexp_replace(F.substring("t", F.get("x.spots", F.col("x.begin")) + 1, F.length("t")), r"(?U)^\s+|[.\s]+$", "")
    return best.select("t", "x.field", value.alias("value")).where("value != ''")


def _spread(df: DataFrame) -> DataFrame:
    """Dealt out, as small data would be put into one Python task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def corrections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, value, conf: signed corrections; only texts that can hold one are looked at, each once."""
    able = lines.where((F.length(F.regexp_replace("t", r"[^\p{L}\p{N}]", "")) >= len(CORRECTION_STEM) + 4) & F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]", "").contains("is"))
    return able.join(corrected(able), "t").select(*keys, "field", "value", F.col("s").alias("conf"))


def collect(lines: DataFrame, rows: DataFrame, types: DataFrame, foreign: DataFrame) -> DataFrame:
    """All candidates with the rank of their page: its type's, or the foreign rank; corrections have a rank and a type of their own even there."""
    page = ["case_id", "pg_pos"]
    ranked = types.join(foreign, page, "left").withColumn("rank", F.when(F.coalesce("foreign", F.lit(False)), FOREIGN_RANK).otherwise(F.col("rank"))).select(*page, "ptype", "rank")
    seq = lambda order, base: (F.col("pg_pos") * 1_000_000 + order * 10 + base).cast("long")
    plain = (
        inline(lines, [*page, "ln_pos"]).withColumn("seq", seq(F.col("ln_pos"), 0)).select(*page, "field", "ratio", "conf", "value", "seq", "error")
        .unionByName(beside(rows, page).withColumn("seq", seq(F.col("row_id"), 1)).select(*page, "field", "ratio", "conf", "value", "seq", "error"))
        .unionByName(below(rows, page).withColumn("seq", seq(F.col("row_id"), 2)).select(*page, "field", "ratio", "conf", "value", "seq", "error"))
        .join(ranked, page)
    )
    fixed = corrections(lines, [*page, "ln_pos"]).withColumn("seq", seq(F.col("ln_pos"), 3)).join(ranked.select(*page), page)
    fixed = fixed.select(*page, "field", F.lit(1.0).alias("ratio"), "conf", "value", "seq", F.lit("correction").alias("ptype"), F.lit(CORRECTION_RANK).alias("rank"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(fixed).select(*SCHEMA)
