"""Risk flags from biometric slips, adjudicators' notes and contradicting names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ANCHOR_RATIO, FLAG_RATIO, FLAG_RATIO_LOW, FURNITURE, NAME_CONFIDENCE, NAME_RATIO, NONE_RATIO, NOTE_FLAG_RATIO, SLIP_RATIO
from ..functions.fuzzy import best_window, found_flags, ratio
from ..functions.text import squash

KEYS = ["case_id", "pg_pos"]


def flags_string(flags: Column) -> Column:
    """Sorted, joined by `|`, `none` without any."""
    return F.when(F.size(flags) > 0, F.array_join(F.array_sort(F.array_distinct(flags)), "|")).otherwise("none")


def parse_flags(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("none")), r"\|"), lambda x: ~x.isin("", "none"))


def slip_values(lines: DataFrame) -> DataFrame:
    """case_id, value, error: what follows `observed flags` on slip pages, up to page furniture."""
    pages = lines.groupBy(*KEYS).agg(squash(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln_pos", "t"))), lambda x: x["t"]), " ")).alias("psq"))
    # Spread the Python work; an exchange by KEYS would be dropped beside that of the grouping, which is merged into few tasks.
    pages = pages.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id")
    sure = F.col("psq").rlike(r"biometric|scanimage|speciesmatch|formb\d{1,2}")
    like = pages.where(~sure).withColumn("w", best_window(worth=SLIP_RATIO)(F.lit("biometricscanslip"), F.substring("psq", 1, 160))).where((F.col("w.ratio") >= SLIP_RATIO) | F.col("w.error").isNotNull())
    slips = pages.where(sure).select(*KEYS, F.lit(None).cast("string").alias("error")).union(like.select(*KEYS, "w.error"))
    near = lines.join(slips, KEYS).select("case_id", "error", squash(F.col("t")).alias("sq")).where(F.length("sq").between(6, 90))
    near = near.withColumn("w", best_window(worth=ANCHOR_RATIO)(F.lit("observedflags"), F.substring("sq", 1, 19))).withColumn("error", F.coalesce("error", "w.error")).where((F.col("w.ratio") >= ANCHOR_RATIO) | F.col("error").isNotNull())
    return near.select("case_id", F.split(F.expr("substring(sq, w.stop + 1)"), FURNITURE)[0].alias("value"), "error")


def observed(lines: DataFrame) -> DataFrame:
    """case_id, slip_flags, slip_anchor, slip_resolved, slip_error; the looser threshold is tried where the stricter finds nothing."""
    seen = slip_values(lines).withColumns({"w": best_window(worth=NONE_RATIO)(F.lit("none"), F.col("value")), "h": found_flags(FLAG_RATIO)(F.col("value")), "l": found_flags(FLAG_RATIO_LOW)(F.col("value"))})
    seen = seen.select("case_id", "value", ((F.col("w.ratio") >= NONE_RATIO) & (F.col("value") != "")).alias("none"), F.col("h.flags").alias("high"), F.col("l.flags").alias("low"), F.coalesce("error", "w.error", "h.error", "l.error").alias("error"))
    found = F.when(F.col("none") | (F.col("value") == ""), F.array().cast("array<string>")).when(F.size("high") > 0, F.col("high")).otherwise(F.col("low"))
    seen = seen.select("case_id", "error", found.alias("f"), (F.col("none") | (F.size(found) > 0)).alias("ok"))
    return seen.groupBy("case_id").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("slip_flags"), F.lit(True).alias("slip_anchor"), F.bool_and("ok").alias("slip_resolved"), F.max("error").alias("slip_error"))


def noted(lines: DataFrame) -> DataFrame:
    """case_id, note_flags, note_error: flags named within 46 characters after their anchors, and denials that were rescinded."""
    pages = lines.groupBy(*KEYS).agg(squash(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln_pos", "t"))), lambda x: x["t"]), " ")).alias("psq"))
    # An anchor's window may hold the next anchor, so each match is looked at with what follows it, not consumed.
    anchors = F.concat(*[F.regexp_extract_all("psq", F.lit(p), F.lit(1)) for p in (r"riskflag[a-z]{0,10}?(?:present)?(?=(.{0,46}))", r"disqualif[a-z]{0,12}(?=(.{0,46}))")])
    windows = pages.select("case_id", F.explode(anchors).alias("w")).select("case_id", F.split(F.split("w", FURNITURE)[0], "finding|reason")[0].alias("w"))
    named = windows.where(F.length("w") >= 5).select("case_id", found_flags(NOTE_FLAG_RATIO)(F.col("w")).alias("m")).select("case_id", "m.flags", "m.error")
    rescinded = pages.where(F.col("psq").contains("priordenialstamp") & F.col("psq").contains("rescind")).select("case_id", F.array(F.lit("rescinded_denial")).alias("flags"), F.lit(None).cast("string").alias("error"))
    return named.union(rescinded).groupBy("case_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("note_flags"), F.max("error").alias("note_error"))


#: What registry and intake pages say, and how a line of a name begins.
NAME_PAGES, NAME_STARTS = {"registry": "planetaryregistry", "intake": "workauthorizationintake"}, "registryname|applicant"


def stated_names(lines: DataFrame) -> DataFrame:
    """case_id, kind, value, conf, ord: names on registry and intake pages, what follows a line's last colon or else the next line; letters a-z only."""
    page = W.partitionBy(*KEYS)
    sq = squash(F.col("t"))
    held = squash(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln_pos", "t")).over(page)), lambda x: x["t"]), " "))
    near = page.orderBy("ln_pos")
    rows = lines.withColumns({"_held": held, "_sq": sq, "_t": F.lead("t").over(near), "_s": F.lead("s").over(near)})
    kind = F.when(F.col("_held").contains(NAME_PAGES["registry"]), "registry").when(F.col("_held").contains(NAME_PAGES["intake"]), "intake")
    colon = F.col("t").contains(":")
    value = F.regexp_replace(F.lower(F.when(colon, F.substring_index("t", ":", -1)).otherwise(F.col("_t"))), "[^a-z]", "")
    conf = F.when(colon, F.col("s")).otherwise(F.least("s", "_s"))
    named = rows.where(F.col("_sq").rlike(f"^({NAME_STARTS})")).where(colon | F.col("_t").isNotNull())
    return named.select("case_id", kind.alias("kind"), value.alias("value"), conf.alias("conf"), (F.col("pg_pos") * 1_000_000 + F.col("ln_pos")).alias("ord")).where("kind is not null")


def identity_conflict(names: DataFrame) -> DataFrame:
    """case_id, name_conflict, for names (case_id, kind registry or intake, value, conf, ord): the first trusted name of each kind, too different."""
    trusted = names.where((F.col("conf") >= NAME_CONFIDENCE) & (F.length(squash(F.col("value"))) > 5))
    first = trusted.groupBy("case_id").agg(*[F.min_by(F.when(F.col("kind") == k, squash(F.col("value"))), F.when(F.col("kind") == k, F.col("ord"))).alias(k) for k in ("registry", "intake")])
    return first.select("case_id", F.coalesce(ratio(F.col("registry"), F.col("intake")) < NAME_RATIO, F.lit(False)).alias("name_conflict"))


def detect(cases: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """case_id, risk_flags, confidence of the detection, its evidence, and the error that a reading of it met (null: none), worked out once a case."""
    out = cases.select("case_id").distinct().join(observed(lines), "case_id", "left").join(noted(lines), "case_id", "left").join(identity_conflict(names), "case_id", "left")
    empty = F.array().cast("array<string>")
    slip, note = F.coalesce("slip_flags", empty), F.coalesce("note_flags", empty)
    anchor, resolved = F.coalesce("slip_anchor", F.lit(False)), F.coalesce("slip_resolved", F.lit(False))
    found = F.when(anchor, F.array_union(slip, note)).otherwise(note)
    clean_slip = anchor & resolved & (F.size(slip) == 0)
    found = F.when(F.coalesce("name_conflict", F.lit(False)) & ~clean_slip, F.array_union(found, F.array(F.lit("identity_conflict")))).otherwise(found)
    sure = F.when(anchor & resolved, 1.0).when(anchor, 0.75).otherwise(0.45)
    return out.select("case_id", flags_string(found).alias("risk_flags"), sure.alias("flags_confidence"), F.struct(anchor.alias("slip_anchor"), resolved.alias("slip_resolved"), slip.alias("slip_flags"), note.alias("note_flags"), F.coalesce("name_conflict", F.lit(False)).alias("name_conflict")).alias("evidence"), F.coalesce("slip_error", "note_error").alias("error"))


def flag_bits(flags: Column) -> dict[str, Column]:
    """One 0/1 column a flag, and counts by kind."""
    from ..constants import DISQUALIFYING, FLAGS, REVIEW_ONLY

    own = parse_flags(flags)
    bits = {f"flag_{f}": F.array_contains(own, f).cast("double") for f in FLAGS}
    count = lambda kind: F.size(F.array_intersect(own, F.array(*[F.lit(f) for f in kind]))).cast("double")
    return bits | {"flag_n": F.size(own).cast("double"), "flag_dq_n": count(DISQUALIFYING), "flag_ro_n": count(REVIEW_ONLY), "flag_none": (F.size(own) == 0).cast("double")}


def order_window() -> W:
    return W.partitionBy("case_id").orderBy("pg_pos", "ln_pos")
