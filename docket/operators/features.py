"""Feature families: one aggregation or projection a family, joined by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CONTENT_FIELDS, DAMAGE_WORDS, DECISIONS, FEE_SOURCES, FIELD_ALIASES, PAGE_FURNITURE, PAGE_LABELS, PAGE_MARKS, PAGE_RANK, PLACEHOLDER, RAW_STRINGS, REASONS, REVOKED_SPONSORS, SOURCE_PAIRS, SOURCE_RATIO, SOURCE_TYPES, STAMP_LENGTH, STAMP_TOKENS, VOCABULARY
from ..functions.fuzzy import best_label, bound, note_signals, over_distinct, ratio, stamp_names
from ..functions.scan import Literals
from ..functions.text import squash
from .flags import flag_bits

KEY = "case_id"

def _bit(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def shape(lines: DataFrame, key: str = KEY) -> DataFrame:
    """Lines, pages, confidence: mean, least, the tenth from below by index (not interpolated), quartile, population deviation."""
    ordered = F.array_sort(F.collect_list("s"))
    return lines.groupBy(key).agg(
        F.count("*").cast("double").alias("n_lines"), F.count_distinct("pg_pos").cast("double").alias("n_pages"), F.avg("s").alias("conf_mean"), F.min("s").alias("conf_min"),
        F.element_at(ordered, F.greatest(F.lit(1), F.floor(F.count("*") / 10).cast("int"))).alias("conf_p10"), F.percentile("s", 0.25).alias("conf_p25"), F.stddev_pop("s").alias("conf_std"),
        F.avg((F.col("s") < 0.8).cast("double")).alias("conf_low"), F.sum(F.length("t")).cast("double").alias("n_chars"),
    )


def page_profile(lines: DataFrame, pages: DataFrame, kinds: list[str] | None = None, key: str = KEY) -> DataFrame:
    """For each page type lines, mean confidence and pages, in one pivot; then the worst and the spread of types that have pages, and how many types but `other` have none.

    pages: key, pg_pos, ptype of all pages; one without lines counts as a page of confidence 0.
    """
    kinds = list(PAGE_RANK) if kinds is None else kinds
    each = lines.groupBy(key, "pg_pos").agg(F.count("*").alias("_n"), F.sum("s").alias("_s"))
    typed = pages.select(key, "pg_pos", "ptype").join(each, [key, "pg_pos"], "left")
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("ptype") == k, F.col(c))), F.lit(0))
    agg = lambda k: [of(k, "_n").cast("double").alias(f"pp_{k}_n"), F.coalesce(F.try_divide(of(k, "_s"), of(k, "_n")), F.lit(0.0)).alias(f"pp_{k}_conf"), F.count_if(F.col("ptype") == k).cast("double").alias(f"pp_{k}_pages")]
    wide = typed.groupBy(key).agg(*[a for k in kinds for a in agg(k)])
    confs = F.array_compact(F.array(*[F.when(F.col(f"pp_{k}_pages") > 0, F.col(f"pp_{k}_conf")) for k in kinds]))
    missing = sum(((F.col(f"pp_{k}_pages") == 0).cast("double") for k in kinds if k != "other"), F.lit(0.0))
    return wide.withColumns({"pp_worst": F.array_min(confs), "pp_spread": F.array_max(confs) - F.array_min(confs), "pp_missing": missing}).na.fill(0.0)


#: Strings of the manual's rules, in squashed text.
POLICY_STRINGS = ["revokedsponsor", "sponsorstandingrequiresadditionalverification", "sponsorrevoked", "embargoreview", "registrystatusclear", "hardship", "waiver", "sampledenia", "diplomaticnote", "observedflags"]

#: All that is looked for in a packet's squashed visible text, in one pass.
TEXT_STRINGS = Literals([*(p for ps in RAW_STRINGS.values() for p in ps), *POLICY_STRINGS, *DAMAGE_WORDS])


def raw_form(text: Column, holds=None) -> dict[str, Column]:
    """Bits of strings that forms print, over the squashed visible text; holds: a function that tells whether it holds a string, where it was scanned."""
    holds = squash(text).contains if holds is None else holds
    return {n: _bit(F.lit(True) & _or([holds(p) for p in ps])) for n, ps in RAW_STRINGS.items()}


def _or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def policy(text: Column, holds=None) -> dict[str, Column]:
    """Rules of the manual over resolved fields and visible prose; holds as in `raw_form`."""
    holds = squash(text).contains if holds is None else holds
    visa, fee = F.col("visa_class"), F.col("fee_status")
    bits = flag_bits(F.col("risk_flags"))
    revoked, prose = F.col("sponsor_id").isin(REVOKED_SPONSORS), _or([holds(x) for x in ("revokedsponsor", "sponsorstandingrequiresadditionalverification", "sponsorrevoked")])
    out = {
        "manual_revoked_sponsor": revoked, "revoked_prose": prose, "revoked_any": revoked | prose,
        "registry_embargo": holds("embargoreview"), "registry_clear": holds("registrystatusclear"),
        "transit": visa == "TRANSIT-7", "dip": visa == "DIP-1", "med3": visa == "MED-3",
        "waived_ok": (fee == "waived") & ((visa == "DIP-1") | holds("hardship")), "waived_bad": (fee == "waived") & (visa != "DIP-1") & ~holds("hardship"),
        "unpaid_no_waiver": (fee == "unpaid") & ~holds("waiver"), "fee_unknown": fee == "unknown",
        "sponsor_missing": (visa != "DIP-1") & ~F.col("sponsor_id").rlike("^SPN-[0-9]{4}$"), "date_missing": F.col("arrival_date").isin("", "1900-01-01", "unknown"),
        "dq_flag": bits["flag_dq_n"] > 0, "ro_multi": bits["flag_ro_n"] >= 2, "sample_denial_wm": holds("sampledenia"), "hardship_visible": holds("hardship"),
        "diplomatic_note": holds("diplomaticnote"), "med3_no_biohazard_evidence": (visa == "MED-3") & ~holds("observedflags"),
    }
    return {f"pol_{k}": _bit(v) for k, v in out.items()} | {"pol_ro_flag_n": bits["flag_ro_n"]}


def dates(text: Column, arrival: Column) -> dict[str, Column]:
    """Distinct printed dates, their span, days from arrival to the last, and whether that is over 180."""
    days = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d\d-\d\d-\d\d)\b"), F.lit(1)), lambda x: F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")))), lambda x: x.isNotNull()))
    own = F.to_date(F.try_to_timestamp(arrival, F.lit("yyyy-MM-dd")))
    lag = F.coalesce(F.when(F.year(own) > 1900, F.datediff(F.array_max(days), own)), F.lit(0))
    return {"date_n": F.size(days).cast("double"), "date_span": F.coalesce(F.datediff(F.array_max(days), F.array_min(days)), F.lit(0)).cast("double"), "date_lag": lag.cast("double"), "date_stale": (lag > 180).cast("double")}


def fee_arithmetic(text: Column) -> dict[str, Column]:
    """Eleven keys of the fee pages' text (null: no such page): amount, waiver code, and contradictions with the status."""
    sq = squash(text)
    amount = F.replace(F.regexp_extract(text, r"\$\s?([0-9][0-9,]*\.?\d{0,2})", 1), F.lit(","), F.lit("")).try_cast("double")
    code = F.regexp_extract(sq, r"waivercode([a-z0-9]{2,12})", 1)
    real, fee = (code != "") & ~code.isin("na", "none"), F.col("fee_status")
    paid, waived = (fee == "paid") & (amount == 0), (fee == "waived") & (amount > 0) & ~real
    return {
        "fa_receipt_present": _bit(text.isNotNull()), "fa_amount_found": _bit(amount.isNotNull() | sq.contains("amountna")), "fa_amount_zero": _bit(amount == 0), "fa_amount_pos": _bit(amount > 0),
        "fa_amount_log": F.coalesce(F.log1p(amount), F.lit(0.0)), "fa_waivercode_na": _bit(sq.contains("waivercodena")), "fa_waivercode_real": _bit(real),
        "fa_paid_zero": _bit(paid), "fa_waived_pos": _bit(waived), "fa_unpaid_pos": _bit((fee == "unpaid") & (amount > 0)), "fa_contradiction": _bit(F.coalesce(paid, F.lit(False)) | F.coalesce(waived, F.lit(False))),
    }


def biometric(text: Column) -> dict[str, Column]:
    """Printed biometric confidence of 0 to 100, and its thresholds."""
    n = F.regexp_extract(text, r"onfidence\s*[:\s]\s*([0-9]{1,3})\s*%", 1).try_cast("int")
    n = F.when(n.between(0, 100), n)
    return {"bio_conf_found": _bit(n.isNotNull()), "bio_conf": F.coalesce(n.cast("double"), F.lit(0.0)), "bio_conf_lt80": _bit(n < 80), "bio_conf_lt90": _bit(n < 90), "bio_conf_ge95": _bit(n >= 95)}


def stamps(lines: DataFrame, pages: DataFrame, key: str = KEY) -> DataFrame:
    """Ten keys for each stamp, and three over all: how often it stands on how many pages, how large, how sure, alone, on notes.

    A watermark repeats over half the packet; a stamp stands once or twice on one page.  Lines are
    judged once for each distinct text.  pages: key, pg_pos, ptype, every page.
    """
    short = lines.withColumn("sq", squash(F.col("t"))).where(F.length("sq").between(1, STAMP_LENGTH))
    short = over_distinct(short, "sq", stamp_names, "stamps").where(F.size("stamps") > 0).join(pages.select(key, "pg_pos", "ptype"), [key, "pg_pos"], "left")
    out = []
    for name, words in STAMP_TOKENS.items():
        own = lambda c, name=name: F.when(F.array_contains("stamps", name), c)
        any_ = lambda test, own=own: F.max(own(test).cast("double"))
        out += [
            F.count(own(F.lit(1))).cast("double").alias(f"st_{name}_n"), F.count_distinct(own(F.col("pg_pos"))).cast("double").alias(f"st_{name}_pages"),
            F.max(own((F.col("y1") - F.col("y0")) / F.col("ph"))).alias(f"st_{name}_maxh"), F.max(own((F.col("x1") - F.col("x0")) / F.col("pw"))).alias(f"st_{name}_maxw"),
            F.max(own(F.col("s"))).alias(f"st_{name}_conf"), any_(F.col("ptype") == "note").alias(f"st_{name}_on_note"), any_(F.length("sq") <= len(words[0]) + 4).alias(f"st_{name}_alone"),
        ]
    size = pages.groupBy(key).agg(F.count("*").alias("_pages"))
    wide = size.join(short.groupBy(key).agg(*out), key, "left").na.fill(0.0)
    more = {}
    for name in STAMP_TOKENS:
        n, on, share = F.col(f"st_{name}_n"), F.col(f"st_{name}_pages"), F.col(f"st_{name}_pages") / F.col("_pages")
        more |= {f"st_{name}_pagefrac": share, f"st_{name}_watermarky": _bit((on >= 2) & (share >= 0.5)), f"st_{name}_stampy": _bit((on == 1) & (n <= 2) & (F.col(f"st_{name}_alone") > 0))}
    seen = lambda name: F.col(f"st_{name}_n") > 0
    more |= {
        "st_denial_wm_trap": _bit((F.col("st_sampledenial_pages") >= 1) & (F.col("st_sampledenial_pages") / F.col("_pages") >= 0.4)),
        "st_real_denial_mark": _bit(seen("denied") & ~seen("sampledenial")), "st_appr_and_denial": _bit(seen("denied") & seen("approved")),
    }
    return wide.withColumns(more).drop("_pages")


def damage(lines: DataFrame, pages: DataFrame, text: DataFrame, key: str = KEY) -> DataFrame:
    """Twenty-nine keys of how complete a packet is.  pages: key, pg_pos, ptype, foreign, every page; text: key, visible_text, and _held, its scan for `TEXT_STRINGS`, where there is one."""
    sq = squash(F.col("t"))
    body = ~sq.contains(PAGE_FURNITURE[0]) & ~sq.startswith(PAGE_FURNITURE[1])
    per = lines.groupBy(key, "pg_pos").agg(
        F.count_if(body).alias("body"), F.count("*").alias("lines"), F.count_if(F.col("s") < 0.80).alias("low"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln_pos", sq.alias("sq")))), lambda x: x["sq"]), "").alias("sq")
    )
    per = pages.join(per, [key, "pg_pos"], "left")
    labels = F.coalesce(*[F.when(F.col("ptype") == p, F.array(*[F.lit(w) for w in ws])) for p, ws in PAGE_LABELS.items()])
    per = per.withColumns({"want": F.size(labels), "hit": F.size(F.filter(labels, lambda w: F.coalesce(F.col("sq"), F.lit("")).contains(w)))}).withColumn("cov", F.when(F.col("want") > 0, F.col("hit") / F.col("want")))
    of = lambda p: F.count_if(F.col("ptype") == p)
    n = F.count("*")
    evidence = ("intake", "registry", "slip", "sponsor", "fee")
    typed = F.count("cov")
    out = per.groupBy(key).agg(
        F.count_if(F.coalesce("body", F.lit(0)) <= 1).alias("dm_n_blank_pages"), (F.count_if(F.coalesce("body", F.lit(0)) <= 1) / n).alias("dm_blank_frac"),
        F.count_if("foreign").alias("dm_n_foreign_pages"), F.max(F.col("foreign").cast("int")).alias("dm_any_foreign"),
        F.coalesce(F.avg("cov"), F.lit(0.0)).alias("dm_label_coverage"), typed.alias("dm_typed_pages"), of("other").alias("dm_untyped_pages"), F.coalesce(F.sum(F.when(F.col("want") > 0, F.col("want") - F.col("hit"))), F.lit(0)).alias("dm_missing_labels"),
        *[F.coalesce(F.max(F.when(F.col("ptype") == p, F.col("cov"))), F.lit(-1.0)).alias(f"dm_{p}_cov") for p in ("intake", "registry", "slip", "fee")],
        *[(of(p) > 0).cast("int").alias(f"dm_has_{p}") for p in evidence],
        of("note").alias("dm_n_note_pages"), (of("intake") > 1).cast("int").alias("dm_dup_intake"), (of("note") > 1).cast("int").alias("dm_dup_note"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("dm_lowconf_lines"), (F.coalesce(F.sum("low"), F.lit(0)) / F.greatest(F.coalesce(F.sum("lines"), F.lit(0)), F.lit(1))).alias("dm_lowconf_frac"), (F.coalesce(F.sum("lines"), F.lit(0)) / n).alias("dm_lines_per_page"),
    )
    conf = lines.groupBy(key).agg(F.stddev_pop("s").alias("dm_conf_std"), F.percentile("s", 0.25).alias("dm_conf_p25"))
    t = F.coalesce("visible_text", F.lit(""))
    found = F.size(F.regexp_extract_all(t, F.lit(r"\[[^\]]{2,40}\]"), F.lit(0)))
    holds = TEXT_STRINGS.holds(F.col("_held")) if "_held" in text.columns else squash(t).contains
    words = sum((_bit(holds(w)) for w in DAMAGE_WORDS), F.lit(0.0))
    text = text.select(key, found.alias("dm_n_brackets"), (found > 0).cast("int").alias("dm_any_bracket"), words.alias("dm_damage_words"))
    out = text.join(out, key, "left").join(conf, key, "left").withColumns({"dm_conf_p25": F.coalesce("dm_conf_p25", F.lit(1.0)), "dm_n_doc_types": sum((F.col(f"dm_has_{p}") for p in evidence), F.lit(0))})
    return out.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0 if c.endswith("_cov") else 0.0)).alias(c) for c in out.columns if c != key])


def sponsor_letter(text: Column) -> dict[str, Column]:
    """Ten keys of the attestation letters' text (null: no such page): what it says of sponsor, name and class, against the fields."""
    spn = F.regexp_extract(text, r"(?i)SPN[-_ ]?(\d{4})", 1)
    classes = r"(?i)\b(XW-?[12]|DIP-?1|MED-?3|TRANSIT-?7)\b"
    near = F.regexp_extract(F.regexp_extract(text, r"(?i)class\s+([A-Za-z0-9\-]{3,10})", 1), classes, 1)
    visa = F.regexp_replace(F.upper(F.when(near != "", near).otherwise(F.regexp_extract(text, classes, 1))), "^([A-Z]+)-?", "$1-")
    said = F.regexp_extract(text, r"(?i)attests?\s+that\s+(.{2,60}?)\s+is\s+expected", 1)
    name, own = squash(said), squash(F.col("applicant_name"))
    told = {"spn": spn != "", "name": said != "", "class": visa.rlike("[0-9]")}
    able = {"spn": F.col("sponsor_id").rlike(r"^SPN-\d{4}$"), "name": (F.length(own) > 3) & (F.length(name) > 3), "class": ~F.col("visa_class").isin("", "unknown")}
    same = {"spn": F.concat(F.lit("SPN-"), spn) == F.col("sponsor_id"), "name": ratio(name, own) >= 0.80, "class": visa == F.col("visa_class")}
    off = sum((_bit(told[k] & able[k] & ~same[k]) for k in told), F.lit(0.0))
    return {
        "spl_present": _bit(text.isNotNull()), **{f"spl_{k}_found": _bit(told[k]) for k in told}, **{f"spl_{k}_match": _bit(told[k] & able[k] & same[k]) for k in told},
        "spl_caseid_clause": _bit(squash(text).contains("activecaseid")), "spl_n_mismatch": off, "spl_manual_revoked": _bit(told["spn"] & F.concat(F.lit("SPN-"), spn).isin(REVOKED_SPONSORS)),
    }


def cross_source(readings: DataFrame, key: str = KEY) -> DataFrame:
    """key, field, sources, votes, distinct, top_share, conflict: one vote a source, its strongest reading, the first of equals.

    readings: key, field, source, value, w, seq.  A conflict needs two values over two sources.
    """
    vote = readings.where("value is not null").groupBy(key, "field", "source").agg(F.max_by("value", F.struct("w", (-F.col("seq")).alias("s"))).alias("value"))
    n = vote.groupBy(key, "field", "value").agg(F.count("*").alias("n"))
    return n.groupBy(key, "field").agg(F.sum("n").alias("votes"), F.count("*").alias("distinct_values"), (F.max("n") / F.sum("n")).alias("top_share"), ((F.count("*") >= 2) & (F.sum("n") >= 2)).cast("int").alias("conflict"))


def agreement(votes: DataFrame, formed: Column, key: str = KEY) -> DataFrame:
    """key, field, a struct<nsrc, ndist, top, types, pairs> of the votes (key, field, ptype, w, seq, value, sq) of each field.

    nsrc: page types that vote.  Votes of one value form a cluster: equal ones where the field is formed, else of near keys.  ndist: clusters; top:
    the heaviest one's share; types: page types of the two heaviest, empty where they are one; pairs: for each of SOURCE_PAIRS whether
    both types' heaviest votes are the same (1), are not (-1), or one is missing (0).
    """
    one = W.partitionBy(key, "field").orderBy(F.col("w").desc(), "seq", "value", "sq", "ptype")
    ranked = votes.withColumns({"formed": formed, "i": F.row_number().over(one)})
    same = lambda a, b: F.when(F.col("formed"), F.col(f"{a}value") == F.col(f"{b}value")).otherwise(ratio(F.col(f"{a}sq"), F.col(f"{b}sq")) >= SOURCE_RATIO)
    # Near pairs within a field of a packet, of which there are as many votes as pages.
    lighter = ranked.select(key, "field", F.col("i").alias("j"), F.col("value").alias("late_value"), F.col("sq").alias("late_sq"))
    able = ranked.join(lighter, [key, "field"]).where("i < j").where(F.col("formed") | (bound(F.col("late_sq"), F.col("sq")) >= SOURCE_RATIO))
    near = able.withColumn("same", same("late_", "")).where("same").groupBy(key, "field", F.col("j").alias("i")).agg(F.collect_set("i").alias("near"))
    vote = F.struct("i", F.coalesce("near", F.array().cast("array<int>")).alias("near"), "w", "ptype")
    lists = ranked.join(near, [key, "field", "i"], "left").groupBy(key, "field").agg(F.sort_array(F.collect_list(vote)).alias("xs"))

    # A vote's cluster is the first near vote that leads one, or its own.
    def lead(done, x):
        led = F.filter(x["near"], lambda r: F.exists(done, lambda d: (d["i"] == r) & (d["lead"] == r)))
        return F.concat(done, F.array(F.struct(x["i"].alias("i"), F.coalesce(F.array_min(led), x["i"]).alias("lead"))))

    led = F.aggregate("xs", F.array().cast("array<struct<i:int,lead:int>>"), lead)
    each = lists.select(key, "field", F.explode(F.zip_with("xs", led, lambda x, d: F.struct(d["lead"].alias("lead"), x["w"].alias("w"), x["ptype"].alias("ptype")))).alias("c")).select(key, "field", "c.*")
    clusters = each.groupBy(key, "field", "lead").agg(F.sum("w").alias("w"), F.collect_set("ptype").alias("types"))
    found = clusters.groupBy(key, "field").agg(F.count("*").cast("int").alias("ndist"), F.sum("w").alias("all"), F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("less"), "lead", "types"))).alias("cs"))
    both = F.when(F.col("ndist") > 1, F.array_sort(F.array_union(F.col("cs")[0]["types"], F.get("cs", F.lit(1))["types"])))
    firsts = [F.min_by(F.struct("value", "sq"), F.when(F.col("ptype") == t, F.col("i"))).alias(t) for t in sorted({t for pair in SOURCE_PAIRS for t in pair})]
    heads = ranked.groupBy(key, "field").agg(F.count_distinct("ptype").cast("int").alias("nsrc"), F.first("formed").alias("formed"), *firsts)
    pair = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), 0).when(same(f"{a}.", f"{b}."), 1).otherwise(-1)
    heads = heads.select(key, "field", "nsrc", F.array(*[pair(a, b) for a, b in SOURCE_PAIRS]).alias("pairs"))
    top = -F.col("cs")[0]["less"] / F.when(F.col("all") == 0, 1.0).otherwise(F.col("all"))
    types = F.when(F.size(both) > 1, both).otherwise(F.array().cast("array<string>"))
    return heads.join(found, [key, "field"]).select(key, "field", F.struct("nsrc", "ndist", top.alias("top"), types.alias("types"), "pairs").alias("a"))


def source_features(votes: DataFrame, cases: DataFrame, formed: list[str], key: str = KEY) -> DataFrame:
    """102 keys of how far the sources of each field agree.

    votes: key, field, ptype, pg_pos, seq, w, redacted, value (normalised; null: none).  A page has one vote a field, its
    strongest reading, the first of equals.  A conflict needs two values over two page types.
    """
    fields = list(FIELD_ALIASES)
    free = ~F.col("field").isin(*formed)
    good = over_distinct(votes.where("not redacted and value is not null").withColumn("sq", squash(F.col("value"))), "sq", best_label, "l")
    good = good.where(~free | ((F.length("sq") >= 2) & ~F.col("l.like")))
    best = good.groupBy(key, "field", "ptype", "pg_pos").agg(F.max_by(F.struct("w", "value", "sq", "seq"), F.struct("w", (-F.col("seq")).alias("s"))).alias("b"))
    told = agreement(best.select(key, "field", "ptype", "b.*"), ~free, key)
    red = votes.where("redacted").groupBy(key, "field").agg(F.lit(1.0).alias("red"))
    both = told.join(red, [key, "field"], "full_outer")
    nsrc, conflict = F.coalesce("a.nsrc", F.lit(0)), F.coalesce(F.size("a.types") > 1, F.lit(False))
    each = {"nsrc": nsrc, "ndist": F.coalesce("a.ndist", F.lit(0)), "top": F.coalesce("a.top", F.lit(0.0)), "conflict": conflict, "red": F.coalesce("red", F.lit(0.0)), "single": nsrc == 1, "absent": nsrc == 0}
    each |= {f"{a}_{b}": F.coalesce(F.get("a.pairs", F.lit(i)), F.lit(0)) for i, (a, b) in enumerate(SOURCE_PAIRS)}
    rows = both.select(key, "field", F.coalesce("a.types", F.array().cast("array<string>")).alias("types"), *[v.cast("double").alias(k) for k, v in each.items()])
    wide = rows.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.col(k))).alias(f"xs_{k}_{f}") for f in fields for k in each], *[F.count_if(F.array_contains("types", t)).cast("double").alias(f"xs_confsrc_{t}") for t in SOURCE_TYPES]
    )
    wide = cases.select(key).join(wide, key, "left")
    wide = wide.select(key, *[F.coalesce(F.col(c), F.lit(1.0 if c.startswith("xs_absent_") else 0.0)).alias(c) for c in wide.columns if c != key])
    total = lambda k: sum((F.col(f"xs_{k}_{f}") for f in fields), F.lit(0.0))
    any_ = lambda *fs: F.greatest(*[F.col(f"xs_conflict_{f}") for f in fs])
    return wide.withColumns({
        "xs_n_conflicts": total("conflict"), "xs_any_conflict": any_(*fields), "xs_n_redacted": total("red"), "xs_n_singleton": total("single") + total("absent"),
        "xs_identity_conflict": any_("applicant_name", "species_code", "home_world"), "xs_sponsor_conflict": F.col("xs_conflict_sponsor_id"), "xs_policy_conflict": any_("visa_class", "fee_status"),
    })


def notes(lines: DataFrame, key: str = KEY) -> DataFrame:
    """Score and decision of adjudicators' notes, and how well each reason was read; lines go in page order and may wrap."""
    sq = squash(F.col("t"))
    own = lines.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pg_pos", "ln_pos", sq.alias("sq")))), lambda x: x["sq"]).alias("xs"))
    able = own.where(F.exists("xs", lambda x: (F.length(x) >= 5)))
    told = able.select(key, note_signals(F.col("xs")).alias("n"))
    found = F.size("n.reasons").cast("double")
    return told.select(
        key, F.col("n.score").alias("note_score"), *[_bit(F.col("n.decision") == d).alias(f"note_{d.lower()}") for d in DECISIONS], _bit(F.col("n.decision").isNotNull()).alias("note_any"),
        found.alias("note_reasons"), _bit(found > 0).alias("note_reason_any"), *[F.coalesce(F.col("n.reasons")[r], F.lit(0.0)).alias(f"note_reason_{r}") for r in REASONS],
    )


def slip(evidence: Column) -> dict[str, Column]:
    """How far a slip's flags can be relied on; evidence_none is 1 where neither slip nor note says anything about risk."""
    anchor, resolved, n = evidence["slip_anchor"], evidence["slip_resolved"], F.size(evidence["slip_flags"])
    noted = F.coalesce(F.size(evidence["note_flags"]), F.lit(0))
    return {
        "slip_anchor": _bit(anchor), "slip_resolved": _bit(anchor & resolved), "slip_unresolved": _bit(anchor & ~resolved), "slip_clean": _bit(anchor & resolved & (n == 0)), "slip_n": F.coalesce(n, F.lit(0)).cast("double"),
        "slip_note_n": noted.cast("double"), "slip_name_conflict": _bit(evidence["name_conflict"]), "evidence_none": 1.0 - _bit(F.coalesce(anchor, F.lit(False)) | (noted > 0)),
    }


def resolution() -> dict[str, Column]:
    """How well each field is held: resolved at all, rank and number of its readings, form, and where the fee comes from."""
    placeholder = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    open_ = {f: F.col(f).isNull() | (F.col(f) == "") | (F.col(f) == placeholder[f]) for f in CONTENT_FIELDS}
    full = lambda c, form: _bit(F.col(c).rlike(f"^{form}$"))
    return {
        **{f"resolved_{f}": _bit(~c) for f, c in open_.items()}, "n_unknown_fields": sum((_bit(c) for c in open_.values()), F.lit(0.0)),
        **{f"{k}_{f}": F.col(f"{k}_{f}").cast("double") for k in ("rank", "nev") for f in FIELD_ALIASES},
        **{f"fee_src_{x}": _bit(F.col("fee_source") == x) for x in FEE_SOURCES}, "fee_is_prior": _bit(F.col("fee_source") == "prior"), "fee_observed": _bit(F.col("fee_source") != "prior"),
        "visa_unknown": _bit(F.coalesce(F.col("visa_class"), F.lit("")).isin("", "unknown")), "sponsor_wellformed": full("sponsor_id", r"SPN-\d{4}"), "sponsor_placeholder": _bit(F.col("sponsor_id") == PLACEHOLDER["sponsor_id"]),
        "date_wellformed": full("arrival_date", r"\d{4}-\d{2}-\d{2}"), "date_placeholder": _bit(F.col("arrival_date") == PLACEHOLDER["arrival_date"]),
        "name_n_tokens": F.size(F.filter(F.split(F.coalesce("applicant_name", F.lit("")), r"\s+"), lambda x: x != "")).cast("double"), "species_is_upper_snake": full("species_code", "[A-Z][A-Z_]{3,}"),
    }


def packet_shape(lines: DataFrame, pages: DataFrame, key: str = KEY) -> DataFrame:
    """Which page types a packet has, lines a page, the share of lines below 0.90, and which marks stand in some line.

    pages: key, pg_pos, ptype, every page.  A packet without lines has its pages still.
    """
    of = pages.groupBy(key).agg(*[F.max((F.col("ptype") == t).cast("double")).alias(f"has_page_{t}") for t in PAGE_RANK], F.count_distinct("ptype").cast("double").alias("n_page_types"), F.count("*").alias("_n"))
    sq = squash(F.col("t"))
    told = lines.groupBy(key).agg(F.count("*").alias("_l"), F.avg((F.col("s") < 0.9).cast("double")).alias("conf_lt_90_frac"), *[F.max(_bit(sq.contains(x))).alias(f"tok_{x}") for x in PAGE_MARKS])
    out = of.join(told, key, "left").withColumn("lines_per_page", F.coalesce("_l", F.lit(0)) / F.greatest(F.col("_n"), F.lit(1)))
    return out.drop("_n", "_l").na.fill(0.0)


def name_agreement(stated: DataFrame, key: str = KEY) -> DataFrame:
    """key, n_distinct_names, name_agreement: the least ratio of any stated name to the first, for stated (key, pg_pos, ln_pos, value)."""
    names = stated.select(key, "pg_pos", "ln_pos", squash(F.col("value")).alias("sq"))
    first = names.groupBy(key).agg(F.min_by("sq", F.struct("pg_pos", "ln_pos")).alias("first"))
    each = names.groupBy(key, "sq").agg(F.lit(1.0).alias("one")).join(first, key)
    return each.select(key, "one", ratio(F.col("sq"), F.col("first")).alias("r")).groupBy(key).agg(F.sum("one").alias("n_distinct_names"), F.min("r").alias("name_agreement"))


def one_hots(columns: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """A bit for each closed value."""
    columns = {k: VOCABULARY[k] for k in ("visa_class", "fee_status")} if columns is None else columns
    return {f"is_{c}_{squash_name(v)}": _bit(F.col(c) == v) for c, vs in columns.items() for v in vs}


def squash_name(v: str) -> str:
    return "".join(ch for ch in v.lower() if ch.isalnum())


def design(lines: DataFrame, types: DataFrame, fields: DataFrame, pages: DataFrame, votes: DataFrame, text: str = "visible_text") -> DataFrame:
    """case_id and all families; fields is one row a case with the visible text and that of its sponsor and fee pages.  Absent evidence is 0."""
    t = F.col(text)
    fields = fields.withColumn("_held", TEXT_STRINGS.scan(squash(t)))
    holds = TEXT_STRINGS.holds(F.col("_held"))
    flat = {**one_hots(), **flag_bits(F.col("risk_flags")), **raw_form(t, holds)}
    more = {**policy(t, holds), **dates(t, F.col("arrival_date")), **fee_arithmetic(F.col("fee_text")), **biometric(t), **sponsor_letter(F.col("sponsor_text"))}
    out = fields.select(KEY, text, "arrival_date", "fee_status", "visa_class", "sponsor_id", "applicant_name", "risk_flags", "fee_text", "sponsor_text", "_held", *[c.alias(n) for n, c in flat.items()])
    out = out.select(KEY, *flat, *[c.alias(n) for n, c in more.items()])
    formed = ["arrival_date", "fee_status", "visa_class", "sponsor_id"]
    for family in (shape(lines), page_profile(lines, pages), stamps(lines, pages), damage(lines, pages, fields.select(KEY, text, "_held")), notes(lines), source_features(votes, fields, formed)):
        out = out.join(family, KEY, "left")
    # A note that approves what a disqualifying flag speaks against.
    return out.withColumn("note_find_vs_dqflag", _bit((F.col("note_approved") == 1) & (F.col("pol_dq_flag") == 1))).na.fill(0.0)
