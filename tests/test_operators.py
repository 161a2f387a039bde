"""Operators of the packet plan on hand-made values, with expectations from their rules."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docket.constants import CAUTION_MODES, DECISIONS, PLACEHOLDER
from docket.functions import fuzzy
from docket.functions import text as tx
from docket.operators import candidates, consensus, decide, features, flags, layout, respace, score, trust, vocab
from docket.plans import packets


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function,value,want",
    [
        (tx.squash, "Fee Status: PAID!", "feestatuspaid"),
        (tx.canon, "Oil|!sbz rn", "01111582m"),
        (tx.eval_key, "  A \t b ", "a b"),
        (tx.clean, " :;= value .-", "value .-"),
        (tx.id_digits, "00OQ1", "1"),
        (tx.id_digits, "000", "0"),
        (tx.safe_date, "2026-02-30", "1900-01-01"),
        (tx.safe_date, "2026-06-30", "2026-06-30"),
        (tx.norm_date, "on 2O26 / l / 5", "2026-01-05"),
        (tx.norm_date, "2026-06-31", None),
        (tx.norm_date, "2026-02-30 2026-03-01", None),
        (tx.norm_visa, "class xw 1", "XW-1"),
        (tx.norm_visa, "XW1", "XW1"),
        (tx.norm_visa, "nothing", None),
        (tx.norm_fee_exact, "Fee: UNPALD", "unpaid"),
        (tx.norm_fee_exact, "pd", "paid"),
        (tx.norm_fee_exact, "waved", "waived"),
        (tx.norm_fee_exact, "?", None),
        (tx.repair_sponsor, "spn 47O5", "SPN-4705"),
        (tx.repair_sponsor, "5PN-1234", "SPN-1234"),
        (tx.repair_sponsor, "Attestation Letter", None),
        (tx.norm_sponsor, "Manual correction: sponsor is SPN-4705.", "SPN-4705"),
        (tx.repair_name, "MiraixVeerix", "Miraix Veerix"),
        (tx.repair_name, "lxodane", "Ixodane"),
        (tx.repair_name, "unknown", "unknown"),
        (tx.repair_name, "la Bo", "la Bo"),
        (tx.repair_name, "loXo lo9e", "lo Xo lo9e"),
        (tx.fee_from_receipt, "Amount $120.00 Waiver Code: N/A", "paid"),
        (tx.fee_from_receipt, "Amount $0.00 Waiver Code: HX-1", "waived"),
        (tx.fee_from_receipt, "Amount $0.00 Waiver Code: N/A", "unknown"),
        (tx.fee_from_receipt, "Amount $5.00", None),
    ],
)
def test_text(spark, function, value, want):
    assert one(spark, function(F.col("v")), v=value) == want


@pytest.mark.parametrize("value,want", [("", True), ("[lost]", True), ("a", True), ("name redacted", True), ("Ixodane Luzarn", False), ("(white out)", True)])
def test_redacted(spark, value, want):
    assert one(spark, tx.is_redacted(F.col("v")), v=value) is want


def test_ratio_is_not_symmetric(spark):
    assert round(fuzzy.matched("observedflags", "reason"), 3) != round(fuzzy.matched("reason", "observedflags"), 3)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(60)]
    pairs = list(zip(words, reversed(words), strict=True))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.ratio("a", "b").alias("r"), fuzzy.bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(r["r"] == SequenceMatcher(None, r["a"], r["b"]).ratio() <= r["m"] + 1e-12 for r in rows)


@pytest.mark.parametrize("pattern_first", [True, False])
def test_window_is_the_first_best_of_all(pattern_first):
    rng = random.Random(9)
    for _ in range(150):
        pattern, text = ("".join(rng.choice("abcd") for _ in range(n)) for n in (rng.randrange(1, 9), rng.randrange(0, 25)))
        least, most, best = max(3, int(0.55 * len(pattern))), int(1.5 * len(pattern)), (0.0, 0, 0)
        spans = [(0, len(text))] if len(text) < least else [(i, i + n) for n in range(least, min(most, len(text)) + 1) for i in range(len(text) - n + 1)]
        for i, j in spans if text else ():
            r = fuzzy.matched(pattern, text[i:j]) if pattern_first else fuzzy.matched(text[i:j], pattern)
            if r > best[0]:
                best = (r, i, j)
        assert fuzzy.window(pattern, text, 0.55, 1.5, pattern_first) == best


def test_windows_and_labels():
    assert fuzzy.window("none", "xxnonexx", 0.55, 1.5, True)[0] == 1.0
    assert fuzzy.label_of("feestatus")[0] == "fee_status" and fuzzy.label_of("caseid")[0] is None
    assert fuzzy.label_of("observedflags") == (None, 0.0, True)
    assert fuzzy.flags_in("activewarrantbiohazardred", 0.62) == ["active_warrant", "biohazard_red"]
    assert fuzzy.flags_in("", 0.62) == [] and fuzzy.flags_in("cboanvedflgecnom", 0.70) == []


def test_notes(spark):
    score_, decision, reasons = fuzzy.notes_of(["manualadjudicatornote", "findingdenied", "reasonmandatoryfeeunpaid"])
    assert (score_, decision) == (1.0, "DENIED") and "fee_unpaid" in reasons
    assert fuzzy.notes_of(["find1ng", "approved"])[1] == "APPROVED" and fuzzy.notes_of(["nothinghere"]) == (0.0, None, {})
    lines = spark.createDataFrame([("c", 0, 0, "Finding: NEEDS REVIEW"), ("c", 0, 1, "Reason: Revoked sponsor"), ("d", 0, 0, "x")], "case_id string, pg_pos int, ln_pos int, t string")
    got = {r["case_id"]: r for r in features.notes(lines).collect()}
    assert got["c"]["note_needs_review"] == 1.0 and got["c"]["note_reason_revoked_spn"] == 1.0 and got["c"]["note_denied"] == 0.0


def test_notes_take_the_next_line_only_where_nothing_follows():
    assert fuzzy.notes_of(["findingdenled", "approved"])[1] == "DENIED"
    assert fuzzy.notes_of(["finding", "approved" + "x" * 30])[1] == "APPROVED"
    assert fuzzy.notes_of(["reason" + "q" * 41 + "revokedsponsor"])[2] == {}  # a reason begins right after its anchor
    assert fuzzy.notes_of(["reasonrevoked", "sponsor"])[2] == {"revoked_spn": 1.0}
    assert 0.78 <= fuzzy.notes_of(["reasonrevokedsponzor"])[2]["revoked_spn"] < 1.0


def test_page_profile_counts_pages_without_lines(spark):
    kinds = list(features.PAGE_RANK)
    pages = spark.createDataFrame([("a", i, k) for i, k in enumerate(k for k in kinds if k != "other")] + [("b", 0, "other"), ("b", 1, kinds[0])], "case_id string, pg_pos int, ptype string")
    lines = spark.createDataFrame([("a", i, 0, "x", 0.5 + i / 10) for i in range(len(kinds) - 1)] + [("b", 0, 0, "y", 0.9)], "case_id string, pg_pos int, ln_pos int, t string, s double")
    got = {r["case_id"]: r for r in features.page_profile(lines, pages).collect()}
    assert got["a"]["pp_missing"] == 0.0 and got["b"]["pp_missing"] == len(kinds) - 2
    assert (got["b"]["pp_worst"], got["b"]["pp_spread"], got["b"][f"pp_{kinds[0]}_pages"], got["b"][f"pp_{kinds[0]}_conf"]) == (0.0, 0.9, 1.0, 0.0)


def test_names_below_their_labels_make_a_conflict(spark):
    rows = [("a", 0, 0, "Planetary Registry", 0.99), ("a", 0, 1, "Registry name", 0.99), ("a", 0, 2, "Zorblax Quill", 0.98), ("a", 1, 0, "Work Authorization Intake", 0.99), ("a", 1, 1, "Applicant: Other Person", 0.99)]
    rows += [("b", 0, 0, "Planetary Registry", 0.99), ("b", 0, 1, "Registry name: Same Person", 0.99), ("b", 1, 0, "Work Authorization Intake", 0.99), ("b", 1, 1, "Applicant", 0.99), ("b", 1, 2, "same person", 0.99)]
    rows += [("c", 0, 0, "Applicant: Nobody Here", 0.99)]
    lines = spark.createDataFrame(rows, "case_id string, pg_pos int, ln_pos int, t string, s double")
    names = flags.stated_names(lines)
    assert sorted((r["case_id"], r["kind"], r["value"], r["conf"]) for r in names.collect()) == [("a", "intake", "otherperson", 0.99), ("a", "registry", "zorblaxquill", 0.98), ("b", "intake", "sameperson", 0.99), ("b", "registry", "sameperson", 0.99)]
    assert {r["case_id"]: r["name_conflict"] for r in flags.identity_conflict(names).collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("value,want", [("Fee: unpald", "unpaid"), ("wa1ved", "waived"), ("zzz", None), ("", None)])
def test_fee_by_nearness(spark, value, want):
    assert one(spark, fuzzy.norm_fee(F.col("v")), v=value) == want


def corrected(spark, text):
    rows = candidates.corrected(spark.createDataFrame([(text,)], "t string")).collect()
    return (rows[0]["field"], rows[0]["value"]) if rows else (None, None)


def test_corrections(spark):
    assert corrected(spark, "Manualcorrection:sponsorisSPN-4705.") == ("sponsor_id", "SPN-4705")
    assert corrected(spark, "Manual correction: fee status is paid.") == ("fee_status", "paid")
    assert corrected(spark, "nothing of the kind is here") == (None, None)
    assert corrected(spark, "Manual correction: visa clas is XW-2 . ") == ("visa_class", "XW-2")  # a letter lost
    assert corrected(spark, "Manual correction: sponsorr id is SPN-0001") == ("sponsor_id", "SPN-0001")  # a letter gained
    assert corrected(spark, "Manual correction: fee is") == (None, None)


def test_consensus_breaks_ties_by_first_seen(spark):
    rows = [("c", "f", "a", 1.0, 2, 5), ("c", "f", "b", 1.0, 2, 1), ("c", "g", "x", 0.4, 3, 2), ("c", "g", "y", 0.3, 2, 1), ("c", "g", "y", 0.3, 4, 9), ("c", "g", None, 9.0, 1, 0)]
    got = {r["field"]: tuple(r)[2:] for r in consensus.resolve(spark.createDataFrame(rows, "case string, field string, value string, w double, rank int, seq int"), ["case", "field"]).collect()}
    assert got["f"] == ("b", 1.0, 1, 2) and got["g"] == ("y", 0.6, 2, 2)


def test_greedy_consensus(spark):
    rows = [("c", "ixodaneluzarn", "Ixodane Luzarn", 0.9, 2, 1), ("c", "ixodaneluzam", "Ixodane Luzam", 0.5, 3, 2), ("c", "zoltansmith", "Zoltan Smith", 1.0, 4, 3)]
    got = consensus.resolve_free(spark.createDataFrame(rows, "case string, key string, value string, w double, rank int, seq int"), ["case"], 0.8).first()
    assert (got["rep"], round(got["score"], 6), got["n"], got["rank"]) == ("Ixodane Luzarn", 1.4, 2, 2)


@pytest.mark.parametrize("field,value,want,how", [("fee_status", "unpa1d", "unpaid", "exact"), ("fee_status", "unqaid", "unpaid", "similar"), ("visa_class", "XW-9", "XW-9", "kept"), ("species_code", "ORION", "ORION_GRAYS", "contained"), ("home_world", "Qo'noS Prime", "Qo'noS Prime", "kept"), ("species_code", "KLINGON_WARRIOR", "KLINGON_WARRIOR", "kept"), ("visa_class", "dip 1", "DIP-1", "exact"), ("home_world", "unknown", "unknown", "none")])
def test_snap(spark, field, value, want, how):
    got = one(spark, vocab.match_detail(F.col("v"), field), v=value)
    assert (got["value"], got["how"]) == (want, how)
    assert one(spark, vocab.snap(vocab.snap(F.col("v"), field), field), v=value) == want


def test_rescue_from_text(spark):
    assert one(spark, vocab.find_in_text(F.col("v"), "home_world"), v="bound for Titan Freep0rt today") == "Titan Freeport"
    assert one(spark, vocab.find_in_text(F.col("v"), "home_world"), v="Titan Freeport or Eris Relay") is None
    assert one(spark, vocab.find_sponsor_in_text(F.col("v")), v="SPN-1234 and spn 1234") == "SPN-1234"
    assert one(spark, vocab.find_sponsor_in_text(F.col("v")), v="SPN-1234 and SPN-4321") is None


@pytest.mark.parametrize(
    "value,text,want",
    [
        ("IxodaneLuzarn", "Name: Ixodane Luzarn", "Ixodane Luzarn"), ("unknown", "un known", "unknown"), ("", "x", ""), ("Zoltan Smith", "Zoltan Smith", "Zoltan Smith"),
        ("IxodaneLuzarn", "I xodaneLuzarn", "IxodaneLuzarn"), ("Ixodane-Luzarn", "Ixodane Luzarn", "Ixodane-Luzarn"), ("JSmithers", "J Smithers", "JSmithers"), ("IxodaneLuzarn", "Ixodane\nLuzarn", "Ixodane Luzarn"),
    ],
)
def test_respace(spark, value, text, want):
    got = one(spark, respace.repair(F.col("v"), F.col("t")), v=value, t=text)
    assert got == want and got.replace(" ", "") == value.replace(" ", "")


def test_rows_by_a_scan(spark):
    rng = random.Random(3)
    boxes = [(c, i, rng.uniform(0, 60), rng.uniform(0, 400), rng.uniform(6, 20)) for c in range(20) for i in range(15)]
    df = spark.createDataFrame([(c, 0, i, f"t{i}", y, y + h, x, x + 10) for c, i, y, x, h in boxes], "case_id int, pg_pos int, ln_pos int, t string, y0 double, y1 double, x0 double, x1 double")
    got = {(r["case_id"], r["ln_pos"]): r["row_id"] for r in layout.group_rows(df, ["case_id", "pg_pos"]).collect()}
    for c in range(20):
        mine, row, last = sorted(((y + h / 2, x, i, h) for k, i, y, x, h in boxes if k == c)), 0, None
        for cy, _, i, h in mine:
            if last and abs(cy - last[0]) > 0.6 * max(min(h, last[1]), 8.0):
                row += 1
            last = (cy, h)
            assert got[c, i] == row


def test_doc_lines_coerce(spark):
    page = "struct<page:int,w:string,h:string,hidden_text:string,lines:array<struct<t:string,s:string,x0:string,y0:string,x1:string,y1:string>>>"
    rows = [("A-1", [(0, "0", "x", "secret", [("hi", "0.5", "1", "2", "3", "4"), None, (None, "nan", None, "q", "1", "1")]), None, (1, "10", "20", None, None)]), ("A-2", []), ("A-3", None)]
    got = layout.doc_lines(spark.createDataFrame(rows, f"case_id string, pages array<{page}>")).collect()
    assert [(r["ln_pos"], r["t"], r["s"], r["y0"], r["pw"], r["ph"]) for r in got] == [(0, "hi", 0.5, 2.0, 1.0, 1.0), (2, "", 0.0, 0.0, 1.0, 1.0)]


def test_flags_of_pages(spark):
    lines = [("c", 0, 0, "FORM B-13 Biometric Scan Slip"), ("c", 0, 1, "Observed flags: active_warrant"), ("d", 0, 0, "Manual adjudicator note"), ("d", 0, 1, "Reason: Disqualifying risk flag: planetary_embargo"), ("e", 0, 0, "Biometric scan slip"), ("e", 0, 1, "Observed flags: none"), ("f", 0, 0, "PRIOR DENIAL STAMP rescinded")]
    df = spark.createDataFrame(lines, "case_id string, pg_pos int, ln_pos int, t string")
    names = spark.createDataFrame([("d", "registry", "Zoltan Smith", 0.99, 1), ("d", "intake", "Ixodane Luzarn", 0.99, 2), ("f", "registry", "Zoltan Smith", 0.5, 1)], "case_id string, kind string, value string, conf double, ord int")
    got = {r["case_id"]: r["risk_flags"] for r in flags.detect(df, df, names).collect()}
    assert got == {"c": "active_warrant", "d": "identity_conflict|planetary_embargo", "e": "none", "f": "rescinded_denial"}


def test_decide_is_the_brute_force_argmax(spark):
    rng = random.Random(5)
    ps = [[a / 20, b / 20, (20 - a - b) / 20] for a in range(21) for b in range(21 - a)]
    rng.shuffle(ps)
    df = spark.createDataFrame([(p,) for p in ps], "p array<double>").select("p", decide.decide(F.col("p")).alias("d"))
    table = decide.payoff(-8.0)
    for r in df.collect():
        p = r["p"]
        ev = [sum(p[t] * table[a][t] for t in range(3)) - 8 * p[a] * (1 - p[a]) for a in range(3)]
        assert ev[r["d"]["action"]] >= max(ev) - 1e-9 and r["d"]["decision"] == DECISIONS[r["d"]["action"]]
        assert 0.01 <= r["d"]["confidence"] <= 0.99


@pytest.mark.parametrize("mode", CAUTION_MODES)
def test_caution_only_sends_to_review(spark, mode):
    rows = [(d, x, y) for d in DECISIONS for x in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame(rows, "d string, dis int, ref int").withColumn("p", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    for r in df.select("*", decide.caution(F.col("d"), F.lit(0.7), F.col("p"), F.col("dis"), F.col("ref"), mode).alias("c")).collect():
        fires = mode != "off" and (r["dis"] or (r["ref"] and mode.startswith("any")))
        moved = fires and r["d"] != "NEEDS_REVIEW" and (r["d"] == "APPROVED" or mode.endswith("_all"))
        assert tuple(r["c"]) == (("NEEDS_REVIEW", 0.2) if moved else (r["d"], 0.7))
    with pytest.raises(ValueError):
        decide.caution(F.lit("x"), F.lit(1), F.lit(1), F.lit(1), F.lit(1), "approved")


def test_score(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.8), (2, 1, 0.5), (1, 2, 0.6)], "truth int, action int, confidence double")
    r = score.challenge_score(df).first()
    assert (r["classification"], r["false_approvals"], r["accuracy"]) == (80 * (8 - 4 + 1 + 2) / 32, 1, 0.25)
    assert abs(r["brier"] - (0.01 + 0.64 + 0.25 + 0.36) / 4) < 1e-12


def test_hidden_layer_is_measured_only(spark):
    text = "Home World: Nowhere\nvisa class XW-2\n"
    assert one(spark, trust.hidden_value(F.col("v"), "home_world"), v=text) == "Nowhere"
    assert one(spark, trust.hidden_value(F.col("v"), "visa_class"), v=text) == "XW-2"
    assert [one(spark, trust.agreement(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("x", ""), ("unknown", "y"), ("Ab", "aB "), ("Titan Freeport", "Titan Freepor"), ("abc", "xyz"))] == ["no_hidden", "no_visible", "agree", "near", "disagree"]
    assert trust.safe_columns(["a", "hidden_x", "inj_y"]) == ["a"]
    with pytest.raises(ValueError):
        trust.check_lineage(["hidden_text"])


def test_cross_source(spark):
    rows = [("c", "f", "s1", "a", 1.0, 2), ("c", "f", "s1", "b", 1.0, 1), ("c", "f", "s2", "a", 0.2, 3), ("d", "f", "s1", "a", 1.0, 1)]
    got = {r["case_id"]: tuple(r)[2:] for r in features.cross_source(spark.createDataFrame(rows, "case_id string, field string, source string, value string, w double, seq int")).collect()}
    assert got == {"c": (2, 2, 0.5, 1), "d": (1, 1, 1.0, 0)}
    assert PLACEHOLDER["sponsor_id"] == "SPN-0000"


def packet(lines):
    """Line rows (case, page, line, text, confidence) with a geometry."""
    return [(c, p, i, t, s, 10.0, 20.0 * i, 110.0, 20.0 * i + 10, 200.0, 100.0) for c, p, i, t, s in lines]


LINES = "case_id string, pg_pos int, ln_pos int, t string, s double, x0 double, y0 double, x1 double, y1 double, pw double, ph double"


def test_stamps_and_damage(spark):
    lines = spark.createDataFrame(packet([
        ("c", 0, 0, "Finding: denied", 0.9), ("c", 0, 1, "DEN1ED", 0.7), ("c", 1, 0, "SAMPLE DENIAL", 0.9), ("c", 2, 0, "SAMPLE DENIAL", 0.9), ("c", 2, 1, "Case ID: MIB-1", 0.5), ("c", 2, 2, "[torn off]", 0.8),
    ]), LINES)
    pages = spark.createDataFrame([("c", 0, "note", False), ("c", 1, "other", True), ("c", 2, "intake", False), ("c", 3, "intake", False), ("d", 0, "other", False)], "case_id string, pg_pos int, ptype string, foreign boolean")
    got = {r["case_id"]: r.asDict() for r in features.stamps(lines, pages).collect()}
    c = got["c"]
    assert len(c) == 124 and c["st_denied_n"] == 4 and c["st_denied_pages"] == 3 and c["st_denied_on_note"] == 1 and c["st_denied_alone"] == 1  # a sample denial is a denial by its letters
    assert c["st_sampledenial_pagefrac"] == 0.5 and c["st_sampledenial_watermarky"] == 1 and c["st_denial_wm_trap"] == 1 and c["st_real_denial_mark"] == 0
    assert c["st_denied_maxw"] == 0.5 and c["st_denied_maxh"] == 0.1 and c["st_denied_conf"] == 0.9 and not any(v for k, v in got["d"].items() if k != "case_id")
    text = spark.createDataFrame([("c", "Finding: denied [torn off] Torn"), ("d", None)], "case_id string, visible_text string")
    got = {r["case_id"]: r.asDict() for r in features.damage(lines, pages, text).collect()}
    c = got["c"]
    assert len(c) == 30 and (c["dm_n_blank_pages"], c["dm_n_foreign_pages"], c["dm_dup_intake"], c["dm_n_brackets"], c["dm_damage_words"]) == (2, 1, 1, 1, 1)
    assert c["dm_label_coverage"] == (1 / 2 + 1 / 8 + 0) / 3 and c["dm_intake_cov"] == 1 / 8 and c["dm_missing_labels"] == 1 + 7 + 8 and c["dm_slip_cov"] == -1
    assert c["dm_lowconf_lines"] == 2 and c["dm_lines_per_page"] == 1.5 and got["d"]["dm_conf_p25"] == 1 and got["d"]["dm_n_blank_pages"] == 1


def test_letters_and_receipts(spark):
    row = {"sponsor_id": "SPN-0007", "visa_class": "XW-1", "applicant_name": "Ixodane Luzarn", "fee_status": "waived"}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    say = lambda f, t: {k: v for k, v in df.select(*[c.alias(n) for n, c in f(F.lit(t).cast("string")).items()]).first().asDict().items()}
    got = say(features.sponsor_letter, "We attest that Ixodane Luzam is expected. SPN 0007, class XW2. Active case ID.")
    assert len(got) == 10 and got == {"spl_present": 1, "spl_spn_found": 1, "spl_name_found": 1, "spl_class_found": 1, "spl_spn_match": 1, "spl_name_match": 1, "spl_class_match": 0, "spl_caseid_clause": 1, "spl_n_mismatch": 1, "spl_manual_revoked": 1}
    assert not any(say(features.sponsor_letter, None).values()) and not any(say(features.fee_arithmetic, None).values())
    got = say(features.fee_arithmetic, "Amount: $1,200.50 Waiver Code: N/A")
    assert len(got) == 11 and abs(got["fa_amount_log"] - math.log(1201.5)) < 1e-12 and (got["fa_waivercode_na"], got["fa_waivercode_real"], got["fa_waived_pos"], got["fa_contradiction"]) == (1, 0, 1, 1)
    assert say(features.fee_arithmetic, "Amount: N/A Waiver Code HX-12")["fa_waivercode_real"] == 1


def test_source_features(spark):
    rows = [("c", "visa_class", "intake", 0, 1, 0.9, False, "XW-1"), ("c", "visa_class", "intake", 0, 2, 0.5, False, "XW-2"), ("c", "visa_class", "registry", 1, 3, 0.4, False, "XW-2"), ("c", "visa_class", "slip", 2, 4, 0.1, False, "XW-1"),
            ("c", "home_world", "intake", 0, 5, 0.9, False, "Titan Freeport"), ("c", "home_world", "registry", 1, 6, 0.4, False, "Titan Freepor"), ("c", "home_world", "slip", 2, 7, 0.4, True, "[lost]")]
    votes = spark.createDataFrame(rows, "case_id string, field string, ptype string, pg_pos int, seq int, w double, redacted boolean, value string")
    cases = spark.createDataFrame([("c",), ("d",)], "case_id string")
    got = {r["case_id"]: r.asDict() for r in features.source_features(votes, cases, ["visa_class"]).collect()}
    c = got["c"]
    assert len(c) == 103 and (c["xs_nsrc_visa_class"], c["xs_ndist_visa_class"], c["xs_conflict_visa_class"], c["xs_policy_conflict"]) == (3, 2, 1, 1) and abs(c["xs_top_visa_class"] - 1 / 1.4) < 1e-12
    assert (c["xs_intake_registry_visa_class"], c["xs_intake_slip_visa_class"], c["xs_registry_slip_visa_class"], c["xs_intake_sponsor_visa_class"]) == (-1, 1, -1, 0)
    assert (c["xs_ndist_home_world"], c["xs_intake_registry_home_world"], c["xs_red_home_world"], c["xs_n_redacted"], c["xs_n_singleton"]) == (1, 1, 1, 1, 6)
    assert (c["xs_confsrc_intake"], c["xs_confsrc_registry"], c["xs_confsrc_slip"], c["xs_confsrc_fee"]) == (1, 1, 1, 0)
    assert got["d"]["xs_absent_visa_class"] == 1 and got["d"]["xs_n_singleton"] == 8


def test_receipts_of_fee_pages_only(spark):
    lines = spark.createDataFrame(packet([("c", 0, 0, "Amount: $9.00", 0.9), ("c", 0, 1, "Waiver code: N/A", 0.9), ("c", 1, 0, "Amount: $0.00", 0.9), ("c", 1, 1, "Waiver code: HX-1", 0.9), ("d", 0, 0, "A fee, unpaid", 0.9), ("d", 0, 1, "fee paid", 0.9), ("e", 0, 0, "fee unknown", 0.9)]), LINES)
    types = spark.createDataFrame([("c", 0, "other"), ("c", 1, "fee"), ("d", 0, "other"), ("e", 0, "other")], "case_id string, pg_pos int, ptype string")
    got = {r["case_id"]: r["printed_fee"] for r in packets.printed_fee(lines, types).collect()}
    assert got == {"c": "waived", "d": "unpaid", "e": None}
