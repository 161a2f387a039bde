"""A packet that a step fails on is a dead letter with its reason, and every other packet is what it would have been."""

import json

import pytest
from pyspark.sql import types as T

from docket.functions import fuzzy
from docket.operators import candidates, flags, respace
from docket.plans import cli, packets
from docket.sources import records
from docket.streaming.packets import extract_stream, record_stream

INTAKE = ["FORM I-8090 Primary Intake Record", "Applicant Name: Ixodane Luzarn", "Home World: {world}", "Visa Class: XW-1", "Sponsor ID: SPN-0123", "Declared Purpose: research", "Arrival Date: 2026-03-15"]


def packet(case, world="Titan Freeport", extra=(), slip="none"):
    pages = [[t.format(world=world) for t in INTAKE] + list(extra), ["FORM B-13 Biometric Scan Slip", "Species Match: JOVIAN_GASFORM", f"Observed flags: {slip}"]]
    line = lambda i, t: {"t": t, "s": "0.98", "x0": "40", "y0": str(20 * i), "x1": "400", "y1": str(20 * i + 14)}
    return {"case_id": case, "scale": 2, "pages": [{"page": n, "k": 0, "w": "1200", "h": "1600", "hidden_text": "", "lines": [line(i, t) for i, t in enumerate(ts)]} for n, ts in enumerate(pages)]}


def fails_on(one, word):
    """`one`, raising where an argument says word; made here, so that workers get it by value."""

    def poisoned(*values):
        if any(word in str(v).lower() for v in values):
            raise ValueError(f"cannot read {word}")
        return one(*values)

    return poisoned


@pytest.fixture
def poisons(monkeypatch):
    label, flag = fuzzy.label_of, fuzzy.flags_in
    monkeypatch.setattr(candidates, "best_label", fuzzy.total(fails_on(lambda k: label(k or ""), "curarelabel"), fuzzy._LABEL, (None, 0.0, False)))
    monkeypatch.setattr(flags, "found_flags", lambda least: fuzzy.total(fails_on(lambda t: (flag(t or "", least),), "curareflag"), fuzzy._FLAGS, ([],)))
    same = T.StructType([T.StructField("text", T.StringType())])
    monkeypatch.setattr(respace, "_respaced", fuzzy.total(fails_on(lambda v, t: (respace.respaced(v, t or ""),), "curare page"), same, (None,)))


def test_total_function_returns_value_or_error(spark):
    inverse = fuzzy.total(lambda a, b: (a / b,), T.StructType([T.StructField("q", T.DoubleType())]), (None,))
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double").select(inverse("a", "b").alias("x")).select("x.*").collect()
    assert rows[0]["q"] == 0.5 and rows[0]["error"] is None
    assert sum(r["error"] is not None for r in rows) >= 1 and rows[1]["q"] is None and "ZeroDivisionError" in rows[1]["error"]
    empty = spark.createDataFrame([], "a double, b double").select(inverse("a", "b").alias("x"))
    assert empty.count() == 0


def test_long_keys_are_no_labels(spark):
    assert fuzzy.label_of("a" * 200_000) == (None, 0.0, False)
    longest = max((a for names in fuzzy.FIELD_ALIASES.values() for a in names), key=len)
    assert fuzzy.label_of(longest)[1] == 1.0 and len(longest) < fuzzy.LABEL_LONGEST


def test_bad_packets_are_dead_letters(spark, tmp_path, poisons):
    rows = [packet("A-1"), packet("A-2", "Eris Relay"), packet("B-1", extra=["Curare label: x"]), packet("B-2", slip="curareflag"), packet("B-3", extra=["curare page"]), packet("C-1"), packet("C-1", "Eris Relay")]
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    every = spark.read.schema(records.RECORD).json(str(tmp_path / "r.jsonl")).drop("_corrupt")
    good, dead = packets.extract_isolated(every)
    assert {r["case_id"]: (r["home_world"], r["visa_class"], r["risk_flags"], r["declared_purpose"]) for r in good.collect()} == {"A-1": ("Titan Freeport", "XW-1", "none", "research"), "A-2": ("Eris Relay", "XW-1", "none", "research")}
    assert {r["case_id"]: r["reason"] for r in dead.collect()} == {
        "B-1": "labels: ValueError: cannot read curarelabel", "B-2": "flags: ValueError: cannot read curareflag", "B-3": "spacing: ValueError: cannot read curare page", "C-1": "repeated case_id",
    }


def test_stream_and_command_line_go_on(spark, tmp_path, poisons, monkeypatch):
    (tmp_path / "in").mkdir()
    rows = [packet("A-1"), packet("B-1", extra=["Curare label: x"]), packet("A-1", "Eris Relay")]
    (tmp_path / "in" / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + '{"case_id": "T-1", "pa')
    query = extract_stream(record_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(240)
    assert [(r["case_id"], r["home_world"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A-1", "Eris Relay")]
    assert [(r["case_id"], r["reason"][:6]) for r in spark.read.json(str(tmp_path / "out-dead")).collect()] == [("B-1", "labels")]
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "fields")]) == 0
    assert [(r["case_id"], r["home_world"]) for r in spark.read.parquet(str(tmp_path / "fields")).collect()] == [("A-1", "Eris Relay")]
    dead = spark.read.json(str(tmp_path / "fields.dead")).collect()
    assert sorted(r["reason"][:10] for r in dead) == ["labels: Va", "unreadable"] and [r["line"] for r in dead if r["line"]] == ['{"case_id": "T-1", "pa']
