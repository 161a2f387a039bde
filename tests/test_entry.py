"""The registry, sources, sinks and the whole plan on small tables."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from docket import workload
from docket.constants import CONTENT_FIELDS, OUTPUT_ORDER
from docket.plans import packets
from docket.sources import records, sinks
from docket.streaming.packets import extract_stream, record_stream

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, f"Supplier#{i}", i % 3, 1.0 * i) for i in range(1, 9)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return workload.records(spark, str(d))


def test_extract(spark, some):
    got = {r["case_id"]: r for r in packets.extract(some).collect()}
    assert len(got) == 8
    r = got["MIB-1"]
    assert (r["applicant_name"], r["home_world"], r["visa_class"], r["sponsor_id"], r["arrival_date"]) == ("Ixodane Luzarn", "Mars Dome-7", "MED-3", "SPN-0001", "2026-02-15")
    assert r["risk_flags"] == "active_warrant" and r["fee_status"] == "paid" and r["species_code"] == "JOVIAN_GASFORM"


def test_hidden_text_changes_nothing(spark, some):
    other = some.selectExpr("case_id", "scale", "transform(pages, p -> named_struct('page', p.page, 'k', p.k, 'w', p.w, 'h', p.h, 'hidden_text', 'Visa Class: XW-2', 'lines', p.lines)) AS pages")
    a, b = ({tuple(r) for r in packets.extract(x).select("case_id", *CONTENT_FIELDS).collect()} for x in (some, other))
    assert a == b


def test_sources_and_sinks(spark, tmp_path):
    good = json.dumps({"case_id": "A-1", "scale": 2, "pages": [{"page": 0, "w": 5, "lines": [{"t": "x", "s": "0.9"}]}]})
    (tmp_path / "r.jsonl").write_text(good + "\n\n" + json.dumps({"case_id": "A-2", "pages": "none"}) + "\n" + '{"case_id": "A-3", "pa')
    got = {r["case_id"]: r["pages"] for r in records.read_records(spark, str(tmp_path / "r.jsonl")).collect()}
    assert sorted(got) == ["A-1", "A-2"] and got["A-2"] == [] and got["A-1"][0]["lines"][0]["s"] == "0.9"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "A-7.pdf").write_bytes(b"x")
    (tmp_path / "p" / "note.txt").write_bytes(b"x")
    files = records.packet_files(spark, str(tmp_path / "p"))
    assert [(r["case_id"], bytes(r["content"])) for r in files.collect()] == [("A-7", b"x")]
    read = records.ocr(files, lambda: lambda case, content: 1 / 0).first()
    assert read["pages"] == [] and "ZeroDivisionError" in read["error"]
    rows = spark.createDataFrame([tuple("b" * (len(OUTPUT_ORDER) - 1)) + (0.5,)], ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in OUTPUT_ORDER))
    for suffix, read in (("x.jsonl", spark.read.json), ("x.csv", lambda p: spark.read.csv(p, header=True))):
        sinks.write_predictions(rows, str(tmp_path / suffix))
        assert read(str(tmp_path / suffix)).first()["case_id"] == "b"
    sinks.write_predictions(rows, str(tmp_path / "x.json"))
    doc = json.loads(spark.read.text(str(tmp_path / "x.json")).first()[0])
    assert doc["predictions"][0]["confidence"] == 0.5 and sinks.pretty(json.dumps(doc)).startswith("{\n  ")
    assert records.read_vocabulary(spark).where("field = 'fee_status'").count() == 3


def test_stream(spark, some, tmp_path):
    some.where("case_id in ('MIB-1', 'MIB-2')").write.json(str(tmp_path / "in"))
    query = extract_stream(record_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(180)
    assert sorted(r["case_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["MIB-1", "MIB-2"]


def test_registry_stands_without_the_corpus_part(tmp_path):
    for name in ("__spark_entry__.py", "docket"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "docket").mkdir()
    for p in (ROOT / "docket").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "docket" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    entry = (ROOT / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
