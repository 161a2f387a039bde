"""Order and limit of record lines, and the operators of the base inputs."""

import json

import pytest
from pyspark.sql import functions as F

from docket.constants import CONTENT_FIELDS, FIELD_ALIASES, PLACEHOLDER
from docket.operators import features
from docket.plans import packets
from docket.sources import records


def put(path, *rows):
    path.write_text("".join(json.dumps({"case_id": c, "scale": s, "pages": [], "turn": t}) + "\n" for c, s, t in rows))


def test_last_of_repeated_records_wins(spark, tmp_path):
    put(tmp_path / "a.jsonl", ("A", 9, 3), ("B", 1, 1), ("A", 2, 10))
    put(tmp_path / "b.jsonl", ("B", 5, 0), ("C", 7, 0), ("C", 6, 0))
    read = lambda **o: {r["case_id"]: r["scale"] for r in records.read_records(spark, str(tmp_path), **o).collect()}
    assert read() == {"A": 2, "B": 5, "C": 6}
    assert read(sequence="turn")["A"] == 2 and read(sequence="turn")["B"] == 1
    assert read(limit=2) == {"A": 9, "B": 1} and read(limit=9) == read()


def test_names_and_marks(spark):
    named = spark.createDataFrame([("c", 1, 0, "Zed"), ("c", 0, 1, "Mira Veer"), ("c", 2, 0, "MIRA VEER"), ("d", 0, 0, "Oz")], "case_id string, pg_pos int, ln_pos int, value string")
    got = {r["case_id"]: (r["n_distinct_names"], r["name_agreement"]) for r in features.name_agreement(named).collect()}
    assert got["d"] == (1, 1) and got["c"][0] == 2 and got["c"][1] < 0.4
    lines = spark.createDataFrame([("c", "Appli- cation DEN1ED", 0.8), ("c", "was denied", 0.95)], "case_id string, t string, s double")
    pages = spark.createDataFrame([("c", 0, "note"), ("c", 1, "note"), ("d", 0, "other")], "case_id string, pg_pos int, ptype string")
    got = {r["case_id"]: r.asDict() for r in features.packet_shape(lines, pages).collect()}
    assert (got["c"]["has_page_note"], got["c"]["has_page_other"], got["c"]["n_page_types"], got["c"]["lines_per_page"], got["c"]["conf_lt_90_frac"], got["c"]["tok_denied"], got["c"]["tok_approved"]) == (1, 0, 1, 1, 0.5, 1, 0)
    assert got["d"]["has_page_other"] == 1 and got["d"]["lines_per_page"] == 0 and got["d"]["tok_denied"] == 0


def test_resolution(spark):
    row = PLACEHOLDER | {"applicant_name": " Mira  Veer ", "species_code": "JOVIAN_GASFORM", "sponsor_id": "SPN-12", "fee_source": "prior", "fee_status": "paid"}
    row |= {f"{k}_{f}": v for k, v in (("rank", 9), ("nev", 0)) for f in FIELD_ALIASES}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    got = df.select(*[c.alias(n) for n, c in features.resolution().items()]).first().asDict()
    assert got["n_unknown_fields"] == len(CONTENT_FIELDS) - 4 and got["resolved_sponsor_id"] == 1 and got["sponsor_wellformed"] == 0 and got["date_placeholder"] == 1 and got["date_wellformed"] == 1
    assert (got["fee_src_prior"], got["fee_is_prior"], got["fee_observed"], got["name_n_tokens"], got["species_is_upper_snake"], got["rank_home_world"]) == (1, 1, 0, 2, 1, 9)
    none = df.withColumn("fee_source", F.lit(None).cast("string")).select(*[c.alias(n) for n, c in features.resolution().items()]).first()
    assert (none["fee_is_prior"], none["fee_observed"]) == (0, 0)


def test_rank_and_number_of_readings(spark):
    said = spark.createDataFrame([("c", "home_world"), ("c", "home_world"), ("c", "visa_class"), ("d", "visa_class")], "case_id string, field string")
    won = spark.createDataFrame([("c", "home_world", 2), ("c", "visa_class", 5)], "case_id string, field string, rank int")
    got = {r["case_id"]: r for r in packets.support(said, won, list(FIELD_ALIASES)).collect()}
    assert (got["c"]["rank_home_world"], got["c"]["nev_home_world"], got["c"]["rank_visa_class"], got["c"]["rank_sponsor_id"], got["c"]["nev_sponsor_id"]) == (2, 2, 5, 9, 0)
    assert (got["d"]["rank_visa_class"], got["d"]["nev_visa_class"]) == (9, 1)


def test_inputs_need_the_evidence_of_extraction(spark):
    with pytest.raises(ValueError, match="meta"):
        packets.inputs(None, spark.createDataFrame([("c",)], "case_id string"))
