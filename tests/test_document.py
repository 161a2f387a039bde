"""The document of many tasks is byte for byte that of one."""

import json

import pytest
from pyspark.sql import functions as F

from docket.sources import document, sinks


def test_document_of_many_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("MIB-"), (F.col("id") * 7919 % 4999).cast("string")).alias("case_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit('é "quoted" 😀 '), "id")).alias("x")).repartition(7)
    rows = rows.unionByName(spark.createDataFrame([(None, "no case"), ("Ω", ""), ("Ω", "")], "case_id string, x string"))
    path = str(tmp_path / "p.json")
    document.write_document(rows.select("case_id", sinks.line(["case_id", "x"]).alias("line")), path, "case_id", "line")
    text = (tmp_path / "p.json").read_text()
    assert text == sinks.document(rows).first()["value"] and len(json.loads(text)["predictions"]) == 5003
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p.json"]
    # Replaced whole, by nothing too.
    document.write_document(rows.limit(0).select("case_id", F.lit("").alias("line")), path, "case_id", "line")
    assert json.loads((tmp_path / "p.json").read_text()) == {"predictions": []}


def test_a_failed_run_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "p.json")
    (tmp_path / "p.json").write_text("old")
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 90, "{}").otherwise(F.raise_error(F.lit("stop"))).alias("line"))
    with pytest.raises(Exception, match="stop"):
        document.write_document(rows, path, "k", "line")
    assert (tmp_path / "p.json").read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["p.json"]
    (tmp_path / "folder.json").mkdir()
    with pytest.raises(FileExistsError):
        document.write_document(rows, str(tmp_path / "folder.json"), "k", "line")
