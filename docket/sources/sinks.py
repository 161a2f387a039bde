"""Sinks: predictions as JSON lines, one JSON document or CSV, and run statistics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OUTPUT_ORDER
from .document import write_document


def write_predictions(df: DataFrame, path: str) -> None:
    """By suffix: .jsonl (keys sorted), .json (one document in one file), anything else CSV in output order."""
    rows = df.select(*OUTPUT_ORDER)
    if path.endswith(".jsonl"):
        rows.select(line(OUTPUT_ORDER).alias("value")).write.mode("overwrite").text(path)
    elif path.endswith(".json"):
        write_document(rows.select("case_id", line(OUTPUT_ORDER).alias("line")), path, "case_id", "line")
    else:
        rows.write.mode("overwrite").option("header", True).csv(path)


def write_dead(dead: DataFrame, path: str) -> None:
    """Dead letters (case_id and reason, a torn line's text where there is one) as JSON lines; none leave an empty folder."""
    dead.select(line(dead.columns).alias("value")).write.mode("overwrite").text(path)


def line(columns: list[str]) -> Column:
    """A row's JSON text, keys sorted."""
    return F.to_json(F.struct(*sorted(columns)))


def document(rows: DataFrame) -> DataFrame:
    """One row, one text: {"predictions": [...]}, keys sorted.  A report of this form holds all predictions in one text by definition."""
    each = line(rows.columns)
    return rows.agg(F.sort_array(F.collect_list(F.struct("case_id", each.alias("j")))).alias("x")).select(F.concat(F.lit('{"predictions": ['), F.array_join(F.transform("x", lambda r: r["j"]), ", "), F.lit("]}")).alias("value"))


def run_statistics(stats: DataFrame) -> DataFrame:
    """cases, pages, total and slowest case of rows (case_id, pages, runtime_s)."""
    return stats.agg(F.count("*").alias("cases"), F.sum("pages").alias("pages"), F.sum("runtime_s").alias("total_s"), F.max_by("case_id", F.struct("runtime_s", "case_id")).alias("slowest"), F.max("runtime_s").alias("slowest_s"))


def pretty(text: str) -> str:
    """The document indented by two, for people."""
    return json.dumps(json.loads(text), indent=2, sort_keys=True)
