"""python -m docket.plans.cli records [model | --scored table] output: records (JSON lines) to predictions; without a model, to fields.

model: a folder of `Adjudicator.save`.  table: Parquet of case_id and p.  Records and lines that a step fails on
go to `output`.dead (JSON lines of case_id, line, reason) and stop no other.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ..operators.adjudicator import Adjudicator
from ..sources.records import read_records, torn_lines
from ..sources.sinks import write_dead, write_predictions
from .packets import adjudicate, extract_isolated, inputs


def main(argv: list[str]) -> int:
    scored = len(argv) == 4 and argv[1] == "--scored"
    if len(argv) not in (2, 3) and not scored:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("docket").getOrCreate()
    records = read_records(spark, argv[0])
    fields, dead = extract_isolated(records, meta=len(argv) == 3)
    write_dead(dead.unionByName(torn_lines(spark, argv[0]), allowMissingColumns=True), argv[-1] + ".dead")
    if len(argv) == 2:
        fields.drop("visible_text").write.mode("overwrite").parquet(argv[1])
    elif scored:
        write_predictions(adjudicate(records, fields, spark.read.parquet(argv[2]).select("case_id", "p")), argv[3])
    else:
        model, own = Adjudicator.load(spark, argv[1]), records.join(fields.select("case_id"), "case_id", "left_semi")
        write_predictions(adjudicate(own, fields, model.predict_proba(inputs(own, fields)), model.caution, model.false_approval, model.brier), argv[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
