"""Steps of the packet plan that all its queries share: dealt out, bounded, and read once."""

import random

from pyspark.sql import functions as F

from docket.constants import HEADER_RATIO, SLIP_RATIO
from docket.functions import fuzzy
from docket.operators import flags, layout

LINE = "case_id string, pg_pos int, ln_pos int, t string, s double"


def test_no_ratio_is_above_its_bound(spark):
    draw = random.Random(5)
    text = lambda: "".join(draw.choice("abcé") for _ in range(draw.randrange(14)))
    rows = [(text(), text()) for _ in range(600)] + [("formi8090", "mibfeereceipt")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.bound(F.col("a"), F.col("b")).alias("top")).collect()
    assert all(fuzzy.matched(r["a"], r["b"]) <= r["top"] for r in got)
    assert got[-1]["top"] < HEADER_RATIO  # by lengths alone 0.82: such pairs were all compared


def test_windows_that_are_worth_it_are_the_same():
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(draw.choice("biometrcsanlpx") for _ in range(draw.choice([0, 4, 30, 160])))
        best = fuzzy.window("biometricscanslip", text, 0.55, 1.5, True)
        assert fuzzy.window("biometricscanslip", text, 0.55, 1.5, True, SLIP_RATIO) == (best if best[0] >= SLIP_RATIO else (0.0, 0, 0))


def test_python_work_stays_dealt_out(spark):
    lines = spark.createDataFrame([("a", 0, 0, "Fee Receipt", 1.0)], LINE)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan(flags.slip_values(lines))  # it was dropped beside the grouping's own exchange
    held = plan(layout.page_types(lines, ["case_id", "pg_pos"]))
    assert held.index("ArrowEvalPython") < held.index("REPARTITION_BY_NUM")  # the comparison is above, not below, the exchange
