"""What the driver holds does not grow with blocks or tasks."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from docket.llm import ann


def test_graph_of_a_sample_keeps_no_blocks():
    x = np.random.default_rng(0).normal(size=(4096, 16))
    tracemalloc.start()
    graph = ann.neighbour_graph(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6  # all blocks together: 134 MB
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert (np.sort(graph, axis=1) == np.sort(np.argsort(-s, axis=1)[:, : ann.GRAPH_K], axis=1)).all()


def test_least_draws(spark):
    rows = spark.range(20_000).select("id")
    draw = F.xxhash64("id", F.lit(ann.SEED))
    for n in (20_000, 10**9):  # the second: a threshold that too few pass
        got = [r["id"] for r in ann.least(rows, n, 300, draw).collect()]
        assert got == [r["id"] for r in rows.orderBy(draw, "id").limit(300).collect()]
