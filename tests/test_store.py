"""Results by content: what is unchanged is not computed, what a broken run left is not read."""

from pyspark.sql import functions as F

from docket.plans import store


def test_only_what_is_new_is_computed(spark, tmp_path):
    folder, seen = str(tmp_path / "store"), []

    def compute(rows):
        seen.append(sorted(r["case_id"] for r in rows.collect()))
        return rows.select("case_id", F.length("x").alias("n")).where("case_id <> 'bad'")

    table = lambda *rows: spark.createDataFrame(list(rows), "case_id string, x string, `odd name` string")
    got = lambda rows, **o: {r["case_id"]: r["n"] for r in store.kept(rows, folder, compute, **({"version": "1"} | o)).collect()}
    first = table(("a", "x", None), ("b", "xx", ""), ("b", "xx", ""), (None, "x", None), ("bad", "", None))
    assert got(first) == {"a": 1, "b": 2} and seen.pop() == ["a", "b", "bad"]
    assert got(first) == {"a": 1, "b": 2} and seen.pop() == ["bad"]  # tried again, as it has no result
    second = table(("a", "x", None), ("b", "xxx", ""), ("c", None, None))
    assert got(second) == {"a": 1, "b": 3, "c": None} and seen.pop() == ["b", "c"]
    assert got(second) == {"a": 1, "b": 3, "c": None} and not seen
    assert got(first.where("case_id <> 'bad'")) == {"a": 1, "b": 2} and not seen
    assert got(table(("b", "xx", None)), version="1") == {"b": 2} and seen.pop() == ["b"]  # null is not empty
    assert got(second, version="2") == {"a": 1, "b": 3, "c": None} and seen.pop() == ["a", "b", "c"]
    # A part without its line in the manifest does not count.
    spark.createDataFrame([("a", 99, "x")], "case_id string, n int, _content string").write.parquet(f"{folder}/parts/torn")
    assert got(second) == {"a": 1, "b": 3, "c": None} and not seen
    assert got(second.limit(0)) == {} and got(second.limit(0), version="9") == {}


def test_version_follows_the_code():
    assert len(store.plan_version()) == 64 and store.plan_version() == store.plan_version()
