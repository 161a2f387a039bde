"""Helpers shared by the corpus operators: table access and lineage cuts."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session has none and runs on one machine (tests) a folder of our own is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docket-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: the lineage ends, and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows, so that neither side holds thousands of long texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()  # a worker outlives its task


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; lower() would change other letters too."""
    return F.translate(col, UPPER, UPPER.lower())


def width(spark: SparkSession) -> int:
    """Partitions to deal rows to: what the session has for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Each name as it is or, where df has such a column (whatever its case), with underscores before it; one name gives a string."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


#: Rows of one key above which they may be told apart; rows that are written out at once.
HOT, CHUNK = 1_000, 10_000
#: Bytes of a broadcast at most.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: int) -> DataFrame:
    """A broadcast hint for what is known to have so many bytes at most, where that is little."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def drawn(rows: DataFrame, total: int, seed: int, per: int) -> DataFrame:
    """rows (row struct, key struct) plus name long: a hash of key and seed.

    A key of so many rows that a bin of about `per` rows would be twice that is no lot of its own: its
    rows get a hash of key, row and number among equal rows.  Equal rows are counted,
    not numbered, and written out again in chunks, so none of it needs them in one task.
    """
    named = rows.select("row", "key", F.xxhash64("key", F.lit(seed)).alias("name"))
    bin_ = F.pmod("name", F.lit(max(1, total // per)))
    heavy = [r["bin"] for r in named.groupBy(bin_.alias("bin")).count().where(F.col("count") > 2 * per + HOT).collect()]
    if not heavy:
        return named
    hot = cut(named.where(bin_.isin(heavy)).groupBy(F.col("name").alias("hot")).count().where(F.col("count") > HOT).select("hot"))
    hot = small(hot, 16 * hot.count())
    same = named.join(hot, F.col("name") == F.col("hot"), "left_semi").groupBy("row", "key", "name").agg(F.count("*").alias("m"))
    chunks = same.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))))
    dealt = chunks.repartition(width(rows.sparkSession), F.xxhash64("row", "at"))
    each = dealt.withColumn("i", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK, F.col("m")) - 1)))
    return named.join(hot, F.col("name") == F.col("hot"), "left_anti").union(each.select("row", "key", F.xxhash64("name", "row", "i").alias("name")))
