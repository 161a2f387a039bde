"""Sharding (native): a uniform shuffle into shards of exact size.

Rows are dealt to logical partitions by a hash.  A communication matrix says
how many rows each partition sends to each shard; it is drawn from the
multivariate hypergeometric law of a uniform permutation, so its rows add up to
the partitions and its columns to the shard sizes exactly.  Rows are permuted
inside their partition, cut by the matrix, exchanged, and permuted again inside
the shard.  No step needs more than one logical partition at a time.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, drawn, small, table, unused

SHARDS = 16
SEED = 20240817
#: Rows a logical partition should hold.
ROWS = 50_000


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def draw(rng: random.Random, good: int, bad: int, sample: int) -> int:
    """One hypergeometric variate, by inversion outward from the mode: about as many steps as the standard deviation."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    at = math.exp(_log_choose(good, mode) + _log_choose(bad, sample - mode) - _log_choose(good + bad, sample))
    u, left, right, down, up = rng.random() - at, at, at, mode, mode
    while u > 0 and (down > low or up < high):
        if down > low:
            left *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= left
            if u <= 0:
                return down
        if up < high:
            right *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= right
            if u <= 0:
                return up
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row p: how many of partition p's rows go to each shard."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, pool = [], sum(left)
        for size in left:
            k = draw(rng, size, pool - size, n)
            row.append(k)
            n, pool = n - k, pool - size
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_rows(df: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED, rows: int = ROWS) -> DataFrame:
    """df plus shard int and slot long: a uniform shuffle, shard counts at most one apart, slots gapless from 0.

    key: columns whose values name a row; the shuffle is a function of them and
    the seed.  Null keys are values like any other.  Repeated rows each take a
    slot of their own (which of them is which cannot be told).  Columns of df
    named shard or slot (in any case) are replaced, all others are kept, whatever their names.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    total = df.count()
    parts = max(1, -(-total // rows))
    # A row is one struct from here on, so none of its names can clash.
    keyed = drawn(df.select(F.struct(*kept).alias("row"), F.struct(*[F.col(c) for c in key]).alias("key")), total, seed, rows)
    dealt = keyed.select("row", "key", F.col("name").alias("a"), F.xxhash64("name", F.lit(seed + 1)).alias("b")).withColumn("part", F.pmod("a", F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # one row for each 50,000 rows
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    ids = sorted(counts)
    ends = []
    for part, row in zip(ids, communication_matrix([counts[i] for i in ids], sizes, seed), strict=True):
        at, cuts = 0, []
        for k in row:
            at += k
            cuts.append(at)
        ends.append((part, cuts))
    matrix = small(spark.createDataFrame(ends, "of int, ends array<long>"), len(ends) * (8 * shards + 64))
    pos = F.row_number().over(W.partitionBy("part").orderBy("a", "b", "key")).cast("long")
    sent = dealt.withColumn("pos", pos).join(matrix, F.col("part") == F.col("of")).withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("pos"))).cast("int"))
    # The second permutation: strips of a shard by the second hash, in order, so that no task holds a whole shard.
    strips = max(1, -(-total // (shards * rows)))
    span = (1 << 62) // strips + 1
    sent = cut(sent.select("row", "key", "a", "b", "shard", F.floor(F.shiftrightunsigned("b", 2) / F.lit(span)).cast("int").alias("strip")))
    offsets = sent.groupBy(F.col("shard").alias("s"), F.col("strip").alias("t")).count()
    offsets = offsets.select("s", "t", (F.sum("count").over(W.partitionBy("s").orderBy("t")) - F.col("count")).alias("before"))
    slot = F.row_number().over(W.partitionBy("shard", "strip").orderBy("b", "a", "key"))
    out = sent.withColumn("rank", slot).join(small(offsets, shards * strips * 32), (F.col("shard") == F.col("s")) & (F.col("strip") == F.col("t")))
    return out.select("row.*", "shard", (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one doc_id are told apart by their texts, so that reruns agree."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    docs = docs.withColumn("text_crc32", F.col("text_crc32").cast("long"))
    return shard_rows(docs, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: documents with shard and slot.

    Every row is dealt, rows of null and repeated doc_id too; rows of one doc_id are told apart by a hash
    of the text.  Columns named shard or slot are replaced.  An empty table gives an empty result.
    """
    name = unused(docs, "th")
    return shard_rows(docs.withColumn(name, F.xxhash64("text")), ["doc_id", name]).drop(name)
