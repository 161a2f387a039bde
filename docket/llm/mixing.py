"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, gone through as often as a
document may be taken.  A document's virtual finish time is the number of
words its source has sent by then over the source's weight.  Documents of all
sources are range-sorted by it and the sequence is cut at the total budget.
Running sums are taken in two levels (strips, then rows of a strip), so a
source of any size is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, drawn, small, table, width

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
COPIES = 2
SEED = 9173
#: Documents a strip of a source should hold.
ROWS = 2_000
#: Sources at most: the driver works out a share for each.
MAX_SOURCES = 1_000_000


def words(text):
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight, none above most times its size; the excess is reshared by weight."""
    out, left = [0.0] * len(sizes), float(budget)
    # A source fills up the sooner, the less its size over its weight; one pass in that order finds them all.
    order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: (sizes[i] / weights[i], i))
    weight = sum(weights[i] for i in order)
    for at, i in enumerate(order):
        if left * weights[i] < most * sizes[i] * weight:
            for j in order[at:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def mix(df: DataFrame, source: str = "source", size: str = "size", key: tuple[str, ...] = ("doc_id",), budget: float = BUDGET, copies: int = COPIES, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, rows: int = ROWS) -> DataFrame:
    """df plus source_size long, target double, copies_taken int.

    Sources by code point, null last, get the weights in turn.  budget: share of
    all sizes; no document is taken more than `copies` times.  Documents of
    size 0 are never taken.  Which documents are taken depends on key, source, size
    and seed only, so reruns agree; repeated rows are queued one after another.
    Input columns of the three result names (in any case) are replaced, all others are kept, whatever
    their names.  An empty table gives an empty result.  Sources are weighed on the driver: more
    than MAX_SOURCES raise an error.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("source_size", "target", "copies_taken")]
    df = cut(df.select(F.struct(*kept).alias("row"), F.struct(*[F.col(c) for c in key], F.col(source).alias("source"), F.col(size).cast("long").alias("size")).alias("key")))  # sizes are counted from texts once
    found = df.groupBy(F.col("key.source").alias("source")).agg(F.sum("key.size").alias("n"), F.count("*").alias("rows"))
    many = found.count()
    if many > MAX_SOURCES:
        raise ValueError(f"{many} sources; their shares are worked out on the driver, for {MAX_SOURCES} at most")
    found = sorted(found.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    ws = [weights[i % len(weights)] for i in range(len(found))]
    total, count = sum(r["n"] for r in found), sum(r["rows"] for r in found)
    goal = targets([r["n"] for r in found], ws, budget * total, copies)
    plan = spark.createDataFrame(
        [(r["source"], int(r["n"]), float(t), float(w), -(-r["rows"] // rows)) for r, t, w in zip(found, goal, ws, strict=True)],
        "of string, source_size long, target double, w double, strips long",
    )
    plan = small(plan, sum(len((r["source"] or "").encode()) + 64 for r in found))
    span = F.lit(float(1 << 62))
    df = drawn(df, count, seed, 25 * rows).select("row", F.col("key.source").alias("source"), F.col("key.size").alias("n"), F.col("name").alias("r"), "key")
    queued = df.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("strip", F.floor(F.shiftrightunsigned("r", 2) / span * F.col("strips")).cast("long"))
    before = queued.groupBy("source", "strip").agg(F.sum("n").alias("sum"))
    before = before.select(F.col("source").alias("s"), F.col("strip").alias("t"), (F.sum("sum").over(W.partitionBy("source").orderBy("strip")) - F.col("sum")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("source", "strip").orderBy("r", "key").rowsBetween(W.unboundedPreceding, 0))
    queued = queued.withColumn("inside", inside)
    queued = queued.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("strip") == F.col("t")))
    queued = cut(queued.select("row", "n", "source_size", "target", "w", "r", (F.col("before") + F.col("inside")).alias("sent")))

    passes = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    times = queued.where("n > 0").select("n", "w", "source_size", "sent", "r", passes.alias("k"))
    times = times.select("n", ((F.col("sent") + F.col("k") * F.col("source_size")) / F.col("w")).alias("finish"), F.col("r").alias("tie"))
    parts = max(width(spark), -(-count * copies // 200_000))
    line = cut(times.repartitionByRange(parts, "finish", "tie").select("*", F.spark_partition_id().alias("part")))
    at, last, most = 0, None, budget * total
    for part, n in sorted((r["part"], r["n"]) for r in line.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row a partition
        if at + n > most:
            run = F.sum("n").over(W.partitionBy("part").orderBy("finish", "tie").rowsBetween(W.unboundedPreceding, 0))
            last = line.where(F.col("part") == part).select("finish", "tie", (run + F.lit(at)).alias("run")).where(F.col("run") <= most).agg(F.max(F.struct("finish", "tie"))).first()[0] or _before(line, part)
            break
        at += n
    if last is None:
        taken = F.lit(copies if at <= most and total else 0)
    else:
        def one(k: int):
            finish = (F.col("sent") + F.lit(k) * F.col("source_size")) / F.col("w")
            return ((finish < last["finish"]) | ((finish == last["finish"]) & (F.col("r") <= last["tie"]))).cast("int")

        taken = sum((one(k) for k in range(copies)), F.lit(0))
    return queued.select("row.*", "source_size", "target", F.when(F.col("n") > 0, taken).otherwise(0).cast("int").alias("copies_taken"))


def _before(line: DataFrame, part: int):
    """The last row ahead of a partition of which nothing fits; a time before all if there is none."""
    found = line.where(F.col("part") < part).agg(F.max(F.struct("finish", "tie"))).first()[0]
    return found or {"finish": -1.0, "tie": 0}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies_taken") * F.col("size")).cast("long").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that the mix takes, once for each time it takes them.

    The queueing moves only (doc_id, text hash, source, size); texts follow in one join.  Every row is
    mixed for itself, those of null and repeated doc_id too; of rows that agree in doc_id, text and source as
    many are taken as the mix took of them, the least as JSON most often.  Texts without words are never
    taken.  Other columns stay, whatever their names; an empty table gives an empty result.
    """
    key = ["doc_id", "th", "source"]
    ids = docs.select("doc_id", F.xxhash64("text").alias("th"), "source", words(F.col("text")).alias("size"))
    taken = mix(ids, key=("doc_id", "th")).groupBy(*[F.col(c).alias(f"of_{c}") for c in key])
    times = [F.count_if(F.col("copies_taken") >= k).alias(f"n{k}") for k in range(1, COPIES + 1)]
    taken = cut(taken.agg(F.count("*").alias("rows"), *times).where("n1 > 0"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("th"), "source")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    rows = rows.join(taken, same[0] & same[1] & same[2])
    count = lambda nth: sum(((nth <= F.col(f"n{k}")).cast("int") for k in range(1, COPIES + 1)), F.lit(0))
    out = rows.where("rows = 1").select("row", count(F.lit(1)).alias("k"))
    if not taken.where("rows > 1").isEmpty():
        nth = F.row_number().over(W.partitionBy(*key).orderBy(F.to_json("row")))
        out = out.union(rows.where("rows > 1").withColumn("nth", nth).select("row", count(F.col("nth")).alias("k")).where("k > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1), "k"))).select("row.*")
