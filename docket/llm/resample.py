"""Importance resampling towards a target: hashed n-grams from a table of word positions.

Every document is exploded into (document, place, word); lead() over a window per
document gives the following words, and one concatenation per order its n-grams,
which are hashed to buckets.  Counts per bucket of all documents and of the target
give each bucket a gain; gains joined to a document's buckets add up to its weight,
and Gumbel noise from a hash of doc_id makes the highest scores a draw without
replacement.

Documents are dealt once, as whole rows; words keep that partitioning, so neither the
window nor the grouping moves a word.  A document's buckets are written once, two bytes
an n-gram, and read for the counts and for the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ascii_lower, cut, table, width

#: Buckets (gains are a table of so many rows at most, whatever the input), orders, words a drawn document has at least, share drawn in percent, seed.
BUCKETS, ORDERS, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none of null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def ngrams(rows: DataFrame, orders: int = ORDERS) -> DataFrame:
    """key, pos, n1 .. n<orders>: the runs of words that start at each place of rows (key, text); null past the end, and in the one row of a text without words.

    key tells rows apart.  The table of places is made where the rows of a key are, as posexplode keeps their partitioning.
    """
    dealt = rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key")
    places = dealt.select("key", F.posexplode_outer(words(F.col("text"))).alias("pos", "n1"))
    one = Window.partitionBy("key").orderBy("pos")
    following = [F.lead("n1", k).over(one).alias(f"w{k}") for k in range(1, orders)]
    places = places.select("key", "pos", "n1", *following)
    runs = [F.concat(F.col("n1"), *[x for k in range(1, n) for x in (F.lit(" "), F.col(f"w{k}"))]).alias(f"n{n}") for n in range(2, orders + 1)]
    return places.select("key", "pos", "n1", *runs)


def bucket_lists(rows: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words long, found array: the buckets of all n-grams of rows (key, text), repeats included."""
    hashed = F.array_compact(F.array(*[(F.crc32(f"n{n}") % buckets).cast("short" if buckets <= 1 << 15 else "int") for n in range(1, orders + 1)]))
    grams = ngrams(rows, orders).select("key", "n1", hashed.alias("found"))
    return grams.groupBy("key").agg(F.count("n1").alias("n_words"), F.flatten(F.collect_list("found")).alias("found"))


def counts(lists: DataFrame, name: str) -> DataFrame:
    """bucket, and how many n-grams fall in it."""
    return lists.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain long for every bucket of the corpus: floor(1000 ln) of the smoothed rates' quotient.

    corpus: bucket, s; target: bucket, t.  `buckets` rows at most.
    """
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"all_{c}"))
    both = corpus.join(F.broadcast(target), "bucket", "left").join(F.broadcast(total(corpus, "s"))).join(F.broadcast(total(target, "t")))  # one row each
    t, s = F.coalesce(F.col("t"), F.lit(0)).cast("double"), F.col("s").cast("double")
    ratio = (t + 1.0) * (F.col("all_s") + float(buckets)) / ((s + 1.0) * (F.col("all_t") + float(buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x standard Gumbel noise), from a hash of seed and doc_id alone; a null doc_id hashes as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], share: Column) -> DataFrame:
    """rows plus rank long, from 1 in that order, where it is at most share (an aggregate of rows); else null.

    Rows are range-sorted; a partition's first rank follows from the counts of those before it (one row a partition on the driver), so no task sees more than its range.
    """
    dealt = cut(rows.repartitionByRange(width(rows.sparkSession), *order).withColumn("part_", F.spark_partition_id()))
    sizes = {r["part_"]: r["n"] for r in dealt.groupBy("part_").agg(F.count("*").alias("n")).collect()}
    before, upto = {}, 0
    for part in sorted(sizes):
        before[part] = upto
        upto += sizes[part]
    drawn = dealt.agg(share.alias("x")).first()["x"] or 0
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("part_")) if before else F.lit(0)
    place = (start + F.row_number().over(Window.partitionBy("part_").orderBy(*order))).cast("long")
    return dealt.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("part_")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features long, weight long, score long, rank long for every row of docs (doc_id, text); target: text.

    Null and empty texts have no n-grams and weight 0.  Repeated rows are rows of their own; their scores tie, and ties go to
    the smaller doc_id (null first), then to either of equal rows.  rank is null where a document is not drawn.  An empty target or
    corpus gives smoothed gains or no rows.  Other columns of docs take no part, so none can clash.
    """
    row = F.monotonically_increasing_id()
    lists = cut(bucket_lists(docs.select(F.struct("doc_id", row.alias("row")).alias("key"), "text"), orders, buckets))
    aimed = bucket_lists(target.select(row.alias("key"), "text"), orders, buckets)
    gain = F.broadcast(gains(counts(lists, "s"), counts(aimed, "t"), buckets))  # `buckets` rows at most
    found = lists.select("key", "n_words", F.explode_outer("found").alias("bucket")).join(gain, "bucket", "left")
    out = found.groupBy("key", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    out = out.select("key.doc_id", "n_words", "n_features", "weight")
    out = out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    fit = F.col("n_words") >= min_words
    order = [fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    return ranked(out, order, F.floor(percent * F.sum(fit.cast("long")) / 100)).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its byte table, worked out from the polynomial.
CRC = """
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i))"""
SQL = (
    "WITH"
    + CRC
    + r""",
w AS MATERIALIZED (
  SELECT src, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT 'd' AS src, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
g AS MATERIALIZED (
  SELECT src, doc_id, array_to_string(ws[p : p + n - 1], ' ') AS gram, count(*) AS m
  FROM (SELECT src, doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, range(1, 4) o(n)) GROUP BY ALL),
k AS MATERIALIZED (
  SELECT gram, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(encode(gram)) + 1), lambda i: ('0x' || hex(encode(gram))[2 * i - 1 : 2 * i])::BIGINT),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT gram FROM g), crc_table),
c AS (SELECT bucket, coalesce(sum(m) FILTER (src = 'd'), 0) AS s, coalesce(sum(m) FILTER (src = 'b'), 0) AS t FROM g JOIN k USING (gram) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
d AS (SELECT doc_id, sum(m) AS n_features, sum(m * gain) AS weight FROM g JOIN k USING (gram) JOIN gain USING (bucket) WHERE src = 'd' GROUP BY doc_id),
a AS (
  SELECT w.doc_id, len(ws) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (doc_id) WHERE src = 'd'),
r AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id) AS place FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT floor(5 * count(*) FILTER (fit) / 100) FROM a) THEN place END AS rank FROM r
"""
)
