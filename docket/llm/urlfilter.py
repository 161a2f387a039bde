"""URL filters (native): hashed host-suffix/path-prefix expressions against a rule table.

Each URL is expanded into every (host suffix, path prefix) expression whose
label count and path length occur among the rules.  Expressions meet rules in an
equi-join on the first bytes of their SHA-256 digest; the full digest is
compared afterwards, and of the rules that fit the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, table

#: Rules of the registered query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hex digits of the digest that the join uses (8: 32 bits).
PREFIX = 8
#: Rules are broadcast up to this many rows; a rule row is under 1 KB as `rule_rows` cuts none, so size is checked too.
BROADCAST_RULES = 20_000
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    """Length-framed, so that no two (host, path) pairs read alike."""
    return F.sha2(F.concat(F.octet_length(host).cast("string"), F.lit(":"), host, path), 256)


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", prefix: int = PREFIX) -> DataFrame:
    """urls plus host, path, rule, verdict.

    rules: verdict (allow or block), host, path.  A rule fits its host and all
    subdomains if the path starts with its own; the longest text host+path
    wins, then the longer host, then block.  Rules with a null or empty host
    fit nothing.  Null URLs and those without `://` have host and path "" and the
    default verdict.  Repeated rows stay repeated; columns of urls named host,
    path, rule or verdict are replaced, others are kept.
    """
    spark = urls.sparkSession
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rules = (
        rules.select(F.col("verdict").alias("_verdict"), ascii_lower(F.col("host")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"))
        .where("_host is not null and _host != '' and _verdict in ('allow', 'block')")
        .groupBy("_host", "_path").agg(F.max("_verdict").alias("_verdict"))  # 'block' > 'allow'
    )
    shape = rules.agg(
        F.collect_set(F.size(F.split("_host", r"\."))).alias("labels"),
        F.collect_set(F.length("_path")).alias("lengths"),
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.length("_host") + F.length("_path") + 100), F.lit(0)).alias("size"),
    ).first()  # distinct label counts and path lengths: two short lists, whatever the number of rules
    hashed = rules.select("*", _expression(F.col("_host"), F.col("_path")).alias("_full")).withColumn("_short", F.substring("_full", 1, prefix))
    if shape["n"] <= BROADCAST_RULES and shape["size"] <= BROADCAST_BYTES:
        hashed = F.broadcast(hashed)

    whole = urls.select(F.struct(*kept).alias("_row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))  # no name of theirs can clash
    pairs = whole.where("host != ''").select("host", "path").distinct()
    labels = F.array(*[F.lit(int(x)) for x in sorted(shape["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(int(x)) for x in sorted(shape["lengths"])]).cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        pairs.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
        .select("host", "path", "h", F.explode("ps").alias("p"))
        .select("host", "path", _expression(F.col("h"), F.col("p")).alias("full"))
        .withColumn("short", F.substring("full", 1, prefix))
    )
    found = (
        expanded.join(hashed, expanded["short"] == hashed["_short"])
        .where(F.col("full") == F.col("_full"))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("_host") + F.length("_path")).alias("a"), F.length("_host").alias("b"), "_verdict", "_host", "_path")).alias("best"))
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.concat("best._host", "best._path").alias("rule"), F.col("best._verdict").alias("_found"))
    )
    return whole.join(found, (whole["host"] == found["_h"]) & (whole["path"] == found["_p"]), "left").select(
        "_row.*", "host", "path", "rule", F.coalesce("_found", F.lit(default)).alias("verdict")
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/'))
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""
