"""From nested records to lines, visual rows and page types.

Record: case_id, scale, pages array<struct<page, k, w, h, hidden_text, lines
array<struct<t, s, x0, y0, x1, y1>>>>.  Everything per case shuffles once, by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import HEADER_RATIO, PAGE_RANK, PAGE_TYPES
from ..functions.fuzzy import bound, ratio
from ..functions.text import id_digits, squash


def number(c: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.nanvl(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def doc_lines(records: DataFrame) -> DataFrame:
    """One row a line: case_id, pg_pos, page, pw, ph, ln_pos, t, s, x0, y0, x1, y1.

    Null pages and lines are left out but keep their places; null texts are empty,
    unreadable numbers 0, page sizes of 0 count as 1.  The untrusted layer is not read.
    """
    pages = records.select("case_id", F.posexplode("pages").alias("pg_pos", "p")).where("p is not null")
    lines = pages.select("case_id", "pg_pos", F.col("p.page").alias("page"), *[F.when(number(F.col(f"p.{c}")) == 0, 1.0).otherwise(number(F.col(f"p.{c}"))).alias(f"p{c}") for c in ("w", "h")], F.posexplode("p.lines").alias("ln_pos", "l"))
    return lines.where("l is not null").select("case_id", "pg_pos", "page", "pw", "ph", "ln_pos", F.coalesce("l.t", F.lit("")).alias("t"), *[number(F.col(f"l.{c}")).alias(c) for c in ("s", "x0", "y0", "x1", "y1")])


def visible_text(sep: str = " ") -> Column:
    """All line texts of a record in order, without a shuffle."""
    return F.array_join(F.flatten(F.transform(F.filter("pages", lambda p: p.isNotNull()), lambda p: F.transform(F.filter(p["lines"], lambda x: x.isNotNull()), lambda x: F.coalesce(x["t"], F.lit(""))))), sep)


def group_rows(lines: DataFrame, keys: list[str], factor: float = 0.6, least: float = 8.0) -> DataFrame:
    """lines plus row_id, row_pos: a line starts a row if its centre is further from the previous line's than factor x the lower height (least at least)."""
    w = W.partitionBy(*keys).orderBy("_cy", "x0", "ln_pos")
    rows = lines.withColumns({"_cy": (F.col("y0") + F.col("y1")) / 2, "_h": F.col("y1") - F.col("y0")})
    apart = F.abs(F.col("_cy") - F.lag("_cy").over(w)) > factor * F.greatest(F.least("_h", F.lag("_h").over(w)), F.lit(least))
    rows = rows.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("row_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("row_pos", F.row_number().over(W.partitionBy(*keys, "row_id").orderBy("x0", "ln_pos")) - 1).drop("_cy", "_h", "_new")


def widest_gaps(rows: DataFrame, keys: list[str], start: str, stop: str, order: str, k: int = 2) -> DataFrame:
    """keys, pos, gap, rank: the k widest gaps between neighbours, ties to the later."""
    w = W.partitionBy(*keys).orderBy(order)
    gaps = rows.withColumns({"pos": F.row_number().over(w) - 1, "gap": F.lead(start).over(w) - F.col(stop)}).where("gap is not null")
    return gaps.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("gap"), F.desc("pos")))).where(F.col("rank") <= k).select(*keys, "pos", "gap", "rank")


def page_types(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ptype, rank: the type whose header words are nearest to the beginning of one of the first six lines.

    A header word contained in a line counts 0.99; of equals the type declared
    first wins.  The word list is short and fixed, so it multiplies rows by a constant.
    """
    words = F.array(*[F.struct(F.lit(n).alias("ptype"), F.lit(i).alias("o"), F.lit(w).alias("w")) for i, (n, _, ws) in enumerate(PAGE_TYPES) for w in ws])
    first = lines.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("ln_pos"))).where("_n <= 6")
    # Small data would be put into one Python task.  Dealt before the words multiply it: a filter on the ratio would be pushed below a later exchange.
    first = first.select(*keys, squash(F.col("t")).alias("sq")).where("sq != ''").repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tests = first.select(*keys, "sq", F.explode(words).alias("x")).select(*keys, "sq", "x.*")
    head = F.expr("substring(sq, 1, length(w) + 4)")
    near = tests.where(bound(head, F.col("w")) >= HEADER_RATIO).withColumn("_r", ratio(head, F.col("w")))
    near = near.withColumn("_r", F.when(F.col("sq").contains(F.col("w")), F.greatest("_r", F.lit(0.99))).otherwise(F.col("_r")))
    held = tests.where(F.col("sq").contains(F.col("w"))).withColumn("_r", F.lit(0.99))
    best = near.select(*keys, "ptype", "o", "_r").union(held.select(*keys, "ptype", "o", "_r")).where(F.col("_r") >= HEADER_RATIO)
    best = best.groupBy(*keys).agg(F.max_by("ptype", F.struct("_r", (-F.col("o")).alias("o"))).alias("ptype"))
    every = lines.select(*keys).distinct().join(best, keys, "left").withColumn("ptype", F.coalesce("ptype", F.lit("other")))
    ranks = F.create_map(*[F.lit(x) for kv in PAGE_RANK.items() for x in kv])
    return every.withColumn("rank", F.element_at(ranks, F.col("ptype")))


def foreign_pages(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, foreign: the page states case ids and all are two edits or more from its own.  Footers do not count."""
    pattern = F.lit(r"(?i)[MN][I1L][B8][-_ ]?([0-9OQIlSB]{4,8})")
    counted = ~squash(F.col("t")).rlike("^packet|page[0-9]*$")
    stated = lines.where(counted).select(*keys, "case_id", F.explode(F.regexp_extract_all("t", pattern, F.lit(1))).alias("id")) if "case_id" in keys else None
    own = id_digits(F.element_at(F.split("case_id", "-"), -1))
    far = stated.select(*keys, (F.levenshtein(id_digits(F.col("id")), own) >= 2).alias("far"))
    return far.groupBy(*keys).agg(F.bool_and("far").alias("foreign"))


def orientation(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k: of readings (k, sum_s) in four directions the one of most confidence, ties to the lower k."""
    return readings.groupBy(*keys).agg(F.max_by("k", F.struct("sum_s", (-F.col("k")).alias("o"))).alias("k"))


def looks_upright(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, upright: five lines or more, of median width/height 1.5 and mean confidence 0.75 or more."""
    aspect = (F.col("x1") - F.col("x0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    return lines.groupBy(*keys).agg(((F.count("*") >= 5) & (F.percentile(aspect, 0.5) >= 1.5) & (F.avg("s") >= 0.75)).alias("upright"))


def pack_line(polygon: Column, score: Column) -> Column:
    """Axis-aligned box of a polygon (array of [x, y]), coordinates to 1 and score to 4 places, half to even."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.bround(score, 4).alias("s"), F.bround(F.array_min(xs), 1).alias("x0"), F.bround(F.array_min(ys), 1).alias("y0"), F.bround(F.array_max(xs), 1).alias("x1"), F.bround(F.array_max(ys), 1).alias("y1"))
