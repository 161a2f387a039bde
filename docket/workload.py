"""Queries over the driver's tables, each an operator at work, with the SQL that states the same.

The tables hold no packets, so relations with the same shape are derived from them
alike on both sides: lines of documents as page lines, order lines as readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .constants import FLAGS, NULLISH, RAW_STRINGS
from .functions import text as tx
from .operators import consensus, decide, features, flags, layout, respace, score, vocab

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as lines of six-line pages, with a geometry and confidence worked out of their length."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.col("doc_id").alias("case_id"), "lang", F.posexplode(F.split("text", "\n")).alias("ln_pos", "t"))
    n = F.length("t")
    return lines.select(
        "case_id", "lang", "ln_pos", "t", F.floor(F.col("ln_pos") / 6).cast("int").alias("pg_pos"), (0.5 + (n % 50) / 100.0).alias("s"),
        (20.0 * F.col("ln_pos") + n % 3).alias("y0"), (20.0 * F.col("ln_pos") + n % 3 + 12).alias("y1"), (n % 7 * 10.0).alias("x0"), (n % 7 * 10.0 + n).alias("x1"),
    )


_LINES = """
WITH pl AS (
  SELECT case_id, lang, CAST(i - 1 AS INTEGER) AS ln_pos, ts[i] AS t FROM (
    SELECT doc_id AS case_id, lang, string_split(text, chr(10)) AS ts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
lines AS (
  SELECT case_id, lang, ln_pos, t, CAST(ln_pos // 6 AS INTEGER) AS pg_pos, 0.5::DOUBLE + (length(t) % 50) / 100.0::DOUBLE AS s,
         20.0::DOUBLE * ln_pos + length(t) % 3 AS y0, 20.0::DOUBLE * ln_pos + length(t) % 3 + 12 AS y1, length(t) % 7 * 10.0::DOUBLE AS x0, length(t) % 7 * 10.0::DOUBLE + length(t) AS x1 FROM pl)
"""


# --- consensus


@query("""
WITH r AS (
  SELECT l_orderkey, l_returnflag, l_linenumber, l_shipdate, l_partkey,
         CAST(CASE l_linenumber WHEN 1 THEN 600 WHEN 2 THEN 100 WHEN 3 THEN 100 WHEN 4 THEN 70 WHEN 5 THEN 90 WHEN 6 THEN 30 ELSE 5 END AS BIGINT)
           * CAST(round(100 - l_discount * 100) AS BIGINT) * CAST(round(100 - l_discount * 100) AS BIGINT) * CAST(round(100 - l_discount * 100) AS BIGINT) AS w,
         l_partkey * 100 + l_linenumber AS seq
  FROM lineitem),
c AS (SELECT l_orderkey, l_returnflag AS rep, sum(w)::BIGINT AS score, count(*) AS n, min(l_linenumber) AS rank, min(seq) AS first FROM r GROUP BY ALL)
SELECT l_orderkey, rep, score, n, rank FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, n DESC, first) = 1
""")
def weighted_consensus(spark, sf_dir):
    """Order lines as readings of a flag: rank is the line number, confidence 1 - discount; weights in integers."""
    conf = F.round(100 - F.col("l_discount") * 100).cast("long")
    w = F.round(100 * consensus.weight(F.when(F.col("l_linenumber") == 7, 9).otherwise(F.col("l_linenumber")), F.lit(1.0), F.lit(1.0)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("rank"), (w.cast("long") * conf * conf * conf).alias("w"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return consensus.resolve(rows, ["l_orderkey"])


@query("""
WITH v AS (
  SELECT l_orderkey AS case_id, l_shipmode_ AS source, l_returnflag AS value, l_quantity AS w, l_partkey * 100 + l_linenumber AS seq FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem)),
b AS (SELECT case_id, source, value FROM v QUALIFY row_number() OVER (PARTITION BY case_id, source ORDER BY w DESC, seq) = 1),
n AS (SELECT case_id, value, count(*) AS n FROM b GROUP BY ALL)
SELECT case_id, 'flag' AS field, sum(n)::BIGINT AS votes, count(*) AS distinct_values, max(n) / sum(n) AS top_share, CASE WHEN count(*) >= 2 AND sum(n) >= 2 THEN 1 ELSE 0 END AS conflict FROM n GROUP BY case_id
""")
def cross_source_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("flag").alias("field"), F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("value"), F.col("l_quantity").alias("w"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return features.cross_source(rows)


# --- closed vocabularies

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_CANON = "regexp_replace(replace(translate(lower({0}), 'oil|!sbz', '01111582'), 'rn', 'm'), '[^a-z0-9]', '', 'g')"


@query(f"""
WITH n AS (SELECT c_custkey, translate(c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN 'OI' WHEN 1 THEN 'SB' ELSE 'EA' END, CASE c_custkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '58' ELSE 'FO' END) AS raw FROM customer),
v(value) AS (VALUES {", ".join(f"('{s}')" for s in SEGMENTS)}),
s AS (SELECT c_custkey, raw, value, {_CANON.format("value")} AS vk, {_CANON.format("raw")} AS k FROM n, v),
d AS (SELECT *, 1 - levenshtein(k, vk) / greatest(length(k), length(vk)) AS sim FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY sim DESC, value DESC) AS o FROM d),
t AS (SELECT c_custkey, any_value(raw) AS raw, max(value) FILTER (o = 1) AS v1, max(sim) FILTER (o = 1) AS best, max(sim) FILTER (o = 2) AS second FROM r GROUP BY c_custkey)
SELECT c_custkey, raw, round(best, 6) AS best, round(second, 6) AS second,
       CASE WHEN best >= 1 THEN 'exact' WHEN best >= 0.8 AND best - second >= 0.06 THEN 'similar' ELSE 'kept' END AS how,
       CASE WHEN best >= 1 OR (best >= 0.8 AND best - second >= 0.06) THEN v1 ELSE raw END AS value
FROM t
""")
def vocab_snap_top2(spark, sf_dir):
    """Market segments, some letters misread, snapped back."""
    k = F.col("c_custkey") % 3
    seg = F.col("c_mktsegment")
    raw = F.when(k == 0, F.translate(seg, "OI", "01")).when(k == 1, F.translate(seg, "SB", "58")).otherwise(F.translate(seg, "EA", "FO"))
    d = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("d", vocab.match_detail(F.col("raw"), "segment", SEGMENTS))
    return d.select("c_custkey", "raw", F.round("d.best", 6).alias("best"), F.round("d.second", 6).alias("second"), "d.how", "d.value")


@query("SELECT c_mktsegment AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS ord FROM customer GROUP BY 1")
def mine_vocab(spark, sf_dir):
    return vocab.mine(table(spark, sf_dir, "customer"), "c_mktsegment").withColumn("ord", F.col("ord").cast("long"))


@query("WITH n AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) SELECT arg_min(value, (-n, value)) AS value, max(n) / sum(n) AS share, sum(n)::BIGINT AS n_train FROM n")
def majority_prior(spark, sf_dir):
    return vocab.majority(table(spark, sf_dir, "orders"), "o_orderpriority")


# --- text

@query(f"SELECT p_partkey, {_CANON.format('p_name')} AS canon_key, {_CANON.format('p_type')} AS type_key FROM part")
def canon_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.canon(F.col("p_name")).alias("canon_key"), tx.canon(F.col("p_type")).alias("type_key"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS squash_key FROM part")
def squash_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.squash(F.col("p_name")).alias("squash_key"))


@query(r"SELECT c_custkey, lower(regexp_replace(trim('  ' || c_name || '   ' || c_mktsegment || ' '), '\s+', ' ', 'g')) AS eval_key, lower(regexp_replace('  ' || c_name || '   ' || c_mktsegment || ' ', '\s+', '', 'g')) AS ws_key FROM customer")
def eval_key(spark, sf_dir):
    t = F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.eval_key(t).alias("eval_key"), tx.unspaced(t).alias("ws_key"))


@query(r"""
WITH t AS (SELECT p_partkey, replace(p_name, ' ', '') AS camel, unnest(string_split(replace(p_name, ' ', ' l'), ' ')) AS tok, generate_subscripts(string_split(replace(p_name, ' ', ' l'), ' '), 1) AS i FROM (SELECT p_partkey, p_name || 'Xy a oXo' AS p_name FROM part)),
s AS (SELECT p_partkey, i, CASE WHEN regexp_full_match(tok, '[A-Za-z]{4,}') THEN regexp_replace(tok, '([a-z])([A-Z])', '\1 \2', 'g') ELSE tok END AS tok FROM t),
u AS (SELECT p_partkey, i, j, unnest(string_split(tok, ' ')) AS w FROM (SELECT *, 1 AS j FROM s))
SELECT p_partkey, string_agg(regexp_replace(w, '^l(\p{Ll}{2,})$', 'I\1'), ' ' ORDER BY i) AS name FROM (SELECT p_partkey, i * 100 + k AS i, w FROM (SELECT p_partkey, i, unnest(string_split(tok, ' ')) AS w, generate_subscripts(string_split(tok, ' '), 1) AS k FROM s)) GROUP BY p_partkey
""")
def name_case_split(spark, sf_dir):
    raw = F.replace(F.concat("p_name", F.lit("Xy a oXo")), F.lit(" "), F.lit(" l"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.repair_name(raw).alias("name"))


@query(r"""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SPN-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN 'spn ' || translate(lpad((o_custkey % 10000)::VARCHAR, 4, '0'), '015', 'OlS') WHEN 2 THEN '5PN.' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') ELSE 'none' END AS raw FROM orders),
m AS (SELECT o_orderkey, raw, CASE WHEN regexp_matches(raw, '(?i)SPN[\s\-_.:]*[A-Za-z0-9|!?]{4}') THEN regexp_extract(raw, '(?i)SPN[\s\-_.:]*([A-Za-z0-9|!?]{4})', 1) WHEN o_orderkey % 4 = 2 THEN right(raw, 4) END AS d FROM r)
SELECT o_orderkey, raw, CASE WHEN regexp_full_match(translate(d, 'oODQlIi|!LZzSsBbGgqT?Ae', '00001111112255866997748'), '[0-9]{4}') THEN 'SPN-' || translate(d, 'oODQlIi|!LZzSsBbGgqT?Ae', '00001111112255866997748') END AS sponsor FROM m
""")
def sponsor_repair(spark, sf_dir):
    d, k = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("SPN-"), d)).when(k == 1, F.concat(F.lit("spn "), F.translate(d, "015", "OlS"))).when(k == 2, F.concat(F.lit("5PN."), d)).otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("sponsor", tx.repair_sponsor(F.col("raw")))


@query("SELECT c_custkey, CASE WHEN ltrim(translate(k, 'OoQDIl|iSsBZG', '0000111155826'), '0') = '' THEN '0' ELSE ltrim(translate(k, 'OoQDIl|iSsBZG', '0000111155826'), '0') END AS digits FROM (SELECT c_custkey, translate(lpad((c_custkey % 1000)::VARCHAR, 6, '0'), '0158', 'OISB') AS k FROM customer)")
def digit_fold(spark, sf_dir):
    k = F.translate(F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0"), "0158", "OISB")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.id_digits(k).alias("digits"))


@query(r"""
WITH r AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 5 WHEN 0 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' WHEN 1 THEN translate(strftime(o_orderdate, '%Y / %m / %d'), '01', 'Ol') WHEN 2 THEN 'due ' || strftime(o_orderdate, '%Y.%m') || '.31' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date' END AS raw FROM orders),
p AS (SELECT *, translate(regexp_extract(raw, '(?i)([0-9OQIlSB]{4})\s*[-/. ]\s*([0-9OQIlSB]{1,2})\s*[-/. ]\s*([0-9OQIlSB]{1,2})', 1), 'OoQDIl|iSsBZG', '0000111155826') AS y, translate(regexp_extract(raw, '(?i)([0-9OQIlSB]{4})\s*[-/. ]\s*([0-9OQIlSB]{1,2})\s*[-/. ]\s*([0-9OQIlSB]{1,2})', 2), 'OoQDIl|iSsBZG', '0000111155826') AS m, translate(regexp_extract(raw, '(?i)([0-9OQIlSB]{4})\s*[-/. ]\s*([0-9OQIlSB]{1,2})\s*[-/. ]\s*([0-9OQIlSB]{1,2})', 3), 'OoQDIl|iSsBZG', '0000111155826') AS d FROM r)
SELECT o_orderkey, raw, strftime(try_strptime(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d') AS norm,
       coalesce(strftime(try_strptime(CASE WHEN regexp_full_match(raw, '\d{4}-\d\d-\d\d') THEN raw END, '%Y-%m-%d'), '%Y-%m-%d'), '1900-01-01') AS safe FROM p
""")
def date_normalize(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit("."))).when(k == 1, F.translate(F.date_format(d, "yyyy / MM / dd"), "01", "Ol"))
        .when(k == 2, F.concat(F.lit("due "), F.date_format(d, "yyyy.MM"), F.lit(".31"))).when(k == 3, F.date_format(d, "yyyy-MM-dd")).otherwise("no date")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", tx.norm_date(F.col("raw")).alias("norm"), tx.safe_date(F.col("raw")).alias("safe"))


@query(r"""
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'Amount $0.00 Waiver Code: ' ELSE 'Amount $' || CAST(floor(l_quantity) AS BIGINT) || '.50 Waiver Code: ' END || CASE l_linenumber % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'HX-12' ELSE '' END AS t FROM lineitem),
p AS (SELECT *, CAST(regexp_extract(t, '\$\s*([\d,]+)\s*[.,]\s*(\d\d)', 1) AS BIGINT) + CAST(regexp_extract(t, '\$\s*([\d,]+)\s*[.,]\s*(\d\d)', 2) AS BIGINT) AS amount, l_linenumber % 3 = 1 AS waived FROM r)
SELECT l_orderkey, l_partkey, l_linenumber, amount, CASE WHEN amount > 0 AND NOT waived THEN 'paid' WHEN amount = 0 AND waived THEN 'waived' WHEN amount = 0 THEN 'unknown' END AS fee FROM p
""")
def amount_rules(spark, sf_dir):
    amount = F.when(F.col("l_partkey") % 3 == 0, F.lit("Amount $0.00 Waiver Code: ")).otherwise(F.concat(F.lit("Amount $"), F.floor("l_quantity").cast("long").cast("string"), F.lit(".50 Waiver Code: ")))
    code = F.when(F.col("l_linenumber") % 3 == 0, "N/A").when(F.col("l_linenumber") % 3 == 1, "HX-12").otherwise("")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.concat(amount, code).alias("t"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", tx.amount_of(F.col("t")).alias("amount"), tx.fee_from_receipt(F.col("t")).alias("fee"))


@query(r"""
SELECT doc_id, CASE WHEN s LIKE '%unpaid%' OR s LIKE '%unpald%' OR s LIKE '%unpd%' THEN 'unpaid' WHEN s LIKE '%waiv%' OR s LIKE '%waved%' THEN 'waived' WHEN s LIKE '%paid%' OR s LIKE '%pald%' OR s = 'pd' THEN 'paid' WHEN s LIKE '%unknown%' OR s LIKE '%nomatch%' THEN 'unknown' END AS fee,
       CASE WHEN v <> '' THEN regexp_replace(v, '\s', '-') END AS visa
FROM (SELECT doc_id, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS s, regexp_extract(upper(t), '(XW[-\s]?[12]|DIP[-\s]?1|MED[-\s]?3|TRANSIT[-\s]?7)', 1) AS v FROM (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Un-paid ' WHEN 1 THEN 'fee waived, xw 1' WHEN 2 THEN 'PAID DIP-1' WHEN 3 THEN 'no match med3' WHEN 4 THEN 'pd' ELSE '' END || coalesce(text, '') AS t FROM documents))
""")
def fee_and_visa(spark, sf_dir):
    k = F.col("doc_id") % 6
    head = F.when(k == 0, "Un-paid ").when(k == 1, "fee waived, xw 1").when(k == 2, "PAID DIP-1").when(k == 3, "no match med3").when(k == 4, "pd").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", tx.norm_fee_exact(F.col("t")).alias("fee"), tx.norm_visa(F.col("t")).alias("visa"))


@query(r"""
SELECT doc_id, t = '' OR contains(t, '[') OR contains(t, ']') OR length(regexp_replace(lower(t), '[^a-z0-9]', '', 'g')) < 2
       OR regexp_full_match(t, '(?i)(\[|\()?\s*(name|registry|species|world|purpose|sponsor|data|field|value)?\s*(cut\s*out|cutout|whiteout|white\s*out|lost|redacted|illegible|missing|destroyed|torn|unreadable|removed)\s*(\]|\))?') AS redacted
FROM (SELECT doc_id, regexp_replace(CASE doc_id % 7 WHEN 0 THEN 'name redacted' WHEN 1 THEN '(white out)' WHEN 2 THEN 'Data  Lost' WHEN 3 THEN '' ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
""")
def redaction_filter(spark, sf_dir):
    k = F.col("doc_id") % 7
    t = F.when(k == 0, "name redacted").when(k == 1, "(white out)").when(k == 2, "Data  Lost").when(k == 3, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.is_redacted(t).alias("redacted"))


_PRINTED = [ps[-1] for ps in RAW_STRINGS.values()]


@query(f"""
SELECT doc_id, {", ".join("(" + " OR ".join(f"contains(s, '{p}')" for p in ps) + f")::INT::DOUBLE AS {n}" for n, ps in RAW_STRINGS.items())}
FROM (SELECT doc_id, regexp_replace(lower(text || ' ' || insert_dash), '[^a-z0-9]', '', 'g') AS s
      FROM (SELECT doc_id, text, left(w, 5) || '- ' || upper(substr(w, 6)) AS insert_dash FROM (SELECT doc_id, text, [{", ".join(f"'{w}'" for w in _PRINTED)}][(doc_id % {len(_PRINTED)}) + 1] AS w FROM documents WHERE text IS NOT NULL)))
""")
def raw_form_bits(spark, sf_dir):
    """Seventeen bits of what forms print, each printed at the end of some texts, broken and in capitals; texts are scanned once for all."""
    w = F.get(F.array(*[F.lit(w) for w in _PRINTED]), (F.col("doc_id") % len(_PRINTED)).cast("int"))
    t = F.concat("text", F.lit(" "), F.substring(w, 1, 5), F.lit("- "), F.upper(F.substring(w, F.lit(6), F.length(w))))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", features.TEXT_STRINGS.scan(tx.squash(t)).alias("held"))
    bits = features.raw_form(None, features.TEXT_STRINGS.holds(F.col("held")))
    return rows.select("doc_id", *[c.alias(n) for n, c in bits.items()])


# --- layout


@query(_LINES + """,
w AS (SELECT *, (y0 + y1) / 2 AS cy, lag((y0 + y1) / 2) OVER o AS py FROM lines WINDOW o AS (PARTITION BY case_id, pg_pos ORDER BY (y0 + y1) / 2, x0, ln_pos)),
r AS (SELECT case_id, pg_pos, ln_pos, x0, sum(CASE WHEN abs(cy - py) > 0.6 * 12 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, pg_pos ORDER BY cy, x0, ln_pos ROWS UNBOUNDED PRECEDING)::BIGINT AS row_id FROM w)
SELECT case_id, pg_pos, ln_pos, row_id, row_number() OVER (PARTITION BY case_id, pg_pos, row_id ORDER BY x0, ln_pos) - 1 AS row_pos FROM r
""")
def rows_gaps_islands(spark, sf_dir):
    lines = packet_lines(spark, sf_dir)
    rows = layout.group_rows(lines, ["case_id", "pg_pos"])
    return rows.select("case_id", "pg_pos", "ln_pos", F.col("row_id").cast("long"), F.col("row_pos").cast("long"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts)::BIGINT AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
g AS (SELECT user_id, pos, lead(a) OVER (PARTITION BY user_id ORDER BY pos) - a AS gap FROM e)
SELECT user_id, pos, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, pos DESC) AS rank FROM g WHERE gap IS NOT NULL QUALIFY rank <= 2
""")
def widest_gap_top2(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"), F.struct("ts", "event_id").alias("o"))
    got = layout.widest_gaps(e, ["user_id"], "a", "a", "o")
    return got.select("user_id", F.col("pos").cast("long"), "gap", F.col("rank").cast("long"))


@query(_LINES + """
SELECT case_id, count(*)::DOUBLE AS n_lines, count(DISTINCT pg_pos)::DOUBLE AS n_pages, round(avg(s), 6) AS conf_mean, min(s) AS conf_min,
       list_sort(list(s))[greatest(1, count(*) // 10)] AS conf_p10, round(quantile_cont(s, 0.25), 6) AS conf_p25, round(stddev_pop(s), 6) AS conf_std, sum(length(t))::DOUBLE AS n_chars
FROM lines GROUP BY case_id
""")
def line_stats(spark, sf_dir):
    out = features.shape(packet_lines(spark, sf_dir))
    return out.select("case_id", "n_lines", "n_pages", F.round("conf_mean", 6).alias("conf_mean"), "conf_min", "conf_p10", F.round("conf_p25", 6).alias("conf_p25"), F.round("conf_std", 6).alias("conf_std"), "n_chars")


@query(_LINES + """,
k AS (SELECT *, CASE pg_pos % 3 WHEN 0 THEN 'intake' WHEN 1 THEN 'fee' ELSE 'slip' END AS ptype FROM lines)
SELECT case_id, """ + ", ".join(f"count(*) FILTER (ptype = '{p}')::DOUBLE AS pp_{p}_n, coalesce(round(avg(s) FILTER (ptype = '{p}'), 6), 0) AS pp_{p}_conf, count(DISTINCT pg_pos) FILTER (ptype = '{p}')::DOUBLE AS pp_{p}_pages" for p in ("intake", "fee", "slip")) + """,
       (CASE WHEN bool_or(ptype = 'intake') THEN 0 ELSE 1 END + CASE WHEN bool_or(ptype = 'fee') THEN 0 ELSE 1 END + CASE WHEN bool_or(ptype = 'slip') THEN 0 ELSE 1 END)::DOUBLE AS pp_missing
FROM k GROUP BY case_id
""")
def page_profile_pivot(spark, sf_dir):
    lines = packet_lines(spark, sf_dir)
    k = F.col("pg_pos") % 3
    types = lines.select("case_id", "pg_pos").distinct().withColumn("ptype", F.when(k == 0, "intake").when(k == 1, "fee").otherwise("slip"))
    out = features.page_profile(lines, types, ["intake", "fee", "slip"])
    return out.select("case_id", *[F.round(c, 6).alias(c) if c.endswith("_conf") else F.col(c) for c in out.columns if c not in ("case_id", "pp_worst", "pp_spread")])


@query("""
WITH r AS (SELECT o_custkey AS page, o_orderkey % 4 AS k, sum(CAST(round(o_totalprice) AS BIGINT))::BIGINT AS sum_s FROM orders GROUP BY ALL)
SELECT page, k FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY sum_s DESC, k) = 1
""")
def orientation_argmax(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 4).alias("k")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("sum_s"))
    return layout.orientation(r, ["page"])


@query(_LINES + "SELECT case_id, count(*) >= 5 AND quantile_cont((x1 - x0) / greatest(y1 - y0, 1), 0.5) >= 1.5 AND avg(s) >= 0.75 AS upright FROM lines GROUP BY case_id")
def upright_gate(spark, sf_dir):
    return layout.looks_upright(packet_lines(spark, sf_dir), ["case_id"])


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' ') AS visible FROM documents WHERE text IS NOT NULL")
def visible_text(spark, sf_dir):
    """Nested records built of documents, joined again without a shuffle."""
    line = F.transform(F.split("text", "\n"), lambda t: F.struct(F.trim(t).alias("t")))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array(F.struct(line.alias("lines"))).alias("pages"))
    return rows.select("doc_id", layout.visible_text().alias("visible"))


# --- flags and sets


@query("""
WITH u AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 50) AS a, list(DISTINCT event_type) FILTER (value <= 20) AS b FROM events GROUP BY user_id)
SELECT user_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), '|'), 'none') AS both_kinds,
       CASE WHEN len(list_intersect(coalesce(a, []), coalesce(b, []))) = 0 THEN 'none' ELSE array_to_string(list_sort(list_intersect(a, b)), '|') END AS shared,
       len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)))::INT AS only_a FROM u
""")
def flag_set_ops(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 20, F.col("event_type"))).alias("b"))
    return u.select("user_id", flags.flags_string(F.array_union("a", "b")).alias("both_kinds"), flags.flags_string(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("only_a"))


_FLAG_LISTS = "[" + ", ".join(f"'{f}'" for f in FLAGS) + "]"


@query(f"""
WITH f AS (SELECT doc_id, list_filter({_FLAG_LISTS}, lambda x, i: (doc_id // i) % 3 = 0) AS t, list_filter({_FLAG_LISTS}, lambda x, i: ((doc_id + 1) // i) % 3 = 0) AS g FROM documents)
SELECT flag, count(*) FILTER (list_contains(t, flag) AND list_contains(g, flag)) AS tp, count(*) FILTER (NOT list_contains(t, flag) AND list_contains(g, flag)) AS fp, count(*) FILTER (list_contains(t, flag) AND NOT list_contains(g, flag)) AS fn
FROM f, (SELECT unnest({_FLAG_LISTS}) AS flag) GROUP BY flag
""")
def flag_prf(spark, sf_dir):
    every = F.array(*[F.lit(f) for f in FLAGS])
    pick = lambda d: F.filter(every, lambda x, i: F.floor(d / (i + 1)) % 3 == 0)
    rows = table(spark, sf_dir, "documents").select(pick(F.col("doc_id")).alias("t"), pick(F.col("doc_id") + 1).alias("g"))
    return score.set_scores(rows, "t", "g", FLAGS)


# --- joins and splits


@query("SELECT doc_id, 'C-' || doc_id AS case_id, doc_id % 5 = 0 AS dev FROM labels")
def split_mod5(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("C-"), F.col("doc_id").cast("string")).alias("case_id")).withColumn("dev", score.is_dev(F.col("case_id")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_todo(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_EVAL = r"lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
_NULLISH = "({0} IS NULL OR " + _EVAL + " IN (" + ", ".join(f"'{x}'" for x in NULLISH) + "))"


@query(f"""
SELECT d.doc_id, CASE WHEN {_NULLISH.format("h")} THEN 'no_hidden' WHEN {_NULLISH.format("v")} THEN 'no_visible' WHEN {_EVAL.format("v")} = {_EVAL.format("h")} THEN 'agree' ELSE 'other' END AS verdict
FROM (SELECT doc_id, text AS v FROM documents) d LEFT JOIN (
  SELECT item_id, CASE WHEN item_id % 2 = 0 THEN b.text ELSE '  ' || replace(t.text, ' ', '  ') || ' ' END AS h FROM benchmark b LEFT JOIN documents t ON b.item_id = t.doc_id) b ON d.doc_id = b.item_id
""")
def hidden_agreement(spark, sf_dir):
    """Verdict of two readings of a whole text; near and disagree are one here, as their border is a ratio SQL does not have."""
    from .operators import trust

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("v"))
    twin = d.select(F.col("doc_id").alias("i"), F.concat(F.lit("  "), F.replace("v", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("u"))
    b = table(spark, sf_dir, "benchmark").join(twin, F.col("item_id") == F.col("i"), "left").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.col("u")).alias("h"))
    out = d.join(b, F.col("doc_id") == F.col("item_id"), "left").withColumn("verdict", trust.agreement(F.col("v"), F.col("h")))
    return out.select("doc_id", F.when(F.col("verdict").isin("near", "disagree"), "other").otherwise(F.col("verdict")).alias("verdict"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, ws, ws[2] || ws[3] AS squeezed FROM d WHERE len(ws) >= 6 AND length(ws[2]) >= 3 AND length(ws[3]) >= 3),
i AS (SELECT doc_id, squeezed, ws, unnest(range(1, len(ws) + 1)) AS i FROM k),
s AS (SELECT *, lower(ws[i]) AS head FROM i WHERE starts_with(lower(squeezed), lower(ws[i]))),
m AS (SELECT *, unnest(range(1, length(squeezed) // 2 + 1)) AS m FROM s),
n AS (SELECT doc_id, squeezed, array_to_string(ws[i : i + m], ' ') AS cand, m + 1 AS words, list_min(list_transform(ws[i : i + m], lambda x: length(x))) AS least FROM m WHERE i + m <= len(ws)),
f AS (SELECT doc_id, squeezed, arg_min(cand, (-words, -least, cand)) AS best FROM n WHERE lower(replace(cand, ' ', '')) = lower(squeezed) AND least >= 2 GROUP BY ALL)
SELECT doc_id, squeezed, substr(squeezed, 1, instr(best, ' ') - 1) || ' ' || substr(squeezed, instr(best, ' ')) AS repaired FROM f WHERE len(string_split(best, ' ')) = 2
""")
def respace_ngrams(spark, sf_dir):
    """Two neighbouring words run together, then parted again as the text prints them."""
    words = r"^\s*+\S++\s++(\S{3,}+)\s++(\S{3,}+)(?:\s++\S++){3}"  # of six at least; read no further
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), F.concat(F.regexp_extract("text", words, 1), F.regexp_extract("text", words, 2)).alias("squeezed"))
    rows = rows.where("squeezed != ''")
    return rows.select("doc_id", "squeezed", respace.repair(F.col("squeezed"), F.col("t")).alias("repaired")).where("size(split(repaired, ' ')) = 2")


# --- decisions and evaluation


def nation_probabilities(spark, sf_dir) -> DataFrame:
    """Shares of order statuses by customer as a probability vector, in exact hundredths."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count("*").alias("n"))
    a, d = F.floor(100 * F.col("f") / F.col("n")), F.floor(100 * F.col("o") / F.col("n"))
    return rows.select("o_custkey", F.array(a / 100.0, d / 100.0, (100 - a - d) / 100.0).alias("p"), (F.col("o_custkey") % 3).cast("int").alias("truth"))


_PROBS = """
WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS n FROM orders GROUP BY 1),
q AS (SELECT o_custkey, floor(100 * f / n) AS a, floor(100 * o / n) AS d FROM c),
pr AS (SELECT o_custkey, (a / 100.0)::DOUBLE AS p0, (d / 100.0)::DOUBLE AS p1, ((100 - a - d) / 100.0)::DOUBLE AS p2, (o_custkey % 3)::INT AS truth FROM q),
ev AS (SELECT *, p0 * 8 + p1 * {fa} + p2 * 1 - {b} * p0 * (1 - p0) AS e0, p0 * 0 + p1 * 8 + p2 * 1 - {b} * p1 * (1 - p1) AS e1, p0 * 2 + p1 * 2 + p2 * 8 - {b} * p2 * (1 - p2) AS e2 FROM pr),
ac AS (SELECT *, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS action FROM ev),
de AS (SELECT *, greatest(0.01, least(0.99, CASE action WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS confidence FROM ac)
"""


@query(_PROBS.format(fa=-8, b=8) + "SELECT o_custkey, ['APPROVED', 'DENIED', 'NEEDS_REVIEW'][action + 1] AS decision, round(confidence, 4) AS confidence FROM de")
def ev_decide(spark, sf_dir):
    rows = nation_probabilities(spark, sf_dir).withColumn("d", decide.decide(F.col("p")))
    return rows.select("o_custkey", "d.decision", F.round("d.confidence", 4).alias("confidence"))


@query(_PROBS.format(fa=-8, b=8) + """
SELECT o_custkey, CASE WHEN action = 0 AND o_custkey % 4 = 0 THEN 'NEEDS_REVIEW' ELSE ['APPROVED', 'DENIED', 'NEEDS_REVIEW'][action + 1] END AS decision,
       round(CASE WHEN action = 0 AND o_custkey % 4 = 0 THEN greatest(0.01, least(0.99, p2)) ELSE confidence END, 4) AS confidence FROM de
""")
def caution_demote(spark, sf_dir):
    rows = nation_probabilities(spark, sf_dir).withColumn("d", decide.decide(F.col("p")))
    told = (F.col("o_custkey") % 4 == 0).cast("int")
    rows = rows.withColumn("c", decide.caution(F.col("d.decision"), F.col("d.confidence"), F.col("p"), told, F.lit(0), "dis"))
    return rows.select("o_custkey", "c.decision", F.round("c.confidence", 4).alias("confidence"))


@query(_PROBS.format(fa=-8, b=8) + """,
z AS (SELECT o_custkey, ln(greatest(p0, 1e-9)) / exp(0.3) AS a, ln(greatest(p1, 1e-9)) / exp(0.3) AS b, ln(greatest(p2, 1e-9)) / exp(0.3) AS c FROM pr)
SELECT o_custkey, round(exp(a) / (exp(a) + exp(b) + exp(c)), 4) AS q0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 4) AS q1, round(exp(c) / (exp(a) + exp(b) + exp(c)), 4) AS q2 FROM z
""")
def recal_temperature(spark, sf_dir):
    rows = nation_probabilities(spark, sf_dir).select("o_custkey", decide.recalibrate(F.col("p"), "temperature", 0.3).alias("q"))
    return rows.select("o_custkey", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(3)])


@query(_PROBS.format(fa=-8, b=8) + """,
z AS (SELECT o_custkey, ln(greatest(p0, 1e-9)) * exp(-0.2) + 0.1 AS a, ln(greatest(p1, 1e-9)) * exp(0.1) - 0.3 AS b, ln(greatest(p2, 1e-9)) * exp(0.0) + 0.2 AS c FROM pr)
SELECT o_custkey, round(exp(a) / (exp(a) + exp(b) + exp(c)), 4) AS q0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 4) AS q1, round(exp(c) / (exp(a) + exp(b) + exp(c)), 4) AS q2 FROM z
""")
def recal_vector(spark, sf_dir):
    rows = nation_probabilities(spark, sf_dir).select("o_custkey", decide.recalibrate(F.col("p"), "vector", [-0.2, 0.1, 0.0], [0.1, -0.3, 0.2]).alias("q"))
    return rows.select("o_custkey", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(3)])


_SCORE = """
round(80.0 * sum(CASE WHEN truth = action THEN 8 WHEN action = 2 THEN 2 WHEN truth = 2 THEN 1 WHEN truth = 1 AND action = 0 THEN -4 ELSE 0 END) / (8 * count(*)), 5) AS classification,
round(20 * greatest(0, 1 - 2 * avg(pow(confidence - (truth = action)::INT, 2))), 5) AS calibration, count(*) FILTER (truth = 1 AND action = 0) AS false_approvals,
round(avg((truth = action)::INT), 5) AS accuracy, round(avg(pow(confidence - (truth = action)::INT, 2)), 5) AS brier
"""


@query(_PROBS.format(fa=-8, b=8) + f"SELECT {_SCORE} FROM de")
def challenge_score(spark, sf_dir):
    rows = nation_probabilities(spark, sf_dir).withColumn("d", decide.decide(F.col("p"))).select("truth", "d.action", "d.confidence")
    out = score.challenge_score(rows)
    return out.select("false_approvals", *[F.round(c, 5).alias(c) for c in ("classification", "calibration", "accuracy", "brier")])


@query(" UNION ALL ".join(f"SELECT * FROM ({_PROBS.format(fa=fa, b=b)} SELECT {fa}::DOUBLE AS false_approval, {b}::DOUBLE AS brier_weight, {_SCORE} FROM de)" for fa in (-4, -8, -16) for b in (0, 8)))
def param_sweep(spark, sf_dir):
    out = score.param_sweep(nation_probabilities(spark, sf_dir), [-4, -8, -16], [0, 8])
    return out.select("false_approval", "brier_weight", "false_approvals", *[F.round(c, 5).alias(c) for c in ("classification", "calibration", "accuracy", "brier")])


@query("WITH sweep AS (" + ORACLES["param_sweep"] + """), t AS (SELECT *, classification + calibration AS total FROM sweep)
SELECT false_approval, brier_weight, false_approvals, round(total, 3) AS total FROM t WHERE total >= (SELECT max(total) FROM t) - 0.5
ORDER BY false_approvals, total DESC, false_approval, brier_weight LIMIT 1
""")
def config_selection(spark, sf_dir):
    """Of the settings nearly as good as the best, the one with fewest false approvals."""
    out = score.select_config(score.param_sweep(nation_probabilities(spark, sf_dir), [-4, -8, -16], [0, 8]))
    return out.select("false_approval", "brier_weight", "false_approvals", F.round("total", 3).alias("total"))


@query("SELECT o_custkey, round(0.5 * p0 + 0.5 * p1, 6) AS b0, round(0.5 * p1 + 0.5 * p2, 6) AS b1, round(0.5 * p2 + 0.5 * p0, 6) AS b2 FROM (" + _PROBS.format(fa=-8, b=8) + " SELECT * FROM pr)")
def blend_cells(spark, sf_dir):
    rows = nation_probabilities(spark, sf_dir)
    q = decide.blend(F.col("p"), F.array(F.col("p")[1], F.col("p")[2], F.col("p")[0]))
    return rows.select("o_custkey", *[F.round(q[i], 6).alias(f"b{i}") for i in range(3)])


@query("SELECT 'doc' AS field, round(avg(CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 1 ELSE 0 END), 6) AS accuracy FROM (SELECT lang AS a, CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) ELSE 'xx' END AS b FROM documents)")
def field_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise("xx").alias("b"))
    out = score.per_field(rows, {"doc": "b"})
    return out.select("field", F.round("accuracy", 6).alias("accuracy"))


@query(r"""
SELECT doc_id, len(ds)::DOUBLE AS date_n, coalesce(date_diff('day', list_min(ds), list_max(ds)), 0)::DOUBLE AS date_span, coalesce(date_diff('day', DATE '2024-03-01', list_max(ds)), 0)::DOUBLE AS date_lag
FROM (SELECT doc_id, list_distinct([(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER)), (DATE '2024-05-05' + CAST(doc_id % 90 AS INTEGER))]) AS ds FROM documents)
""")
def date_spans(spark, sf_dir):
    day = lambda base, n: F.date_format(F.date_add(F.to_date(F.lit(base)), (F.col("doc_id") % n).cast("int")), "yyyy-MM-dd")
    t = F.concat_ws(" and ", day("2024-01-01", 400), day("2024-05-05", 90), F.lit("2024-13-77"))
    out = features.dates(t, F.lit("2024-03-01"))
    return table(spark, sf_dir, "documents").select("doc_id", *[out[c].alias(c) for c in ("date_n", "date_span", "date_lag")])


@query("""
SELECT c_custkey, json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name)::VARCHAR AS line FROM customer
""")
def jsonl_rows(spark, sf_dir):
    """Lines as the JSON sink writes them, keys sorted."""
    from .sources.sinks import line

    return table(spark, sf_dir, "customer").select("c_custkey", line(["c_name", "c_custkey", "c_mktsegment"]).alias("line"))


@query("SELECT count(*) AS cases, sum(l_linenumber)::BIGINT AS pages, arg_max(l_orderkey, (s, l_orderkey)) AS slowest FROM (SELECT l_orderkey, count(*) AS l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY 1)")
def run_statistics(spark, sf_dir):
    from .sources.sinks import run_statistics as stats

    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.sum("l_quantity").alias("runtime_s")).withColumnRenamed("l_orderkey", "case_id")
    return stats(rows).select("cases", "pages", "slowest")


@query(f"""
WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN translate(c_mktsegment, 'OI', '01') WHEN 1 THEN 'the ' || lower(c_mktsegment) || ' trade' WHEN 2 THEN 'none' ELSE 'quarry' END AS raw, CASE c_custkey % 4 WHEN 2 THEN 'Sector: ' || c_mktsegment ELSE 'nothing' END AS page FROM customer),
v(value) AS (VALUES {", ".join(f"('{x}')" for x in SEGMENTS)}),
h AS (SELECT c_custkey, value FROM n, v WHERE contains({_CANON.format("page")}, {_CANON.format("value")}) QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1)
SELECT c_custkey, raw, value AS found FROM n LEFT JOIN h USING (c_custkey)
""")
def vocab_find(spark, sf_dir):
    """The one value of a closed vocabulary that a page's text holds."""
    k, seg = F.col("c_custkey") % 4, F.col("c_mktsegment")
    raw = F.when(k == 0, F.translate(seg, "OI", "01")).when(k == 1, F.concat(F.lit("the "), F.lower(seg), F.lit(" trade"))).when(k == 2, "none").otherwise("quarry")
    page = F.when(k == 2, F.concat(F.lit("Sector: "), seg)).otherwise("nothing")
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), vocab.find_in_text(page, "segment", SEGMENTS).alias("found"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
SELECT o_orderkey, n_lines::BIGINT AS n_lines, round(quantity + CASE WHEN o_orderkey % 10 = 0 THEN n_lines ELSE 0 END, 4)::DOUBLE AS quantity, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS run
FROM orders JOIN l ON l_orderkey = o_orderkey
""")
def kept_results(spark, sf_dir):
    """Sums of every order's lines, kept by content: all are computed by the first run, and by the second only the tenth whose lines have changed."""
    import uuid

    from .plans.store import kept
    from .tables import shared_folder

    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    changed = orders.withColumn("lines", F.when(F.col("o_orderkey") % 10 == 0, F.transform("lines", lambda x: x.withField("q", x["q"] + 1))).otherwise(F.col("lines")))

    def sums(run):
        return lambda rows: rows.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["q"]), 4).alias("quantity"), F.lit(run).alias("run"))

    kept(orders, folder, sums(1), "sums", "o_orderkey")
    return kept(changed, folder, sums(2), "sums", "o_orderkey")


# --- functions that SQL does not have


@query()
def fuzzy_ratio_topk(spark, sf_dir):
    """The three part types nearest to each part's name, by ratio of matching blocks of 0.3 or more; distinct keys only."""
    from .operators.ratio_join import ratio_join

    part = table(spark, sf_dir, "part").select(tx.squash(F.col("p_name")).alias("a"), F.lower("p_type").alias("b"))
    near = ratio_join(part, part, "a", "b", 0.3)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("r"), "b"))).where("rank <= 3")


@query("""
WITH n AS (SELECT DISTINCT p_name AS t FROM part WHERE length(p_name) > 0),
l AS (SELECT t, c, count(*) AS k FROM (SELECT t, unnest(string_split(t, '')) AS c FROM n) GROUP BY ALL),
s AS (SELECT x.t AS a, y.t AS b, sum(least(x.k, y.k)) AS shared FROM l x JOIN l y ON x.c = y.c AND x.t < y.t GROUP BY ALL)
SELECT a, b, round(2.0 * shared / (length(a) + length(b)), 6) AS overlap FROM s WHERE 2.0 * shared >= 0.7 * (length(a) + length(b)) - 1e-9
""")
def letter_overlap_pairs(spark, sf_dir):
    """Pairs of part names that share seven tenths of their letters: the filter of joins by ratio."""
    from .operators.ratio_join import overlap_pairs

    names = table(spark, sf_dir, "part").select("p_name")
    return overlap_pairs(names, names, "p_name", "p_name", 0.7).where("a < b").select("a", "b", F.round("overlap", 6).alias("overlap"))


@query()
def label_anchor(spark, sf_dir):
    """Labels of form lines made of customers, read with misprints."""
    from .functions.fuzzy import best_label, over_distinct

    k = F.col("c_custkey") % 5
    label = F.when(k == 0, "Applicant Narne").when(k == 1, "Home Wor1d").when(k == 2, "Observed Flags").when(k == 3, "Fee Stat us").otherwise("Case ID")
    rows = table(spark, sf_dir, "customer").select("c_custkey", tx.squash(label).alias("key"))
    return over_distinct(rows, "key", best_label, "l").select("c_custkey", "key", "l.field", "l.like", F.round("l.ratio", 6).alias("ratio"))


@query()
def flag_match(spark, sf_dir):
    """Flags in noisy values of events."""
    from .functions.fuzzy import match_flags, over_distinct

    every = F.array(*[F.lit(f.replace("_", "")) for f in FLAGS])
    value = F.concat(F.get(every, (F.col("event_id") % 8).cast("int")), F.when(F.col("event_id") % 3 == 0, "x").otherwise(""))
    rows = table(spark, sf_dir, "events").select("event_id", F.translate(value, "io", "1c").alias("v"))
    return over_distinct(rows, "v", match_flags(0.62), "flags").select("event_id", "v", F.array_join("flags", "|").alias("flags"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets made of suppliers: an intake page, a fee receipt and a slip, with misprints and an untrusted layer."""
    c = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    world = F.get(F.array(*[F.lit(w) for w in ("Titan Freeport", "Mars Dome-7", "Zeta Reticuli", "Eris Relay")]), (k % 4).cast("int"))
    purpose = F.get(F.array(*[F.lit(w) for w in ("research", "field repair", "transit", "medical consult")]), (k % 4).cast("int"))
    visa = F.get(F.array(*[F.lit(w) for w in ("XW-1", "MED-3", "DIP-1", "TRANSIT-7")]), (k % 4).cast("int"))
    flag = F.get(F.array(*[F.lit(w) for w in ("none", "active_warrant", "none", "identity_conflict", "none")]), (k % 5).cast("int"))
    spn = F.lpad((k % 10000).cast("string"), 4, "0")

    def lines(*texts):
        return F.array(*[F.struct(t.alias("t"), F.format_number(0.99 - 0.01 * ((k + i) % 7), 2).alias("s"), F.lit("40.0").alias("x0"), F.lit(f"{20.0 * i:.1f}").alias("y0"), F.lit("400.0").alias("x1"), F.lit(f"{20.0 * i + 14:.1f}").alias("y1")) for i, t in enumerate(texts)])

    def page(n, *texts):
        return F.struct(F.lit(n).alias("page"), F.lit(0).alias("k"), F.lit("1200").alias("w"), F.lit("1600").alias("h"), F.when(k % 7 == 0, F.lit("Home World: Nowhere")).otherwise("").alias("hidden_text"), lines(*texts).alias("lines"))

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pages = F.array(
        page(0, F.lit("FORM I-8090 Primary Intake Record"), text("Case ID: MIB-", k.cast("string")), text("Applicant Name: Ixodane Luzarn"), text("Home World: ", F.translate(world, "o", "0")), text("Visa Class: ", visa), text("Sponsor ID: SPN-", spn), text("Declared Purpose: ", purpose), text("Arrival Date: 2026-0", (1 + k % 9).cast("string"), "-15")),
        page(1, F.lit("MIB Fee Receipt"), F.when(k % 3 == 0, "Fee Status: unpaid").when(k % 3 == 1, "Fee Status: paid").otherwise("Fee Status: waived"), F.lit("Amount: $120.00"), F.lit("Waiver Code: N/A")),
        page(2, F.lit("FORM B-13 Biometric Scan Slip"), text("Species Match: JOVIAN_GASFORM"), text("Observed flags: ", flag), F.lit("Biometric confidence: 93 %")),
    )
    return c.select(F.concat(F.lit("MIB-"), k.cast("string")).alias("case_id"), F.lit(2).alias("scale"), pages.alias("pages"))


_PACKETS = """
WITH p AS (
  SELECT s_suppkey AS k, 'MIB-' || s_suppkey AS case_id, ['Titan Freeport', 'Mars Dome-7', 'Zeta Reticuli', 'Eris Relay'][s_suppkey % 4 + 1] AS world, ['research', 'field repair', 'transit', 'medical consult'][s_suppkey % 4 + 1] AS purpose,
         ['XW-1', 'MED-3', 'DIP-1', 'TRANSIT-7'][s_suppkey % 4 + 1] AS visa, ['none', 'active_warrant', 'none', 'identity_conflict', 'none'][s_suppkey % 5 + 1] AS flag, ['unpaid', 'paid', 'waived'][s_suppkey % 3 + 1] AS fee FROM supplier)
"""


@query(_PACKETS + """
SELECT case_id, 'Ixodane Luzarn' AS applicant_name, 'JOVIAN_GASFORM' AS species_code, world AS home_world, visa AS visa_class, 'SPN-' || lpad((k % 10000)::VARCHAR, 4, '0') AS sponsor_id,
       '2026-0' || (1 + k % 9) || '-15' AS arrival_date, purpose AS declared_purpose, flag AS risk_flags, fee AS fee_status FROM p
""")
def packet_extract(spark, sf_dir):
    """Nine fields of each packet through the whole plan."""
    from .plans.packets import extract

    return extract(records(spark, sf_dir)).drop("visible_text")


@query()
def packet_features(spark, sf_dir):
    from .plans.packets import extract, inputs, read

    rows = records(spark, sf_dir)
    held = read(rows)
    return inputs(rows, extract(rows, meta=True, held=held), held)


_EVIDENCE = {
    "n_lines": "16", "n_pages": "3", "date_n": "1", "bio_conf_found": "1", "bio_conf": "93", "bio_conf_lt80": "0", "bio_conf_ge95": "0",
    "raw_fee_unpaid": "fee = 'unpaid'", "raw_fee_paid": "fee = 'paid'", "raw_fee_waived": "fee = 'waived'", "raw_visa_transit": "visa = 'TRANSIT-7'", "raw_observed_none": "flag = 'none'",
    "pol_transit": "visa = 'TRANSIT-7'", "pol_dip": "visa = 'DIP-1'", "pol_med3": "visa = 'MED-3'", "pol_waived_ok": "fee = 'waived' AND visa = 'DIP-1'", "pol_waived_bad": "fee = 'waived' AND visa <> 'DIP-1'",
    "pol_dq_flag": "flag = 'active_warrant'", "pol_ro_flag_n": "flag = 'identity_conflict'", "pol_date_missing": "0", "pol_sponsor_missing": "0",
    "fa_receipt_present": "1", "fa_amount_pos": "1", "fa_amount_log": "ln(121)", "fa_waivercode_na": "1", "fa_waivercode_real": "0", "fa_waived_pos": "fee = 'waived'", "fa_unpaid_pos": "fee = 'unpaid'", "fa_contradiction": "fee = 'waived'",
    "spl_present": "0", "st_denied_n": "0", "st_appr_and_denial": "0", "slip_anchor": "1", "slip_n": "flag <> 'none'", "slip_clean": "flag = 'none'",
    "dm_label_coverage": "(7 / 8 + 3 / 4 + 3 / 5) / 3", "dm_missing_labels": "4", "dm_intake_cov": "7 / 8", "dm_registry_cov": "-1", "dm_n_doc_types": "3", "dm_n_blank_pages": "0", "dm_lines_per_page": "16 / 3",
    "resolved_home_world": "1", "resolved_risk_flags": "flag <> 'none'", "n_unknown_fields": "(flag = 'none')::INT + (k % 10000 = 0)::INT", "sponsor_placeholder": "k % 10000 = 0", "rank_home_world": "2", "rank_species_code": "3", "nev_home_world": "1", "fee_src_anchored": "1", "fee_observed": "1", "visa_unknown": "0",
    "sponsor_wellformed": "1", "date_wellformed": "1", "date_placeholder": "0", "name_n_tokens": "2", "species_is_upper_snake": "1", "has_page_intake": "1", "has_page_note": "0", "n_page_types": "3", "lines_per_page": "16 / 3", "tok_waiver": "1", "tok_denied": "0", "n_distinct_names": "1", "name_agreement": "1", "flags_confidence": "1",
    "xs_nsrc_fee_status": "1", "xs_top_fee_status": "1", "xs_n_conflicts": "0", "xs_n_singleton": "8", "xs_absent_home_world": "0", "xs_intake_registry_home_world": "0",
}


@query(_PACKETS + "SELECT case_id, " + ", ".join(f"round(({v})::DOUBLE, 6) AS {n}" for n, v in _EVIDENCE.items()) + " FROM p")
def packet_evidence(spark, sf_dir):
    """Model inputs whose value follows from how the packets are made."""
    from .plans.packets import extract, inputs, read

    rows = records(spark, sf_dir)
    held = read(rows)
    return inputs(rows, extract(rows, meta=True, held=held), held).select("case_id", *[F.round(c, 6).alias(c) for c in _EVIDENCE])


@query(_PACKETS + "SELECT case_id, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS disagree, 0 AS refused FROM p")
def hidden_signals(spark, sf_dir):
    """Disagreements of the untrusted layer with resolved fields."""
    from .operators import trust
    from .plans.packets import extract

    rows = records(spark, sf_dir)
    return trust.signals(extract(rows), trust.split(rows)[1], ["home_world", "visa_class"])


@query()
def quality_model_oof(spark, sf_dir):
    """Probabilities of quality for labelled documents by fits that have not seen the row, a mean over two seeds of folds; all fits share their scans."""
    from .operators.trees import boosted_out_of_fold

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    cols = {"f_len": F.length("text").cast("double"), "f_lines": F.size(F.split("text", "\n")).cast("double"), "f_digits": F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double"), "f_upper": F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double"), "f_pipe": F.length(F.regexp_replace("text", "[^|]", "")).cast("double")}
    rows = docs.where("quality is not null").select("doc_id", "quality", *[c.alias(n) for n, c in cols.items()])
    out = boosted_out_of_fold(rows, "quality", "doc_id", list(cols), classes=2, n=3, seeds=[0, 1], iterations=4, rate=0.3, leaves=4)
    return out.select("doc_id", "quality", F.get("folds", F.lit(0)).alias("fold"), F.get("p", F.lit(1)).alias("p1"))


#: Features of order lines with the upper edges of their bins: every value is a bin.
PRICE_BINS = {"quantity": [float(i) for i in range(51)], "linenumber": [float(i) for i in range(8)], "discount": [float(i) for i in range(11)], "tax": [float(i) for i in range(9)]}


def _rounds_sql(rounds: int) -> str:
    """SQL of boosting with trees of two leaves at rate 0.5, a round after the other."""
    steps = [
        """b AS (
  SELECT CASE WHEN l_extendedprice < 15000 THEN 0 WHEN l_extendedprice < 45000 THEN 1 ELSE 2 END AS y, l_quantity AS x0, l_linenumber::DOUBLE AS x1,
         round(l_discount * 100) AS x2, round(l_tax * 100) AS x3, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL),
z0 AS (SELECT *, """
        + ", ".join(f"(SELECT ln(sum(n) FILTER (y = {k}) / sum(n)) FROM b) AS z{k}" for k in range(3))
        + " FROM b)"
    ]
    for i in range(rounds):
        steps.append(f"""p{i} AS (SELECT *, exp(z0) + exp(z1) + exp(z2) AS e FROM z{i}),
g{i} AS (SELECT k, f, CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS v, sum(n * (q - (y = k)::INT)) AS g, sum(n * q * (1 - q)) AS h, sum(n) AS n
  FROM (SELECT *, CASE k WHEN 0 THEN exp(z0) WHEN 1 THEN exp(z1) ELSE exp(z2) END / e AS q FROM p{i}, range(3) a(k)), range(4) c(f) GROUP BY ALL),
s{i} AS (SELECT k, f, v, sum(g) OVER u AS lg, sum(h) OVER u AS lh, sum(n) OVER u AS ln, sum(g) OVER o AS g, sum(h) OVER o AS h, sum(n) OVER o AS n
  FROM g{i} WINDOW u AS (PARTITION BY k, f ORDER BY v ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY k, f)),
c{i} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, v) AS place
  FROM (SELECT *, round(lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1), 8) AS gain FROM s{i} WHERE ln >= 20 AND n - ln >= 20 AND lh >= 0.001 AND h - lh >= 0.001)
  WHERE gain > 0),
z{i + 1} AS (SELECT y, x0, x1, x2, x3, n, """
            + ", ".join(f"z{k} - 0.5 * coalesce((SELECT CASE WHEN CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END <= v THEN lg / (lh + 1) ELSE (g - lg) / (h - lh + 1) END FROM c{i} WHERE k = {k} AND place = 1), 0) AS z{k}" for k in range(3))
            + f" FROM p{i})")
    e = "(exp(z0) + exp(z1) + exp(z2))"
    mean = ", ".join(f"round(sum(n * exp(z{k}) / {e}) / sum(n), 6) AS p{k}" for k in range(3))
    return "WITH " + ",\n".join(steps) + f"\nSELECT y AS label, sum(n)::BIGINT AS n, {mean} FROM z{rounds} GROUP BY y"


@query(_rounds_sql(3))
def boosted_price_class(spark, sf_dir):
    """Order lines in three price classes by boosted trees of two leaves: mean probabilities of each class, by class."""
    from .operators.trees import boost

    line = table(spark, sf_dir, "lineitem").where("l_extendedprice is not null")
    label = F.when(F.col("l_extendedprice") < 15000, 0).when(F.col("l_extendedprice") < 45000, 1).otherwise(2)
    rows = line.select(label.alias("label"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("linenumber"), F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"))
    model = boost(rows, "label", list(PRICE_BINS), iterations=3, rate=0.5, leaves=2, bounds=list(PRICE_BINS.values()))
    mean = [F.round(F.avg(F.get("p", F.lit(k))), 6).alias(f"p{k}") for k in range(3)]
    return model.transform(rows).groupBy("label").agg(F.count("*").alias("n"), *mean)


@query()
def predictions_document(spark, sf_dir):
    """Decisions by customer, each one JSON text with sorted keys."""
    rows = nation_probabilities(spark, sf_dir).withColumn("d", decide.decide(F.col("p")))
    from .sources.sinks import line

    rows = rows.select(F.col("o_custkey").cast("string").alias("case_id"), F.col("d.decision").alias("adjudication"), F.round("d.confidence", 4).alias("confidence"))
    return rows.select(line(rows.columns).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lines to features to a cost-sensitive decision, against the labels we have."""
    lines = packet_lines(spark, sf_dir)
    shape = features.shape(lines)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "quality", "toxic")
    good = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf_mean"))) * 10 + 0.001) / 10.0  # in tenths, so that squares are exact to four places
    p = F.array(good * good, (1 - good) * (1 - good), 2 * good * (1 - good))
    rows = shape.join(labels, "case_id", "left").withColumn("d", decide.decide(p))
    return rows.select("case_id", "n_lines", "n_pages", F.round("conf_mean", 6).alias("conf_mean"), "quality", "toxic", "d.decision", F.round("d.confidence", 4).alias("confidence"))


@query(_LINES + """,
sh AS (SELECT case_id, count(*)::DOUBLE AS n_lines, count(DISTINCT pg_pos)::DOUBLE AS n_pages, avg(s) AS m FROM lines GROUP BY case_id),
pr AS (SELECT *, floor(greatest(0, least(1, m)) * 10 + 0.001) / 10.0::DOUBLE AS g FROM sh),
p AS (SELECT *, g * g AS p0, (1 - g) * (1 - g) AS p1, 2 * g * (1 - g) AS p2 FROM pr),
ev AS (SELECT *, p0 * 8 + p1 * -8 + p2 * 1 - 8 * p0 * (1 - p0) AS e0, p1 * 8 + p2 * 1 - 8 * p1 * (1 - p1) AS e1, p0 * 2 + p1 * 2 + p2 * 8 - 8 * p2 * (1 - p2) AS e2 FROM p),
ac AS (SELECT *, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS action FROM ev)
SELECT ac.case_id, n_lines, n_pages, round(m, 6) AS conf_mean, quality, toxic, ['APPROVED', 'DENIED', 'NEEDS_REVIEW'][action + 1] AS decision,
       round(greatest(0.01, least(0.99, CASE action WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 4) AS confidence
FROM ac LEFT JOIN labels ON ac.case_id = labels.doc_id
""")
def packet_decision(spark, sf_dir):
    return flagship(spark, sf_dir)
