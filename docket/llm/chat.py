"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable.  A conversation that ends in another
role (or has no assistant) has one more example without a target, so that the
output holds every turn.  The template frames turns with control strings and escapes
them inside texts and roles in a way that can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = f"{END}{START}assistant ok"


def escape(col: Column) -> Column:
    """Double backslashes, then part `<|` by a single one: runs of backslashes from the text are even, ours are not."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(col: Column) -> Column:
    """A role also must not hold the newline that ends it."""
    return F.replace(escape(col), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(col: Column) -> Column:
    return unescape(F.replace(col, F.lit("<\\n>"), F.lit("\n")))


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example int, target int, formatted string, loss_start int, loss_length int.

    turns: conv_id, turn, role, text.  Turns go by turn (null first), then role
    and text, so ties and repeated rows have one order.  Null roles and texts
    are empty; a null conv_id is a conversation like any other.  target: the
    turn's place from 0, null in an example without a target, whose loss span is
    empty.  loss_start counts code points from 0 in formatted.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    heads = F.transform("ts", lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
    bodies = F.transform("ts", lambda t: escape(t["text"]))
    convs = convs.select("conv_id", F.transform("ts", lambda t: t["role"] == "assistant").alias("own"), heads.alias("heads"), bodies.alias("bodies"))
    convs = convs.withColumn("framed", F.transform(F.arrays_zip("heads", "bodies"), lambda x: F.concat(x["heads"], x["bodies"], F.lit(f"{END}\n"))))
    places = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.get("own", i) | (i == F.size("own") - 1))
    out = convs.select("conv_id", "own", "heads", "bodies", "framed", F.posexplode(places).alias("example", "at"))
    mine = F.get("own", F.col("at"))
    context = F.array_join(F.slice("framed", 1, F.col("at")), "")
    return out.select(
        "conv_id",
        "example",
        F.when(mine, F.col("at")).alias("target"),
        F.concat(context, F.get("framed", F.col("at"))).alias("formatted"),
        F.when(mine, F.length(context) + F.length(F.get("heads", F.col("at")))).otherwise(0).cast("int").alias("loss_start"),
        F.when(mine, F.length(F.get("bodies", F.col("at")))).otherwise(0).cast("int").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, losses array<string>, formatted_chars long, from the examples alone."""
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    convs = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("whole"),
        F.transform(F.sort_array(F.collect_list(F.struct("example", "target", loss.alias("loss")))), lambda x: F.when(x["target"].isNotNull(), x["loss"])).alias("spans"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    pieces = F.slice(F.split("whole", r"<\|im_start\|>"), 2, 1 << 30)
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"),
    )
    losses = F.transform(F.filter("spans", lambda x: x.isNotNull()), unescape)
    return convs.select("conv_id", F.transform(pieces, turn).alias("turns"), losses.alias("losses"), "formatted_chars")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(expand(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>')) + 24) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
