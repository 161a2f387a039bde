"""Spacing repair: a value takes the word boundaries that the page prints, and never another character."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NULLISH, RESPACE_KEY, RESPACE_TOKEN
from ..functions.fuzzy import total
from ..functions.text import eval_key, let, unspaced


def printed(key: str, tokens: list[str]) -> list[list[str]]:
    """Runs of tokens that spell key: its places in the joined page that begin and end where tokens do."""
    joined = "".join(tokens)
    blob, key = joined.lower().replace("ς", "σ"), key.replace("ς", "σ")  # a sigma's form follows its place in a word
    out, at = [], blob.find(key)
    if at < 0:
        return out
    sizes = map(len, tokens) if len(blob) == len(joined) else (len(t.lower()) for t in tokens)  # lower() can lengthen
    ends = {n: i for i, n in enumerate(accumulate(sizes, initial=0))}
    while at >= 0:
        if at in ends and at + len(key) in ends:
            out.append(tokens[ends[at] : ends[at + len(key)]])
        at = blob.find(key, at + 1)
    return out


def respaced(value: str, text: str) -> str:
    """Of the printed runs the one with most words, then the longest shortest word, if that beats the value's own; ties to the smaller text."""
    rank = lambda ws: (len(ws), min(map(len, ws)))
    own = value.split()
    runs = [ws for ws in printed("".join(own).lower(), text.split()) if min(map(len, ws)) >= RESPACE_TOKEN and rank(ws) > rank(own)]
    if not runs:
        return value
    best, flat = min(runs, key=lambda ws: (-len(ws), -min(map(len, ws)), " ".join(ws))), "".join(own)
    stops = list(accumulate(map(len, best), initial=0))
    return " ".join(flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)) if stops[-1] == len(flat) else value


#: Not deterministic to Spark, so that a filter on its result does not run it a second time.
_respaced = total(lambda value, text: (respaced(value, text or ""),), T.StructType([T.StructField("text", T.StringType())]), (None,), [pa.string()]).asNondeterministic()


def repair(value: Column, text: Column) -> Column:
    """value with the spacing of the best run in the visible text, as it is where that fails.

    Nullish values and keys under five characters stay, and so does any value
    that the repair would change by more than spaces.
    """
    return let(_found(value, text), lambda found: _kept(value, found))


def _fit(value: Column) -> Column:
    return ~eval_key(value).isin(NULLISH) & (F.length(unspaced(value)) >= RESPACE_KEY)


def _found(value: Column, text: Column) -> Column:
    """The repaired value as text, and the error that its repair met (null: none)."""
    return _respaced(F.when(_fit(value), value).otherwise(F.lit("-")), F.when(_fit(value), text).otherwise(F.lit("")))


def _kept(value: Column, found: Column) -> Column:
    out = found["text"]
    return F.when(_fit(value) & (unspaced(out) == unspaced(value)), out).otherwise(value)


def repair_fields(df: DataFrame, fields: list[str], text: str = "visible_text", error: str | None = None) -> DataFrame:
    """df with its fields repaired; error: a column for what a repair met."""
    names = {f: f"_respaced_{f}" for f in fields}
    both = df.withColumns({names[f]: _found(F.col(f), F.col(text)) for f in fields})
    out = both.withColumns({f: _kept(F.col(f), F.col(names[f])) for f in fields} | ({error: F.coalesce(*[F.col(names[f])["error"] for f in fields])} if error else {}))
    return out.drop(*names.values())
