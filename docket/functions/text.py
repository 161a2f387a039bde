"""Text normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AMOUNT_PATTERN, DATE_PATTERN, ID_DIGITS, NULLISH, PLACEHOLDER, REDACTED_WORDS, SPONSOR_DIGITS, SPONSOR_MISREAD, SPONSOR_PLAIN, SPONSOR_TOKEN, VISA_PATTERN, WAIVER_CODE


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c: Column) -> Column:
    """Lower-cased, only a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canon(c: Column) -> Column:
    """Key under which readings that OCR confuses are equal; `rn` is folded before separators go."""
    folded = F.translate(F.lower(c), "oil|!sbz", "01111582")
    return F.regexp_replace(F.replace(folded, F.lit("rn"), F.lit("m")), "[^a-z0-9]", "")


def eval_key(c: Column) -> Column:
    """Trimmed, runs of white space one space, lower-cased: equality of the score."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))


def unspaced(c: Column) -> Column:
    """Lower-cased without any white space."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def is_nullish(c: Column) -> Column:
    return F.coalesce(eval_key(c), F.lit("")).isin(NULLISH)


def clean(c: Column) -> Column:
    """Without separators before and behind; a final dot or dash stays."""
    out = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^[\s:;=.,\-|]+", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\s:;=,|]+$", ""), r"^\s+|\s+$", "")


def id_digits(c: Column) -> Column:
    """Letters that OCR takes for digits become digits; no leading zeros, but `0` for nothing."""
    out = F.ltrim(F.translate(c, *ID_DIGITS), F.lit("0"))
    return F.when(out == "", "0").otherwise(out)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts have 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def safe_date(c: Column) -> Column:
    """ISO date, or the placeholder."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"), F.lit(PLACEHOLDER["arrival_date"]))


def norm_date(c: Column) -> Column:
    """First y-m-d in the text, OCR digits folded, if it is a day of the years 1900 to 2200; else null."""
    y, m, d = (F.translate(F.regexp_extract(c, f"(?i){DATE_PATTERN}", i), *ID_DIGITS) for i in (1, 2, 3))
    day = F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))
    return F.when(F.year(day).between(1900, 2200), F.date_format(day, "yyyy-MM-dd"))


def norm_visa(c: Column) -> Column:
    """First of the five classes, separators as one dash; null without one."""
    found = F.regexp_extract(F.upper(c), VISA_PATTERN, 1)
    return F.when(found != "", F.regexp_replace(found, r"\s", "-"))


def norm_fee_exact(c: Column) -> Column:
    """Fee status by what the squashed text contains, in this order; null if nothing tells."""
    s = squash(c)
    has = lambda *xs: F.lit(False) if not xs else _any([s.contains(x) for x in xs])
    return (
        F.when(has("unpaid", "unpald", "unpd"), "unpaid")
        .when(has("waiv", "waved"), "waived")
        .when(has("paid", "pald") | (s == "pd"), "paid")
        .when(has("unknown", "nomatch"), "unknown")
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def repair_sponsor(c: Column) -> Column:
    """SPN-dddd from a noisy reading, or null: SPN and four characters, or else a first three-character token that reads as SPN."""
    plain = F.regexp_extract(c, SPONSOR_PLAIN, 1)
    other = F.when(canon(F.regexp_extract(c, SPONSOR_TOKEN, 1)) == canon(F.lit("SPN")), F.regexp_extract(c, SPONSOR_TOKEN, 2))
    digits = F.translate(F.when(plain != "", plain).otherwise(other), *SPONSOR_DIGITS)
    return F.when(digits.rlike("^[0-9]{4}$"), F.concat(F.lit("SPN-"), digits))


def norm_sponsor(c: Column) -> Column:
    found = F.translate(F.regexp_extract(c, SPONSOR_MISREAD, 1), *ID_DIGITS)
    return F.coalesce(F.when(found.rlike("^[0-9]{4}$"), F.concat(F.lit("SPN-"), found)), repair_sponsor(c))


def repair_name(c: Column) -> Column:
    """One space between tokens; CamelCase tokens of more than three ASCII letters are split; `lxo`, of three lower-case letters or more, reads `Ixo`."""
    split = lambda t: F.when(t.rlike("^[A-Za-z]{4,}$"), F.regexp_replace(t, "(?<=[a-z])(?=[A-Z])", " ")).otherwise(t)
    tokens = F.split(F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "), " "), split), " "), " ")
    named = F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, r"^l(?=\p{Ll}{2,}$)", "I")), " ")
    return F.when(is_nullish(c), c).otherwise(named)


def is_redacted(c: Column) -> Column:
    """Evidence was destroyed: empty, bracketed, under two characters, or saying so."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return (t == "") | t.contains("[") | t.contains("]") | (F.length(squash(t)) < 2) | t.rlike(rf"(?i)^(\[|\()?\s*{REDACTED_WORDS}\s*(\]|\))?$")


def amount_of(c: Column) -> Column:
    """Dollars and cents of the first amount, added as plain numbers: only whether it is zero means anything."""
    whole = F.replace(F.regexp_extract(c, AMOUNT_PATTERN, 1), F.lit(","), F.lit(""))
    return whole.try_cast("long") + F.regexp_extract(c, AMOUNT_PATTERN, 2).try_cast("long")


def fee_from_receipt(c: Column) -> Column:
    """Fee status from a receipt's amount and waiver code, null unless both are printed."""
    code = squash(F.regexp_extract(c, WAIVER_CODE, 1))
    waived = (code != "") & ~code.isin("na", "none", "nil", "n", "0")
    amount = amount_of(c)
    told = F.when((amount > 0) & ~waived, "paid").when((amount == 0) & waived, "waived").when((amount == 0) & ~waived, "unknown")
    return F.when(c.rlike(WAIVER_CODE), told)
