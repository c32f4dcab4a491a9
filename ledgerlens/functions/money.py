"""Amounts in words, signs, brackets and currencies, read by one grammar: sign, mark, number, unit, mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as no amount, currencies that are dropped, marks of the sides, and units.
BLANK = ["", "-", "--", "nil", "n/a", "nan", "none"]
CURRENCY = r"(?i)[₹$£€]|INR|Rs\.?|USD|GBP|EUR"
CREDIT, DEBIT = ["cr", "c"], ["dr", "d"]
UNITS = {"lakh": 1e5, "lac": 1e5, "crore": 1e7}

_MARK, _UNIT = "|".join(CREDIT + DEBIT), "|".join(UNITS)
#: A minus, a mark in front, what stands between, and a mark behind; and a number with its unit anywhere.
_SIGNED = rf"(?is)^\s*(-?)\s*(?:({_MARK})\b)?(.*?)\s*({_MARK})?\s*$"
_MEASURED = rf"(?i)(\d[\d,]*\.?\d*|,[\d,]*\.?\d*)\s*({_UNIT})\b"


def _inside(text: Column) -> tuple[Column, Column]:
    """Whether a text stands in brackets, and what stands in them."""
    held = text.startswith("(") & text.endswith(")")
    return held, F.when(held, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def _number(text: Column) -> Column:
    """The number that a text's digits make, with its first dot; 0 if they make none."""
    kept = F.regexp_replace(text, r"[^\d.\-]", "")
    whole = F.regexp_replace(kept, r"(?<=\.[^.]{0,99})\.", "")
    return F.abs(F.coalesce(whole.try_cast("double"), F.lit(0.0)))


def with_amount(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds a signed amount: brackets, a minus and, without a unit, a debit mark make it negative; unreadable text is 0."""
    held, inner = _inside(F.trim(raw))
    parsed = rows.withColumns({"_held": held, "_text": F.trim(F.regexp_replace(inner, CURRENCY, ""))})
    group = lambda pattern, k: F.lower(F.regexp_extract("_text", pattern, k))
    parsed = parsed.withColumns({"_unit": group(_MEASURED, 2), "_size": group(_MEASURED, 1), "_minus": group(_SIGNED, 1), "_front": group(_SIGNED, 2), "_body": group(_SIGNED, 3), "_back": group(_SIGNED, 4)})
    times = F.element_at(F.create_map(*(F.lit(x) for u in UNITS.items() for x in u)), F.col("_unit"))
    value = F.when(F.col("_unit") != "", _number(F.col("_size")) * times).otherwise(_number(F.concat("_minus", "_body")))
    owed = (F.col("_unit") == "") & (F.col("_back").isin(DEBIT) | F.col("_front").isin(DEBIT))
    negative = F.col("_held") | (F.col("_minus") != "") | owed
    blank = F.col(raw).isNull() | F.lower(F.trim(raw)).isin(BLANK)
    amount = F.when(blank, 0.0).otherwise(F.when(negative & (value != 0), -value).otherwise(value))
    return parsed.withColumn(name, amount).drop("_held", "_text", "_unit", "_size", "_minus", "_front", "_body", "_back")


def parse_unsigned(raw: Column) -> Column:
    """struct(amount, sign): the size of the amount and '+', '-' or '': a mark in front decides, then a minus or brackets, then a mark behind."""
    sides = {"cr": "+", "dr": "-"}
    grammar = r"(?is)^\s*(?:(cr|dr)\b\.?\s*)?(-?)(\(?)(.*?)(cr|dr)?(\)?)\s*$"
    part = lambda k: F.lower(F.regexp_extract(F.trim(raw), grammar, k))
    side = lambda mark: F.element_at(F.create_map(*(F.lit(x) for s in sides.items() for x in s)), F.nullif(mark, F.lit("")))
    held = (part(3) != "") & (part(6) != "")
    less = F.when((part(2) != "") | held, "-")
    amount = F.coalesce(F.regexp_replace(F.regexp_replace(part(4), r"(?i)[₹$£€]|INR|Rs\.?", ""), r"[^\d.]", "").try_cast("double"), F.lit(0.0))
    blank = raw.isNull() | F.trim(raw).isin("", "-", "--", "nil", "n/a", "nan")
    sign = F.when(side(part(1)) == "-", "-").otherwise(F.coalesce(side(part(1)), less, F.when(held | (part(6) == ""), side(part(5))), F.lit("")))
    return F.struct(F.when(blank, 0.0).otherwise(amount).alias("amount"), F.when(blank, "").otherwise(sign).alias("sign"))
