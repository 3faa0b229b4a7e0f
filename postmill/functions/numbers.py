"""Counts in free form, and numbers that may be anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import inline, strip

# What a count looks like, and the words for reactions beside it.
_COUNT = r"\d{1,3}(?:[.,]\d{3})+|\d+(?:\.\d+)?(?:\s?[KkMm])?"
FIRST_COUNT = rf"\b({_COUNT})\b"
SOCIAL_COUNT = rf"(?i)\b({_COUNT})\s*(?:reactions?|likes?|react)\b"
SOCIAL_COUNT_AFTER = rf"(?i)(?:reactions?|likes?|react)\s*[:\-]?\s*({_COUNT})\b"
_MAGNITUDE = r"(?i)^(\d{1,3}(?:[.,]\d{3})+|\d+(?:\.\d+)?)(?:\s?([KM]))?$"


def length_bucket(lines: Column) -> Column:
    return F.when(lines < 5, "Short").when(lines <= 10, "Medium").otherwise("Long")


def abbreviated_number(value: Column) -> Column:
    """``1.2K`` as 1200; what isn't a count, or is null, as 0. Beyond the magnitude a fraction is cut off."""
    text = F.replace(strip(value), F.lit(","), F.lit(""))
    number = F.regexp_extract(text, _MAGNITUDE, 1).try_cast("double")
    suffix = F.upper(F.regexp_extract(text, _MAGNITUDE, 2))
    factor = F.when(suffix == "K", 1000).when(suffix == "M", 1_000_000).otherwise(1)
    return F.coalesce((number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def first_number(text: Column) -> Column:
    return abbreviated_number(F.regexp_extract(F.coalesce(text, F.lit("")), FIRST_COUNT, 1))


def social_count(text: Column) -> Column:
    """The count that stands by a word for reactions, before it or else after it; 0 without."""
    flat = inline(F.coalesce(text, F.lit("")))
    before, after = F.regexp_extract(flat, SOCIAL_COUNT, 1), F.regexp_extract(flat, SOCIAL_COUNT_AFTER, 1)
    return abbreviated_number(F.when(before != "", before).otherwise(after))


def coerce_int(value: Column, default: int = 0) -> Column:
    """A whole number from text: blanks around it and underscores between digits don't matter, anything else gives the default."""
    plain = F.regexp_replace(strip(value), r"(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint")), F.lit(default).cast("bigint"))


def coerce_variant(value: Column, default: int = 0) -> Column:
    """A whole number from a VARIANT: text as ``coerce_int``, fractions cut off, true as 1, anything else the default.

    Infinite and other numbers beyond a bigint give the default too.
    """
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(kind == "STRING", coerce_int(F.try_variant_get(value, "$", "string"), default))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (F.abs(number) < 9e18), number.cast("bigint")),
        F.lit(default).cast("bigint"),
    )
