"""Arrays of tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip


def normalize_tags(tags: Column) -> Column:
    """Stripped, without blank and null elements and repeats, in the order of first sight; null gives an empty array."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, empty), strip), lambda t: t.isNotNull() & (t != "")))


def tags_of_variant(value: Column) -> Column:
    """Tags from a VARIANT: an array's elements or the one value, as text."""
    kind = F.schema_of_variant(value)
    many = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    one = F.array(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
    empty = F.array().cast("array<string>")
    return normalize_tags(F.when(value.isNull() | (kind == "VOID"), empty).when(kind.startswith("ARRAY"), many).otherwise(one))


def remap_tags(tags: Column, mapping: Column) -> Column:
    """Every tag by a map of raw to unified tags, those it lacks as they are; repeats go."""
    return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(mapping, t), t)))
