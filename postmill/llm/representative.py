"""Problem 4: the best record of each duplicate group, field by field.

Records are ranked by window ordering, and the top row of each group is kept: the surviving record by how complete it is,
how trusted its origin is and how recent it is, ties going to the smallest id. Its text, engagement and tags are the best
that the group offers, each ranked by a worth of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"^[\s\p{Z}\p{Cf}]*$"
#: Origins of records, most trusted first: an interface tells more reliably than a page, and a page more than a file of unknown source.
TRUST = ("voyager", "dom", "import")


def distinct_tags(tags) -> Column:
    """Number of different non-blank elements; 0 for a null or empty array."""
    kept = F.filter(tags, lambda t: t.isNotNull() & ~t.rlike(BLANK))
    return F.coalesce(F.size(F.array_distinct(kept)), F.lit(0))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    """A column of ``df``, or nulls where it has none of that name."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _rated(df: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Of each member of a group what it is ranked by; no texts."""
    filled = lambda c: F.when(c, 1).otherwise(0)
    trust = F.array_position(F.array(*map(F.lit, TRUST)), F.coalesce(_column(df, "origin", "string"), F.lit("")))
    source = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("text"),
        F.col("engagement").cast("bigint").alias("engagement"),
        distinct_tags(F.col("tags")).cast("bigint").alias("tags"),
        F.when(trust == 0, len(TRUST) + 1).otherwise(trust).cast("int").alias("distrust"),
        _column(df, "processed_at", "timestamp_ntz").alias("seen_at"),
        (filled(F.coalesce(_column(df, "language", "string"), F.lit("")) != "") + filled(F.coalesce(_column(df, "line_count", "bigint"), F.lit(0)) > 0)).alias("others"),
    )
    source = source.withColumn("complete", F.col("others") + filled(F.col("text") > 0) + filled(F.col("engagement").isNotNull()) + filled(F.col("tags") > 0))
    return groups.select("id", "group_id").join(source.drop("others"), "id")


def _best(rated: DataFrame) -> DataFrame:
    """``group_id, field, id``: the top member of each group for each field; a value that is null is no candidate.

    Only the first row of an order is kept, so a hot group is cut to one row per field in each input partition before the shuffle.
    """
    worths = [F.struct(F.lit(f).alias("field"), F.col(f).alias("worth")) for f in ("text", "engagement", "tags")]
    told = rated.select("group_id", "id", F.explode(F.array(*worths)).alias("f")).select("group_id", "id", "f.field", "f.worth").where("worth IS NOT NULL")
    order = Window.partitionBy("group_id", "field").orderBy(F.col("worth").desc(), "id")
    return told.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("group_id", "field", "id")


def _picked(best: DataFrame) -> DataFrame:
    pick = lambda field: F.max(F.when(F.col("field") == field, F.col("id"))).alias(f"{field}_idx")
    return best.groupBy("group_id").agg(pick("text"), pick("engagement"), pick("tags")).withColumnRenamed("group_id", "group_idx")


def best_fields(df: DataFrame, groups: DataFrame, id_col: str = "idx") -> DataFrame:
    """``group_idx, text_idx, engagement_idx, tags_idx`` for each group of two or more records.

    groups: ``id, group_id``. text_idx has the longest text in characters (a null text counts as shortest),
    engagement_idx the highest engagement that isn't null (null if the group has none), tags_idx the most different
    non-blank tags. Ties go to the smallest id, which also names the group; trust and recency don't count here. Of rows
    with the same id the one of most worth counts.
    """
    return _picked(_best(_rated(df, groups, id_col)))


def best_records(df: DataFrame, groups: DataFrame, id_col: str = "idx") -> DataFrame:
    """``group_idx, record_idx``: the best whole record of each group.

    Order: how many of text, engagement, tags, language and line_count are filled, then the trust in its origin (an unknown one
    least), then the latest processed_at (null last), then the smallest id. Columns that ``df`` lacks count as null.
    """
    order = Window.partitionBy("group_id").orderBy(F.col("complete").desc(), "distrust", F.col("seen_at").desc_nulls_last(), "id")
    ranked = _rated(df, groups, id_col).select("group_id", "id", "complete", "distrust", "seen_at").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank = 1").select(F.col("group_id").alias("group_idx"), F.col("id").alias("record_idx"))


def consolidated(df: DataFrame, groups: DataFrame, id_col: str = "idx") -> DataFrame:
    """One record per group: ``group_idx, record_idx, text, engagement, tags``.

    record_idx is the record that survives, by ``best_records``; text, engagement and tags are those of the members that
    ``best_fields`` names. Where an id is there with different rows, the field of most worth of that id is taken, ties by its value.
    """
    best = best_fields(df, groups, id_col).join(best_records(df, groups, id_col), "group_idx")
    source = df.select(F.col(id_col).cast("bigint").alias("id"), "text", F.col("engagement").cast("bigint").alias("engagement"), "tags")

    def take(field: str, worth: Column) -> DataFrame:
        chosen = best.select(F.col(f"{field}_idx").alias("id")).distinct()
        order = Window.partitionBy("id").orderBy(worth.desc_nulls_last(), F.col(field).desc_nulls_last())
        one = source.select("id", field).join(chosen, "id", "left_semi").withColumn("rank", F.row_number().over(order)).where("rank = 1")
        return one.select(F.col("id").alias(f"{field}_idx"), field)

    return (
        best.join(take("text", F.length("text")), "text_idx", "left")
        .join(take("engagement", F.col("engagement")), "engagement_idx", "left")
        .join(take("tags", distinct_tags(F.col("tags"))), "tags_idx", "left")
        .select("group_idx", "record_idx", "text", "engagement", "tags")
    )
