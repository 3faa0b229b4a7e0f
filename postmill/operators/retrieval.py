"""Ranking posts and finding the best examples for a brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.numbers import length_bucket
from postmill.session import cut_lineage

#: Tiers of a match and their labels, best first (fixed values).
TIERS = ("exact_match", "same_tag_same_language", "same_tag_any_language", "global_best")
LABELS = (
    "Exact match",
    "Same tag and language; length relaxed",
    "Same tag; language and length relaxed",
    "Global fallback",
)
MOST_EXAMPLES = 5


def _worth() -> list[Column]:
    return [F.col("score").desc(), F.col("engagement").desc(), F.col("length").desc()]


def usable(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("reason").isNull() & (F.col("fp") != ""))


def _print_key(*more: str) -> list[Column]:
    """What stands for a fingerprint where rows are grouped: two hashes, far shorter than the text."""
    return [F.xxhash64("fp").alias("k1"), F.xxhash64(F.lit(7), "fp").alias("k2"), *map(F.col, more)]


def best_per_fingerprint(silver: DataFrame) -> DataFrame:
    """The best usable post of each fingerprint, with ``first_idx``, the smallest idx of its group.

    Order: score, engagement, length; ties go to the smaller idx. A hot fingerprint is cut to one row in each input partition
    before the shuffle, and its smallest idx is a sum of such minima.
    """
    order = Window.partitionBy("k1", "k2").orderBy(*_worth(), "idx")
    posts = usable(silver)
    best = posts.select("*", *_print_key()).withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    firsts = posts.select(*_print_key("idx")).groupBy("k1", "k2").agg(F.min("idx").alias("first_idx"))
    return best.join(firsts, ["k1", "k2"]).drop("k1", "k2")


def first_per_fingerprint(df: DataFrame, order_col: str = "idx") -> DataFrame:
    """The first row of each fingerprint; rows with an empty one go. A hot fingerprint is cut before the shuffle."""
    order = Window.partitionBy("fp").orderBy(order_col)
    return df.where(F.col("fp") != "").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def filtered_posts(silver: DataFrame, length: str, language: str, tag: str) -> DataFrame:
    """Usable posts of a length bucket, language and tag, the best of each fingerprint, with ``rank`` from 1, best first."""
    matching = silver.where(
        (F.col("language") == language) & F.array_contains("tags", tag) & (length_bucket(F.col("line_count")) == length)
    )
    return numbered(best_per_fingerprint(matching), [*_worth(), F.col("first_idx")])


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with numbers from 1 in an order, without a partition that sees all rows.

    The rows are sorted by ranges; a row's number is its place in its partition and the sizes of the partitions before it,
    of which the driver gets one number each.
    """
    placed = cut_lineage(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = {r["__part"]: r.n for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(before)]
        before += sizes[part]
    within = F.col("__at") - F.shiftleft(F.col("__part").cast("bigint"), 33)
    start = F.element_at(F.create_map(*starts), F.col("__part")) if starts else F.lit(0)
    return placed.withColumn(name, (start + within + 1).cast("bigint")).drop("__part", "__at")


def prompt_examples(silver: DataFrame, briefs: DataFrame, limit: int = MOST_EXAMPLES) -> DataFrame:
    """The ``limit`` best examples of each brief, by tier and then worth; one pass over the posts for all briefs.

    briefs: ``brief_id, length, language, tag``. Tiers nest: length, then language, then tag is given up. A
    fingerprint counts in its best tier only. Within a tier ties go to the fingerprint seen first among the rows of
    that tier. A limit of 0 or less gives nothing.

    No brief meets all posts: of each tag, language and length bucket only the best ``limit`` fingerprints (and
    their equals) can be in a result, and of all posts the best ``2 * limit``, as fewer than ``limit`` of those can
    have gone to better tiers. Both are cut in the input partitions before the shuffle, on numbers and hashes alone; texts
    are fetched for the few posts chosen. silver is read several times, so cut its lineage first.
    """
    ranks = ["idx", "score", "engagement", "length"]
    posts = usable(silver).select(*_print_key(*ranks), "language", length_bucket(F.col("line_count")).alias("bucket"), "tags")
    tagged = posts.withColumn("tag", F.explode(F.array_distinct("tags"))).drop("tags")
    group = ["tag", "k1", "k2"]
    # The best post of each fingerprint in each cell, then the best fingerprints of the cell; rank keeps the equals of the last one.
    one = Window.partitionBy(*group, "language", "bucket").orderBy(*_worth(), "idx")
    cell = Window.partitionBy("tag", "language", "bucket").orderBy(*_worth())
    cells = tagged.withColumn("__nth", F.row_number().over(one)).where("__nth = 1").withColumn("__rank", F.rank().over(cell)).where(F.col("__rank") <= limit).drop("__nth", "__rank")
    # The first idx of a fingerprint among the rows of each tier, from minima that are made before the shuffle.
    least = tagged.groupBy(*group, "language", "bucket").agg(F.min("idx").alias("i0"))
    least = least.join(least.groupBy(*group, "language").agg(F.min("i0").alias("i1")), [*group, "language"]).join(least.groupBy(*group).agg(F.min("i0").alias("i2")), group)
    cells = cells.join(least, [*group, "language", "bucket"])
    wanted = briefs.select("brief_id", F.col("length").alias("w_length"), F.col("language").alias("w_language"), "tag")
    spoken = F.col("language") == F.col("w_language")
    tier = F.when(spoken & (F.col("bucket") == F.col("w_length")), 0).when(spoken, 1).otherwise(2)
    matches = cells.join(wanted, "tag").withColumn("tier", tier).select("brief_id", "tier", "k1", "k2", *ranks, F.get(F.array("i0", "i1", "i2"), F.col("tier")).alias("first_idx"))
    narrow = silver.select("idx", "reason", "fp", "score", "engagement", "length")
    overall = best_per_fingerprint(narrow).orderBy(*_worth(), "first_idx").limit(max(0, 2 * limit)).select(*_print_key(*ranks, "first_idx"), F.lit(1).alias("__all"))
    rest = wanted.select("brief_id", F.lit(1).alias("__all")).join(F.broadcast(overall), "__all").select("brief_id", F.lit(3).alias("tier"), "k1", "k2", *ranks, "first_idx")
    met = Window.partitionBy("brief_id", "k1", "k2")
    best = (
        matches.unionByName(rest)
        .withColumn("__tier", F.min("tier").over(met))
        .where("tier = __tier")
        .withColumn("__rank", F.row_number().over(met.orderBy(*_worth(), "idx")))
        .where("__rank = 1")
    )
    order = Window.partitionBy("brief_id").orderBy("tier", *_worth(), "first_idx")
    chosen = best.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= limit).select("brief_id", "position", "idx", "tier")
    return chosen.join(silver.select("idx", "text", "engagement", "line_count", "language", "tags", "score"), "idx").select(
        "brief_id", "position", "idx", "text", "engagement", "line_count", "language", "tags", "score",
        F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("match_tier"),
        F.element_at(F.array(*map(F.lit, LABELS)), F.col("tier") + 1).alias("match_label"),
    )


def tag_universe(silver: DataFrame) -> DataFrame:
    """Every tag of a post that is one, once, in code-point order."""
    return silver.where(F.col("reason").isNull()).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def dashboard_counts(silver: DataFrame) -> DataFrame:
    """One row: posts, usable tags, and the languages in order, joined by commas. The posts are read once."""
    tags = F.transform(F.when(F.col("reason").isNull(), F.col("tags")).otherwise(F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value")))
    told = F.concat(F.array(F.struct(F.lit("post").alias("kind"), F.lit("").alias("value")), F.struct(F.lit("language").alias("kind"), F.col("language").alias("value"))), tags)
    seen = silver.select(F.explode(told).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    of = lambda kind: F.col("kind") == kind
    return seen.agg(
        F.coalesce(F.sum(F.when(of("post"), F.col("n"))), F.lit(0).cast("bigint")).alias("n_posts"),
        F.count(F.when(of("tag"), 1)).alias("n_tags"),
        F.array_join(F.array_sort(F.collect_set(F.when(of("language"), F.col("value")))), ",").alias("languages"),
    )
