"""The silver columns of a table of posts, the reasons against a post, and its score as an example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.tags import normalize_tags
from postmill.session import ship_package


def add_clean_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``normalized, clean, clean_lines, n_words, n_unique, fp, reason``, each worked out once.

    clean is the sanitized text, fp what texts are compared by, reason why a text is no post, or null. A null text
    counts as empty. One Arrow function gives all of them, behind a generator, through which the optimizer moves no
    filter: it would call the function again for it.
    """
    return _silver(df, text_col, False)


CLEAN_COLUMNS = ("normalized", "clean", "clean_lines", "n_words", "n_unique", "fp", "reason")


def _silver(df: DataFrame, text_col: str, scraped: bool) -> DataFrame:
    ship_package(df.sparkSession)
    others = [F.col(f"`{c}`") for c in df.columns if c not in CLEAN_COLUMNS]
    return df.select(*others, F.inline(F.array(T.silver_columns(F.col(text_col), scraped))))


def add_cleaned_post(df: DataFrame, raw_col: str) -> DataFrame:
    """``df`` with the silver columns of scraped text after its whole cleaning; ``clean`` is the post. Null counts as empty."""
    return _silver(df, raw_col, True)


def example_score(engagement: Column, tags: Column, line_count: Column) -> Column:
    """Worth of a post as an example, from the silver columns; minus infinity for what is no post.

    line_count is the stored one; 0 or null stands for the text's own.
    """
    lines = F.when(F.coalesce(line_count, F.lit(0)) != 0, line_count).otherwise(F.col("clean_lines"))
    score = (
        F.least("n_words", F.lit(80)) / 8.0
        + F.least(F.length("clean"), F.lit(600)) / 150.0
        + F.least("n_unique", F.lit(50)) / 50.0
        + F.when(lines > 1, 1.25).otherwise(0.0)
        + F.least(F.size(F.coalesce(tags, F.array().cast("array<string>"))), F.lit(2)) * 0.35
        + F.log1p(F.greatest(F.coalesce(engagement, F.lit(0)), F.lit(0)).cast("double")) * 0.45
        - F.when((lines <= 1) & (F.col("n_words") < 10), 2.0).otherwise(0.0)
    )
    return F.when(F.col("reason").isNotNull(), F.lit(float("-inf"))).otherwise(score)


def silver(posts: DataFrame) -> DataFrame:
    """Posts with normalized tags, silver columns, ``score`` and ``length`` (of the stored text).

    posts: ``idx, text, engagement, line_count, language, tags``; other columns are left out. Null engagement and
    line_count count as 0, null language as English, null tags as none.
    """
    chosen = posts.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("engagement").cast("bigint"), F.lit(0).cast("bigint")).alias("engagement"),
        F.coalesce(F.col("line_count").cast("bigint"), F.lit(0).cast("bigint")).alias("line_count"),
        F.coalesce(F.nullif(T.strip(F.col("language")), F.lit("")), F.lit("English")).alias("language"),
        normalize_tags(F.col("tags")).alias("tags"),
    )
    scored = add_clean_columns(chosen)
    return scored.withColumn("score", example_score(F.col("engagement"), F.col("tags"), F.col("line_count"))).withColumn("length", F.length("text"))
