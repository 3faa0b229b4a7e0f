"""The pN_ queries, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, canonical, language, mixing, mojibake, neardup, oracles, pii, representative, residue, subjects
from postmill.session import read_table

#: TESTDATA.md: adjacent words, similarity 0.75 or more, posts of 25 words or more.
POST_COPIES = {"width": 2, "similarity": 0.75, "min_words": 25}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = read_table(spark, sf_dir, "processed_posts")
    return language.label_errors(posts, language.fit_on(posts)).withColumnRenamed("id", "idx")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = read_table(spark, sf_dir, "processed_posts")
    return language.segment_table(posts, language.fit_on(posts)).withColumnRenamed("id", "idx")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged_ids(read_table(spark, sf_dir, "raw_posts")).withColumnRenamed("id", "idx")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired_table(read_table(spark, sf_dir, "raw_posts")).withColumnRenamed("id", "idx")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.duplicate_links(read_table(spark, sf_dir, "processed_posts"), **POST_COPIES)
    return neardup.all_pairs(members, links)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(read_table(spark, sf_dir, "processed_posts"), **POST_COPIES)
    return groups.withColumnRenamed("id", "idx")


def _copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of two posts or more."""
    groups = neardup.near_duplicate_groups(read_table(spark, sf_dir, "processed_posts"), **POST_COPIES)
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(several, "group_id", "left_semi").select("id", "group_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.best_fields(read_table(spark, sf_dir, "processed_posts"), _copy_groups(spark, sf_dir))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.consolidated(read_table(spark, sf_dir, "processed_posts"), _copy_groups(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = canonical.map_values(read_table(spark, sf_dir, "processed_posts"), read_table(spark, sf_dir, "canonical_tags"))
    return mapped.select(F.col("id").alias("idx"), F.col("value").alias("tag_raw"), "canon_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unmatched_values(read_table(spark, sf_dir, "processed_posts"), read_table(spark, sf_dir, "canonical_tags"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.residue_rows(read_table(spark, sf_dir, "raw_posts"))
    return found.select(F.col("id").alias("idx")).distinct()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(read_table(spark, sf_dir, "raw_posts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.kinds_found(read_table(spark, sf_dir, "raw_posts"))
    return found.select(F.col("id").alias("idx"), F.col("kind").alias("pii_kind"))


def p7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_table(read_table(spark, sf_dir, "raw_posts")).withColumnRenamed("id", "idx")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))
    return mix.documents.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "source_targets")
    return mixing.reached_shares(mixing.mix_sources(read_table(spark, sf_dir, "documents"), targets), targets)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return subjects.fitted_subjects(documents, read_table(spark, sf_dir, "doc_labels"), read_table(spark, sf_dir, "subjects"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select(F.col("id").alias("doc_id"), "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_subjects(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_segments": p1_segments,
        "p2_found": p2_found,
        "p2_repaired": p2_repaired,
        "p3_found": p3_found,
        "p3_groups": p3_groups,
        "p4_found": p4_found,
        "p4_records": p4_records,
        "p5_found": p5_found,
        "p5_unmatched": p5_unmatched,
        "p6_found": p6_found,
        "p6_clean": p6_clean,
        "p7_found": p7_found,
        "p7_masked": p7_masked,
        "p8_ids": p8_ids,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_composition": p10_composition,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
