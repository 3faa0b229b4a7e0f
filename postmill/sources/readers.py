"""Reading posts, checkpoints, pages and activity documents, with leniency where sources are careless."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import htmlx, jsonx
from postmill.functions import text as T
from postmill.functions.numbers import coerce_variant, social_count
from postmill.functions.tags import tags_of_variant
from postmill.operators.quality import add_cleaned_post
from postmill.operators.retrieval import first_per_fingerprint
from postmill.session import ship_package
from postmill.sources.files import exists

LANGUAGES = ("English", "Hinglish")


def _elements(spark: SparkSession, path: str, what: str) -> DataFrame:
    """``idx, v``: the elements of a JSON file that must hold a list of objects; their position is their key.

    One file is one row here and its elements are exploded at once; large collections belong into Parquet with an
    explicit idx, for which no reader is needed.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    checked = whole.select(
        F.when(F.schema_of_variant("doc").startswith("ARRAY"), F.col("doc")).otherwise(F.raise_error(F.lit(f"{what} must contain a list."))).alias("doc")
    )
    items = checked.select(F.posexplode(F.try_variant_get("doc", "$", "array<variant>")).alias("pos", "v"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    bad = F.raise_error(F.concat(F.lit(f"{what}: element "), F.col("pos").cast("string"), F.lit(" is not an object.")))
    return items.select(F.col("pos").cast("bigint").alias("idx"), F.when(is_object, F.col("v")).otherwise(bad).alias("v"))


def _field(name: str, kind: str = "variant"):
    return F.try_variant_get("v", f"$.{name}", kind)


def _text(what: str):
    text = F.coalesce(_field("text", "string"), F.lit(""))
    empty = F.raise_error(F.concat(F.lit(f"{what}: element "), F.col("idx").cast("string"), F.lit(" has no text.")))
    return F.when(T.strip(text) == "", empty).otherwise(text)


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """``idx, text, engagement`` of a JSON list of posts; unknown keys are ignored, a missing or blank text stops the read."""
    rows = _elements(spark, path, "Raw posts")
    return rows.select("idx", _text("Raw posts").alias("text"), coerce_variant(_field("engagement")).alias("engagement"))


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx, text, engagement`` of JSON Lines, an object with ``idx`` in each line: the form for large collections.

    Files are split between tasks anywhere. Unknown keys are ignored; a line that is no object, has no idx, or a missing or
    blank text stops the read.
    """
    lines = spark.read.text(path).where(T.strip(F.col("value")) != "").select(F.try_parse_json("value").alias("v"), "value")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("Raw posts: no object with an idx in the line "), F.substring("value", 1, 80)))
    keyed = lines.select(F.when(is_object, F.try_variant_get("v", "$.idx", "bigint")).alias("idx"), "v", "value")
    rows = keyed.select(F.coalesce(F.col("idx"), bad.cast("bigint")).alias("idx"), "v")
    return rows.select("idx", _text("Raw posts").alias("text"), coerce_variant(_field("engagement")).alias("engagement"))


def read_processed_posts(spark: SparkSession, path: str, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``idx, text, engagement, line_count, language, tags`` of a JSON list; a language that isn't supported stops the read."""
    return _processed(_elements(spark, path, "Processed posts"), languages)


def _processed(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    spoken = F.coalesce(F.nullif(T.strip(_field("language", "string")), F.lit("")), F.lit("English"))
    refused = F.raise_error(F.concat(F.lit("Unsupported language "), spoken))
    return rows.select(
        "idx",
        _text("Processed posts").alias("text"),
        coerce_variant(_field("engagement")).alias("engagement"),
        coerce_variant(_field("line_count")).alias("line_count"),
        F.when(spoken.isin(*languages), spoken).otherwise(refused).alias("language"),
        tags_of_variant(_field("tags")).alias("tags"),
    )


def read_checkpoint(spark: SparkSession, path: str, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Posts of a checkpoint file ``{"records": [{"index", "post"}]}``; a missing file has none, of equal indexes the last counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], "idx bigint, text string, engagement bigint, line_count bigint, language string, tags array<string>")
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    records = F.try_variant_get("doc", "$.records", "array<variant>")
    malformed = F.raise_error(F.lit("Checkpoint file is malformed."))
    items = whole.select(F.posexplode(F.when(records.isNotNull(), records).otherwise(malformed)).alias("pos", "r"))
    rows = items.select("pos", F.try_variant_get("r", "$.index", "bigint").alias("idx"), F.try_variant_get("r", "$.post", "variant").alias("v"))
    rows = rows.select("pos", F.when(F.col("idx").isNotNull() & F.col("v").isNotNull(), F.col("idx")).otherwise(malformed).alias("idx"), "v")
    last = rows.groupBy("idx").agg(F.max_by("v", "pos").alias("v"))
    return _processed(last, languages)


def latest_checkpoints(states: DataFrame) -> DataFrame:
    """The last written state of each idx from ``idx, written_at, post``, rows without either key left out."""
    last = states.where("idx IS NOT NULL AND written_at IS NOT NULL").groupBy("idx").agg(F.max_by("post", "written_at").alias("post"), F.max("written_at").alias("written_at"))
    return last.select("idx", "written_at", "post.*")


def posts_of_pages(pages: DataFrame, id_col: str = "idx", html_col: str = "html") -> DataFrame:
    """``idx, text, engagement``: posts of the cards in ``pages``, cleaned, the first of each fingerprint.

    A page may hold any number of cards, inside one another too; idx is that of the page. A card's text is its first text
    block, else the first place that texts are in, else all of it. Pages that are null or hold no card give no row.
    """
    ship_package(pages.sparkSession)
    cards = pages.select(F.col(id_col).alias("idx"), F.posexplode(htmlx.html_cards(F.col(html_col))).alias("at", "card"))
    likely = cards.where(htmlx.likely_post(F.col("card")))
    block = F.get(F.col("card.blocks"), F.lit(0))
    raw = F.when(F.length(F.coalesce(block, F.lit(""))) >= 3, block).otherwise(F.coalesce(F.nullif("card.content", F.lit("")), F.col("card.text")))
    blob = social_count(F.col("card.text"))
    found = likely.select(
        F.struct("idx", "at").alias("key"), "idx", raw.alias("raw"), F.when(blob > 0, blob).otherwise(htmlx.card_likes(F.col("card"))).alias("engagement")
    )
    return _cleaned(found.where(F.length(F.trim("raw")) >= 3), "key").drop("key")


def posts_of_activity(documents: DataFrame, id_col: str = "idx", json_col: str = "json") -> DataFrame:
    """``idx, text, engagement``: posts of activity documents, one count for all texts of a part, the first of each fingerprint."""
    ship_package(documents.sparkSession)
    parts = documents.select(F.col(id_col).alias("idx"), F.posexplode(jsonx.json_containers(F.col(json_col))).alias("part", "c"))
    texts = parts.select("idx", "part", jsonx.largest_count(F.col("c.counts")).alias("engagement"), F.posexplode("c.texts").alias("at", "raw"))
    keyed = texts.select(F.struct("idx", "part", "at").alias("key"), "idx", "raw", "engagement")
    return _cleaned(keyed, "key").drop("key")


def _cleaned(found: DataFrame, order: str) -> DataFrame:
    posts = add_cleaned_post(found, "raw").select(*[c for c in found.columns if c != "raw"], F.col("clean").alias("text"), "fp")
    return first_per_fingerprint(posts, order).drop("fp")


def first_source(*sources: DataFrame) -> DataFrame:
    """The first of several sources that has any row."""
    for source in sources[:-1]:
        if not source.isEmpty():
            return source
    return sources[-1]


@dataclass(frozen=True)
class Settings:
    """Paths and limits, from the environment where it sets them; a bad number counts as not set."""

    raw_path: str = "data/raw_posts.json"
    processed_path: str = "data/processed_posts.json"
    max_scrolls: int = 3
    scroll_pause: float = 0.8
    page_timeout: int = 7

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None, prefix: str = "POSTMILL_") -> Settings:
        environment = dict(os.environ) if environment is None else environment
        values = {}
        for name, default in cls().__dict__.items():
            raw = environment.get(f"{prefix}{name.upper()}")
            try:
                values[name] = default if raw is None or not raw.strip() else type(default)(raw)
            except ValueError:
                values[name] = default
        return cls(**values)


def sidecar_path(target: str, label: str) -> str:
    """``posts.json`` and ``failures`` give ``posts.failures.json`` beside it."""
    path = Path(target)
    return str(path.with_name(f"{path.stem}.{label}.json"))
