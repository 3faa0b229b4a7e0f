"""Queries over the tables of a data directory, one for each operator or family of operators."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import htmlx, jsonx, numbers
from postmill.functions import text as T
from postmill.functions.tags import normalize_tags, remap_tags
from postmill.operators import dedup, enrich, generate, quality, retrieval
from postmill.plans import oracles
from postmill.session import cut_lineage, read_table, ship_package
from postmill.sources import readers

Query = Callable[[SparkSession, str], DataFrame]


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.silver(read_table(spark, sf_dir, "processed_posts"))


def _text(spark: SparkSession, sf_dir: str, table: str, key: str = "idx", *more: str) -> DataFrame:
    """Key and canonical text of a table."""
    ship_package(spark)
    return read_table(spark, sf_dir, table).select(key, *more, T.canonicalize(F.col("text")).alias("text"))


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief for every canonical tag, lengths, languages and hashtag counts by turns."""
    tags = read_table(spark, sf_dir, "canonical_tags")
    turn = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("canon_id") % len(values)).cast("int"))
    controls = [F.lit(v).alias(k) for k, v in generate.DEFAULTS.items() if k != "hashtag_count"]
    return tags.select(
        F.col("canon_id").alias("brief_id"), turn(["Short", "Medium", "Long"]).alias("length"), turn(["English", "Hinglish"]).alias("language"),
        F.col("canon_tag").alias("tag"), *controls, (F.col("canon_id") % 4).alias("hashtag_count"),
    )


def clean_text(spark, sf_dir):
    return _silver(spark, sf_dir).select("idx", "clean", "fp", "clean_lines")


def quality_reason(spark, sf_dir):
    return _silver(spark, sf_dir).select("idx", F.coalesce("reason", F.lit("ok")).alias("reason"))


def quality_tally(spark, sf_dir):
    return quality_reason(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n_posts"))


def raw_quality(spark, sf_dir):
    judged = quality.add_clean_columns(read_table(spark, sf_dir, "raw_posts").select("idx", "text"))
    return judged.select("idx", F.coalesce("reason", F.lit("ok")).alias("reason"), "clean_lines", "n_words", "fp")


def score_posts(spark, sf_dir):
    return _silver(spark, sf_dir).where("reason IS NULL").select("idx", F.round("score", 6).alias("score"))


def text_preview(spark, sf_dir):
    return _text(spark, sf_dir, "processed_posts").select("idx", T.preview(F.col("text")).alias("preview"))


def length_buckets(spark, sf_dir):
    lines = F.coalesce(F.col("line_count"), F.lit(0))
    return read_table(spark, sf_dir, "processed_posts").groupBy(numbers.length_bucket(lines).alias("bucket")).agg(F.count("*").alias("n_posts"))


def fingerprint_best(spark, sf_dir):
    return retrieval.best_per_fingerprint(cut_lineage(_silver(spark, sf_dir))).select("fp", "idx", "first_idx")


def fingerprint_first(spark, sf_dir):
    return retrieval.first_per_fingerprint(_silver(spark, sf_dir)).select("fp", "idx")


def filtered_posts(spark, sf_dir):
    found = retrieval.filtered_posts(cut_lineage(_silver(spark, sf_dir)), "Short", "English", "Investing")
    return found.select("rank", "idx", F.round("score", 6).alias("score"), "engagement")


def prompt_examples(spark, sf_dir):
    found = retrieval.prompt_examples(cut_lineage(_silver(spark, sf_dir)), briefs(spark, sf_dir))
    return found.select("brief_id", "position", "idx", "engagement", F.round("score", 6).alias("score"), "match_tier", "match_label")


def post_prompts(spark, sf_dir):
    return generate.prompts_for(cut_lineage(_silver(spark, sf_dir)), briefs(spark, sf_dir))


def variants_prompts(spark, sf_dir):
    return generate.prompts_for(cut_lineage(_silver(spark, sf_dir)), briefs(spark, sf_dir), variants=True)


def stub_client():
    """Answers by what it is asked, as a model that is always of the same opinion would."""

    def answer(prompt: str) -> str:
        key = len(prompt)
        if prompt.startswith(enrich.TAGS_PROMPT):
            tags = prompt[len(enrich.TAGS_PROMPT) :].split(", ")
            return json.dumps({t: t.title() for t in tags})
        if prompt.startswith(enrich.METADATA_PROMPT):
            spoken = "Hinglish" if " hai" in prompt else "English"
            return "```json\n" + json.dumps({"language": spoken, "tags": [f"topic {key % 7}", f"Topic {key % 5}"]}) + "\n```"
        return json.dumps({"variants": [f"Variant {k} of {key % 1000}, with a first sentence. And a second one. #Tag{k}" for k in (1, 2, 3)]})

    return answer


def generated_variants(spark, sf_dir):
    wanted = briefs(spark, sf_dir)
    return generate.generate(variants_prompts(spark, sf_dir), wanted, stub_client, variants=True)


def variant_cards(spark, sf_dir):
    return generate.variant_cards(generated_variants(spark, sf_dir))


def brief_chips(spark, sf_dir):
    return generate.brief_chips(briefs(spark, sf_dir))


def tag_universe(spark, sf_dir):
    return retrieval.tag_universe(_silver(spark, sf_dir))


def _tags(spark, sf_dir):
    return read_table(spark, sf_dir, "processed_posts").select("idx", normalize_tags(F.col("tags")).alias("tags"))


def tags_normalized(spark, sf_dir):
    return _tags(spark, sf_dir).select("idx", F.array_join("tags", "|").alias("tags"))


def tag_counts(spark, sf_dir):
    return _tags(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_posts"))


def tag_remap(spark, sf_dir):
    """Aliases of the fixed list of canonical tags become its tags; the list is the size of a map."""
    refs = read_table(spark, sf_dir, "canonical_tags")
    names = refs.select("canon_tag", F.explode(F.concat(F.array("canon_tag"), "aliases")).alias("alias"))
    aliases = names.groupBy(F.lower("alias").alias("alias")).agg(F.min("canon_tag").alias("canon"))
    plain = _tags(spark, sf_dir).select("idx", F.posexplode("tags").alias("pos", "tag"))
    mapped = plain.join(aliases, F.lower("tag") == F.col("alias"), "left").groupBy("idx", F.coalesce("canon", "tag").alias("tag")).agg(F.min("pos").alias("pos"))
    kept = mapped.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t"))
    return kept.select("idx", F.array_join(F.col("t.tag"), "|").alias("tags"))


def tag_remap_by_map(spark, sf_dir):
    """``tag_remap`` by a map in the plan, as the answer of a model comes."""
    refs = read_table(spark, sf_dir, "canonical_tags").select("canon_tag", "aliases").orderBy("canon_tag").collect()  # a fixed list
    known = {a.lower(): r.canon_tag for r in reversed(refs) for a in [r.canon_tag, *(r.aliases or [])]}
    mapping = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    low = _tags(spark, sf_dir).where(F.size("tags") > 0).select("idx", F.transform("tags", lambda t: F.coalesce(F.try_element_at(mapping, F.lower(t)), t)).alias("tags"))
    return low.select("idx", F.array_join(remap_tags(F.col("tags"), mapping), "|").alias("tags"))


def response_previews(spark, sf_dir):
    return read_table(spark, sf_dir, "raw_posts").select("idx", T.response_preview(F.col("text")).alias("preview"))


def response_texts(spark, sf_dir):
    parts = read_table(spark, sf_dir, "failures").where("idx IS NOT NULL").distinct()
    return parts.select("idx", "failed_at", "stage", enrich.response_text(F.col("text_preview"), F.col("error_message"), F.col("reason")).alias("text"))


def first_keys(spark, sf_dir):
    """The first value under a key of nested documents made of the authors."""
    inner = F.struct("headline", F.struct("followers").alias("count"))
    document = F.to_json(F.struct(F.struct(F.lit(1).alias("none")).alias("first"), F.array(inner).alias("elements"), F.col("profile_kind")))
    return read_table(spark, sf_dir, "authors").select("author_id", jsonx.find_first_key(document, "headline").alias("headline"), jsonx.find_first_key(document, "followers").alias("followers"))


def option_check(spark, sf_dir):
    """Briefs whose hashtag counts run out of range, and what a result is keyed by."""
    wanted = briefs(spark, sf_dir).withColumn("hashtag_count", F.col("brief_id") % 6 - 1).withColumn("tone", F.when(F.col("brief_id") % 7 == 0, "Shouting").otherwise(F.col("tone")))
    return wanted.select("brief_id", generate.valid_options(wanted).alias("valid"), F.array_join(F.array(*[generate.brief_signature()[k].cast("string") for k in ("tag", "length", "tone", "hashtag_count")]), "/").alias("signature"))


def language_list(spark, sf_dir):
    stored = F.coalesce(F.nullif(T.strip(F.col("language")), F.lit("")), F.lit("English"))
    return read_table(spark, sf_dir, "processed_posts").select(stored.alias("language")).distinct()


def dashboard_counts(spark, sf_dir):
    return retrieval.dashboard_counts(_silver(spark, sf_dir))


def display_lines(spark, sf_dir):
    return _text(spark, sf_dir, "processed_posts").select("idx", T.display_lines(F.col("text")).alias("lines"))


def trailing_hashtags(spark, sf_dir):
    parts = _text(spark, sf_dir, "processed_posts").select("idx", T.trailing_hashtags(T.normalize_lines(F.col("text"))).alias("p"))
    return parts.select("idx", "p.body", "p.hashtags")


def hashtag_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "processed_posts").select("idx", T.hashtag_count(F.coalesce("text", F.lit(""))).alias("n"))


def tag_slugs(spark, sf_dir):
    fallback = F.concat(F.lit("variant-"), F.col("canon_id").cast("string"))
    return read_table(spark, sf_dir, "canonical_tags").select("canon_id", T.slug(F.col("canon_tag"), fallback).alias("slug"))


def label_numbers(spark, sf_dir):
    label = F.col("engagement_label")
    return read_table(spark, sf_dir, "raw_posts").select(
        "idx", numbers.abbreviated_number(label).alias("abbreviated"), numbers.first_number(label).alias("first_number"),
        numbers.social_count(label).alias("social"), numbers.coerce_int(label).alias("coerced"),
    )


def marker_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "raw_posts").select("idx", T.marker_count(F.coalesce("text", F.lit(""))).alias("n"))


def public_ids(spark, sf_dir):
    url = F.concat(F.lit("https://www.linkedin.com/in/"), F.col("public_id"), F.lit("/recent-activity/"))
    return read_table(spark, sf_dir, "authors").select("author_id", T.public_identifier(url).alias("public_id")).where("public_id IS NOT NULL")


def latest_checkpoints(spark, sf_dir):
    last = readers.latest_checkpoints(read_table(spark, sf_dir, "checkpoints"))
    return last.select("idx", "engagement", "line_count", "language", F.length("text").alias("n_chars"))


def pending_posts(spark, sf_dir):
    return enrich.pending(read_table(spark, sf_dir, "raw_posts").select("idx"), read_table(spark, sf_dir, "checkpoints"))


def valid_checkpoints(spark, sf_dir):
    return enrich.valid_checkpoint(read_table(spark, sf_dir, "checkpoints").select("idx"), read_table(spark, sf_dir, "raw_posts")).distinct()


def failure_tally(spark, sf_dir):
    return read_table(spark, sf_dir, "failures").distinct().groupBy("stage", "reason").agg(F.count("*").alias("n_failures"))


def cleaned_raw_posts(spark, sf_dir):
    raw = read_table(spark, sf_dir, "raw_posts").select("idx", "engagement_label", "text")
    return quality.add_cleaned_post(raw, "text").select("idx", F.col("clean").alias("text"), numbers.social_count(F.col("engagement_label")).alias("engagement"))


def variant_layout(spark, sf_dir):
    posts = _text(spark, sf_dir, "processed_posts")
    length = F.get(F.array(*map(F.lit, T.WRAP_WIDTH)), (F.col("idx") % 3).cast("int"))
    return posts.select("idx", T.variant_text(F.col("text"), length).alias("text"))


def near_duplicates(spark, sf_dir):
    silver = _silver(spark, sf_dir).where("reason IS NULL")
    _, losers = dedup.resolve_duplicates(silver.select("idx", "fp", "score", "engagement", "length"))
    return losers


def _batch(spark, sf_dir):
    return enrich.process_posts(read_table(spark, sf_dir, "raw_posts").select("idx", "text", "engagement"), stub_client, blank_fails=True)


def enriched_posts(spark, sf_dir):
    return _batch(spark, sf_dir).posts


def enrichment_failures(spark, sf_dir):
    return _batch(spark, sf_dir).failures


def html_posts(spark, sf_dir):
    """Posts read back from cards made of the documents' texts, one break element for each line end."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "engagement", F.coalesce("text", F.lit("")).alias("text"))
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))
    card = F.concat(
        F.lit('<article><div class="feed-shared-text">'), escaped, F.lit('</div><button aria-label="'), F.coalesce("engagement", F.lit(0)), F.lit(' reactions">ok</button></article>')
    )
    return readers.posts_of_pages(documents.select(F.col("doc_id").alias("idx"), card.alias("html")))


def page_posts(spark, sf_dir):
    """Posts of pages of several cards: an article, an element known by its class, a card inside another, and an element that is none."""
    text = F.concat(F.lit("Author number "), F.col("author_id").cast("string"), F.lit(" writes about work and people every week"))
    likes = F.concat(F.lit('<button aria-label="'), (F.col("author_id") % 90 + 1).cast("string"), F.lit(' reactions">ok</button>'))
    made = lambda before, after: F.concat(F.lit(before), text, F.lit(after))
    card = (
        F.when(F.col("author_id") % 4 == 0, F.concat(made('<article><div class="feed-shared-text">', "</div>"), likes, F.lit("</article>")))
        .when(F.col("author_id") % 4 == 1, F.concat(made('<div class="x occludable-update"><article><p>', "</p>"), likes, F.lit("</article></div>")))
        .when(F.col("author_id") % 4 == 2, F.concat(made('<div data-urn="u:1"><span class="break-words">', "</span>"), likes, F.lit("</div>")))
        .otherwise(made('<div class="sidebar"><p>', "</p></div>"))
    )
    pages = read_table(spark, sf_dir, "authors").groupBy(F.floor(F.col("author_id") / 4).cast("bigint").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("author_id", card.alias("card")))).alias("cards"))
    html = F.concat(F.lit("<html><body><main>"), F.array_join(F.col("cards.card"), "\n"), F.lit("</main></body></html>"))
    return readers.posts_of_pages(pages.select("idx", html.alias("html")))


def json_posts(spark, sf_dir):
    """Posts read back from activity documents made of the documents' texts."""
    documents = read_table(spark, sf_dir, "documents")
    update = F.struct(
        F.struct("text").alias("commentary"),
        F.struct(F.struct(F.coalesce("engagement", F.lit(0)).alias("count")).alias("totalSocialActivityCounts")).alias("socialDetail"),
    )
    page = F.to_json(F.struct(F.array(update).alias("elements")))
    return readers.posts_of_activity(documents.select(F.col("doc_id").alias("idx"), page.alias("json")))


def answer_parsing(spark, sf_dir):
    """Answers with raw line ends inside a fence, as models give them, parsed as variants."""
    posts = read_table(spark, sf_dir, "processed_posts").select("idx", F.regexp_replace(F.coalesce("text", F.lit("")), r'[\\"]', "'").alias("t"))
    answer = F.concat(F.lit('```json\n{"variants": ["'), F.col("t"), F.lit('", "second", "third"]}\n```'))
    parsed = posts.select("idx", jsonx.parse_variants(answer).alias("p"))
    return parsed.select("idx", F.get("p.variants", F.lit(0)).alias("first"), "p.error")


def card_scan(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<article><p>"), F.coalesce("text", F.lit("")), F.lit("</p></article>")).alias("html"))
    cards = documents.select("doc_id", htmlx.html_card(F.col("html")).alias("card"))
    return cards.select("doc_id", htmlx.is_card(F.col("card")).alias("is_card"), htmlx.likely_post(F.col("card")).alias("likely"), htmlx.card_likes(F.col("card")).alias("likes"))


_ALL: tuple[Query, ...] = (
    clean_text, quality_reason, quality_tally, raw_quality, score_posts, text_preview, length_buckets, fingerprint_best, fingerprint_first, filtered_posts,
    prompt_examples, post_prompts, variants_prompts, generated_variants, variant_cards, brief_chips, tag_universe, tags_normalized, tag_counts, tag_remap,
    tag_remap_by_map, response_previews, response_texts, first_keys, option_check,
    language_list, dashboard_counts, display_lines, trailing_hashtags, hashtag_counts, tag_slugs, label_numbers, marker_counts, public_ids, latest_checkpoints,
    pending_posts, valid_checkpoints, failure_tally, cleaned_raw_posts, variant_layout, near_duplicates, enriched_posts, enrichment_failures, html_posts,
    page_posts, json_posts, answer_parsing, card_scan,
)


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _shipped(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


