"""Prompts for new posts, the answers to them, and what is shown of a brief and its variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.jsonx import checked_variants
from postmill.operators.retrieval import MOST_EXAMPLES, prompt_examples
from postmill.session import cut_lineage, ship_package

# Choices and wording (fixed values).
CHOICES = {
    "tone": ("Professional", "Conversational", "Bold"),
    "audience": ("General", "Job Seekers", "Founders", "Developers"),
    "goal": ("Match examples", "Educate", "Inspire", "Announce"),
    "voice": ("Match examples", "First Person", "Brand/Company"),
    "cta_strength": ("None", "Soft", "Strong"),
}
LENGTHS = {"Short": ("1 to 5 lines", 3, 5), "Medium": ("6 to 10 lines", 6, 10), "Long": ("11 to 15 lines", 11, 15)}
ANGLES = ("Insight-led hook", "Story/problem-solution hook", "Action/takeaway-led hook")
VARIANTS = 3
GOAL_RULES = {
    "Match examples": "Match the overall intent and framing of the few-shot examples.",
    "Educate": "Teach something practical, clear, and immediately useful.",
    "Inspire": "Leave the reader energized, optimistic, and motivated to act.",
    "Announce": "Present a clear update or announcement with crisp context.",
}
VOICE_RULES = {
    "Match examples": "Follow the dominant voice in the provided examples.",
    "First Person": "Use first-person singular language such as I, me, and my.",
    "Brand/Company": "Use company or team voice and avoid first-person singular pronouns.",
}
CTA_RULES = {
    "None": "Do not include an explicit call to action.",
    "Soft": "Close with a light reflective or conversational call to action.",
    "Strong": "Close with a direct and specific call to action.",
}
NO_HASHTAGS = "Do not include hashtags."
HASHTAGS = "Include exactly {n} relevant {noun} on the final line only, separated by spaces."
LAYOUT = (
    "Use compact LinkedIn-ready line breaks so the post reads as about {least} to {most} visible lines. "
    "Do not compress the full post into one continuous paragraph, and do not add blank spacer lines between every sentence. "
    'Because the response is JSON, encode those line breaks inside each string as "\\n", not as literal raw line breaks.'
)
EMOJI = "Use 1-2 relevant professional emojis only when they feel natural; do not use emojis on every line."
HINGLISH = "If Language is Hinglish then it means it is a mix of Hindi and English."
STYLE_NOTE = "- Follow these controls explicitly while keeping the post natural and readable."
EXAMPLES_NOTE = "5) Use the writing style as per the following examples."
FORM = (
    "- Keep one short idea per line, with no empty line between every sentence.",
    "- Do not use markdown bullets unless they genuinely improve readability.",
    f"- {EMOJI}",
    "- If hashtags are included, place them alone on the final line only.",
)
POST_HEAD = ("Generate a LinkedIn post using the below information. No preamble.", "")
POST_SCRIPT = "The script for the generated post should always be English."
VARIANTS_HEAD = (
    "Generate exactly 3 distinct LinkedIn post variants using the below information.",
    "Return only a valid JSON object. No preamble.",
    "",
)
VARIANTS_SCRIPT = "The script for every generated post should always be English."
VARIANTS_FORM = (
    '- Return only a JSON object with exactly one key: "variants".',
    '- The "variants" value must be an array of exactly 3 non-empty strings.',
    "- Keep the selected tone, audience, goal, voice, CTA, and hashtag rules identical across all variants.",
    "- Variant 1 must use an insight-led hook.",
    "- Variant 2 must use a story/problem-solution hook.",
    "- Variant 3 must use an action/takeaway-led hook.",
    "- Make the variants meaningfully different in opening structure and angle, not just minor rewrites.",
)


@dataclass(frozen=True)
class Options:
    """Controls of a brief; values out of range raise."""

    tone: str = "Professional"
    audience: str = "General"
    goal: str = "Match examples"
    voice: str = "Match examples"
    cta_strength: str = "None"
    hashtag_count: int = 0

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"Unsupported {name} {getattr(self, name)!r}.")
        if not isinstance(self.hashtag_count, int) or not 0 <= self.hashtag_count <= 3:
            raise ValueError("hashtag_count must be a whole number from 0 to 3.")


DEFAULTS = {f.name: f.default for f in fields(Options)}


def valid_options(df: DataFrame) -> Column:
    """Whether a row's controls (columns named as in ``Options``) are all in range."""
    good = F.col("hashtag_count").between(0, 3)
    for name, allowed in CHOICES.items():
        good = good & F.col(name).isin(*allowed)
    return F.coalesce(good, F.lit(False))


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def length_text(length: Column) -> Column:
    """``6 to 10 lines``; null for an unknown bucket."""
    return _looked_up({k: v[0] for k, v in LENGTHS.items()}, length)


def hashtag_rule(count: Column) -> Column:
    parts = HASHTAGS.split("{n}")
    noun, rest = parts[1].split("{noun}")
    said = F.concat(F.lit(parts[0]), count.cast("string"), F.lit(noun), F.when(count == 1, "hashtag").otherwise("hashtags"), F.lit(rest))
    return F.when(count == 0, NO_HASHTAGS).otherwise(said)


def layout_rule(length: Column) -> Column:
    return _looked_up({k: LAYOUT.format(least=v[1], most=v[2]) for k, v in LENGTHS.items()}, length)


def _brief_lines() -> list[Column]:
    said = lambda name, col: F.concat(F.lit(name), F.col(col).cast("string"))
    return [
        said("- Tone: ", "tone"), said("- Audience: ", "audience"), said("- Goal: ", "goal"), said("- Voice: ", "voice"),
        said("- CTA Strength: ", "cta_strength"), said("- Hashtag Count: ", "hashtag_count"), F.lit(STYLE_NOTE),
        F.concat(F.lit("- Goal rule: "), _looked_up(GOAL_RULES, F.col("goal"))),
        F.concat(F.lit("- Voice rule: "), _looked_up(VOICE_RULES, F.col("voice"))),
        F.concat(F.lit("- CTA rule: "), _looked_up(CTA_RULES, F.col("cta_strength"))),
        F.concat(F.lit("- Hashtag rule: "), hashtag_rule(F.col("hashtag_count"))),
    ]


def _examples_text(examples: DataFrame) -> DataFrame:
    """``brief_id, examples``: the examples' part of each brief's prompt; of the first five, those that aren't blank."""
    first = examples.where(F.col("position") <= MOST_EXAMPLES).select("brief_id", "position", T.strip(F.col("text")).alias("text"), T.strip(F.coalesce("match_label", F.lit(""))).alias("label"))
    held = first.where("text <> ''").groupBy("brief_id").agg(F.array_sort(F.collect_list(F.struct("position", "text", "label"))).alias("held"))
    shown = F.transform(
        "held",
        lambda e, i: F.concat(
            F.lit("\nExample "), (i + 1).cast("string"), F.when(e["label"] != "", F.concat(F.lit(" ("), e["label"], F.lit(")"))).otherwise(""), F.lit("\n"), e["text"]
        ),
    )
    return held.select("brief_id", F.concat_ws("\n", F.lit(EXAMPLES_NOTE), F.array_join(shown, "\n")).alias("examples"))


def build_prompts(briefs: DataFrame, examples: DataFrame, variants: bool = False) -> DataFrame:
    """``brief_id, prompt`` of every brief with a known length and controls in range; the others have a null prompt.

    briefs: ``brief_id, length, language, tag`` and the controls of ``Options``; examples as from ``prompt_examples``.
    """
    head, script = (VARIANTS_HEAD, VARIANTS_SCRIPT) if variants else (POST_HEAD, POST_SCRIPT)
    said = briefs.join(_examples_text(examples), "brief_id", "left")
    size = F.concat(F.lit("2) Length: "), F.col("length"), F.lit(" ("), length_text(F.col("length")), F.lit(")"))
    lines = [
        *map(F.lit, head), F.concat(F.lit("1) Topic: "), F.col("tag")), size, F.concat(F.lit("3) Language: "), F.col("language")),
        F.lit(HINGLISH), F.lit(script), F.lit("4) Style Controls:"), *_brief_lines(), F.col("examples"),
    ]
    lines += [F.lit("6) Return Format:")] if variants else [F.lit(""), F.lit("6) Output Format:")]
    lines += [F.concat(F.lit("- "), layout_rule(F.col("length"))), *map(F.lit, FORM), *(map(F.lit, VARIANTS_FORM) if variants else [])]
    known = length_text(F.col("length")).isNotNull() & valid_options(briefs)
    return said.select("brief_id", F.when(known, T.strip(F.concat_ws("\n", *lines))).alias("prompt"))


def prompts_for(silver: DataFrame, briefs: DataFrame, variants: bool = False) -> DataFrame:
    """Prompts with the best examples that the posts hold."""
    return build_prompts(briefs, prompt_examples(silver, briefs), variants)


def generate(prompts: DataFrame, briefs: DataFrame, make_client: Callable[[], Callable[[str], str]], variants: bool = False) -> DataFrame:
    """``brief_id, position, text, error``: the post, or the three variants, of each prompt, laid out for display.

    The model is asked once for each prompt, without retries; an answer that can't be used gives one row with an error.
    """
    ship_package(prompts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            rows = []
            for brief, prompt in zip(frame["brief_id"], frame["prompt"], strict=True):
                try:
                    answer = client(prompt)
                except Exception as e:  # noqa: BLE001
                    rows.append((brief, 1, None, f"The model could not be asked: {e}"))
                    continue
                texts, error = checked_variants(answer) if variants else ([answer], "")
                rows += [(brief, k, t, "") for k, t in enumerate(texts, 1)] if texts is not None else [(brief, 1, None, error)]
            yield pd.DataFrame(rows, columns=["brief_id", "position", "raw", "error"])

    asked = cut_lineage(prompts.where("prompt IS NOT NULL").mapInPandas(run, "brief_id bigint, position bigint, raw string, error string"))
    laid = asked.join(briefs.select("brief_id", "length"), "brief_id").withColumn("__canon", T.canonicalize(F.col("raw")))
    return laid.select("brief_id", "position", F.when(F.col("raw").isNotNull(), T.variant_text(F.col("__canon"), F.col("length"))).alias("text"), "error")


def brief_chips(briefs: DataFrame) -> DataFrame:
    """``brief_id, position, label, value``: what is shown of a brief."""
    tags = F.when(F.col("hashtag_count") <= 0, "No hashtags").otherwise(T.counted(F.col("hashtag_count"), "hashtag"))
    chip = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    chips = F.array(
        chip("Topic", F.col("tag")),
        chip("Format", F.concat_ws(" / ", "length", "language")),
        chip("Tone", F.col("tone")),
        chip("Audience", F.col("audience")),
        chip("Goal", F.col("goal")),
        chip("Voice", F.col("voice")),
        chip("Finish", F.concat(F.lit("CTA: "), F.col("cta_strength"), F.lit(" / "), tags)),
    )
    shown = briefs.select("brief_id", F.posexplode(chips).alias("position", "chip"))
    return shown.select("brief_id", (F.col("position") + 1).alias("position"), "chip.label", "chip.value")


def brief_signature() -> Column:
    """What makes a result stale when it changes: topic, length, language and all controls."""
    return F.struct("tag", "length", "language", "tone", "audience", "goal", "voice", "cta_strength", "hashtag_count")


def variant_cards(variants: DataFrame, angles: tuple[str, ...] = ANGLES) -> DataFrame:
    """Cards of variants (``brief_id, position, text``): labels, lines and hashtags; text is canonical."""
    text = T.normalize_lines(F.coalesce("text", F.lit("")))
    named = F.array(*[F.lit(a.strip()) for a in angles])
    number = F.concat(F.lit("Variant "), F.col("position").cast("string"))
    cards = variants.select("brief_id", "position", text.alias("text"))
    angle = F.coalesce(F.get(named, (F.col("position") - 1).cast("int")), number)
    cards = cards.select("*", angle.alias("angle_label"), number.alias("card_label"), T.display_lines(F.col("text")).alias("estimated_lines"), T.hashtag_count(F.col("text")).alias("hashtag_count"))
    fallback = F.concat(F.lit("variant-"), F.col("position").cast("string"))
    return cards.select(
        "brief_id", "position", "angle_label", "card_label", "text", "estimated_lines",
        T.counted(F.col("estimated_lines"), "line").alias("line_label"), "hashtag_count",
        T.counted(F.col("hashtag_count"), "hashtag").alias("hashtag_label"), F.lit("Copy").alias("copy_label"), F.lit("Copied").alias("copy_feedback"),
        F.concat(F.lit("variant-"), F.col("position").cast("string"), F.lit("-"), T.slug(F.col("angle_label"), fallback)).alias("copy_target"),
    )
