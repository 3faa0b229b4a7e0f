"""SQL for DuckDB that gives the same rows as the queries, written without a look at how Spark gets them.

``processed_posts`` holds no entities, carriage returns or repairable texts, so its canonical form can be said in SQL:
invisible characters go, and the compatibility characters that occur are replaced. Raw posts have no such SQL; the
operators on them are tested against plain Python instead.
"""

from __future__ import annotations

# The constants are written down here once more, so that a wrong one of the engine doesn't pass for right.
CTA_PREFIXES = ("read more", "learn more", "watch here", "watch the replay", "catch up", "hope you take a moment to watch", "i wrote more about this here")
LOW_SIGNAL_LINES = ("activate to view larger image", "media player modal window", "no alternative text description for this image", "play video", "video player")
TIERS = ("exact_match", "same_tag_same_language", "same_tag_any_language", "global_best")
LABELS = ("Exact match", "Same tag and language; length relaxed", "Same tag; language and length relaxed", "Global fallback")

_SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS = f"[{_SPACES}]"
_WORD = r"[\p{L}\p{N}_]"


def _rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _strip(x: str) -> str:
    return _rep(x, f"^{_WS}+|{_WS}+$")


def _inline(x: str) -> str:
    return _strip(_rep(x, f"{_WS}+", " "))


def _comparison(x: str) -> str:
    return _inline(_rep(f"lower({x})", rf"[^\p{{L}}\p{{N}}_{_SPACES}#]"))


def _lines(x: str) -> str:
    for pattern, to in ((r"[ \t]+\n", r"\n"), (r"\n[ \t]+", r"\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", r"\n\n")):
        x = f"regexp_replace({x}, '{pattern}', e'{to}', 'g')" if "n" in to else _rep(x, pattern, to)
    return _strip(x)


def _cta(x: str) -> str:
    return f"regexp_matches({_comparison(x)}, '^(?:{'|'.join(CTA_PREFIXES)})(?: |$)')"


def _alnum(x: str) -> str:
    return rf"regexp_matches({x}, '[\p{{L}}\p{{N}}]')"


def _split(x: str, marks: str) -> str:
    return rf"string_split(regexp_replace({x}, '([{marks}]){_WS}+', '\1' || chr(1), 'g'), chr(1))"


_CANON = r"replace(replace(replace(regexp_replace(coalesce(text, ''), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]', '', 'g'), 'µ', 'μ'), '…', '...'), 'º', 'o')"
_LOW = ", ".join(f"'{x}'" for x in LOW_SIGNAL_LINES)


def _tags(column: str = "tags") -> str:
    """First sight of every non-blank stripped tag, in order."""
    plain = f"[t for t in [{_strip('x')} for x in coalesce({column}, []) if x IS NOT NULL] if t <> '']"
    return f"list_filter({plain}, lambda t, i: list_position({plain}, t) = i)"


_CLEAN = rf"""
base AS (SELECT idx, coalesce(text, '') AS text, coalesce(engagement, 0) AS engagement, coalesce(line_count, 0) AS line_count,
    coalesce(nullif({_strip("language")}, ''), 'English') AS language, {_tags()} AS tags, {_lines(_CANON)} AS norm FROM processed_posts),
parts AS (SELECT idx, unnest(string_split(norm, chr(10))) AS line, generate_subscripts(string_split(norm, chr(10)), 1) AS pos FROM base),
kept AS (SELECT idx, pos, {_strip("line")} AS line, {_inline("line")} AS flat FROM parts WHERE {_comparison("line")} NOT IN ({_LOW})),
said AS (SELECT idx, pos, {_strip("s")} AS s, n FROM (SELECT idx, pos, unnest({_split("flat", ".!?")}) AS s, generate_subscripts({_split("flat", ".!?")}, 1) AS n FROM kept)),
told AS (SELECT idx, pos, s, n, {_cta("s")} AS cta FROM said WHERE s <> ''),
ends AS (SELECT idx, pos, max(n) FILTER (WHERE NOT cta) AS last FROM told GROUP BY idx, pos),
tails AS (SELECT t.idx, t.pos, coalesce(string_agg(s, ' ' ORDER BY n) FILTER (WHERE n <= last), '') AS tail FROM told t JOIN ends e ON t.idx = e.idx AND t.pos = e.pos GROUP BY t.idx, t.pos),
cuts AS (SELECT idx, max(pos) AS at FROM tails WHERE {_alnum("tail")} AND NOT {_cta("tail")} GROUP BY idx),
joined AS (SELECT k.idx, string_agg(CASE WHEN k.pos = c.at THEN t.tail ELSE k.line END, chr(10) ORDER BY k.pos) AS clean
    FROM kept k JOIN cuts c ON k.idx = c.idx AND k.pos <= c.at LEFT JOIN tails t ON k.idx = t.idx AND k.pos = t.pos GROUP BY k.idx),
cleaned AS (SELECT b.*, coalesce({_lines("j.clean")}, '') AS clean FROM base b LEFT JOIN joined j ON b.idx = j.idx),
counted AS (SELECT *, {_comparison("clean")} AS fp, len([x for x in string_split(clean, chr(10)) if {_strip("x")} <> '']) AS clean_lines,
    regexp_extract_all(clean, '{_WORD}+') AS words, [y for y in [{_comparison("x")} for x in string_split(norm, chr(10))] if y <> ''] AS said_lines,
    len([x for x in string_split(norm, chr(10)) if {_alnum("x")} AND NOT {_cta("x")}]) AS solid_lines FROM cleaned),
judged AS (SELECT *, CASE WHEN len(said_lines) = 0 THEN 'empty_text'
    WHEN len([x for x in said_lines if x <> '{LOW_SIGNAL_LINES[0]}']) = 0 THEN 'image_placeholder'
    WHEN len([x for x in said_lines if x NOT IN ({_LOW})]) = 0 THEN 'media_placeholder'
    WHEN clean = '' AND solid_lines = 0 THEN 'cta_only' WHEN clean = '' THEN 'empty_text'
    WHEN len(words) < 8 OR (clean_lines <= 1 AND len(words) < 10) THEN 'thin_post'
    WHEN NOT {_alnum("clean")} THEN 'cta_only' END AS reason FROM counted),
scored AS (SELECT *, length(text) AS length, CASE WHEN line_count < 5 THEN 'Short' WHEN line_count <= 10 THEN 'Medium' ELSE 'Long' END AS bucket,
    CASE WHEN reason IS NOT NULL THEN NULL ELSE
    least(len(words), 80) / 8.0 + least(length(clean), 600) / 150.0 + least(len(list_distinct([lower(w) for w in words])), 50) / 50.0
    + CASE WHEN lines > 1 THEN 1.25 ELSE 0 END + least(len(tags), 2) * 0.35 + ln(1 + greatest(engagement, 0)) * 0.45
    - CASE WHEN lines <= 1 AND len(words) < 10 THEN 2.0 ELSE 0 END END AS score
    FROM (SELECT *, CASE WHEN line_count <> 0 THEN line_count ELSE clean_lines END AS lines FROM judged)),
usable AS (SELECT * FROM scored WHERE reason IS NULL AND fp <> '')
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


_WORTH = "round(score, 9) DESC, engagement DESC, length DESC"
_BEST = f"""
ranked AS (SELECT *, min(idx) OVER (PARTITION BY fp) AS first_idx, row_number() OVER (PARTITION BY fp ORDER BY {_WORTH}, idx) AS nth FROM usable)
"""
BRIEFS = """
briefs AS (SELECT canon_id AS brief_id, CASE canon_id % 3 WHEN 0 THEN 'Short' WHEN 1 THEN 'Medium' ELSE 'Long' END AS w_length,
    CASE canon_id % 2 WHEN 0 THEN 'English' ELSE 'Hinglish' END AS w_language, canon_tag AS w_tag FROM canonical_tags)
"""
_TIERED = f"""
met AS (SELECT b.brief_id, u.*, CASE WHEN list_contains(tags, w_tag) AND language = w_language AND bucket = w_length THEN 0
    WHEN list_contains(tags, w_tag) AND language = w_language THEN 1 WHEN list_contains(tags, w_tag) THEN 2 ELSE 3 END AS tier FROM usable u CROSS JOIN briefs b),
top AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY brief_id, fp) AS best_tier FROM met) WHERE tier = best_tier),
one AS (SELECT * FROM (SELECT *, min(idx) OVER (PARTITION BY brief_id, fp) AS first_idx,
    row_number() OVER (PARTITION BY brief_id, fp ORDER BY {_WORTH}, idx) AS nth FROM top) WHERE nth = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY tier, {_WORTH}, first_idx) AS position FROM one)
"""


def _choice(values: tuple[str, ...], key: str) -> str:
    return "CASE " + key + " ".join(f" WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_COUNT = r"\d{1,3}(?:[.,]\d{3})+|\d+(?:\.\d+)?(?:\s?[KkMm])?"


def _abbreviated(x: str) -> str:
    plain = f"replace({_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, ',', '')"
    pattern = r"(?i)^(\d{1,3}(?:[.,]\d{3})+|\d+(?:\.\d+)?)(?:\s?([KM]))?$"
    number = f"try_cast(regexp_extract({plain}, '{pattern}', 1) AS double)"
    factor = f"CASE upper(regexp_extract({plain}, '{pattern}', 2)) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 ELSE 1 END"
    return f"coalesce(CAST(trunc({number} * {factor}) AS bigint), 0)"


_LABEL = "coalesce(engagement_label, '')"
_BEFORE = rf"regexp_extract({_inline(_LABEL)}, '(?i)\b({_COUNT})\s*(?:reactions?|likes?|react)\b', 1)"
_AFTER = rf"regexp_extract({_inline(_LABEL)}, '(?i)(?:reactions?|likes?|react)\s*[:\-]?\s*({_COUNT})\b', 1)"
_SOCIAL = f"CASE WHEN {_BEFORE} <> '' THEN {_BEFORE} ELSE {_AFTER} END"
_FIRST = rf"regexp_extract({_LABEL}, '\b({_COUNT})\b', 1)"
_INTEGER = f"CASE WHEN regexp_matches({_strip(_LABEL)}, '^[+-]?[0-9]+$') THEN try_cast({_strip(_LABEL)} AS bigint) END"

_BODY = rf"regexp_extract(norm, '(?s)^(.*?)(?:{_WS}+((?:#{_WORD}+{_WS}*)+))?$', 1)"
_HASH = rf"regexp_extract(norm, '(?s)^(.*?)(?:{_WS}+((?:#{_WORD}+{_WS}*)+))?$', 2)"
_DISPLAY = f"""
shown AS (SELECT idx, norm, {_strip(_BODY)} AS body, array_to_string(regexp_extract_all({_HASH}, '#{_WORD}+'), ' ') AS hashtags FROM base),
laid AS (SELECT *, {_inline("body")} AS flat, len([x for x in string_split(body, chr(10)) if {_strip("x")} <> '']) AS n_lines FROM shown),
told_lines AS (SELECT *, len([x for x in {_split("flat", ".!?")} if {_strip("x")} <> '']) AS n_sentences,
    len([x for x in {_split("flat", ",:;")} if {_strip("x")} <> '']) AS n_clauses FROM laid)
"""
# The prompts, line by line, with the default controls of the briefs.
_HASHTAG_RULE = (
    "'- Hashtag rule: ' || CASE n WHEN 0 THEN 'Do not include hashtags.' ELSE 'Include exactly ' || n || ' relevant ' || "
    "CASE n WHEN 1 THEN 'hashtag' ELSE 'hashtags' END || ' on the final line only, separated by spaces.' END"
)
_LAYOUT_RULE = (
    "'- Use compact LinkedIn-ready line breaks so the post reads as about ' || CASE w_length WHEN 'Short' THEN '3 to 5' WHEN 'Medium' THEN '6 to 10' ELSE '11 to 15' END || "
    "' visible lines. Do not compress the full post into one continuous paragraph, and do not add blank spacer lines between every sentence. "
    'Because the response is JSON, encode those line breaks inside each string as "\\n", not as literal raw line breaks.\''
)
_SIZE = "'2) Length: ' || w_length || ' (' || CASE w_length WHEN 'Short' THEN '1 to 5 lines' WHEN 'Medium' THEN '6 to 10 lines' ELSE '11 to 15 lines' END || ')'"


def _said(*lines: str) -> list[str]:
    return ["'" + line.replace("'", "''") + "'" for line in lines]


def _prompt(head: list[str], script: str, title: list[str], form: list[str]) -> str:
    lines = [
        *_said(*head), "'1) Topic: ' || w_tag", _SIZE, "'3) Language: ' || w_language",
        *_said("If Language is Hinglish then it means it is a mix of Hindi and English.", script, "4) Style Controls:", "- Tone: Professional", "- Audience: General"),
        *_said("- Goal: Match examples", "- Voice: Match examples", "- CTA Strength: None"), "'- Hashtag Count: ' || n",
        *_said("- Follow these controls explicitly while keeping the post natural and readable.", "- Goal rule: Match the overall intent and framing of the few-shot examples."),
        *_said("- Voice rule: Follow the dominant voice in the provided examples.", "- CTA rule: Do not include an explicit call to action."),
        _HASHTAG_RULE, "examples", *_said(*title), _LAYOUT_RULE,
        *_said("- Keep one short idea per line, with no empty line between every sentence.", "- Do not use markdown bullets unless they genuinely improve readability."),
        *_said("- Use 1-2 relevant professional emojis only when they feel natural; do not use emojis on every line.", "- If hashtags are included, place them alone on the final line only."),
        *_said(*form),
    ]
    return _strip("concat_ws(chr(10), " + ", ".join(lines) + ")")


_POST_PROMPT = _prompt(
    ["Generate a LinkedIn post using the below information. No preamble.", ""], "The script for the generated post should always be English.", ["", "6) Output Format:"], []
)
_VARIANTS_PROMPT = _prompt(
    ["Generate exactly 3 distinct LinkedIn post variants using the below information.", "Return only a valid JSON object. No preamble.", ""],
    "The script for every generated post should always be English.",
    ["6) Return Format:"],
    [
        '- Return only a JSON object with exactly one key: "variants".',
        '- The "variants" value must be an array of exactly 3 non-empty strings.',
        "- Keep the selected tone, audience, goal, voice, CTA, and hashtag rules identical across all variants.",
        "- Variant 1 must use an insight-led hook.",
        "- Variant 2 must use a story/problem-solution hook.",
        "- Variant 3 must use an action/takeaway-led hook.",
        "- Make the variants meaningfully different in opening structure and angle, not just minor rewrites.",
    ],
)
_EXAMPLES = f"""
shown AS (SELECT brief_id, position, {_strip("text")} AS t, {_choice(LABELS, "tier")} AS label FROM placed WHERE position <= 5),
told_examples AS (SELECT brief_id, '5) Use the writing style as per the following examples.' || chr(10) || string_agg(chr(10) || 'Example ' || nth || ' (' || label || ')' || chr(10) || t, chr(10) ORDER BY nth) AS examples
    FROM (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY position) AS nth FROM shown WHERE t <> '') GROUP BY brief_id),
asked AS (SELECT b.*, b.brief_id % 4 AS n, examples FROM briefs b LEFT JOIN told_examples USING (brief_id)),
variants AS (SELECT brief_id, k AS position, 'Variant ' || k || ' of ' || (length({_VARIANTS_PROMPT}) % 1000) || ', with a first sentence.' || chr(10) || 'And a second one.' || chr(10) || '#Tag' || k AS text
    FROM asked CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))
"""
_ANSWERED = _strip("replace(replace(coalesce(text, ''), chr(92), ''''), chr(34), '''')")
_BASE_ONLY = _CLEAN.split("parts AS")[0].strip().rstrip(",")

SQL: dict[str, str] = {
    "clean_text": _with(_CLEAN) + "SELECT idx, clean, fp, clean_lines FROM counted",
    "quality_reason": _with(_CLEAN) + "SELECT idx, coalesce(reason, 'ok') AS reason FROM judged",
    "quality_tally": _with(_CLEAN) + "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n_posts FROM judged GROUP BY 1",
    "score_posts": _with(_CLEAN) + "SELECT idx, round(score, 6) AS score FROM scored WHERE reason IS NULL",
    "text_preview": _with(_BASE_ONLY)
    + f"SELECT idx, CASE WHEN length({_inline('norm')}) > 160 THEN substr({_inline('norm')}, 1, 160) || '...' ELSE {_inline('norm')} END AS preview FROM base",
    "length_buckets": "SELECT CASE WHEN line_count < 5 THEN 'Short' WHEN line_count <= 10 THEN 'Medium' ELSE 'Long' END AS bucket, count(*) AS n_posts "
    "FROM (SELECT coalesce(line_count, 0) AS line_count FROM processed_posts) GROUP BY 1",
    "fingerprint_best": _with(_CLEAN, _BEST) + "SELECT fp, idx, first_idx FROM ranked WHERE nth = 1",
    "fingerprint_first": _with(_CLEAN) + "SELECT fp, min(idx) AS idx FROM counted WHERE fp <> '' GROUP BY fp",
    "filtered_posts": _with(_CLEAN, "wanted AS (SELECT * FROM usable WHERE bucket = 'Short' AND language = 'English' AND list_contains(tags, 'Investing'))", _BEST.replace("FROM usable", "FROM wanted"))
    + f"SELECT row_number() OVER (ORDER BY {_WORTH}, first_idx) AS rank, idx, round(score, 6) AS score, engagement FROM ranked WHERE nth = 1",
    "prompt_examples": _with(_CLEAN, BRIEFS, _TIERED)
    + f"SELECT brief_id, position, idx, engagement, round(score, 6) AS score, {_choice(TIERS, 'tier')} AS match_tier, {_choice(LABELS, 'tier')} AS match_label FROM placed WHERE position <= 5",
    "tag_universe": _with(_CLEAN) + "SELECT DISTINCT unnest(tags) AS tag FROM scored WHERE reason IS NULL",
    "tags_normalized": f"SELECT idx, array_to_string({_tags()}, '|') AS tags FROM processed_posts",
    "tag_counts": f"SELECT tag, count(*) AS n_posts FROM (SELECT unnest({_tags()}) AS tag FROM processed_posts) GROUP BY tag",
    "tag_remap": "WITH aliases AS (SELECT lower(a) AS alias, min(canon_tag) AS canon FROM (SELECT canon_tag, unnest(list_prepend(canon_tag, aliases)) AS a FROM canonical_tags) GROUP BY 1), "
    f"plain AS (SELECT idx, unnest({_tags()}) AS tag, generate_subscripts({_tags()}, 1) AS pos FROM processed_posts), "
    "mapped AS (SELECT idx, coalesce(canon, tag) AS tag, min(pos) AS pos FROM plain LEFT JOIN aliases ON lower(tag) = alias GROUP BY 1, 2) "
    "SELECT idx, string_agg(tag, '|' ORDER BY pos) AS tags FROM mapped GROUP BY idx",
    "tag_remap_by_map": "WITH aliases AS (SELECT lower(a) AS alias, min(canon_tag) AS canon FROM (SELECT canon_tag, unnest(list_prepend(canon_tag, aliases)) AS a FROM canonical_tags) GROUP BY 1), "
    f"plain AS (SELECT idx, unnest({_tags()}) AS tag, generate_subscripts({_tags()}, 1) AS pos FROM processed_posts), "
    "mapped AS (SELECT idx, coalesce(canon, tag) AS tag, min(pos) AS pos FROM plain LEFT JOIN aliases ON lower(tag) = alias GROUP BY 1, 2) "
    "SELECT idx, string_agg(tag, '|' ORDER BY pos) AS tags FROM mapped GROUP BY idx",
    "response_previews": f"SELECT idx, CASE WHEN text IS NULL THEN 'no response received' WHEN flat = '' THEN 'empty response body' WHEN length(flat) > 240 THEN substr(flat, 1, 240) || '...' ELSE flat END AS preview "
    f"FROM (SELECT idx, text, {_inline("coalesce(text, '')")} AS flat FROM raw_posts)",
    "response_texts": f"SELECT idx, failed_at, stage, coalesce(nullif({_strip('text_preview')}, ''), nullif({_strip('error_message')}, ''), {_strip('reason')}) AS text FROM (SELECT DISTINCT * FROM failures) WHERE idx IS NOT NULL",
    "first_keys": "SELECT author_id, CAST(to_json(headline) AS varchar) AS headline, CAST(followers AS varchar) AS followers FROM authors",
    "option_check": "SELECT canon_id AS brief_id, canon_id % 6 BETWEEN 1 AND 4 AND canon_id % 7 <> 0 AS valid, canon_tag || '/' || CASE canon_id % 3 WHEN 0 THEN 'Short' WHEN 1 THEN 'Medium' ELSE 'Long' END || '/' || "
    "CASE WHEN canon_id % 7 = 0 THEN 'Shouting' ELSE 'Professional' END || '/' || (canon_id % 6 - 1) AS signature FROM canonical_tags",
    "language_list": f"SELECT DISTINCT coalesce(nullif({_strip('language')}, ''), 'English') AS language FROM processed_posts",
    "dashboard_counts": _with(_CLEAN)
    + "SELECT (SELECT count(*) FROM scored) AS n_posts, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM scored WHERE reason IS NULL)) AS n_tags, "
    "(SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT language AS l FROM scored)) AS languages",
    "display_lines": _with(_BASE_ONLY, _DISPLAY)
    + "SELECT idx, CAST(CASE WHEN norm = '' THEN 0 ELSE (CASE WHEN n_lines > 1 THEN n_lines WHEN flat = '' THEN 0 WHEN n_sentences > 1 THEN n_sentences "
    "WHEN n_clauses > 1 THEN n_clauses ELSE greatest(1, ceil(length(flat) / 90.0)) END) + CASE WHEN hashtags <> '' THEN 1 ELSE 0 END END AS bigint) AS lines FROM told_lines",
    "trailing_hashtags": _with(_BASE_ONLY, _DISPLAY) + "SELECT idx, body, hashtags FROM shown",
    "hashtag_counts": rf"SELECT idx, CAST(len(regexp_extract_all(coalesce(text, ''), '(?:^|[^\p{{L}}\p{{N}}_])#{_WORD}')) AS bigint) AS n FROM processed_posts",
    "tag_slugs": "SELECT canon_id, coalesce(nullif(regexp_replace(regexp_replace(lower(canon_tag), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'variant-' || canon_id) AS slug FROM canonical_tags",
    "label_numbers": f"SELECT idx, {_abbreviated('engagement_label')} AS abbreviated, {_abbreviated(_FIRST)} AS first_number, {_abbreviated(_SOCIAL)} AS social, "
    f"coalesce({_INTEGER}, 0) AS coerced FROM raw_posts",
    "marker_counts": "SELECT idx, CAST(" + " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}" for m in ("Ã", "Â", "â€", "ðŸ")) + " AS bigint) AS n FROM (SELECT idx, coalesce(text, '') AS t FROM raw_posts)",
    "page_posts": "SELECT author_id // 4 AS idx, 'Author number ' || author_id || ' writes about work and people every week' AS text, author_id % 90 + 1 AS engagement FROM authors WHERE author_id % 4 < 3",
    "post_prompts": _with(_CLEAN, BRIEFS, _TIERED, _EXAMPLES) + f"SELECT brief_id, {_POST_PROMPT} AS prompt FROM asked",
    "variants_prompts": _with(_CLEAN, BRIEFS, _TIERED, _EXAMPLES) + f"SELECT brief_id, {_VARIANTS_PROMPT} AS prompt FROM asked",
    "generated_variants": _with(_CLEAN, BRIEFS, _TIERED, _EXAMPLES) + "SELECT brief_id, position, text, '' AS error FROM variants",
    "variant_cards": _with(_CLEAN, BRIEFS, _TIERED, _EXAMPLES)
    + "SELECT brief_id, position, a AS angle_label, 'Variant ' || position AS card_label, text, 3 AS estimated_lines, '3 lines' AS line_label, 1 AS hashtag_count, '1 hashtag' AS hashtag_label, "
    "'Copy' AS copy_label, 'Copied' AS copy_feedback, 'variant-' || position || '-' || regexp_replace(lower(a), '[^a-z0-9]+', '-', 'g') AS copy_target "
    "FROM (SELECT *, CASE position WHEN 1 THEN 'Insight-led hook' WHEN 2 THEN 'Story/problem-solution hook' ELSE 'Action/takeaway-led hook' END AS a FROM variants)",
    "answer_parsing": f"SELECT idx, nullif(t, '') AS first, CASE WHEN t = '' THEN 'A variant is empty.' ELSE '' END AS error FROM (SELECT idx, {_ANSWERED} AS t FROM processed_posts)",
    "public_ids": "SELECT author_id, public_id FROM authors WHERE public_id IS NOT NULL AND regexp_full_match(public_id, '[A-Za-z0-9_-]+')",
    "latest_checkpoints": "SELECT idx, post.engagement AS engagement, post.line_count AS line_count, post.language AS language, length(post.text) AS n_chars "
    "FROM (SELECT idx, post, row_number() OVER (PARTITION BY idx ORDER BY written_at DESC) AS nth FROM checkpoints WHERE idx IS NOT NULL AND written_at IS NOT NULL) WHERE nth = 1",
    "pending_posts": "SELECT idx FROM raw_posts WHERE idx NOT IN (SELECT idx FROM checkpoints WHERE idx IS NOT NULL)",
    "valid_checkpoints": "SELECT DISTINCT idx FROM checkpoints WHERE idx IN (SELECT idx FROM raw_posts)",
    "failure_tally": "SELECT stage, reason, count(*) AS n_failures FROM (SELECT DISTINCT * FROM failures) GROUP BY stage, reason",
    "brief_chips": "WITH b AS (SELECT canon_id AS brief_id, CASE canon_id % 3 WHEN 0 THEN 'Short' WHEN 1 THEN 'Medium' ELSE 'Long' END AS len, "
    "CASE canon_id % 2 WHEN 0 THEN 'English' ELSE 'Hinglish' END AS lang, canon_tag AS tag, canon_id % 4 AS n FROM canonical_tags) "
    "SELECT brief_id, 1 AS position, 'Topic' AS label, tag AS value FROM b UNION ALL SELECT brief_id, 2, 'Format', len || ' / ' || lang FROM b "
    "UNION ALL SELECT brief_id, 3, 'Tone', 'Professional' FROM b UNION ALL SELECT brief_id, 4, 'Audience', 'General' FROM b "
    "UNION ALL SELECT brief_id, 5, 'Goal', 'Match examples' FROM b UNION ALL SELECT brief_id, 6, 'Voice', 'Match examples' FROM b "
    "UNION ALL SELECT brief_id, 7, 'Finish', 'CTA: None / ' || CASE n WHEN 0 THEN 'No hashtags' WHEN 1 THEN '1 hashtag' ELSE n || ' hashtags' END FROM b",
}
