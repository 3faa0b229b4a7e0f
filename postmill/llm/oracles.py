"""SQL for DuckDB, by comparing everything with everything, for the problems that SQL can express."""

from __future__ import annotations

# The constants of problem 5 are written down here once more, so that a wrong one of the engine doesn't pass for right.
DECORATION = "matters|today|tips|community|basics|101|(?:19|20)[0-9]{2}"
ONE_ERROR, TWO_ERRORS, CUT_SHARE, CUT_LEAST = 5, 8, 0.5, 5

_BLANK = r"^[\s\p{Z}\p{Cf}]*$"

_PAIRS = r"""
said AS (SELECT idx, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS w FROM processed_posts WHERE text IS NOT NULL),
long AS (SELECT idx, w, len(w) - 1 AS n FROM said WHERE len(w) >= 25),
grams AS (SELECT idx, n, w[k] || ' ' || w[k + 1] AS g FROM (SELECT idx, n, w, unnest(range(1, n + 1)) AS k FROM long)),
counts AS (SELECT idx, n, g, count(*) AS c FROM grams GROUP BY ALL),
pairs AS (SELECT a.idx AS idx_a, b.idx AS idx_b FROM counts a JOIN counts b ON a.g = b.g AND a.idx < b.idx
    GROUP BY a.idx, b.idx, a.n, b.n HAVING 2 * sum(least(a.c, b.c)) >= 0.75 * (a.n + b.n))
"""

_GROUPS = """
linked AS (SELECT idx_a AS x, idx_b AS y FROM pairs UNION ALL SELECT idx_b, idx_a FROM pairs),
reach(x, y) AS (SELECT x, y FROM linked UNION SELECT r.x, b.y FROM reach r JOIN linked b ON r.y = b.x),
groups AS (SELECT x AS idx, min(y) AS group_idx FROM reach GROUP BY x)
"""

_RATED = rf"""
rated AS (SELECT g.group_idx, p.idx, length(p.text) AS size, p.engagement, len(list_distinct([t for t in coalesce(p.tags, [])
    if t IS NOT NULL AND NOT regexp_matches(t, '{_BLANK}')])) AS n_tags FROM groups g JOIN processed_posts p USING (idx))
"""


def _normal(x: str) -> str:
    plain = rf"regexp_replace({x}, '[\p{{Cf}}\p{{M}}]', '', 'g')"
    split = rf"regexp_replace({plain}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')"
    return rf"trim(regexp_replace(lower({split}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_MAPPED = rf"""
refs AS (SELECT canon_id, words, replace(words, ' ', '') AS r, array_to_string(list_sort(string_split(words, ' ')), ' ') AS bag
    FROM (SELECT canon_id, {_normal("ref")} AS words FROM (SELECT canon_id, unnest(list_prepend(canon_tag, coalesce(aliases, []))) AS ref FROM canonical_tags)) WHERE words <> ''),
typed AS (SELECT DISTINCT idx, value FROM (SELECT idx, unnest(tags) AS value FROM processed_posts) WHERE value IS NOT NULL AND NOT regexp_matches(value, '{_BLANK}')),
seen AS (SELECT value, replace(words, ' ', '') AS t, array_to_string(list_sort(string_split(words, ' ')), ' ') AS bag
    FROM (SELECT value, coalesce(nullif(regexp_replace(words, ' (?:{DECORATION})$', ''), ''), words) AS words FROM (SELECT value, {_normal("value")} AS words FROM (SELECT DISTINCT value FROM typed)))
    WHERE words <> ''),
rated AS (SELECT value, canon_id, CASE WHEN t = r THEN 0 WHEN seen.bag = refs.bag THEN 1
    WHEN length(r) >= {ONE_ERROR} AND damerau_levenshtein(t, r) <= 1 THEN 2 WHEN length(r) >= {TWO_ERRORS} AND damerau_levenshtein(t, r) <= 2 THEN 3
    WHEN length(t) >= greatest({CUT_LEAST}, ceil({CUT_SHARE} * length(r))) AND length(t) < length(r) AND starts_with(r, t) THEN 4 END AS cost
    FROM seen CROSS JOIN refs),
mapped AS (SELECT value, canon_id FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY cost, canon_id) AS nth FROM rated WHERE cost IS NOT NULL) WHERE nth = 1)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(p.strip() for p in parts) + "\n"


SQL = {
    "p3_found": _with(_PAIRS) + "SELECT idx_a, idx_b FROM pairs",
    "p3_groups": _with(_PAIRS, _GROUPS, recursive=True).rstrip()
    + ",\nclasses AS (SELECT idx, min(idx) OVER (PARTITION BY w) AS rep FROM long), reps AS (SELECT DISTINCT rep FROM classes),\n"
    "degrees AS (SELECT x AS rep, count(*) AS n FROM linked WHERE x IN (SELECT rep FROM reps) AND y IN (SELECT rep FROM reps) GROUP BY x)\n"
    "SELECT c.idx, c.rep, coalesce(g.group_idx, c.rep) AS group_id, coalesce(d.n, 0) AS n_links FROM classes c LEFT JOIN groups g ON c.idx = g.idx LEFT JOIN degrees d ON c.rep = d.rep",
    "p4_found": _with(_PAIRS, _GROUPS, _RATED, recursive=True)
    + "SELECT group_idx, first(idx ORDER BY size DESC, idx) AS text_idx, first(idx ORDER BY engagement DESC, idx) FILTER (WHERE engagement IS NOT NULL) AS engagement_idx, "
    "first(idx ORDER BY n_tags DESC, idx) AS tags_idx FROM rated GROUP BY group_idx",
    "p5_found": _with(_MAPPED)
    + "SELECT idx, value AS tag_raw, coalesce(canon_id, 0) AS canon_id FROM typed LEFT JOIN mapped USING (value) WHERE value NOT IN (SELECT canon_tag FROM canonical_tags)",
    "p5_unmatched": _with(_MAPPED) + "SELECT value, count(*) AS n_rows FROM typed WHERE value NOT IN (SELECT value FROM mapped) GROUP BY value",
}
