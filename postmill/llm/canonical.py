"""Problem 5: free-typed values mapped to a reference list, in Spark SQL alone.

A partition-based pigeonhole join finds typing errors: a reference string is cut into k+1 segments, of which
one must survive k errors, so positional substrings of the value meet the segments in an equality join, and
``levenshtein`` verifies what met. Decoration, order of words and cut-off ends are undone by equality joins too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Words typed after a value that don't change it (fixed values).
DECORATION = "matters|today|tips|community|basics|101|(?:19|20)[0-9]{2}"
#: Strings of at least so many letters may hold one, and two, errors; a swap of neighbours is one error.
ONE_ERROR, TWO_ERRORS = 5, 8
#: A value that is the start of a reference string stands for it from this share of its length.
CUT_SHARE = 0.5
CUT_LEAST = 5

#: Patterns, given to the statements as parameters.
_ARGS = {
    "blank": r"^[\s\p{Z}\p{Cf}]*$",
    "invisible": r"[\p{Cf}\p{M}]",
    "hump": r"(\p{Ll})(\p{Lu})",
    "other": r"[^\p{L}\p{N}]+",
    "decoration": f" (?:{DECORATION})$",
}


def _normal(column: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(regexp_replace({column}, :invisible, ''), :hump, '$1 $2')), :other, ' '))"


def _swaps(column: str) -> str:
    return (
        f"transform(sequence(1, length({column}) - 1), i -> "
        f"concat(substr({column}, 1, i - 1), substr({column}, i + 1, 1), substr({column}, i, 1), substr({column}, i + 2)))"
    )


_ERRORS = f"""
CASE WHEN levenshtein(t, r, 1) >= 0 THEN 1
     WHEN length(t) = length(r) AND exists({_swaps("t")}, v -> v = r) THEN 1
     WHEN length(r) < {TWO_ERRORS} THEN NULL
     WHEN levenshtein(t, r, 2) >= 0 THEN 2
     WHEN exists({_swaps("t")}, v -> levenshtein(v, r, 1) >= 0 OR exists({_swaps("v")}, w -> w = r)) THEN 2
     WHEN exists({_swaps("r")}, v -> levenshtein(t, v, 1) >= 0) THEN 2 END
"""

_VALUES = """
SELECT DISTINCT CAST(id AS bigint) AS id, value
FROM (SELECT id, explode(vals) AS value FROM {source})
WHERE value IS NOT NULL AND NOT value RLIKE :blank
"""

_MAPPING = f"""
WITH refs AS (
  SELECT DISTINCT canon_id, words, replace(words, ' ', '') AS r, array_join(array_sort(split(words, ' ')), ' ') AS bag
  FROM (SELECT CAST(canon_id AS bigint) AS canon_id, {_normal("ref")} AS words
        FROM (SELECT canon_id, explode(concat(array(canon_tag), coalesce(aliases, array()))) AS ref FROM {{refs}})
        WHERE ref IS NOT NULL AND canon_id IS NOT NULL)
  WHERE words <> ''
),
seen AS (
  SELECT value, words, replace(words, ' ', '') AS t, array_join(array_sort(split(words, ' ')), ' ') AS bag
  FROM (SELECT value, coalesce(nullif(regexp_replace(words, :decoration, ''), ''), words) AS words
        FROM (SELECT value, {_normal("value")} AS words FROM (SELECT DISTINCT value FROM {{values}})))
  WHERE words <> ''
),
texts AS (SELECT DISTINCT t FROM seen),
segments AS (
  SELECT r, n, k, i, CAST(floor(i * n / (k + 1)) AS int) AS start, CAST(floor((i + 1) * n / (k + 1)) AS int) AS stop
  FROM (SELECT r, n, k, explode(sequence(0, k)) AS i
        FROM (SELECT DISTINCT r, length(r) AS n, CASE WHEN length(r) < {TWO_ERRORS} THEN 2 ELSE 4 END AS k FROM refs
              WHERE length(r) >= {ONE_ERROR}))
),
spans AS (SELECT DISTINCT n, k, i, start, stop FROM segments),
pieces AS (
  SELECT DISTINCT t, n, i, substr(t, p + 1, width) AS piece
  FROM (SELECT t, s.n, s.i, s.stop - s.start AS width,
               explode(sequence(s.start + greatest(-s.i, size - s.n - (s.k - s.i)), s.start + least(s.i, size - s.n + (s.k - s.i)))) AS p
        FROM (SELECT t, length(t) AS size, explode(sequence(length(t) - 4, length(t) + 4)) AS n FROM texts) v
        JOIN spans s ON v.n = s.n
        WHERE abs(size - s.n) <= s.k
          AND greatest(-s.i, size - s.n - (s.k - s.i)) <= least(s.i, size - s.n + (s.k - s.i)))
  WHERE p >= 0 AND p + width <= length(t)
),
near AS (
  SELECT t, r, errors
  FROM (SELECT /*+ REPARTITION({{tasks}}, t, r) */ t, r
        FROM (SELECT DISTINCT p.t, s.r FROM pieces p
              JOIN segments s ON p.n = s.n AND p.i = s.i AND p.piece = substr(s.r, s.start + 1, s.stop - s.start)))
  LATERAL VIEW explode(array({_ERRORS})) told AS errors
  WHERE errors IS NOT NULL
),
cuts AS (
  SELECT r, canon_id, substr(r, 1, m) AS head
  FROM (SELECT r, canon_id,
               explode(sequence(greatest({CUT_LEAST}, CAST(ceil({CUT_SHARE} * length(r)) AS int)), length(r) - 1)) AS m
        FROM refs WHERE greatest({CUT_LEAST}, CAST(ceil({CUT_SHARE} * length(r)) AS int)) <= length(r) - 1)
),
found AS (
  SELECT value, canon_id, 0 AS cost FROM seen JOIN refs ON t = r
  UNION ALL SELECT value, canon_id, 1 FROM seen JOIN refs ON seen.bag = refs.bag
  UNION ALL SELECT value, canon_id, 1 + errors FROM seen JOIN near ON seen.t = near.t JOIN refs ON near.r = refs.r
  UNION ALL SELECT value, canon_id, 4 FROM seen JOIN cuts ON seen.t = cuts.head
)
SELECT value, min_by(canon_id, struct(cost, canon_id)) AS canon_id FROM found GROUP BY value
"""


def value_mapping(values: DataFrame, refs: DataFrame) -> DataFrame:
    """``value, canon_id`` for every different value that stands for an entry of ``refs (canon_id, canon_tag, aliases)``.

    Tried in this order: the same letters and digits; the same words in another order; up to two errors (one below
    eight letters, none below five); the start of an entry. Among equals the smallest canon_id counts. Values of
    no letters or digits have no entry.
    """
    args = {k: v for k, v in _ARGS.items() if k != "blank"}
    spark = values.sparkSession
    # What a pair costs is not told by its bytes, so how many tasks compare them is said rather than left to be coalesced;
    # above the generator no filter is moved, which would compare them before they are dealt out.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return spark.sql(
        _MAPPING.replace("{tasks}", str(tasks)), args=args, values=values.select("value"), refs=refs.select("canon_id", "canon_tag", "aliases")
    )


def map_values(df: DataFrame, refs: DataFrame, id_col: str = "idx", values_col: str = "tags") -> DataFrame:
    """``id, value, canon_id`` for each different non-blank element that isn't an entry letter for letter; 0 is no entry.

    Null arrays and null or blank elements give no row, an element repeated in a row gives one, an empty table none.
    """
    spark = df.sparkSession
    source = df.select(df[id_col].alias("id"), df[values_col].alias("vals"))
    values = spark.sql(_VALUES, args={"blank": _ARGS["blank"]}, source=source)
    typed = spark.sql(
        "SELECT v.* FROM {values} v LEFT ANTI JOIN {refs} r ON v.value = r.canon_tag", values=values, refs=refs.select("canon_tag")
    )
    return spark.sql(
        "SELECT v.id, v.value, coalesce(m.canon_id, 0L) AS canon_id FROM {typed} v LEFT JOIN {mapping} m ON v.value = m.value",
        typed=typed,
        mapping=value_mapping(typed, refs),
    )


def unmatched_values(df: DataFrame, refs: DataFrame, id_col: str = "idx", values_col: str = "tags") -> DataFrame:
    """``value, n_rows`` of each value without an entry, through an anti-join with the mapping."""
    spark = df.sparkSession
    source = df.select(df[id_col].alias("id"), df[values_col].alias("vals"))
    values = spark.sql(_VALUES, args={"blank": _ARGS["blank"]}, source=source)
    return spark.sql(
        "SELECT v.value, count(*) AS n_rows FROM {values} v LEFT ANTI JOIN {mapping} m ON v.value = m.value GROUP BY v.value",
        values=values,
        mapping=value_mapping(values, refs),
    )
