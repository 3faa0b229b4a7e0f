"""Text normalisation, sanitation and display as column expressions.

One Arrow function, ``canonicalize``, does what Spark has no built-in for (entities, compatibility forms, repair of
one kind of wrong decoding); everything after it stays in the JVM. Functions here take text that went through it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from textwrap import wrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# Fixed values of the text rules.
INVISIBLE = "​‌‍⁠﻿­"
MOJIBAKE_MARKERS = ("Ã", "Â", "â€", "ðŸ")
LOW_SIGNAL_LINES = (
    "activate to view larger image",
    "media player modal window",
    "no alternative text description for this image",
    "play video",
    "video player",
)
CTA_PREFIXES = (
    "read more",
    "learn more",
    "watch here",
    "watch the replay",
    "catch up",
    "hope you take a moment to watch",
    "i wrote more about this here",
)

#: Characters that count as white space, and breaks between lines.
SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACES}]"
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHARS}]+"
SENTENCE_END = f"(?<=[.!?]){WS}+"
CLAUSE_END = f"(?<=[,:;]){WS}+"


def _markers(text: str) -> int:
    return sum(map(text.count, MOJIBAKE_MARKERS))


def _reread(text: str) -> str | None:
    """A text whose characters, written as cp1252, are read as UTF-8; None where that can't be, or leaves as many markers."""
    try:
        better = text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return None
    return better if _markers(better) < _markers(text) else None


def _repaired(text: str) -> str:
    """UTF-8 once read as cp1252 is undone, at most twice, as a whole, and only while markers of it become fewer."""
    once = _reread(text) if _markers(text) else None
    twice = _reread(once) if once is not None and _markers(once) else None
    return next(t for t in (twice, once, text) if t is not None)


_GONE = re.compile(f"[{INVISIBLE}]")


def canonical_text(text: str | None) -> str:
    """Entities, line ends, invisible characters, wrong decoding and compatibility forms; null gives the empty text."""
    if not text:
        return ""
    if text.isascii() and "&" not in text and "\r" not in text:
        return text
    text = html.unescape(text).replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    return _GONE.sub("", unicodedata.normalize("NFKC", _repaired(_GONE.sub("", text))))


@F.pandas_udf(StringType())
def _canonicalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: canonical_text(t) if isinstance(t, str) else "")


def canonicalize(text: Column) -> Column:
    """Text fit for the functions of this module."""
    return _canonicalize(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize_lines(text: Column) -> Column:
    """Blanks around line ends and runs of blanks go, at most one empty line stays."""
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n[ \t]+", "\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def inline(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def comparison(text: Column) -> Column:
    """Small letters, digits, hash signs and single blanks."""
    return inline(F.regexp_replace(F.lower(text), f"[^{WORD_CHARS}{SPACES}#]", ""))


def split_lines(text: Column) -> Column:
    """Lines as an array; a break at the end opens none, and an empty text is one empty line."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)


def chunks(text: Column, end: str) -> Column:
    return F.filter(F.transform(F.split(text, end), strip), lambda x: x != "")


def has_alnum(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def normalized_text(text: str, lines: bool = True) -> str:
    """``normalize_lines`` of a canonical text; without lines all white space becomes single blanks."""
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n[ \t]+", "\n", text))
    return (re.sub(r"\n{3,}", "\n\n", text) if lines else re.sub(r"\s+", " ", text)).strip()


_NOT_COMPARED = re.compile(r"[^\w\s#]")
_SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
_WORD_RUN = re.compile(r"\w+")
_ODD_SPACE = re.compile(r"[^\S \n]")
_OPEN = re.compile("&[#A-Za-z]|" + "|".join(MOJIBAKE_MARKERS))
_CALLS = tuple(p + " " for p in CTA_PREFIXES)


def compared_text(text: str) -> str:
    """``comparison`` of a canonical text."""
    return " ".join(_NOT_COMPARED.sub("", text.lower()).split())


def _calls(text: str) -> bool:
    return (compared_text(text) + " ").startswith(_CALLS)


def _alnum(text: str) -> bool:
    return any(map(str.isalnum, text))


def _without_calls(line: str, again: bool) -> str:
    """A line without its last sentences that only call for a click; empty if nothing else is left."""
    normal = lambda t: normalized_text(canonical_text(t) if again else t, False)
    parts = [s.strip() for s in _SENTENCE_GAP.split(normal(line)) if s.strip()]
    while parts and _calls(parts[-1]):
        parts.pop()
    return normal(" ".join(parts))


def sanitized_text(text: str, again: bool = True) -> str:
    """A text without lines of players and images, and without a tail of symbols or calls for a click.

    again: canonical forms are taken anew at every step, which entities of entities and half repaired texts need; for
    other texts it changes nothing.
    """
    normal = lambda t: normalized_text(canonical_text(t) if again else t)
    kept = [line.strip() for line in normal(text).splitlines() if compared_text(line) not in LOW_SIGNAL_LINES]
    while kept:
        kept[-1] = _without_calls(kept[-1], again)
        if _alnum(kept[-1]) and not _calls(kept[-1]):
            break
        kept.pop()
    return normal("\n".join(kept))


def reason_against(normalized: str, compared: str, clean: str, clean_lines: int, n_words: int) -> str | None:
    """The first rule by which a text is no post."""
    if not compared:
        return "empty_text"
    if any(p in compared for p in LOW_SIGNAL_LINES):
        lines = {c for line in normalized.splitlines() if (c := compared_text(line))}
        if lines <= {LOW_SIGNAL_LINES[0]}:
            return "image_placeholder"
        if lines <= set(LOW_SIGNAL_LINES):
            return "media_placeholder"
    if not clean:
        lines = [line for line in normalized_text(normalized).splitlines() if line.strip()]
        return "cta_only" if lines and not any(_alnum(_without_calls(line.strip(), False)) for line in lines) else "empty_text"
    if n_words < 8 or clean_lines <= 1 and n_words < 10:
        return "thin_post"
    if not _alnum(compared):
        return "empty_text"
    return None if _alnum(clean) else "cta_only"


def judged_text(text: str | None) -> tuple[str, str, int, int, int, str, str | None]:
    """``(normalized, clean, clean_lines, n_words, n_unique, fp, reason)`` of a text as it stands; null counts as empty."""
    canonical = canonical_text(text)
    normalized = normalized_text(canonical)
    compared = compared_text(normalized)
    if _OPEN.search(canonical):
        clean = sanitized_text(canonical)
    elif any(p in compared for p in _PHRASES) or _ODD_SPACE.search(normalized):
        clean = sanitized_text(canonical, again=False)
    elif normalized[-1:].isalnum():
        clean = normalized
    else:  # only lines of symbols at its end can go
        lines = normalized.split("\n")
        while lines and not _alnum(lines[-1]):
            lines.pop()
        clean = "\n".join(lines).strip()
    words = _WORD_RUN.findall(clean)
    clean_lines = sum(1 for line in clean.splitlines() if line.strip())
    fp = compared if clean == normalized else compared_text(clean)
    return normalized, clean, clean_lines, len(words), len({w.lower() for w in words}), fp, reason_against(normalized, compared, clean, clean_lines, len(words))


_PHRASES = (*LOW_SIGNAL_LINES, *CTA_PREFIXES)
_SCRAPED = [
    (re.compile(pattern), to)
    for pattern, to in (
        (r"http[^\x09-\x0D\x1C-\x20\x85\xA0]+|www\.[^\x09-\x0D\x1C-\x20\x85\xA0]+", ""),
        (r"<[^>]+>", ""),
        (r"\r\n?", "\n"),
        (r"\n{3,}", "\n\n"),
        (r"[ \t]+\n", "\n"),
        (r"\n[ \t]+", "\n"),
        (r"[\x00-\x09\x0B-\x1F]", ""),
        (r"([!?.]){2,}", r"\1"),
        (r"\s+([,.;:!?])", r"\1"),
        (r"([,;:!?.])([A-Za-z0-9])", r"\1 \2"),
        (r"\s+\)", ")"),
        (r"\(\s+", "("),
    )
]
_BULLETS = re.compile(r"\s*[\u2022\u00B7\u2014\u2013]\s*")
_LINE_ENDS = re.compile(r"\s*\n\s*")
_HASHTAG_WORD = re.compile("hashtag", re.I | re.A)
_HASHTAG_GAP = re.compile(r"\s+#\s*([A-Za-z0-9_]+)")


def scraped_text(text: str | None) -> str:
    """Scraped text ready to be judged: links, tags and control characters go, marks are single and spaced as in print, each bullet or dash begins a line, sentences begin with a capital, hashtags stand in the line."""
    text = canonical_text(text)
    for pattern, to in _SCRAPED:
        text = pattern.sub(to, text)
    text = _LINE_ENDS.sub("\n", _BULLETS.sub("\n", text.strip())).strip()
    text = _HASHTAG_WORD.sub("", capitalized(text) or "")
    return re.sub(r"[ \t]{2,}", " ", _HASHTAG_GAP.sub(r" #\1", text)).strip()


_SILVER = StructType(
    [StructField("normalized", StringType()), StructField("clean", StringType())]
    + [StructField(n, t) for n, t in (("clean_lines", LongType()), ("n_words", IntegerType()), ("n_unique", IntegerType()))]
    + [StructField("fp", StringType()), StructField("reason", StringType())]
)


def _silver_udf(scraped: bool):
    @F.pandas_udf(_SILVER)
    def silver(texts: pd.Series) -> pd.DataFrame:
        told = (t if isinstance(t, str) else None for t in texts)
        return pd.DataFrame([judged_text(scraped_text(t) if scraped else t) for t in told], columns=_SILVER.names)

    return silver


def silver_columns(text: Column, scraped: bool = False) -> Column:
    """Struct of ``judged_text``, in one Arrow crossing; with scraped of ``scraped_text`` first."""
    return _silver_udf(scraped)(text)


def preview(text: Column, limit: int = 160) -> Column:
    flat = inline(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def response_preview(text: Column, limit: int = 240) -> Column:
    """Preview of a response body, with words of its own for a missing and a blank one."""
    flat = inline(F.coalesce(text, F.lit("")))
    return (
        F.when(text.isNull(), "no response received")
        .when(flat == "", "empty response body")
        .when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("...")))
        .otherwise(flat)
    )


def capitalized(text: str | None) -> str | None:
    """Words of letters with two capitals or more stay, others become small; sentences, lines and a lone i begin with a capital."""
    if not text:
        return text
    tokens = re.findall(r"\S+|\n", re.sub(r"[ \t]+", " ", text.strip()))
    kept = [t if t.islower() or t.isalpha() and sum(map(str.isupper, t)) > 1 else t.lower() for t in tokens]
    flat = " ".join(kept).replace(" \n ", "\n")
    flat = re.sub(r"(^|[.!?\n]\s*)([a-z])", lambda m: m[1] + m[2].upper(), flat)
    flat = re.sub(r"\bi\b", "I", flat)
    return re.sub(r" *\n *", "\n", flat).strip()


def trailing_hashtags(text: Column) -> Column:
    """Struct ``(body, hashtags)``; hashtags at the end count only after white space."""
    pattern = f"(?s)^(.*?)(?:{WS}+((?:#{WORD}{WS}*)+))?$"
    flat = strip(text)
    tags = F.regexp_extract_all(F.regexp_extract(flat, pattern, 2), F.lit(f"(#{WORD})"), 1)
    return F.struct(strip(F.regexp_extract(flat, pattern, 1)).alias("body"), F.array_join(tags, " ").alias("hashtags"))


def display_lines(text: Column) -> Column:
    """Lines a text takes on display: its own, else its sentences, else its clauses, else 90 characters a line."""
    parts = trailing_hashtags(normalize_lines(text))
    body, more = parts["body"], F.when(parts["hashtags"] != "", 1).otherwise(0)
    lines = F.filter(F.transform(split_lines(body), strip), lambda line: line != "")
    flat = inline(body)
    sentences, clauses = F.size(chunks(flat, SENTENCE_END)), F.size(chunks(flat, CLAUSE_END))
    count = (
        F.when(F.size(lines) > 1, F.size(lines))
        .when(flat == "", 0)
        .when(sentences > 1, sentences)
        .when(clauses > 1, clauses)
        .otherwise(F.greatest(F.lit(1), F.ceil(F.length(flat) / 90)))
    )
    return F.when(normalize_lines(text) == "", 0).otherwise(count + more).cast("bigint")


def hashtag_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"((?<![{WORD_CHARS}])#{WORD})"), 1)).cast("bigint")


def slug(text: Column, fallback: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", fallback).otherwise(made)


def counted(number: Column, noun: str) -> Column:
    """``1 line``, ``2 lines``."""
    return F.concat(number.cast("string"), F.when(number == 1, f" {noun}").otherwise(f" {noun}s"))


def compact_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(split_lines(normalize_lines(text)), inline), lambda line: line != ""), "\n")


#: Characters a line holds when one long sentence is broken (fixed values).
WRAP_WIDTH = {"Short": 48, "Medium": 60, "Long": 72}


@F.pandas_udf(StringType())
def _wrapped(texts: pd.Series, lengths: pd.Series) -> pd.Series:
    broken = lambda t, w: "\n".join(x.strip() for x in wrap(t, width=w, break_long_words=False, break_on_hyphens=False))
    return pd.Series([broken(t, WRAP_WIDTH[k]) if isinstance(t, str) else None for t, k in zip(texts, lengths, strict=True)])


def reflow(text: Column, length: Column) -> Column:
    """One paragraph as lines: by sentences, else by clauses, else, from 90 characters, by width."""
    flat = inline(text)
    sentences, clauses = chunks(flat, SENTENCE_END), chunks(flat, CLAUSE_END)
    return (
        F.when(F.size(sentences) > 1, F.array_join(sentences, "\n"))
        .when(F.size(clauses) > 1, F.array_join(clauses, "\n"))
        .when(F.length(flat) < 90, flat)
        .otherwise(_wrapped(flat, length))
    )


def variant_text(text: Column, length: Column) -> Column:
    """A generated variant in compact lines, its hashtags on a line of their own at the end."""
    parts = trailing_hashtags(compact_lines(text))
    body, tags = parts["body"], parts["hashtags"]
    lines = F.filter(F.transform(split_lines(body), strip), lambda line: line != "")
    rebuilt = compact_lines(F.when(F.size(lines) <= 1, reflow(body, length)).otherwise(body))
    return compact_lines(F.concat_ws("\n", F.when(rebuilt != "", rebuilt), F.when(tags != "", tags)))


def public_identifier(url: Column) -> Column:
    """The name in the address of a profile, company or school page; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"linkedin\.com/(?:in|company|school)/([A-Za-z0-9\-_]+)", 1), F.lit(""))


def marker_count(text: Column) -> Column:
    """How often the markers of a wrong decoding occur."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in MOJIBAKE_MARKERS), F.lit(0)).cast("bigint")
