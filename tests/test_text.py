"""Literal cases of the text rules, and random texts against a plain model of them."""

import html
import pickle
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.functions import numbers
from postmill.functions import text as T
from postmill.operators import dedup, quality, sketch


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx bigint, text string")


def values(spark, texts, make):
    frame = rows(spark, texts).withColumn("c", T.canonicalize(F.col("text")))
    return [r.v for r in frame.select("idx", make(F.col("c")).alias("v")).orderBy("idx").collect()]


def silver(spark, texts):
    return quality.add_clean_columns(rows(spark, texts)).orderBy("idx").collect()


def test_normalisation_and_repair(spark):
    texts = ["Iâ€™m​ building this", None, "a&amp;b", "x \n y\n\n\n\nz", "tab\t\tbed", "fi­ne ﬁ", "🔥 Iâ€™m"]
    found = values(spark, texts, T.normalize_lines)
    assert found == ["I’m building this", "", "a&b", "x\ny\n\nz", "tab bed", "fine fi", "🔥 Iâ€TMm"]


def test_reasons(spark):
    cases = {
        "Activate to view larger image,\nActivate to view larger image,": "image_placeholder",
        "Media player modal window": "media_placeholder",
        "Hope you take a moment to watch.": "cta_only",
        "Why NVIDIA built nemotron": "thin_post",
        "": "empty_text",
        "🔥🔥": "empty_text",
        "one two three four five six seven eight nine ten": None,
    }
    found = silver(spark, list(cases))
    assert [r.reason for r in found] == list(cases.values())


def test_sanitising(spark):
    texts = [
        "Useful line\nActivate to view larger image,\nMore context",
        "A useful sentence here.\nRead more:\n➡️",
        "Line one with real detail.\nLearn more:\n➡️",
        "Kept. Read more about it.",
        "&amp;amp;lt;",
        "a\n\nb",
    ]
    found = silver(spark, texts)
    assert [r.clean for r in found] == ["Useful line\nMore context", "A useful sentence here.", "Line one with real detail.", "Kept.", "", "a\n\nb"]
    assert found[2].clean_lines == 1


def test_cleaning_of_scraped_text(spark):
    texts = ["Hello   world!!!\n\nhashtag #Python", None, "see http://x.y now", "a\tb • c", "costs 1.5 euros", "NVIDIA, NVIDIA i"]
    found = quality.add_cleaned_post(rows(spark, texts), "text").orderBy("idx").collect()
    assert [r.clean for r in found] == ["Hello world! #python", "", "See now", "Ab\nC", "Costs 1. 5 euros", "Nvidia, NVIDIA I"]
    assert found[0].fp == "hello world #python"


def test_counts(spark):
    frame = spark.createDataFrame([(x,) for x in ["42", "1.5K", "2 M", "1.234", "1.234.567", "1,234", "x", "", None]], "v string")
    assert [r.n for r in frame.select(numbers.abbreviated_number(F.col("v")).alias("n")).collect()] == [42, 1500, 2000000, 1, 0, 1234, 0, 0, 0]
    frame = spark.createDataFrame([(x,) for x in ["It happened at 2 AM", "We booked a 1:1 session", "none", None]], "v string")
    assert [r.n for r in frame.select(numbers.first_number(F.col("v")).alias("n")).collect()] == [2, 1, 0, 0]
    frame = spark.createDataFrame([(x,) for x in ["42 likes", "likes 1.2K", "It happened at 2 AM", "A 1:1 mentoring session"]], "v string")
    assert [r.n for r in frame.select(numbers.social_count(F.col("v")).alias("n")).collect()] == [42, 1200, 0, 0]
    frame = spark.createDataFrame([(x,) for x in ["8", " 12 ", "1_000", "1.5", "-3", "", None]], "v string")
    assert [r.n for r in frame.select(numbers.coerce_int(F.col("v")).alias("n")).collect()] == [8, 12, 1000, 0, -3, 0, 0]
    frame = spark.range(12).select(numbers.length_bucket(F.col("id")).alias("b"))
    assert [r.b for r in frame.collect()] == ["Short"] * 5 + ["Medium"] * 6 + ["Long"]


def test_display(spark):
    texts = ["One sentence. Two sentences.", "first, second", "x" * 200, "", "a\nb #x", "#AI", "word #AI #ML"]
    assert values(spark, texts, T.display_lines) == [2, 2, 3, 0, 3, 1, 2]
    assert [tuple(v) for v in values(spark, texts[-2:], T.trailing_hashtags)] == [("#AI", ""), ("word", "#AI #ML")]
    assert values(spark, ["#a b#c #d_1 ##e"], T.hashtag_count) == [3]
    assert values(spark, ["Story/problem-solution hook", "!!!"], lambda c: T.slug(c, F.lit("variant-1"))) == ["story-problem-solution-hook", "variant-1"]
    found = values(spark, ["First one. Second one. Third one. #AI #Career", "word " * 30, "", "a\n\nb"], lambda c: T.variant_text(c, F.lit("Short")))
    assert found[0] == "First one.\nSecond one.\nThird one.\n#AI #Career"
    assert all(len(line) <= 48 for line in found[1].split("\n")) and found[2:] == ["", "a\nb"]


def test_previews_and_ids(spark):
    assert values(spark, ["a\n b", "x" * 161], T.preview) == ["a b", "x" * 160 + "..."]
    frame = spark.createDataFrame([(x,) for x in [None, " ", "a\nb", "y" * 300]], "v string")
    assert [r.p for r in frame.select(T.response_preview(F.col("v")).alias("p")).collect()] == ["no response received", "empty response body", "a b", "y" * 240 + "..."]
    frame = spark.createDataFrame([(x,) for x in ["https://www.linkedin.com/in/some-one/", "https://x.y", None]], "v string")
    assert [r.p for r in frame.select(T.public_identifier(F.col("v")).alias("p")).collect()] == ["some-one", None, None]


def _model(text):
    def canon(t):
        t = html.unescape(t or "").replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
        gone = dict.fromkeys(map(ord, T.INVISIBLE))
        t = t.translate(gone)
        for _ in range(2):
            n = sum(t.count(m) for m in T.MOJIBAKE_MARKERS)
            try:
                u = t.encode("cp1252").decode()
            except UnicodeError:
                break
            if not n or sum(u.count(m) for m in T.MOJIBAKE_MARKERS) >= n:
                break
            t = u
        return unicodedata.normalize("NFKC", t).translate(gone)

    def norm(t, lines=True):
        t = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", canon(t))))
        return (re.sub(r"\n{3,}", "\n\n", t) if lines else re.sub(r"\s+", " ", t)).strip()

    def comp(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s#]", "", t.lower())).strip()

    def cta(t):
        return any(comp(t) == p or comp(t).startswith(p + " ") for p in T.CTA_PREFIXES)

    kept = [x.strip() for x in norm(text).splitlines() if comp(x) not in T.LOW_SIGNAL_LINES]
    while kept:
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", norm(kept[-1], False)) if s.strip()]
        while parts and cta(parts[-1]):
            parts.pop()
        kept[-1] = norm(" ".join(parts), False)
        if any(c.isalnum() for c in kept[-1]) and not cta(kept[-1]):
            break
        kept.pop()
    clean = norm("\n".join(kept))
    return clean, comp(norm(clean, False))


PIECES = ["word", "Read more", "read more:", "Play video", "\n", "\n\n", " ", "\t", "➡️", "é", "&amp;", "&lt;", "â€™", "​", " ", "Learn more here. ", "End. ", "catch up", "नमस्ते", "#tag", "…", "\x1c"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=60, max_size=60))
def test_random_texts_against_the_model(spark, texts):
    found = silver(spark, texts)
    assert [(r.clean, r.fp) for r in found] == [_model(t) for t in texts]


def test_greedy_choice_against_the_model(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the angry bear "
    texts = [base * 2, base * 2 + "x", base + "y", base * 2, "something else entirely with nothing in common", base + "yz", base + "yzw", ""]
    ranked = [(i, t, float(s), 1, len(t)) for i, (t, s) in enumerate(zip(texts, [3, 2, 5, 3, 1, 5, 6, 1], strict=True))]
    frame = spark.createDataFrame(ranked, "idx bigint, fp string, score double, engagement bigint, length int")
    winners, losers = dedup.resolve_duplicates(frame)
    retained, lost = [], []
    for row in ranked:
        near = lambda a, b: bool(a and b) and (a == b or SequenceMatcher(None, a, b).ratio() >= 0.9)
        rivals = [r for r in retained if near(row[1], r[1])]
        if not rivals:
            retained.append(row)
            continue
        winner = max([*rivals, row], key=lambda r: r[2:])
        lost += [(r[0], winner[0]) for r in [*rivals, row] if r is not winner]
        retained = [r for r in retained if r not in rivals] + [winner]
    assert sorted(r.idx for r in winners.collect()) == sorted(r[0] for r in retained)
    assert sorted((r.idx, r.winner_idx) for r in losers.collect()) == sorted(lost)


@pytest.mark.parametrize("size", [150, 250])
def test_popular_characters_are_no_anchors_in_long_texts(size):
    import random

    text = "".join(random.Random(1).choice("abcdefghijkl") for _ in range(size))
    assert dedup.similar("z" + text[1:], text) == (size < 200)
    assert dedup.similar("z" + text[1:], text, autojunk=False)


def test_short_runs_lose_no_similar_pair():
    """What single characters and runs of two rule out is not similar, and most of what runs of three let pass is ruled out."""
    rng = random.Random(5)
    words = ["alpha", "bravo", "team", "launch", "growth", "the", "and", "of", "great", "über", "काम", "2024"]
    x = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    y = []
    for text in x:
        chars = list(text)
        for _ in range(rng.randint(0, len(chars) // 8)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "q"]])
            chars = chars or ["a"]
        y.append("".join(chars))
    passed = dedup._alike(x, y, 0.9)
    kept = set(zip(*(k.tolist() for k in dedup._narrowed(x, y, passed, 0.9))))
    true = {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if dedup.similar(a, b) or dedup.similar(b, a)}
    assert true and true <= kept and len(kept) < len(passed[0])


def _varied(rng, count, longest):
    """Texts of words, some of them changed a little, some much."""
    words = ["alpha", "bravo", "team", "launch", "growth", "the", "and", "of", "great", "über", "काम", "2024", "quixz", "jov"]
    texts: list[str] = []
    for _ in range(count):
        chars = list(rng.choice(texts) if texts and rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, longest))))
        for _ in range(rng.randint(0, len(chars) // 9 + 1)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "q"], ["e"]])
            chars = chars or ["a"]
        texts.append("".join(chars))
    return sorted(set(texts))


@pytest.mark.parametrize("autojunk", [True, False])
def test_sketches_lose_no_similar_pair(autojunk):
    """Of all pairs, few are left to be compared letter by letter, and all similar ones are among them."""
    texts = _varied(random.Random(3 + autojunk), 160, 120)
    groups = sketch.centres(texts, 5)
    columns = sketch.sketches(texts, autojunk, groups)
    table = pa.table({"idx": pa.array(range(len(texts)))} | {k: pa.array(v) for k, v in columns.items()})
    found = pickle.loads(pickle.dumps(sketch.Sketches(table)))
    kept = set()
    for start in range(0, len(found), 50):
        for a, b in sketch.candidates(found, found, start, min(start + 50, len(found)), 0.9, groups, True):
            kept |= set(zip(a.tolist(), b.tolist(), strict=True)) | set(zip(b.tolist(), a.tolist(), strict=True))
    true = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and dedup.similar(a, b, autojunk=autojunk)}
    assert true and true <= kept and len(kept) < len(texts) ** 2 / 5


def test_similar_pairs_of_many_chunks(spark, monkeypatch):
    """Whatever is sent at once, the pairs are those of a comparison of all texts, in both orders."""
    texts = _varied(random.Random(11), 120, 60)
    posts = spark.createDataFrame(list(enumerate(texts)), "idx bigint, fp string").repartition(3)
    true = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and dedup.similar(a, b)}
    for chunk, span in ((10**6, 10**6), (17, 9)):
        monkeypatch.setattr(dedup, "CHUNK", chunk)
        monkeypatch.setattr(dedup, "SPAN", span)
        got = [(r.newer, r.older) for r in dedup.similar_pairs(posts).collect()]
        assert len(got) == len(true) and set(got) == true
