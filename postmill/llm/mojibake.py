"""Problem 2: text decoded with the wrong encoding.

A hidden Markov model labels the characters of a text. One state is clean text; every pair of a true and a wrong
encoding has states of its own: for UTF-8 read as a one-byte encoding, how many continuation bytes are due; for
two one-byte encodings, one. A pair's emission follows from what the character would be if the pair's damage were
undone; the clean state's from how plausible the character is where it stands. Each labelled span gets its pair's
inverse, and the result is looked at again, as text can be damaged twice.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import ship_package

#: UTF-8 read as one of these, and pairs of one-byte encodings (true, read as), with the logarithm of how often a span starts.
UTF8_READ_AS = {"cp1252": -5.0, "latin-1": -6.0, "mac_roman": -6.0, "cp1251": -6.0, "cp437": -6.0, "cp850": -6.0, "koi8_r": -8.0, "cp1250": -8.0}
ONE_BYTE_READ_AS = {
    ("cp1252", "mac_roman"): -5.5, ("cp1252", "cp437"): -7.0, ("cp1252", "cp850"): -7.0, ("cp1252", "cp1251"): -7.0,
    ("mac_roman", "cp1252"): -7.0, ("cp437", "cp1252"): -7.0, ("cp850", "cp1252"): -7.0,
}
LOST, SWAPPED = "lost", "utf-16"
#: A continuation byte that is missing, as control and soft-hyphen characters are easily dropped.
_MISSING = -4.0
_STAY = math.log(0.5)
ROUNDS = 3

_LETTERS = frozenset("áàâãäåæçéèêëíìîïñóòôõöøúùûüýÿßœ")
_COMMON = frozenset("áàâãäçéèêëíîïñóôõöúùûüßœ")
#: Accented letters that are words by themselves, or are often the first or last letter of one (fixed values).
_ALONE = frozenset("àéáèyóÀÉÓÈÁ")
_LAST = frozenset("áàâãçéèêíóôúùüöäßñ")
_FIRST = frozenset("áàâéêíóôúüöäñçœîåÉÀÂÁÊÍÓÔÚÜÖÄÇŒÎÅÑ")
_SAFE_PUNCTUATION = frozenset("’‘“”–—…•→←\xa0​‌‍⁠﻿   …″′−‑")


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control character of that number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        table[ch] = b
    return table


_TABLE = {codec: _bytes_of(codec) for codec in {*UTF8_READ_AS, *(wrong for _, wrong in ONE_BYTE_READ_AS)}}


def _decoded(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return ""


def _lead(b: int) -> tuple[int, float] | None:
    """Continuation bytes after a first byte of UTF-8, and the logarithm of how often it starts a character."""
    if b == 0xC3:
        return 1, -1.0
    if b == 0xC2:
        return 1, -2.3
    if 0xC4 <= b <= 0xDF:
        return 1, -5.5
    if b == 0xE2:
        return 2, -1.6
    if b == 0xE0:
        return 2, -1.6
    if 0xE1 <= b <= 0xEF:
        return 2, -5.0
    if b == 0xF0:
        return 3, -2.3
    return None


def _class(ch: str) -> str:
    if not ch or ch.isspace() or ch in "​‍﻿":
        return " "
    if ch.isalpha():
        return "A" if ch.isupper() else "a"
    return "9" if ch.isdigit() else "."


_memo: dict[tuple[str, str, str], float] = {}


def clean_score(ch: str, before: str, after: str) -> float:
    """Logarithm of how plausible a character is between its neighbours in undamaged text."""
    key = (ch, before, after)
    if (known := _memo.get(key)) is None:
        if len(_memo) > 200_000:
            _memo.clear()
        known = _memo[key] = _clean_score(ch, before, after)
    return known


def _clean_score(ch: str, before: str, after: str) -> float:
    if ch < "\x80":
        return 0.0
    code, p, n = ord(ch), _class(before), _class(after)
    if code == 0xFFFD:
        return -25.0
    if code < 0xA0:
        return -16.0
    if 0x900 <= code < 0x980 or code >= 0x1F000 or 0x2190 <= code < 0x2200 or 0x2600 <= code < 0x27C0 or 0xFE00 <= code < 0xFE10:
        return -2.0
    if 0xE000 <= code < 0xF900:
        return -14.0
    if ch in _SAFE_PUNCTUATION:
        return -3.0
    if ch == "\xad":
        return -4.0
    low = ch.lower()
    if low in _LETTERS:
        base = -3.5 if low in _COMMON else -8.0
        if p not in "aA" and n not in "aA":
            return base if ch in _ALONE and p in " .9" and n in " ." else -11.0
        if ch != low:
            if p == "a":
                return -14.0
            return base - 0.5 if p == "A" or ch in _FIRST or n == "A" else -10.0
        if p == "A" and n == "A":
            return -9.0
        if p not in "aA" and ch not in _FIRST:
            return -11.0
        return base if n in "aA" or ch in _LAST else -10.5
    if ch in "€£¥":
        return -3.0 if p == "9" or n == "9" or (p == " " and n == " ") else -10.0
    if ch in "¿¡":
        return -3.0 if p in " ." and n in "aA." else -12.0
    if ch in "°ºª":
        return -4.0 if p == "9" or (ch != "°" and p == "a") else -11.0
    if ch == "µ":
        return -4.0 if p in "9 " and n == "a" else -13.0
    if ch in "«»‹›„‚":
        opening = p in " ." and n != " " or p == " "
        return -4.0 if opening or (ch in "»›" and n in " .") or (ch in "«‹" and p in " .") else -12.0
    if ch in "©®™×½¼¾²³¹·÷±†‡§‰¶":
        return -5.0 if p in " 9." and n in " 9." or (ch in "®™²³" and n in " .") else -12.0
    if "Ͱ" <= ch < "԰":
        latin = any(c.isalpha() and c < "ɐ" for c in (before, after))
        plain = "А" <= ch <= "я" or "α" <= ch <= "ω"
        return -14.0 if latin or not (before + after).strip("​").strip() else -4.0 if plain and (p in "aA" or n in "aA") else -10.0
    if 0x2B0 <= code < 0x300:
        return -14.0 if p in "aA" or n in "aA" else -9.0
    if 0x2500 <= code < 0x25A0:
        return -9.0
    if 0x3000 <= code < 0xA000 or 0xAC00 <= code < 0xD7B0:
        return -8.0
    if unicodedata.category(ch)[0] in "LMN":
        return -7.0
    return -9.0


Span = tuple[int, int, str, str]


_options: dict[tuple[str, str], tuple[list, list, bool]] = {}


def _readings(ch: str, fold: str) -> tuple[list, list, bool]:
    """What a character can be in each pair: UTF-8 bytes, one-byte originals, and whether its bytes may be swapped.

    In a text of one case, the character may have had the other case when it was damaged.
    """
    if (known := _options.get((ch, fold))) is not None:
        return known
    forms = {ch}
    if fold:
        forms |= {c for c in (ch.upper(), ch.lower()) if len(c) == 1}
    utf8 = [
        (codec, start, b, 0x80 <= b < 0xC0, _lead(b), 0.0 if form == ch else -0.3)
        for codec, start in UTF8_READ_AS.items()
        for form in forms
        if (b := _TABLE[codec].get(form)) is not None
    ]
    single = [
        (f"{true}>{wrong}", start, b, original, 0.0 if form == ch else -0.3)
        for (true, wrong), start in ONE_BYTE_READ_AS.items()
        for form in forms
        if (b := _TABLE[wrong].get(form)) is not None and (original := _decoded(b, true)) >= "\x80"
    ]
    swapped = 0x20 <= ord(ch) >> 8 < 0x7F and not ord(ch) & 0xFF and ord(ch) > 0xFF or ch in "\u0a00\u0d00\u0900"
    _options[ch, fold] = utf8, single, swapped
    return utf8, single, swapped


def _viterbi(run: str, before: str, after: str, fold: str, boost: frozenset[str]) -> list[Span]:
    """Labelled spans ``(start, end, label, restored)`` of one run of characters beyond ASCII."""
    n = len(run)
    around = before + run + after
    shift = len(before)
    # state: (label, due); label "" is clean. Each holds its score and its path: a linked list of (label, byte, previous).
    states: dict[tuple[str, int], tuple[float, tuple | None]] = {("", 0): (0.0, None)}
    for i, ch in enumerate(run):
        left = around[i + shift - 1] if i + shift else ""
        right = around[i + shift + 1] if i + shift + 1 < len(around) else ""
        following: dict[tuple[str, int], tuple[float, tuple | None]] = {}
        ended = [(score + _MISSING * due + (_STAY if label else 0.0), path) for (label, due), (score, path) in states.items()]
        leave, gone = max(ended, key=lambda x: x[0])
        following["", 0] = (leave + clean_score(ch, left, right), ("", 0, gone))
        utf8, single, swapped = _readings(ch, fold)
        if ch == "�":
            following[LOST, 0] = (leave, (LOST, 0, gone))
        if swapped:
            stay = states.get((SWAPPED, 0))
            score, path = (stay[0] - 3.0, stay[1]) if stay and stay[0] - 3.0 > leave - 5.0 else (leave - 5.0, gone)
            following[SWAPPED, 0] = (score, (SWAPPED, 0, path))
        for codec, start, b, inner, lead, cost in utf8:
            if inner:
                for due in (1, 2, 3):
                    if (known := states.get((codec, due))) is not None:
                        score, state = known[0] + cost - 3.2, (codec, due - 1)
                        if state not in following or following[state][0] < score:
                            following[state] = (score, (codec, b, known[1]))
            if lead:
                score, path = leave + (-1.0 if codec in boost else start), gone
                for due in (0, 1, 2):
                    if (known := states.get((codec, due))) is not None and known[0] + _MISSING * due + _STAY > score:
                        score, path = known[0] + _MISSING * due + _STAY, known[1]
                score, state = score + cost + lead[1], (codec, lead[0])
                if state not in following or following[state][0] < score:
                    following[state] = (score, (codec, b, path))
        for name, start, b, original, cost in single:
            score, path = leave + (-1.0 if name in boost else start), gone
            if (known := states.get((name, 0))) is not None and known[0] + _STAY > score:
                score, path = known[0] + _STAY, known[1]
            score += cost - 1.0 + clean_score(original, left, right)
            if (name, 0) not in following or following[name, 0][0] < score:
                following[name, 0] = (score, (name, b, path))
        top = max(score for score, _ in following.values())
        states = {state: x for state, x in following.items() if x[0] > top - 40}
    best, path = max(((score + _MISSING * due, path) for (_, due), (score, path) in states.items()), key=lambda x: x[0])
    steps = []
    while path:
        steps.append(path[:2])
        path = path[2]
    steps.reverse()
    spans: list[Span] = []
    i = 0
    while i < n:
        label = steps[i][0]
        if not label:
            i += 1
            continue
        j = i + 1
        while j < n and steps[j][0] == label:
            j += 1
        spans.append((i, j, label, _inverse(run[i:j], label, [s[1] for s in steps[i:j]])))
        i = j
    return spans


def _inverse(span: str, label: str, read: list[int]) -> str:
    if label == LOST:
        return span
    if label == SWAPPED:
        return "".join(chr(ord(c) >> 8 | (ord(c) & 0xFF) << 8) for c in span)
    if ">" in label:
        return "".join(_decoded(b, label.split(">")[0]) for b in read)
    return bytes(read).decode("utf-8", "replace")


_RUN = re.compile(r"[^\x00-\x7f]+")
_cache: dict[tuple, list[Span]] = {}
#: Runs of these alone are clean wherever they stand.
_PLAIN_RUN = re.compile(r"[’“”‘—–…​\xa0‍️ऀ-ॿ\U0001f000-\U0001ffff➡→✅☕❤]+")


def _fold(text: str) -> str:
    return "l" if text == text.lower() else "u" if text == text.upper() else ""


def is_damaged(text: str) -> bool:
    return bool(_label(text, _fold(text), frozenset()))


def label_text(text: str) -> list[Span]:
    """The damaged spans of a text, in order; pairs met in it are likelier in the rest of it."""
    fold = _fold(text)
    found = _label(text, fold, frozenset())
    if found:
        labels = frozenset(s[2] for s in found if s[2] not in (LOST, SWAPPED))
        if labels and len(found) > 1:
            found = _label(text, fold, labels)
    return found


def _label(text: str, fold: str, boost: frozenset[str]) -> list[Span]:
    spans: list[Span] = []
    for m in _RUN.finditer(text):
        run = m[0]
        if _PLAIN_RUN.fullmatch(run):
            continue
        a, b = m.span()
        before, after = text[a - 1 : a], text[b : b + 1]
        key = (run, _class(before), _class(after), fold, boost)
        known = _cache.get(key)
        if known is None:
            if len(_cache) > 100_000:
                _cache.clear()
            known = _cache[key] = _viterbi(run, before, after, fold, boost)
        spans += [(a + i, a + j, label, restored) for i, j, label, restored in known]
    return spans


def unescaped(text: str) -> str:
    """Named and numbered entities of characters beyond ASCII become those characters; others stay."""
    if "&" not in text:
        return text
    return re.sub(r"&(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);", lambda m: c if (c := html.unescape(m[0])) > "\x7f" else m[0], text)


def repair(text: str | None) -> tuple[str | None, list[str]]:
    """The text with every labelled span restored, and the labels met, without repeats. Null and empty stay as they are."""
    if not text or text.isascii() and "&" not in text:
        return text, []
    labels: list[str] = []
    current = unescaped(text)
    for _ in range(ROUNDS):
        spans = label_text(current)
        if not spans:
            break
        labels += [s[2] for s in spans if s[2] not in labels]
        out, at = [], 0
        for start, end, _, restored in spans:
            out += [current[at:start], restored]
            at = end
        changed = "".join(out) + current[at:]
        if changed == current:
            break
        current = changed
    return (current if labels else text), labels


_OPEN_TO_DOUBT = r"[^\x00-\x7F]|&[A-Za-z]+;|&#"


def repaired_table(df: DataFrame, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """``id, text, encodings``: each row's text, restored where it was damaged, and the labels of its damage.

    A label is the wrong encoding UTF-8 was read as, ``true>wrong`` for one-byte encodings, ``utf-16`` for swapped
    bytes, and ``lost`` where characters can't be recovered. Clean, null and empty texts have no label. Texts of ASCII
    without entities are handed to Python as nulls.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("text string, encodings array<string>")
    def repaired(texts: pd.Series) -> pd.DataFrame:
        done = [repair(t) if isinstance(t, str) else (None, []) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "encodings": [d[1] for d in done]})

    doubtful = F.when(F.col("text").rlike(_OPEN_TO_DOUBT), F.col("text"))
    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    done = chosen.select("id", "text", F.inline(F.array(repaired(doubtful))).alias("restored", "encodings"))
    return done.select("id", F.coalesce("restored", "text").alias("text"), "encodings")


def damaged_ids(df: DataFrame, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """``id`` of each row whose text holds damage, recoverable or not. Texts of ASCII without entities don't leave the JVM."""
    ship_package(df.sparkSession)

    @F.pandas_udf("boolean")
    def damaged(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: is_damaged(unescaped(t))).astype(bool)

    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return chosen.where(F.col("text").isNotNull() & F.col("text").rlike(_OPEN_TO_DOUBT)).where(damaged("text")).select("id")
