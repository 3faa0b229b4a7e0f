"""Problem 10: the subject areas of each document.

Every document becomes hashed terms, once. Passes over all documents then count in how many of them each term is, fit by
expectation maximisation which terms speak for which subject (hand labels begin it), and gather the documents, as
normalised vectors of those terms, in cells. Bisecting k-means clusters the cells; each leaf is labelled by its
discriminative terms. A passage is a mixture of the leaves it is near to, and so of their subjects, and a document has
each subject that a passage of it is clearly about. Only hand labels are a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import ship_package, written

#: Label rows that the fit takes at most, chosen by a hash of the id.
LABEL_ROWS = 4000
#: Counts of different terms that a task holds at most before it gives them away.
HELD_COUNTS = 4_000_000
#: What an index has for terms it doesn't know, and for terms that tell the language only.
ABSENT, WEAK = -1, -2
#: Terms in fewer passages than this, or in as many as this share of a language's documents or more, speak for nothing.
LEAST_PASSAGES, MOST_SHARE = 3, 0.2
#: Rounds of the expectation maximisation, steps within a document in each, and the weight of all passages' terms in those of a subject.
ROUNDS, STEPS, SMOOTH = 5, 3, 20.0
#: A term of a subject occurs where the other passages of its documents are about the subject at least to this share.
AGREEMENT = 0.45
#: A term is discriminative from this share of a subject, and a passage is about a subject from this share of its leaves and this weight of terms.
TERM_SHARE, PASSAGE_SHARE, PASSAGE_WEIGHT = 0.5, 0.6, 1.8
#: Cells that documents are gathered in, each around a document chosen by a hash of the id, and places that the terms of their vectors are folded to for the clustering.
CELLS, CELL_PLACES = 2048, 1 << 12
#: Leaves at most, and the least share of the documents of one.
LEAVES, LEAST_LEAF = 200, 0.0005
SPLIT_ROUNDS, RESTARTS = 8, 4
#: Terms that are compared with all leaves at a time.
TERM_BLOCK = 20_000
#: The nearest leaves share a passage by this power of their cosines: the third one, squared so often.
SQUARED = 1
SEED = 11

_SENTENCES = re.compile(r"(?<=[.!?…।])\s+|[\n\r]+")
#: Words, marks over which no pair of words goes, and ends of sentences or lines.
_TOKENS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[ऀ-ॿ]+|[,;:()\[\]\"“”—–]|[.!?…।](?=\s)|[\n\r]")
#: Comparisons: what is only likened to something isn't the subject (fixed values).
_FIGURE = re.compile(
    r"\b(?:felt|feels?|feeling|looked|looks|sounded|sounds|smelled|seemed) like\b|\bas if\b|\bas though\b|\bfühlte? sich (?:\w+ )?wie\b|"
    r"\bse (?:sintió|sentía|siente|sentiu) como\b|\bcomme si\b|\bparecía una?\b|\bjaisa laga\b|\bjaise\b|\bmetaphor",
    re.I,
)
#: One of these is in every comparison.
_FIGURE_SIGNS = (" like", "as if", "as though", "fühlt", " como", "comme si", "parecía un", "jais", "metaphor")
_MARK, _END = 0, 1


class _Tokens:
    """Numbers of tokens, and of each number its hash as it stands and in small letters (0 for a mark, 1 for an end), and whether it is in capitals."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.hashes: list[tuple[int, int, bool]] = []
        self._table = np.zeros((0, 3), np.int64)

    def table(self) -> np.ndarray:
        if len(self._table) < len(self.hashes):
            self._table = np.vstack([self._table, np.array(self.hashes[len(self._table) :], np.int64)])
        return self._table

    def number(self, token: str) -> int:
        first = token[0]
        if first.isalpha() or first > "ऀ" and token not in "—–“”…":
            low = token.lower()
            entry = *(zlib.crc32(t.encode("utf-8", "replace")) | 2 for t in (token, low)), token == token.upper()
        else:
            entry = (_END, _END, False) if first in ".!?…।\n\r" else (_MARK, _MARK, False)
        known = self.numbers[token] = len(self.hashes)
        self.hashes.append(entry)
        return known


_tokens = _Tokens()


@dataclass
class Passages:
    """Documents as hashed terms: ``terms`` of all passages one after the other, each once in its passage, ``sizes`` of the passages, ``owner`` the document of each."""

    ids: np.ndarray
    langs: list[str]
    terms: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray


def encoded(ids: list[int], langs: list[str], texts: list[str | None]) -> Passages:
    """Words and pairs of neighbouring words of each sentence or line that isn't a comparison.

    A word with a capital inside its sentence stays apart from the small one, unless the sentence is in capitals.
    """
    global _tokens
    if len(_tokens.hashes) > 300_000:
        _tokens = _Tokens()
    get, number = _tokens.numbers.get, _tokens.number
    flat: list[int] = []
    lengths: list[int] = []
    for text in texts:
        before = len(flat)
        if text:
            low = text.lower()
            if any(sign in low for sign in _FIGURE_SIGNS) and _FIGURE.search(text):
                text = "\n".join(s for s in _SENTENCES.split(text) if not _FIGURE.search(s))
            flat += [known if (known := get(t)) is not None else number(t) for t in _TOKENS.findall(text)]
        lengths.append(len(flat) - before)
    document = np.repeat(np.arange(len(texts)), lengths)
    table = _tokens.table()
    stands, small, capital = table[:, 0], table[:, 1], table[:, 2] > 0
    token = np.array(flat, np.int64)
    words = stands[token]
    # A passage begins with a document and after each end.
    begins = np.ones(len(token), bool)
    begins[1:] = (document[1:] != document[:-1]) | (words[:-1] == _END)
    passage = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    is_word = words > _END
    # The first word of a passage counts in small letters, and so do all where every word is in capitals.
    if len(token):
        nth = np.cumsum(is_word)
        first = is_word & (nth == (nth - is_word)[starts][passage] + 1)
        shout = np.bincount(passage, weights=is_word & ~capital[token], minlength=len(starts)) == 0
        words = np.where(first | shout[passage], small[token], words)
    words = np.where(is_word, words, 0).astype(np.uint64)
    owner = document[starts]
    pairs = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0) & (passage[1:] == passage[:-1])) if len(words) else np.zeros(0, np.int64)
    joint = words[pairs] * np.uint64(0x9E3779B1) + words[pairs + 1] * np.uint64(0x85EBCA77) if len(pairs) else np.zeros(0, np.uint64)
    said = words > 0
    term = np.concatenate([words[said], joint ^ (joint >> np.uint64(29))]) & np.uint64(0x7FFFFFFF)
    key = _different((np.concatenate([passage[said], passage[pairs]]).astype(np.uint64) << np.uint64(31)) | term)
    passage = (key >> np.uint64(31)).astype(np.int64)
    sizes = np.bincount(passage, minlength=len(starts))
    full = sizes > 0
    return Passages(np.array(ids, np.int64), langs, (key & np.uint64(0x7FFFFFFF)).astype(np.int32), sizes[full], owner[full])


def _different(key: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting, which is faster on many integers."""
    key = np.sort(key)
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


class Index:
    """Rows of the terms of languages, found by whole keys in a table with room to spare, so that terms never meet however many there are."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows.astype(np.int32)
        self.bits = max(int(4 * len(keys)).bit_length(), 4)
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            missed = self.table[at] != left
            left, at = left[missed], (at[missed] + 1) & ((1 << self.bits) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, terms: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
        """The row of each term in a language; ABSENT for languages below 0."""
        if not len(self.keys):
            return np.full(len(terms), ABSENT, np.int32)
        keys = term_keys(terms, lang)
        at = self._start(keys)
        entry = self.table[at]
        left = np.flatnonzero((entry >= 0) & (self.keys[entry] != keys))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            entry[left] = self.table[at[left]]
            left = left[(entry[left] >= 0) & (self.keys[entry[left]] != keys[left])]
        return np.where(entry >= 0, self.rows[entry], ABSENT)


def term_keys(terms: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
    """One number for a term and its language."""
    return (np.atleast_1d(np.asarray(lang, np.int64)) << 31) | terms


def _no_index() -> Index:
    return Index(np.zeros(0, np.int64), np.zeros(0, np.int32))


@dataclass
class SubjectModel:
    """Discriminative terms by their index, their weights, the leaves as unit vectors of them, weighted, and the leaves' subjects."""

    subjects: list[str]
    langs: list[str]
    index: Index = field(default_factory=_no_index)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    labels: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def about(self, batch: Passages) -> tuple[np.ndarray, np.ndarray]:
        """``(document, subject)`` of each passage that is clearly about one."""
        none = np.zeros(0, np.int64)
        if not len(self.leaves):
            return none, none
        total = np.bincount(np.repeat(np.arange(len(batch.sizes)), batch.sizes), weights=self.weights[batch.terms], minlength=len(batch.sizes))
        heavy = np.flatnonzero(total >= PASSAGE_WEIGHT)
        row = batch.terms[np.repeat(total >= PASSAGE_WEIGHT, batch.sizes)]
        if not len(row):
            return none, none
        size = batch.sizes[heavy]
        start = np.cumsum(size) - size
        best, sure = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), bool)
        for at in range(0, len(heavy), 2000):
            some = slice(at, at + 2000)
            first, last = start[at], start[at + 2000] if at + 2000 < len(start) else len(row)
            near = np.add.reduceat(self.leaves[row[first:last]], start[some] - first, axis=0)
            near /= np.maximum(near.max(axis=1, keepdims=True), 1e-9)
            near = near * near * near
            for _ in range(SQUARED):
                near = near * near
            share = (near @ self.labels) / np.maximum(near.sum(axis=1, keepdims=True), 1e-9)
            best[some] = share.argmax(axis=1)
            sure[some] = share.max(axis=1) >= PASSAGE_SHARE
        return batch.owner[heavy[sure]], best[sure]

    def found(self, batch: Passages) -> list[tuple[int, int, float]]:
        """``(document, subject, share of the passages that are about any)`` of documents as rows of this model, in order."""
        document, subject = self.about(batch)
        key, count = np.unique(document * len(self.subjects) + subject, return_counts=True) if len(document) else (document, document)
        document, subject = key // max(len(self.subjects), 1), key % max(len(self.subjects), 1)
        total = np.bincount(document, weights=count, minlength=1)
        return [(int(d), int(s), float(n / total[d])) for d, s, n in zip(document, subject, count, strict=True)]

    def document_subjects(self, text: str | None, lang: str = "") -> list[tuple[str, float]]:
        """``(subject, share)`` of a text, most first."""
        return [(self.subjects[s], n) for _, s, n in sorted(self.found(known_rows(encoded([0], [lang], [text]), self.index, self.langs)), key=lambda x: (-x[2], x[1]))]


def known_rows(batch: Passages, index: Index, langs: list[str]) -> Passages:
    """The same documents with the rows of the index in place of terms, without those it hasn't.

    A document without a language counts for the one that has most of its terms.
    """
    number = {name: k for k, name in enumerate(langs)}
    lang = np.array([number.get(name, -1) for name in batch.langs], np.int64)
    passage = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
    document = batch.owner[passage]
    unsaid = np.flatnonzero(lang < 0)
    if len(unsaid) and len(langs):
        of = np.isin(document, unsaid)
        terms, who = batch.terms[of], document[of]
        hits = [np.bincount(who, weights=index.of(terms, k) != ABSENT, minlength=len(lang)) for k in range(len(langs))]
        lang[unsaid] = np.array(hits).argmax(axis=0)[unsaid]
    row = index.of(batch.terms, lang[document])
    return _chosen(batch, row)


def _chosen(batch: Passages, row: np.ndarray) -> Passages:
    """The documents with ``row`` in place of their terms, without the negative ones and the passages that have no others."""
    known = row >= 0
    passage = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
    sizes = np.bincount(passage[known], minlength=len(batch.sizes))
    full = sizes > 0
    return Passages(batch.ids, batch.langs, row[known], sizes[full], batch.owner[full])


# Passes over all documents. A pass gives rows of numbers whose first ones say what the others are summed for.

Pass = Callable[[Iterator[Passages]], Iterator[np.ndarray]]


def _frequency_pass(langs: list[str]) -> Pass:
    """``(term, language, passages)``. A task gives away what it has counted when it holds much; sums are made of all it gives."""
    number = {name: k for k, name in enumerate(langs)}

    def run(batches: Iterator[Passages]) -> Iterator[np.ndarray]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            lang = np.array([number.get(name, -1) for name in batch.langs], np.int64)
            of = np.repeat(lang[batch.owner], batch.sizes)
            held.append(np.unique(term_keys(batch.terms[of >= 0], of[of >= 0]), return_counts=True))
            if len(held) > 40:
                held = [_added(held)]
                if len(held[0][0]) > HELD_COUNTS:
                    yield _told_counts(*held.pop())
        if held:
            yield _told_counts(*_added(held))

    return run


def _told_counts(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([keys & 0x7FFFFFFF, keys >> 31, n], axis=1).astype(np.float64)


def _expected_pass(log: np.ndarray | None, votes: dict[int, np.ndarray], n_terms: int, n_subjects: int, agree: bool) -> Pass:
    """``(term, how often it speaks for each subject, and for none)``; with agree how much the other passages are about each subject.

    A passage is about one subject of its document, or about none. Without log only labelled documents count, by their labels.
    """

    def run(batches: Iterator[Passages]) -> Iterator[np.ndarray]:
        seen = np.zeros((n_terms, n_subjects + 1 + n_subjects * agree), np.float64)
        for batch in batches:
            prior = np.zeros((len(batch.ids), n_subjects), np.float32)
            for k, key in enumerate(batch.ids.tolist()):
                if key in votes:
                    prior[k] = votes[key]
            if log is None:
                rated = prior.sum(axis=1) > 0
                batch = _chosen(batch, np.where(np.repeat(rated[batch.owner], batch.sizes), batch.terms, -1))
            row, own = batch.terms, batch.owner
            if not len(row):
                continue
            start = np.cumsum(batch.sizes) - batch.sizes
            if log is None:
                about, others = np.hstack([0.7 * prior[own], np.full((len(own), 1), 0.3)]), prior[own]
            else:
                score = np.add.reduceat(log[row], start, axis=0)
                odds = np.full((len(batch.ids), n_subjects + 1), 0.7 / n_subjects, np.float32)
                odds[:, -1] = 0.3
                odds[:, :-1] += prior
                mixture = odds[own]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                for _ in range(STEPS):
                    about = score + np.log(_rows(mixture))
                    about = np.exp(about - about.max(axis=1, keepdims=True))
                    about /= about.sum(axis=1, keepdims=True)
                    whole = np.zeros((len(batch.ids), n_subjects + 1), np.float32)
                    whole[own[first]] = np.add.reduceat(about, first, axis=0)
                    whole[:, :-1] += 2.0 * prior
                    mixture = np.maximum(whole[own] - about, 0) + 0.02  # what the other passages are about
                others = _rows(np.maximum(whole[own] - about, 0)[:, :-1] + 0.05)
            spread = np.hstack([about, others] if agree else [about])
            for k in range(spread.shape[1]):
                seen[:, k] += np.bincount(row, weights=np.repeat(spread[:, k], batch.sizes), minlength=n_terms)
        some = np.flatnonzero(seen[:, : n_subjects + 1].sum(axis=1) > 0)
        if len(some):
            yield np.hstack([some[:, None], seen[some]])

    return run


def _vectors(batch: Passages, strong: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, row, value)`` of the documents' unit vectors: a discriminative term's weight by the logarithm of its passages."""
    batch = _chosen(batch, strong[batch.terms])
    key = np.sort(np.repeat(batch.owner, batch.sizes) * max(len(weights), 1) + batch.terms)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(key)))
    document, row = key[start] // max(len(weights), 1), key[start] % max(len(weights), 1)
    value = (1 + np.log(n)) * weights[row]
    norm = np.sqrt(np.bincount(document, weights=value**2, minlength=len(batch.ids)))
    return document, row, value / np.maximum(norm[document], 1e-9)


def _pivot_pass(strong: np.ndarray, weights: np.ndarray) -> Pass:
    """``(rank, id, row, value)`` of the CELLS documents of the least hash, of those that have terms. A task gives no more than that many."""

    def run(batches: Iterator[Passages]) -> Iterator[np.ndarray]:
        kept = np.zeros((0, 4))
        for batch in batches:
            document, row, value = _vectors(batch, strong, weights)
            rank = (batch.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(12)).astype(np.float64)
            kept = _least(np.vstack([kept, np.stack([rank[document], batch.ids[document].astype(np.float64), row, value], axis=1)]))
        if len(kept):
            yield kept

    return run


def _least(rows: np.ndarray) -> np.ndarray:
    ranks = np.unique(rows[:, 0])
    return rows[rows[:, 0] <= ranks[CELLS - 1]] if len(ranks) > CELLS else rows


def _cell_pass(strong: np.ndarray, weights: np.ndarray, pivots: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Pass:
    """``(cell, row, sum)``: every document's vector is added to the cell of the pivot it is nearest to; at row -1 the documents are counted."""
    cell, at, value_of = pivots
    order = np.argsort(at, kind="stable")
    cell, value_of = cell[order], value_of[order]
    bounds = np.searchsorted(at[order], np.arange(len(weights) + 1))
    n_cells, width = int(cell.max()) + 1 if len(cell) else 1, len(weights) + 1

    def run(batches: Iterator[Passages]) -> Iterator[np.ndarray]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            document, row, value = _vectors(batch, strong, weights)
            for first in range(0, len(batch.ids), 500):
                some = slice(*np.searchsorted(document, [first, first + 500]))
                d, r, v = document[some] - first, row[some], value[some]
                if not len(d):
                    continue
                n = bounds[r + 1] - bounds[r]
                where = np.repeat(bounds[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
                near = np.bincount(np.repeat(d, n) * n_cells + cell[where], weights=np.repeat(v, n) * value_of[where], minlength=500 * n_cells).reshape(500, n_cells)
                best, some = near.argmax(axis=1), np.unique(d)
                held.append((np.concatenate([best[d] * width + r + 1, best[some] * width]), np.concatenate([v, np.ones(len(some))])))
            if len(held) > 40:
                held = [_added(held)]
        if held:
            key, value = _added(held)
            yield np.stack([key // width, key % width - 1, value], axis=1)

    return run


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, value = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(value, start) if len(key) else value


def _split(x: np.ndarray, mass: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray | None:
    """Two clusters of unit vectors by spherical k-means, each of the least mass; None if they can't be parted so."""
    best, kept = -np.inf, None
    for _ in range(RESTARTS):
        a = x[rng.choice(len(x), p=mass / mass.sum())]
        far = mass * np.maximum(1 - x @ a, 0) ** 2  # the second seed is likely to be far from the first
        if far.sum() <= 0:
            continue
        b = x[rng.choice(len(x), p=far / far.sum())]
        side = None
        for _ in range(SPLIT_ROUNDS):
            now = x @ b > x @ a
            if side is not None and (now == side).all():
                break
            side = now
            if not 0 < side.sum() < len(x):
                break
            a, b = mass[~side] @ x[~side], mass[side] @ x[side]
            a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
        if side is not None and 0 < side.sum() < len(x) and min(mass[side].sum(), mass[~side].sum()) >= least:
            score = float(mass[side] @ (x[side] @ b) + mass[~side] @ (x[~side] @ a))
            if score > best:
                best, kept = score, side
    return kept


def bisect(x: np.ndarray, mass: np.ndarray, leaves: int, least: float = LEAST_LEAF) -> np.ndarray:
    """Leaf number of each row: the leaf of the most scatter is split again and again, as far as its parts have the least share of the mass."""
    rng = np.random.default_rng(SEED)
    label = np.zeros(len(x), np.int32)
    spread = lambda rows: float(mass[rows].sum() - np.linalg.norm(mass[rows] @ x[rows]))
    scatter = {0: spread(slice(None))} if len(x) else {}
    count = 1
    while scatter and count < leaves:
        leaf = max(scatter, key=lambda k: (scatter[k], -k))
        rows = np.flatnonzero(label == leaf)
        side = _split(x[rows], mass[rows], least * mass.sum(), rng) if len(rows) >= 2 else None
        if side is None:
            del scatter[leaf]
            continue
        label[rows[side]] = count
        scatter[leaf], scatter[count] = spread(label == leaf), spread(label == count)
        count += 1
    return label


def _rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9)


class Corpus:
    """Documents that passes can be summed over; here they are in memory. ``narrow`` leaves only the terms of an index, as its rows."""

    def __init__(self, batches: list[Passages], sizes: dict[str, int]):
        self.batches, self.sizes = batches, sizes

    def sum_of(self, run: Pass, width: int, keys: int, least: float = 0) -> np.ndarray:
        """The rows of a pass, summed for the first ``keys`` of the ``width`` columns, which are whole numbers; without keys as they are.

        With least only rows whose first sum comes to it."""
        found = list(run(iter(self.batches)))
        rows = np.vstack(found) if found else np.zeros((0, width))
        if not keys:
            return rows
        key, at = np.unique(rows[:, :keys], axis=0, return_inverse=True)
        out = np.zeros((len(key), width - keys))
        np.add.at(out, at.ravel(), rows[:, keys:])
        out = np.hstack([key, out])
        return out[out[:, keys] >= least] if least else out

    def narrow(self, index: Index, langs: list[str]) -> Corpus:
        return Corpus([known_rows(b, index, langs) for b in self.batches], self.sizes)


#: A row for each document; the lists are strings of four-byte numbers, which cross to Python as they are.
_STORED = "id bigint, lang string, terms binary, sizes binary"


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(counts) * 4).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.int32), np.diff(ends) // 4


def _stored(batch: Passages) -> pa.RecordBatch:
    passages = np.bincount(batch.owner, minlength=len(batch.ids))
    terms = np.bincount(batch.owner, weights=batch.sizes, minlength=len(batch.ids)).astype(np.int64)
    columns = [pa.array(batch.ids), pa.array(batch.langs, pa.string()), _packed(batch.terms, terms), _packed(batch.sizes, passages)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "lang", "terms", "sizes"])


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Passages]:
    for batch in batches:
        if batch.num_rows:
            (terms, _), (sizes, passages) = _unpacked(batch.column(2)), _unpacked(batch.column(3))
            yield Passages(batch.column(0).to_numpy(), batch.column(1).to_pylist(), terms, sizes.astype(np.int64), np.repeat(np.arange(batch.num_rows), passages))


class SharedCorpus(Corpus):
    """The same over a table; tasks add up what they see, and what they give is added up before it comes to the driver."""

    def __init__(self, table: DataFrame, sizes: dict[str, int]):
        self.table, self.sizes = table, sizes

    def sum_of(self, run: Pass, width: int, keys: int, least: float = 0) -> np.ndarray:
        names = [f"c{k}" for k in range(width)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in run(_loaded(batches)):  # what it holds is sent once, by Spark's broadcast of large functions
                kinds = [np.int64] * keys + [np.float32 if keys else np.float64] * (width - keys)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].astype(kind)) for k, kind in enumerate(kinds)], names=names)

        told = self.table.mapInArrow(task, ", ".join(f"{n} {'bigint' if k < keys else 'float' if keys else 'double'}" for k, n in enumerate(names)))
        if keys:
            told = told.groupBy(*names[:keys]).agg(*[F.sum(n).alias(n) for n in names[keys:]])
        if least:
            told = told.where(F.col(names[keys]) >= least)
        found = told.toArrow()
        return np.stack([c.to_numpy() for c in found.columns], axis=1) if found.num_rows else np.zeros((0, width))

    def narrow(self, index: Index, langs: list[str]) -> Corpus:
        shared = self.table.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _loaded(batches):
                yield _stored(known_rows(batch, shared.value, langs))

        return SharedCorpus(written(self.table.mapInArrow(task, _STORED)), self.sizes)


def _fit(corpus: Corpus, labels: list[tuple[int, str]], subjects: list[str]) -> tuple[SubjectModel, Corpus, np.ndarray]:
    """The model, the documents as the rows of its first index, and of each such row the model's own, or a negative number.

    Labels may err and be incomplete.
    """
    subjects = sorted(set(subjects))
    langs = sorted(name for name in corpus.sizes if name) or [""]
    model = SubjectModel(subjects, langs)
    number = {s: k for k, s in enumerate(subjects)}
    rated: dict[int, list[int]] = {}
    for i, s in labels:
        if s in number:
            rated.setdefault(i, []).append(number[s])
    nothing = model, corpus.narrow(model.index, langs), np.zeros(0, np.int32)
    if not rated:
        return nothing
    votes = {i: np.bincount(v, minlength=len(subjects)).astype(np.float32) / len(v) for i, v in rated.items()}
    counted = corpus.sum_of(_frequency_pass(langs), 3, 2, LEAST_PASSAGES)
    term, lang, passages = counted[:, 0].astype(np.int64), counted[:, 1].astype(np.int64), counted[:, 2]
    documents = np.array([corpus.sizes.get(name, 0) for name in langs], float)
    kept = passages <= np.maximum(MOST_SHARE * documents[lang], LEAST_PASSAGES)
    order = np.argsort(term_keys(term, lang)[kept])
    term, lang, passages = term[kept][order], lang[kept][order], passages[kept][order]
    if not len(term):
        return nothing
    keys = term_keys(term, lang)
    index = Index(keys, np.arange(len(keys)))
    corpus = corpus.narrow(index, langs)
    width = len(subjects) + 1
    base = passages / np.bincount(lang, weights=passages, minlength=len(langs))[lang]
    log = None
    for k in range(ROUNDS):
        last = k == ROUNDS - 1
        told = corpus.sum_of(_expected_pass(log, votes, len(keys), len(subjects), last), 1 + width + last * (width - 1), 1)
        seen = np.zeros((len(keys), told.shape[1] - 1))
        seen[told[:, 0].astype(np.int64)] = told[:, 1:]
        chance = seen[:, :width] + SMOOTH * base[:, None]
        whole = np.stack([np.bincount(lang, weights=chance[:, c], minlength=len(langs)) for c in range(width)], axis=1)
        log = np.log(np.maximum(chance / np.maximum(whole[lang], 1e-9), 1e-12)).astype(np.float32)
    agree = _rows(seen[:, width:])[np.arange(len(keys)), seen[:, : width - 1].argmax(axis=1)]
    seen = seen[:, :width]
    stray = agree < AGREEMENT  # a set phrase: the passages around it are about anything
    seen[stray, -1] += seen[stray, :-1].sum(axis=1)
    seen[stray, :-1] = 0
    size = np.stack([np.bincount(lang, weights=seen[:, c], minlength=len(langs)) for c in range(width - 1)], axis=1)
    seen[:, :-1] *= (size.sum(axis=1, keepdims=True) / len(subjects) / np.maximum(size, 1.0))[lang]  # subjects of equal size
    share = _rows(seen[:, :-1] + (seen[:, -1:] + 1.0) / len(subjects))
    top = share.max(axis=1)
    chosen = np.flatnonzero(top >= TERM_SHARE)
    strong = np.full(len(keys), WEAK, np.int32)
    strong[chosen] = np.arange(len(chosen))
    model.index = Index(keys, strong)
    model.weights = (np.log(np.maximum(documents[lang], passages) / passages + 1) * (top - TERM_SHARE) / (1 - TERM_SHARE))[chosen].astype(np.float32)
    if len(chosen):
        _cluster(model, corpus, strong, share[chosen])
    return model, corpus, strong


def _cluster(model: SubjectModel, corpus: Corpus, strong: np.ndarray, share: np.ndarray) -> None:
    """Gathers the documents in cells, clusters the cells, and labels the leaves by the terms that stand out in them."""
    chosen = _least(corpus.sum_of(_pivot_pass(strong, model.weights), 4, 0))
    if not len(chosen):
        return
    cell = np.unique(chosen[:, 0], return_inverse=True)[1]
    told = corpus.sum_of(_cell_pass(strong, model.weights, (cell, chosen[:, 2].astype(np.int64), chosen[:, 3])), 3, 2)
    of, row, value = told[:, 0].astype(np.int64), told[:, 1].astype(np.int64), told[:, 2]
    n_cells, n_terms = int(cell.max()) + 1, len(model.weights)
    mass = np.zeros(n_cells)
    mass[of[row < 0]] = value[row < 0]
    of, row, value = of[row >= 0], row[row >= 0], value[row >= 0]
    x = np.zeros((n_cells, min(CELL_PLACES, n_terms)), np.float32)
    np.add.at(x, (of, row % x.shape[1]), value)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    leaf = bisect(x, np.maximum(mass, 1e-9).astype(np.float32), LEAVES).astype(np.int64)
    del x
    leaves = int(leaf.max()) + 1
    # Only what is there is summed; a block of terms at a time is as wide as all leaves.
    at, value_of = _added([(row * leaves + leaf[of], value)])
    value_of /= np.maximum(np.sqrt(np.bincount(at % leaves, weights=value_of**2, minlength=leaves)), 1e-9)[at % leaves]
    model.leaves = np.zeros((n_terms, leaves), np.float32)
    model.leaves.ravel()[at] = value_of * model.weights[at // leaves]
    # What stands out in a leaf: terms that weigh more in it than in all documents.
    usual = np.bincount(row, weights=value, minlength=n_terms)
    usual /= max(np.linalg.norm(usual), 1e-9)
    stands = np.zeros((leaves, share.shape[1]))
    for first in range(0, n_terms, TERM_BLOCK):
        last = min(first + TERM_BLOCK, n_terms)
        some = slice(*np.searchsorted(at, [first * leaves, last * leaves]))
        block = np.zeros((last - first, leaves))
        block.ravel()[at[some] - first * leaves] = value_of[some]
        stands += (np.maximum(block - usual[first:last, None], 0) ** 2).T @ share[first:last]
    model.labels = _rows(_rows(stands) ** 2).astype(np.float32)


def fit_model(documents: list[tuple[int, str]], labels: list[tuple[int, str]], subjects: list[str]) -> SubjectModel:
    """A model from ``(doc_id, text)`` and ``(doc_id, subject)`` rows in memory, all of one language."""
    documents = sorted({i: t for i, t in documents if t}.items())
    batch = encoded([i for i, _ in documents], [""] * len(documents), [t for _, t in documents])
    return _fit(Corpus([batch], {"": len(documents)}), labels, subjects)[0]


def _lang(df: DataFrame) -> F.Column:
    """The stated language of a document, in small letters; empty where there is none."""
    return F.lower(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit("")))) if "lang" in df.columns else F.lit("")


def _terms_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as hashed terms. Null texts and rows without an id are left out."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                yield _stored(encoded(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist()))

    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), _lang(df).alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return chosen.mapInArrow(task, _STORED)


def _fit_on(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[SubjectModel, Corpus, np.ndarray]:
    """``_fit`` on all documents (``doc_id, text``, and ``lang`` if there is one) and at most LABEL_ROWS label rows."""
    names = [r.subject for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect()]
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject")
        .where("doc_id IS NOT NULL AND subject IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "subject")
        .limit(LABEL_ROWS)
    )
    terms = written(_terms_of(documents, "doc_id", "text"))
    sizes = {r.lang: r.n for r in terms.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return _fit(SharedCorpus(terms, sizes), [(r.doc_id, r.subject) for r in chosen.collect()], names)


def fit_on(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> SubjectModel:
    """The model of all documents, from label rows ``doc_id, subject`` and the subjects allowed."""
    return _fit_on(documents, labels, subjects)[0]


def _told(model: SubjectModel, table: DataFrame, strong: np.ndarray | None) -> DataFrame:
    """``id, subject, share`` of a table of hashed terms, or, with strong, of rows of the first index."""
    shared = table.sparkSession.sparkContext.broadcast((model, strong))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value
        for batch in _loaded(batches):
            batch = known_rows(batch, own.index, own.langs) if rows is None else _chosen(batch, rows[batch.terms])
            found = own.found(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(batch.ids[d]) for d, _, _ in found], pa.int64()), pa.array([own.subjects[s] for _, s, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.float64())],
                names=["id", "subject", "share"],
            )

    return table.mapInArrow(task, "id bigint, subject string, share double")


def subject_table(df: DataFrame, model: SubjectModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, subject, share``: each subject of each document and its share of the document's passages.

    Null, empty and blank texts, and those about none of the subjects, give no row; so do rows without an id. A row that is
    there twice is told twice. A column ``lang`` is read if there is one, other columns are ignored.
    """
    return _told(model, _terms_of(df, id_col, text_col), None)


def fitted_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``subject_table`` of the documents that the model is fitted on, whose texts are read once."""
    model, corpus, strong = _fit_on(documents, labels, subjects)
    return _told(model, corpus.table, strong)


def composition(found: DataFrame) -> DataFrame:
    """``subject, documents, share``: how many documents each subject has, and its share of all their passages."""
    per = found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))
    whole = F.sum("weight").over(Window.partitionBy(F.lit(1)))  # a row for each subject: a handful
    return per.select("subject", "documents", (F.col("weight") / whole).alias("share"))
