"""SuperMinHash signatures for batches of documents.

Every element of a document gets a permutation of the slots and one uniform draw per rank; a slot keeps the
smallest ``rank + draw`` it is offered. Ranks are handed out one after the other to all documents of a batch
at once, and a document stops as soon as the next rank can't lower any of its slots.
"""

from __future__ import annotations

import numpy as np

SLOTS = 200
ROWS_PER_BAND = 4
SKETCH_BITS = 128
BANDS = SLOTS // ROWS_PER_BAND
_DRAW_BITS = 24
_PERMUTATIONS = 2048
_EMPTY = np.int32(2**31 - 1)
_CHUNK = 400_000
_table: np.ndarray | None = None


def _permutations() -> np.ndarray:
    """Fixed pseudo-random permutations; an element picks one by its hash and rotates it by other bits of it."""
    global _table
    if _table is None:
        draws = np.random.default_rng(20240).random((_PERMUTATIONS, SLOTS))
        _table = np.argsort(draws, axis=1).astype(np.int32)
    return _table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiset shingles of word hashes: the n-th occurrence of a shingle in a document is an element of its own.

    Returns the elements and their document numbers. A document of fewer than ``width`` words has none.
    """
    words = words.view(np.uint64) if words.dtype == np.int64 else words.astype(np.uint64)
    lengths = np.diff(offsets)
    document = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = mix(words[:n])
    for k in range(1, width):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k])
    inside = document[:n] == document[width - 1 : n + width - 1]
    value, document = value[inside], document[:n][inside]
    order = np.lexsort((value, document))
    value, document = value[order], document[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (document[1:] != document[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
        occurrence = (np.arange(len(value)) - start).astype(np.uint64)
        value = mix(value + occurrence * np.uint64(0xD1B54A32D192ED03))
    return value, document


def signatures(elements: np.ndarray, document: np.ndarray, documents: int) -> np.ndarray:
    """Signatures as an int32 array (documents, SLOTS); a document without elements keeps empty slots."""
    out = np.full(documents * SLOTS, _EMPTY, np.int32)
    if not len(elements):
        return out.reshape(documents, SLOTS)
    bounds = np.searchsorted(document, np.arange(documents + 1))
    first = 0
    while first < documents:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _CHUNK, "right")) - 1)
        part = slice(bounds[first], bounds[last])
        _fill(elements[part], document[part] - first, out[first * SLOTS : last * SLOTS])
        first = last
    return out.reshape(documents, SLOTS)


def _fill(elements: np.ndarray, document: np.ndarray, out: np.ndarray) -> None:
    table = _permutations()
    row = (elements & np.uint64(_PERMUTATIONS - 1)).astype(np.int32)
    turn = ((elements >> np.uint64(12)) % np.uint64(SLOTS)).astype(np.int32)
    base = document * SLOTS
    state = mix(elements)
    slots = out.reshape(-1, SLOTS)
    for rank in range(SLOTS):
        slot = table[row, rank] + turn
        slot[slot >= SLOTS] -= SLOTS
        draw = (state >> np.uint64(64 - _DRAW_BITS)).astype(np.int32) | np.int32(rank << _DRAW_BITS)
        np.minimum.at(out, base + slot, draw)
        open_documents = slots.max(axis=1) >= np.int32(min((rank + 1) << _DRAW_BITS, int(_EMPTY)))
        keep = open_documents[document]
        if not keep.any():
            return
        row, turn, base, document = row[keep], turn[keep], base[keep], document[keep]
        state = mix(state[keep] + np.uint64(0x9E3779B97F4A7C15))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 40-bit key per band and document, as int64 (documents, BANDS)."""
    rows = signature.reshape(len(signature), BANDS, ROWS_PER_BAND).astype(np.uint64)
    key = np.zeros(rows.shape[:2], np.uint64)
    for k in range(ROWS_PER_BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return (key >> np.uint64(24)).view(np.int64)


def sketch(signature: np.ndarray) -> list[np.ndarray]:
    """One bit of each slot, packed in four 64-bit words; equal bits estimate (1 + Jaccard) / 2. The first SKETCH_BITS fill two words."""
    bit = np.zeros((len(signature), 256), np.uint8)
    bit[:, :SLOTS] = mix(signature.astype(np.uint64)) & np.uint64(1)
    packed = np.packbits(bit, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    return [packed[:, k].copy() for k in range(4)]
