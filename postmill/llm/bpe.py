"""Problem 8: byte-level BPE encoding of whole texts with a public vocabulary.

Each pre-token is a doubly linked list of symbols; a heap holds the merge ranks of neighbours, and entries whose
symbols have changed since are skipped. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import ship_package

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file is public and of fixed size; a larger file than this isn't one.
MAX_VOCABULARY_BYTES = 16 << 20
#: Pre-tokens whose ids a worker keeps, and the longest that it keeps.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64


class BytePairEncoder:
    """Encoder and decoder over ``base64 rank`` lines."""

    def __init__(self, lines: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self._pieces = regex.compile(PATTERN)
        self._cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null or empty. Lone surrogates become the replacement character."""
        ids: list[int] = []
        if not text:
            return ids
        cache = self._cache
        for piece in self._pieces.findall(text):
            known = cache.get(piece)
            if known is None:
                known = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = known
            ids += known
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank is merged first, of equal ranks the leftmost."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        symbol = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, i + 1, 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbol[i] or right[i] != j or len(symbol[i]) + len(symbol[j]) != size:
                continue  # stale: one of the two was merged since
            symbol[i] += symbol[j]
            symbol[j] = b""
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (rank := ranks.get(symbol[i] + symbol[after])) is not None:
                    heapq.heappush(heap, (rank, i, after, len(symbol[i]) + len(symbol[after])))
            before = left[i]
            if before >= 0 and (rank := ranks.get(symbol[before] + symbol[i])) is not None:
                heapq.heappush(heap, (rank, before, i, len(symbol[before]) + len(symbol[i])))
        return [ranks[s] for s in symbol if s]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[int, BytePairEncoder] = {}


def shared_encoder(lines: bytes) -> BytePairEncoder:
    """The encoder of a vocabulary, built once in each worker."""
    key = hash(lines)
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(lines)
    return _encoders[key]


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        lines = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(lines) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return lines


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id, ids`` for every row; null and empty texts have an empty list, a null id stays null.

    Ids are those of the vocabulary without special tokens; strings that look like special tokens are ordinary
    text. The vocabulary is read on the driver and broadcast, its size being bounded.
    """
    ship_package(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(lines.value)
        for batch in batches:
            flat: list[np.ndarray] = []
            ends = np.zeros(batch.num_rows + 1, np.int64)
            for k, text in enumerate(batch.column(1)):
                ids = np.array(encoder.encode(text.as_py()), np.int32)
                flat.append(ids)
                ends[k + 1] = ends[k] + len(ids)
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], names=["id", "ids"]
            )

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The ``keep`` columns of every row and ``tokens``, the number of ids of its text (0 for null or empty)."""
    ship_package(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("bigint")
    def tokens(texts):
        encoder = shared_encoder(lines.value)
        return texts.map(lambda text: len(encoder.encode(text)) if isinstance(text, str) else 0).astype("int64")

    return df.select(*keep, tokens(F.col(text_col)).alias("tokens"))
