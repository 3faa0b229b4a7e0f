"""Problem 3: near-duplicate records, by SuperMinHash, banding, verification and distributed union-find.

Rows: texts become word hashes in the JVM; one Arrow pass gives each its signature. Texts with the same words
in the same order are one class, and only its smallest id goes on. Band keys meet in an equality join, a
sketch of 128 bits drops chance meetings there, lengths and a sketch of 200 bits more of them, and the rest is verified on all shingles.
Rows that share a hot band key are dealt out to blocks, and pairs of blocks are compared in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import superminhash as smh
from postmill.operators.graph import connected_components
from postmill.session import cut_lineage, ship_package, written

WORDS = r"[\p{L}\p{M}\p{Nd}]+"
#: Up to so many ids (8 MB), counted first, are sent to all executors to filter by; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A pair is verified if its sketch agrees in at least so many of the bits expected at the threshold, less this many deviations.
SKETCH_DEVIATIONS = 4.0
#: A band key of more rows than about this is hot: its rows are dealt out to blocks of this size. Which keys are hot is estimated on
#: one id in HOT_SHARE, which changes the plan only: hot or not, every pair of rows under a key is compared.
HOT_ROWS, HOT_SHARE = 8192, 64

SKETCH = ["s1", "s2", "s3", "s4"]


def word_hashes(text) -> F.Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), 1), lambda w: F.xxhash64(w))


def _words(posts: DataFrame) -> DataFrame:
    """``id, words``. A generator keeps the optimizer from splitting the text anew for a filter on the words."""
    return posts.select("id", F.explode(F.array(word_hashes(F.col("text")))).alias("words"))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, offsets = _lists(batch, "words")
            elements, document = smh.shingles(words, offsets, width)
            signature = smh.signatures(elements, document, batch.num_rows)
            keys = smh.band_keys(signature).ravel()
            low, high = keys.astype(np.int32), (keys >> 32).astype(np.uint8).view(np.int8)  # five bytes of each key are kept
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * smh.BANDS)
            n = np.bincount(document, minlength=batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n),
                 pa.ListArray.from_arrays(ends, pa.array(low)), pa.ListArray.from_arrays(ends, pa.array(high)),
                 *map(pa.array, smh.sketch(signature))],
                names=["id", "k1", "k2", "n", "low", "high", *SKETCH],
            )

    return run


def _elements(width: int):
    """Every shingle of a text, of whose hashes five bytes are kept, as one string of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, offsets = _lists(batch, "words")
            elements, document = smh.shingles(words, offsets, width)
            bounds = np.searchsorted(document, np.arange(batch.num_rows + 1)).astype(np.int32) * 5
            packed = elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            told = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([batch.column(0), told], names=["id", "elements"])

    return run


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a column of ``_elements``, and the row of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 5)
    value = np.zeros((len(raw), 8), np.uint8)
    value[:, :5] = raw
    return value.view("<u8").ravel(), np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(offsets) // 5)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, sim`` of pairs with their shingles: what is there in both rows is there twice in all of them together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (x, at_x), (y, at_y) = (_unpacked(batch.column(k)) for k in (2, 3))
        row = np.concatenate([at_x, at_y]).astype(np.int64)
        both = np.concatenate([x, y])
        order = np.lexsort((both, row))
        both, row = both[order], row[order]
        twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
        shared = np.bincount(row[1:][twice], minlength=batch.num_rows)
        total = np.bincount(row, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(2.0 * shared / total)], names=["a", "b", "sim"])


def _sent_if_small(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint where their number, counted first, is under the bound."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _bits_needed(similarity: float, bits: int) -> int:
    jaccard = similarity / (2 - similarity)
    p = (1 + jaccard) / 2
    return math.floor(bits * p - SKETCH_DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def _alike(similarity: float, bits: int, words: list[str]) -> F.Column:
    """Whether the sketches of the rows ``p`` and ``q`` agree as far as those of a pair at the threshold do."""
    differ = sum(F.bit_count(F.col(f"p.{w}").bitwiseXOR(F.col(f"q.{w}"))) for w in words)
    return bits - differ >= _bits_needed(similarity, bits)


def _bands(reps: DataFrame) -> DataFrame:
    """``key, id, s1, s2``: a row for each band of each text; the number of the band is part of the key."""
    told = reps.select("id", "s1", "s2", "high", F.posexplode("low").alias("band", "part"))
    upper = F.shiftleft(F.col("band").cast("bigint") * 256 + F.get("high", F.col("band")).cast("bigint") + 128, 32)
    return told.select((upper + F.col("part").cast("bigint")).alias("key"), "id", "s1", "s2")


def _met(bands: DataFrame, similarity: float, hot_rows: int = HOT_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """``a, b``: each pair of texts once that share a band key and whose sketches are alike enough.

    The pairs of a hot key would all fall to one task. Its rows are dealt out to blocks by a hash of the id; a row goes to every
    pair of blocks that its own is in, and each pair of blocks is a key of its own.
    """
    alike = _alike(similarity, smh.SKETCH_BITS, SKETCH[:2])
    some = bands.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(hot_share)) == 0)
    hot = cut_lineage(
        some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * hot_share > hot_rows)
        .select("key", F.ceil(F.col("n") * hot_share / hot_rows).cast("int").alias("blocks"))
    )
    if hot.isEmpty():
        return _pairs(bands, bands, alike & (F.col("p.id") < F.col("q.id")))
    few = _sent_if_small(hot)
    cold = bands.join(few, "key", "left_anti")
    dealt = bands.join(few, "key").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    cell = lambda first, second: F.xxhash64("key", first, second).alias("key")
    first = dealt.select("key", "id", "s1", "s2", "own", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("other")).select(cell("own", "other"), "id", "s1", "s2", (F.col("own") == F.col("other")).alias("same"))
    second = dealt.select("key", "id", "s1", "s2", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("other")).select(cell("other", "own"), "id", "s1", "s2")
    ordered = (F.col("p.id") < F.col("q.id")) | ~F.col("p.same")
    return _pairs(cold, cold, alike & (F.col("p.id") < F.col("q.id"))).unionByName(_pairs(first, second, alike & ordered)).distinct()


def _pairs(left: DataFrame, right: DataFrame, condition: F.Column) -> DataFrame:
    met = left.alias("p").join(right.alias("q"), F.col("p.key") == F.col("q.key")).where(condition)
    return met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def duplicate_links(
    df: DataFrame, id_col: str = "idx", text_col: str = "text", width: int = 5, similarity: float = 0.8, min_words: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: every text's class, and verified links between different classes.

    members: ``id, rep`` with rep the smallest id of the texts with the same words. links: ``a, b, sim`` with
    a < b, both of them reps, and sim twice the shared shingles (with repeats) over all shingles of both.
    Rows with a null id or text, or fewer than ``min_words`` or ``width`` words, are in neither. A row that is
    there twice counts once; ids are otherwise taken to be unique. Other columns of ``df`` are ignored, whatever their names.
    """
    ship_package(df.sparkSession)
    posts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    least = max(min_words, width)
    words = _words(posts).where(F.size("words") >= least)
    keyed = words.select("id", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(7), "words").alias("k2"), "words")
    signed = written(
        keyed.mapInArrow(_sign(width), "id bigint, k1 bigint, k2 bigint, n int, low array<int>, high array<tinyint>, s1 bigint, s2 bigint, s3 bigint, s4 bigint")
    )
    classes = signed.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    members = cut_lineage(signed.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "rep").distinct())
    copies = members.where("id <> rep").select("id")
    reps = signed.drop("k1", "k2").join(_sent_if_small(copies), "id", "left_anti")
    met = _met(_bands(reps), similarity)
    small = reps.select("id", "n", *SKETCH)
    most = (2 - similarity) / similarity + 1e-9  # without loss: the smaller text has all shared shingles at most
    likely = cut_lineage(
        met.join(small.alias("p"), F.col("a") == F.col("p.id"))
        .join(small.alias("q"), F.col("b") == F.col("q.id"))
        .where((F.col("p.n") <= most * F.col("q.n")) & (F.col("q.n") <= most * F.col("p.n")) & _alike(similarity, smh.SLOTS, SKETCH))
        .select("a", "b")
    )
    involved = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    elements = (
        _words(posts.join(_sent_if_small(involved), "id", "left_semi")).where(F.size("words") >= least)
        .mapInArrow(_elements(width), "id bigint, elements binary")
    )
    links = (
        likely.join(elements.alias("x"), F.col("a") == F.col("x.id"))
        .join(elements.alias("y"), F.col("b") == F.col("y.id"))
        .select("a", "b", F.col("x.elements").alias("x"), F.col("y.elements").alias("y"))
        .mapInArrow(_compared, "a bigint, b bigint, sim double")
        .where(F.col("sim") >= similarity)
        .distinct()
    )
    return members, cut_lineage(links)


def near_duplicate_groups(
    df: DataFrame, id_col: str = "idx", text_col: str = "text", width: int = 5, similarity: float = 0.8, min_words: int = 0
) -> DataFrame:
    """One row per text: ``id, rep, group_id, n_links``.

    rep is the smallest id of the texts with the same words, group_id the smallest id of all that are connected
    by links, n_links the number of other classes this one is linked to. Rows that ``duplicate_links`` leaves out
    give no row; an empty table gives an empty result.
    """
    members, links = duplicate_links(df, id_col, text_col, width, similarity, min_words)
    return groups_of(members, links)


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    per_class = degree.join(parts.withColumnRenamed("node", "rep"), "rep")
    return members.join(per_class, "rep", "left").select(
        "id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``idx_a, idx_b`` for every pair of texts that are copies or linked; only where each pair is asked for."""
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    linked = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return linked.unionByName(copies).select(F.least("x", "y").alias("idx_a"), F.greatest("x", "y").alias("idx_b"))
