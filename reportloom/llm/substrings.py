"""Substring dedup by difference-cover anchors.

Of every text, runs of ANCHOR words are hashed at the positions of a difference cover only:
for any two positions there is an offset below PERIOD that leads both into the cover. Two
equal windows of `window` words at any positions therefore share an anchor at the same
offset inside them, though a fifth of all positions is hashed. Anchors that stand in one
document only end there. Around the others the match is extended: each window that holds a
shared anchor is compared as a whole, by 96 bits of its words, and is repeated if it also
starts in a document with a smaller number.

Whole texts that repeat one of a smaller number are taken out first; all their windows are
repeated. Nothing is paired: anchors and windows are reduced to their smallest document
number, and rows meet that one number, so a passage in a third of all documents is a hot
key of a plain join, which adaptive execution splits.

Null texts have no words. A row without number counts as larger than all others, and rows
with the same number, or without, are not repeats of each other. Repeated rows give the same
result once each. Other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportloom.llm import word_bytes

KINDS = word_bytes.byte_kinds(b" \t\n\x0b\x0c\r")

# A perfect difference set: its differences give each number modulo the period once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
IN_COVER = np.isin(np.arange(PERIOD), COVER)

# Odd bases of the two polynomial hashes; any odd number will do.
BASES = (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99)
# Bits of an anchor's hash. Anchors that meet by chance only cost a comparison.
ANCHOR_BITS = 48
LAST = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Rolling:
    """Hashes of runs of words of one block, modulo 2 ** 64."""

    def __init__(self, words: np.ndarray, base: int):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(base, len(words)), out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), len(words) + 1)

    def __call__(self, start: np.ndarray, size: int) -> np.ndarray:
        return word_bytes.mixed((self.sums[start + size] - self.sums[start]) * self.back[start])


def _places(block: word_bytes.Block, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all anchors, and the rows they stand in."""
    bounds = block.row_bounds()
    size = np.diff(bounds)
    inside = np.arange(len(block.ids)) - np.repeat(bounds[:-1], size)
    left = np.repeat(size, size)
    at = np.flatnonzero(IN_COVER[inside % PERIOD] & (inside + anchor <= left) & (left >= window))
    return at, block.row[at]


def _anchor_keys(rolling: Rolling, at: np.ndarray, anchor: int) -> np.ndarray:
    return rolling(at, anchor) >> np.uint64(64 - ANCHOR_BITS)


def _blocks(texts: pa.Array) -> Iterator[tuple[word_bytes.Block, np.ndarray, np.ndarray]]:
    for block in word_bytes.blocks(texts, KINDS):
        one, two = word_bytes.two_hashes(block.words)
        yield block, one[block.ids], two[block.ids]


def _anchors(window: int) -> Callable:
    """doc, part, anchor: the different anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for block, one, _ in _blocks(batch.column(3)):
                at, row = _places(block, window, window - PERIOD + 1)
                key = _anchor_keys(Rolling(one, BASES[0]), at, window - PERIOD + 1)
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[row[new]]), pa.array(part[row[new]]), pa.array(key[new].view(np.int64))],
                    names=["doc", "part", "anchor"],
                )

    return run


def _held(lists: pa.Array, row: int) -> np.ndarray:
    """The hashes in a row's list."""
    value = lists[row]
    return np.asarray(value.values if value.is_valid else [], np.int64).view(np.uint64)


def _windows(window: int) -> Callable:
    """w1, w2, doc, part: the different windows of each text that hold a shared anchor."""
    anchor = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            shared = batch.column(4)
            for block, one, two in _blocks(batch.column(3)):
                first, second = Rolling(one, BASES[0]), Rolling(two, BASES[1])
                at, row = _places(block, window, anchor)
                key = _anchor_keys(first, at, anchor)
                bounds = block.row_bounds()
                of_row = np.searchsorted(row, np.arange(block.n_rows + 1) + block.first_row)
                marks = np.zeros(len(block.ids) + 1, np.int64)
                for i in range(block.n_rows):
                    here = slice(of_row[i], of_row[i + 1])
                    known = _held(shared, block.first_row + i)
                    hit = at[here][np.isin(key[here], known)]
                    # Windows with the anchor start at most PERIOD - 1 words before it.
                    low = np.maximum(hit - (PERIOD - 1), bounds[i])
                    high = np.minimum(hit, bounds[i + 1] - window) + 1
                    np.add.at(marks, low, 1)
                    np.add.at(marks, high, -1)
                start = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                w1, row = first(start, window), block.row[start]
                w2 = (second(start, window) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((w2, w1, row))
                w1, w2, row = w1[order], w2[order], row[order]
                new = np.ones(len(w1), bool)
                new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (row[1:] != row[:-1])
                row = row[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w1[new].view(np.int64)),
                        pa.array(w2[new].view(np.int32)),
                        pa.array(doc[row]),
                        pa.array(part[row]),
                    ],
                    names=["w1", "w2", "doc", "part"],
                )

    return run


def _kept(window: int) -> Callable:
    """doc_id, n_words, n_removed, kept: what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, whole = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            for block, one, _ in _blocks(batch.column(1)):
                rolling, bounds = Rolling(one, BASES[0]), block.row_bounds()
                gone_words, texts = np.zeros(block.n_rows, np.int64), []
                for i in range(block.n_rows):
                    low, high = int(bounds[i]), int(bounds[i + 1])
                    gone = np.zeros(high - low, bool)
                    known = _held(repeated, block.first_row + i)
                    if whole[block.first_row + i] and high - low >= window:
                        gone[:] = True
                    elif len(known):
                        start = np.arange(low, high - window + 1)
                        start = start[np.isin(rolling(start, window), known)] - low
                        edge = np.zeros(high - low + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + window, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                    gone_words[i] = gone.sum()
                    stay = block.ids[low:high][~gone].tolist()
                    texts.append(b" ".join([block.words[j] for j in stay]))
                rows = slice(block.first_row, block.first_row + block.n_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(gone_words, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(
    df: DataFrame, document: str = "doc_id", text: str = "text", window: int = 50
) -> DataFrame:
    """doc_id, n_words, n_removed, kept: texts without the words of repeated windows.

    `kept` has the words that stay, joined by single blanks. A window needs at least
    PERIOD words.
    """
    if window < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = df.select(
        F.col(document).cast("long").alias("doc_id"),
        F.coalesce(F.col(document).cast("long"), F.lit(LAST)).alias("doc"),
        # Two texts under one number may share this; they are then treated alike.
        F.hash(content).alias("part"),
        F.xxhash64(content).alias("t1"),
        F.xxhash64(F.lit("again"), content).alias("t2"),
        content.alias("text"),
    )
    names = texts.groupBy("doc", "part", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    smallest = names.groupBy("t1", "t2").agg(F.min("doc").alias("first"))
    again = (
        names.join(smallest, ["t1", "t2"])
        .where("doc > first")
        .select("doc", "part", F.col("t1").alias("t1_again"))
        .groupBy("doc", "part")
        .agg(F.collect_set("t1_again").alias("copies"))
    )
    base = (
        texts.select("doc_id", "doc", "part", "t1", "text")
        .join(again, ["doc", "part"], "left")
        .withColumn("copy", F.coalesce(F.array_contains("copies", F.col("t1")), F.lit(False)))
        .select("doc_id", "doc", "part", "text", "copy")
    )
    # With the same columns everywhere, Spark shuffles the texts once for all three uses.
    own = base.where("not copy").select("doc_id", "doc", "part", "text")

    anchors = own.mapInArrow(_anchors(window), "doc bigint, part int, anchor bigint")
    shared = (
        anchors.groupBy("anchor")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .where("low < high")
        .select("anchor")
    )
    of_text = (
        anchors.join(shared, "anchor")
        .groupBy("doc", "part")
        .agg(F.collect_set("anchor").alias("shared"))
    )
    windows = own.join(of_text, ["doc", "part"]).select("doc_id", "doc", "part", "text", "shared").mapInArrow(
        _windows(window), "w1 bigint, w2 int, doc bigint, part int"
    )
    first = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"))
    repeated = (
        windows.join(first, ["w1", "w2"])
        .where("doc > first")
        .groupBy("doc", "part")
        .agg(F.collect_set("w1").alias("repeated"))
    )
    return (
        base.join(repeated, ["doc", "part"], "left")
        .select("doc_id", "text", "repeated", "copy")
        .mapInArrow(_kept(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    )
