"""Words of many texts at once, as numbers.

Texts stand one after the other in an Arrow buffer. A table tells for each byte whether it
is part of a word, a blank or the end of a piece; words, their numbers within a block and
the pieces they stand in follow from array operations. UTF-8 needs no decoding for this,
since all separators are ASCII and bytes of other characters are never below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Texts are handled in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

WORD, BLANK, END = 0, 1, 2

# A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_kinds(blanks: bytes, ends: bytes = b"") -> np.ndarray:
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(ends)] = END
    return kinds


@dataclass
class Block:
    """The words of some neighbouring rows of a batch."""

    first_row: int
    n_rows: int
    ids: np.ndarray  # of each word: its place in words
    words: list[bytes]
    row: np.ndarray  # of each word: its row in the batch
    piece: np.ndarray  # of each word: differs from that of its neighbour across a piece's end

    def row_bounds(self) -> np.ndarray:
        """Where the words of each row start, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.first_row, self.first_row + self.n_rows + 1))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts and the bounds of each in it; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def blocks(
    texts: pa.Array, kinds: np.ndarray, lower: bool = False, size: int = BLOCK_BYTES
) -> Iterator[Block]:
    data, bounds = _bytes_of(texts)
    row, n = 0, len(texts)
    while row < n:
        last = int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1
        last = min(n, max(row + 1, last))
        yield _block(data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row], row, kinds, lower)
        row = last


def _block(
    data: np.ndarray, bounds: np.ndarray, first_row: int, kinds: np.ndarray, lower: bool
) -> Block:
    if lower:
        data = LOWER[data]
    kind = kinds[data]
    word = kind == WORD
    new_text = np.zeros(len(data) + 1, bool)
    new_text[bounds] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    after = np.concatenate((word[1:], [False])) if len(data) else word
    start = np.flatnonzero(word & (~before | new_text[:-1]))
    end = np.flatnonzero(word & (~after | new_text[1:])) + 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    tokens = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]
    ).dictionary_encode()
    row = np.searchsorted(bounds, start, side="right") - 1
    piece = np.cumsum(kind == END, dtype=np.int64)[start] if len(start) else np.zeros(0, np.int64)
    return Block(
        first_row,
        len(bounds) - 1,
        tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        tokens.dictionary.to_pylist(),
        row + first_row,
        piece + row,
    )


def hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def two_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word, as two independent numbers."""
    both = b"".join(xxhash.xxh3_128_digest(w) for w in words)
    pairs = np.frombuffer(both, np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
