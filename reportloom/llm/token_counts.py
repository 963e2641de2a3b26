"""Token counts: Arrow functions that encode batches and give back lengths only.

Texts longer than a piece are split where the tokenizer splits as well, so that the counts
of the pieces add up to the count of the whole. Pieces are gathered into batches of about
the same number of UTF-8 bytes, whatever the number of texts, so memory in a task does not
depend on how long texts are.

Where a text may be split depends on the tokenizer:

- any: at a blank between two ASCII letters (`blank_place`);
- byte-level BPE with the usual word pattern: where a letter or digit ends and a blank, a
  line break or punctuation begins, as no word of the pattern holds both (`word_place`);
- sentencepiece: besides, between any two characters that stand side by side in no piece
  of the vocabulary, since then no piece can hold the place (`PiecePlaces`). This also cuts
  text without blanks, such as Japanese or tables of numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

# A blank between two ASCII letters. Byte-level BPE ends its word there, and in a
# sentencepiece model whose pieces hold the blank mark in front only, no piece crosses it.
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
# The end of a run of letters or digits before a character that the word pattern of
# byte-level BPE never joins to what stands in front of it.
WORD_END = re.compile(r"(?<=[^\W_])(?=[ \n,.;:()\[\]{}、。，！？])")

# The first safe place at or after a position, or None.
Place = Callable[[str, int], "int | None"]


def blank_place(text: str, at: int) -> int | None:
    found = SAFE.search(text, at)
    return found.start() if found else None


def word_place(text: str, at: int) -> int | None:
    found = WORD_END.search(text, at)
    return found.start() if found else None


def json_place(path: str) -> Place:
    """The widest rule that holds for a `.json` file of tokenizers."""
    with open(path, encoding="utf-8") as file:
        before = json.load(file).get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True)
    return word_place if plain and not before.get("add_prefix_space") else blank_place


def safe_cut(text: str, limit: int = PIECE_CHARS, place: Place = blank_place) -> list[str]:
    """Pieces of about limit characters, whose parts add up to the text.

    A stretch without a safe place stays in one piece, however long it is.
    """
    pieces, start = [], 0
    while len(text) - start > limit:
        found = place(text, start + limit)
        if found is None:
            break
        pieces.append(text[start:found])
        start = found
    pieces.append(text[start:])
    return pieces


class Counter(NamedTuple):
    """The number of tokens of each piece, given whether it continues a text, and where
    texts may be cut."""

    count: Callable[[list[str], list[bool]], list[int]]
    place: Place


class PiecePlaces:
    """Safe places of a sentencepiece model.

    A place is safe if its two characters stand side by side in no piece, one of them is a
    piece itself (two unknown characters could become one token), normalisation leaves
    them as they are, and the blank mark that the model puts in front of the later part
    stays a token of its own, which is then taken off.
    """

    MARK = "\u2581"

    def __init__(self, model) -> None:
        self.model = model
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.joined = {a + b for p in pieces for a, b in zip(p, p[1:])}
        self.known: dict[str, bool] = {}

    def _safe(self, pair: str) -> bool:
        a, b = pair
        if a.isspace() or b.isspace() and b != "\n" or pair in self.joined:
            return False
        known = any(self.model.piece_to_id(c) != self.model.unk_id() for c in pair)
        alone = self.MARK + b not in self.joined
        return known and alone and self.model.normalize(pair).lstrip(self.MARK) == pair

    def __call__(self, text: str, at: int) -> int | None:
        blank = blank_place(text, at)
        for i in range(at, len(text) if blank is None else blank):
            pair = text[i - 1 : i + 1]
            safe = self.known.get(pair)
            if safe is None:
                safe = self.known[pair] = self._safe(pair)
            if safe:
                return i
        return blank


def sentencepiece_counter(path: str) -> Counter:
    """Counts as sentencepiece gives them, without begin and end marks.

    The model puts a blank in front of each text itself, so a later piece is encoded
    without its own, or, where it has none, counts one token less.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(pieces: list[str], later: list[bool]) -> list[int]:
        own_blank = [cut and p.startswith(" ") for p, cut in zip(pieces, later)]
        texts = [p[1:] if blank else p for p, blank in zip(pieces, own_blank)]
        added = [cut and not blank for cut, blank in zip(later, own_blank)]
        found = model.encode(texts, num_threads=1)
        return [len(ids) - mark for ids, mark in zip(found, added)]

    return Counter(count, PiecePlaces(model))


def tokenizers_counter(path: str) -> Counter:
    """Counts as tokenizers gives them, without added special tokens."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def count(pieces: list[str], later: list[bool]) -> list[int]:
        return [len(e.ids) for e in model.encode_batch(pieces, add_special_tokens=False)]

    return Counter(count, json_place(path))


def counter_for(path: str) -> Counter:
    return sentencepiece_counter(path) if path.endswith(".model") else tokenizers_counter(path)


def utf8_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _lengths(texts: pa.Array, counter: Counter, batch_bytes: int, piece_chars: int) -> list[int]:
    totals = [0] * len(texts)
    owners: list[int] = []
    pieces: list[str] = []
    later: list[bool] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            for owner, n in zip(owners, counter.count(pieces, later)):
                totals[owner] += n
        owners.clear(), pieces.clear(), later.clear()
        held = 0

    for row, text in enumerate(texts):
        for part, piece in enumerate(safe_cut(text.as_py() or "", piece_chars, counter.place)):
            owners.append(row)
            pieces.append(piece)
            later.append(part > 0)
            held += utf8_bytes(piece)
            if held >= batch_bytes:
                flush()
    flush()
    return totals


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    batch_bytes: int = BATCH_BYTES,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The kept columns with n_bytes (UTF-8) and n_tokens of every whole text.

    path: a `.json` file of tokenizers or a `.model` file of sentencepiece, present on
    every executor. A null text is empty; an empty text has no tokens. Rows stay where
    they are, repeated ones too; an empty table gives no rows.
    """
    source = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = StructType(
        [source.schema[c] for c in keep]
        + [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens = pa.array(_lengths(texts, counter, batch_bytes, piece_chars), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], n_bytes, n_tokens], names=[f.name for f in schema]
            )

    return source.mapInArrow(encode, schema)
