"""Packing: documents become token pieces in sequences of several lengths.

1. Routing. A document longer than the longest window is cut into full windows. What is
   left goes to the smallest tier (1024, 512, 256, 128) that holds it.
2. Tiers. The pieces of the long tier open one window each. Its gap takes the longest
   shorter pieces that fit, one after the other, without cutting any.
3. Gaps. Where nothing fits any more, a shorter piece is cut to fill the window.
4. Shorter tiers, longest first, are packed the same way into windows of their own
   length, which need no padding as it is a power of two.
5. Step groups. Windows of one tier are numbered over all tasks, by their number within
   the task and the number of windows in the tasks before, and as many as make up
   step_tokens form a step group. So every step but the last of a tier has the same number
   of tokens, and all have one shape.

A task packs the rows it reads, block by block, with the pieces of a block in memory.
Windows that a block leaves open are filled by the next one, so a task ends with one
padded sequence at most. The pieces are stored once, and only their counts by task and
tier are shuffled. Sequence numbers hold the task's number.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from reportloom.llm.common import stored
from reportloom.llm.token_counts import PIECE_CHARS, Place, safe_cut, word_place

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 8 * 1024
BLOCK_TOKENS = 1 << 20
# Numbers of the sequences of one task.
TASK_SHIFT = 33
# Texts of these characters alone are read alike by both libraries for byte-level BPE.
PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ɏ]*")

Encoder = Callable[[str], list[int]]


def byte_bpe_encoder(path: str, ranks_path: str | None = None, pattern: str = "") -> Encoder:
    """Ids as tokenizers gives them for a `.json` file, without added special tokens.

    With ranks_path, the same vocabulary as a tiktoken file, texts of plain characters are
    encoded by that library, which is about three times as fast and gives the same ids;
    all other texts still go to tokenizers.
    """
    import base64

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def exact(text: str) -> list[int]:
        return model.encode(text, add_special_tokens=False).ids

    if not ranks_path:
        return exact
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {
        token.content: i
        for i, token in model.get_added_tokens_decoder().items()
        if token.special and not (token.lstrip or token.rstrip or token.single_word)
    }
    if len(special) != len(model.get_added_tokens_decoder()):
        return exact
    fast = tiktoken.Encoding(
        "plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special
    )

    def encode(text: str) -> list[int]:
        if PLAIN.fullmatch(text):
            return fast.encode(text, allowed_special="all")
        return exact(text)

    return encode


class Packer:
    """Packs the pieces of one task."""

    def __init__(self, task: int, tiers: tuple[int, ...]) -> None:
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.task = task
        self.next_sequence = task << TASK_SHIFT
        self.windows_of = dict.fromkeys(self.tiers, 0)
        # Pieces by tier: (ids, document, start, tokens of the document).
        self.waiting: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.out: list[tuple] = []

    def add(self, ids: np.ndarray, document: int) -> None:
        longest, total = self.tiers[0], len(ids)
        full = total - total % longest
        for start in range(0, full, longest):
            self._emit(longest, [(ids[start : start + longest], document, start, total)])
        if full < total:
            self._wait((ids[full:], document, full, total))

    def _wait(self, piece: tuple) -> None:
        tier = min(t for t in self.tiers if t >= len(piece[0]))
        self.waiting[tier].append(piece)

    def _emit(self, tier: int, pieces: list[tuple]) -> None:
        number = self.windows_of[tier]
        self.windows_of[tier] += 1
        offset = 0
        for ids, document, start, total in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.out.append(
                (document, start, len(ids), crc, total, self.next_sequence, offset, tier,
                 self.task, number)
            )
            offset += len(ids)
        self.next_sequence += 1

    def settle(self) -> None:
        """Packs what waits; what cannot fill a window goes on waiting."""
        for tier in self.tiers:
            shorter = sorted(
                (p for t in self.tiers if t < tier for p in self.waiting[t]),
                key=lambda p: len(p[0]),
            )
            sizes = [len(p[0]) for p in shorter]
            opened = sorted(self.waiting[tier], key=lambda p: len(p[0]))
            left = []
            while opened:
                window = [opened.pop()]
                gap = tier - len(window[0][0])
                while gap and sizes:
                    at = bisect_right(sizes, gap) - 1
                    if at >= 0:
                        piece = shorter.pop(at)
                        sizes.pop(at)
                    else:
                        piece, rest = self._cut(shorter.pop(0), gap)
                        sizes.pop(0)
                        at = bisect_right(sizes, len(rest[0]))
                        shorter.insert(at, rest)
                        sizes.insert(at, len(rest[0]))
                    window.append(piece)
                    gap -= len(piece[0])
                while gap and opened:
                    # Only long pieces are left: the next one is cut to fill this window.
                    piece, rest = self._cut(opened.pop(0), gap)
                    window.append(piece)
                    gap -= len(piece[0])
                    if rest is not None:
                        at = bisect_right([len(p[0]) for p in opened], len(rest[0]))
                        opened.insert(at, rest)
                if gap:
                    left += window
                else:
                    self._emit(tier, window)
            for t in self.tiers:
                if t <= tier:
                    self.waiting[t] = []
            for piece in [*left, *shorter]:
                self._wait(piece)

    @staticmethod
    def _cut(piece: tuple, gap: int) -> tuple[tuple, tuple | None]:
        ids, document, start, total = piece
        if len(ids) <= gap:
            return piece, None
        return (ids[:gap], document, start, total), (ids[gap:], document, start + gap, total)

    def finish(self) -> None:
        """The pieces that are left, fewer tokens than a short window, share one sequence."""
        self.settle()
        rest = [p for t in self.tiers for p in self.waiting[t]]
        self.waiting = {t: [] for t in self.tiers}
        longest, window, room = self.tiers[0], [], self.tiers[0]
        while rest:
            piece, after = self._cut(rest.pop(), room)
            window.append(piece)
            room -= len(piece[0])
            if after is not None:
                rest.append(after)
            if not room:
                self._emit(longest, window)
                window, room = [], longest
        if window:
            self._emit(longest, window)


SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier bigint, __task bigint, __window bigint"
)


def pack(
    df: DataFrame,
    encoder: Callable[[], Encoder],
    end_id: int = 0,
    document: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    place: Place = word_place,
) -> DataFrame:
    """One row per piece: document, start and length in its tokens, the CRC-32 of its ids,
    the document's tokens, sequence, offset there, tier and step group.

    encoder: called in each task, gives the function from a text to its ids; place finds
    where it lets a long text be cut (the default suits byte-level BPE). Each document
    is followed by end_id, so an empty or null text is one token. Repeated rows are packed
    each for itself, a null document number stays null. An empty table gives no rows.
    """
    source = df.select(
        F.col(document).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t")
    )
    id_type = source.schema["__id"].dataType.simpleString()
    schema = f"`{document}` {id_type}, {SCHEMA}"
    names = [document, *(c.split()[0] for c in SCHEMA.split(", "))]
    ends = np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer(TaskContext.get().partitionId(), tiers)
        id_arrow = None

        def produced() -> pa.RecordBatch:
            columns = list(zip(*packer.out))
            packer.out = []
            arrays = [pa.array(columns[0], id_arrow)]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        held = 0
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for number, text_value in zip(batch.column(0), batch.column(1)):
                parts = (np.array(encode(p), np.uint32) for p in safe_cut(text_value.as_py(), PIECE_CHARS, place))
                ids = np.concatenate([*parts, ends])
                packer.add(ids, number.as_py())
                held += len(ids)
                if held >= block_tokens:
                    packer.settle()
                    held = 0
                if len(packer.out) >= 10_000:
                    yield produced()
        packer.finish()
        if packer.out:
            yield produced()

    return with_step_groups(stored(source.mapInArrow(run, schema), "packed"), step_tokens)


def with_step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Pieces with step_group (`tier-number`) in place of their task and window there."""
    counts = pieces.groupBy("__task", "tier").agg((F.max("__window") + 1).alias("__n"))
    before = Window.partitionBy("tier").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "__task", "tier", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    number = F.col("__first") + F.col("__window")
    step = F.floor(number / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier"))))
    group = F.concat_ws("-", F.col("tier").cast("string"), step.cast("string"))
    return (
        pieces.join(firsts, ["__task", "tier"])
        .withColumn("step_group", group)
        .select(*[c for c in pieces.columns if not c.startswith("__")], "step_group")
    )
