"""Phrase collocations by top-order marginalisation.

Every word starts one longest window: itself and the words that lead it, up to the end of
its piece, padded behind. Only these windows are counted. Spark's ROLLUP over the window's
columns then sums them into the counts of all shorter phrases, because a phrase occurs as
often as it begins a window; there is no explosion of 1-, 2-, 3- and 4-grams.

Windows are padded early, where a sieve proves the words up to there to be rarer than
`least` together. A sieve counts hashes of HASH_BITS bits and keeps a bit per slot for the frequent
ones, in a table of 2 ** SIEVE_BITS bits whatever the size of the corpus. A slot that several
share only keeps windows longer than needed. The first sieve is for words and pairs, the
second for three and four words whose pairs pass the first. A frequent phrase passes with all
its beginnings, so its count stays exact; counts below `least` are not used.

Null texts count as empty, null languages as `und`. Rows are not identified, so repeated
rows count as often as they stand there, and other columns do not matter. A table without
phrases gives no rows. Ties in the score are broken by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm import word_bytes
from reportloom.llm.common import stored

# What separates words, and what ends a piece.
BLANKS = b" \t"
ENDS = b".,;:!?\n\x0b\x0c\r"

ORDER = 4
HASH_BITS = 40
SIEVE_BITS = 26
# A task holds about so many different hashes before it hands their counts on.
HELD = 1 << 20
BLOCK_BYTES = 2 << 20
# Stands between the words of a window; no word has it.
GLUE = "\t"

WINDOW = [f"w{i}" for i in range(1, ORDER + 1)]
KINDS = word_bytes.byte_kinds(BLANKS, ENDS)


def _lang_hash(names: list[str]) -> np.ndarray:
    return word_bytes.mixed(word_bytes.hashes([n.encode() for n in names]))


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _joined(block: word_bytes.Block, size: int) -> np.ndarray:
    """Whether so many words from each word on are in one piece."""
    here = np.zeros(len(block.ids), bool)
    n = max(0, len(here) - size + 1)
    here[:n] = block.piece[:n] == block.piece[size - 1 :]
    return here


def _run_hashes(block: word_bytes.Block, lang: np.ndarray, lang_hash: np.ndarray):
    """Hashes of the 1, 2, 3 and 4 words from each word on; without meaning across pieces."""
    base = word_bytes.hashes(block.words)[block.ids] ^ lang_hash[lang[block.row]]
    run, out = base, []
    for lead in range(ORDER):
        if lead:
            follower = np.concatenate((base[lead:], np.zeros(min(lead, len(base)), np.uint64)))
            run = run * np.uint64(0xD6E8FEB86659FD93) + follower
        out.append(word_bytes.mixed(run))
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _pairs_pass(block, runs, first: np.ndarray) -> np.ndarray:
    """Whether each word starts a pair that passes the first sieve."""
    return _joined(block, 2) & _passes(first, runs[1])


def hash_counts(texts: DataFrame, first: bytes | None = None) -> DataFrame:
    """h, n: runs of words by hash, pre-aggregated within tasks.

    Without the first sieve of words and pairs, else of three and four words whose pairs
    pass it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(first)

    def chosen(block, runs) -> np.ndarray:
        if shared.value is None:
            return np.concatenate((runs[0], runs[1][_joined(block, 2)]))
        go = _pairs_pass(block, runs, np.frombuffer(shared.value, np.uint8))
        go = np.concatenate((go, np.zeros(ORDER, bool)))
        n = len(block.ids)
        three = go[:n] & go[1 : n + 1]
        four = three & go[2 : n + 2]
        return np.concatenate((runs[2][three], runs[3][four]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def out(key, count):
            for at in range(0, len(key), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part].view(np.int64)), pa.array(count[part])], names=["h", "n"]
                )

        for batch in batches:
            lang, names = _languages(batch.column(0))
            lang_hash = _lang_hash(names)
            for block in word_bytes.blocks(batch.column(1), KINDS, True, BLOCK_BYTES):
                runs = _run_hashes(block, lang, lang_hash)
                short = chosen(block, runs) >> np.uint64(64 - HASH_BITS)
                key, count = np.unique(short, return_counts=True)
                keys.append(key)
                counts.append(count.astype(np.int64))
                held += len(key)
                if held > HELD:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], len(key)
                    if held > HELD // 2:
                        yield from out(key, count)
                        keys, counts, held = [], [], 0
        if keys:
            yield from out(*_summed(keys, counts))

    return texts.mapInArrow(run, "h bigint, n bigint")


def sieve_of(texts: DataFrame, least: int, first: bytes | None = None) -> bytes:
    """A bit per slot of hashes: whether a run of words in it occurs at least so often.

    At most 2 ** SIEVE_BITS bits reach the driver.
    """
    counted = hash_counts(texts, first).groupBy("h").agg(F.sum("n").alias("n"))
    slot = F.shiftrightunsigned("h", HASH_BITS - SIEVE_BITS) + 1
    parts = (
        counted.where(F.col("n") >= least)
        .groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    sieve = bytearray(1 << (SIEVE_BITS - 3))
    for bucket, bits in parts:
        at = (bucket - 1) * len(bits)
        sieve[at : at + len(bits)] = bits
    return bytes(sieve)


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - SIEVE_BITS)
    return (sieve[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _windows(block, lang, lang_hash, first, second):
    """Different windows of a block as columns of word numbers (-1: padded), and their counts."""
    runs = _run_hashes(block, lang, lang_hash)
    n = len(block.ids)
    ids = np.concatenate((block.ids, np.full(ORDER, -1)))
    here, columns = _passes(first, runs[0]), [lang[block.row]]
    for lead in range(ORDER):
        if lead == 1:
            here = here & _pairs_pass(block, runs, first)
        elif lead:
            here = here & _joined(block, lead + 1) & _passes(second, runs[lead])
        columns.append(np.where(here, ids[lead : lead + n], -1))
    keys = [c + 1 for c in columns]
    packed = (keys[0] << 32) | keys[1], (keys[2] << 32) | keys[3], keys[4]
    order = np.lexsort(packed[::-1])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in packed:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.diff(np.append(at, n))


def longest_windows(texts: DataFrame, first: bytes, second: bytes) -> DataFrame:
    """lang, window, n: padded longest windows, pre-aggregated within blocks.

    A window is its four words between GLUE; a padded place is the empty string, which no
    word is.
    """
    shared = texts.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [np.frombuffer(sieve, np.uint8) for sieve in shared.value]
        for batch in batches:
            lang, names = _languages(batch.column(0))
            lang_hash = _lang_hash(names)
            for block in word_bytes.blocks(batch.column(1), KINDS, True, BLOCK_BYTES):
                if not len(block.ids):
                    continue
                columns, count = _windows(block, lang, lang_hash, *sieves)
                words = pa.array([*block.words, b""], pa.binary()).cast(pa.string())
                places = [words.take(pa.array(c % len(words))) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.string()).take(pa.array(columns[0])),
                        pc.binary_join_element_wise(*places, GLUE),
                        pa.array(count, pa.int64()),
                    ],
                    names=["lang", "window", "n"],
                )

    return texts.mapInArrow(run, "lang string, window string, n bigint")


def phrase_counts(df: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """lang, order, phrase, f: phrases of up to 4 words that occur least times or more.

    The row of order 0 has the number of all words of the language.
    """
    texts = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    first = sieve_of(texts, least)
    windows = longest_windows(texts, first, sieve_of(texts, least, first))
    place = F.split("window", GLUE, -1)
    counted = (
        windows.groupBy("lang", "window")
        .agg(F.sum("n").alias("n"))
        .select("lang", *[place[i].alias(name) for i, name in enumerate(WINDOW)], "n")
    )
    rolled = counted.rollup("lang", *WINDOW).agg(
        F.sum("n").alias("f"), F.grouping_id().alias("level")
    )
    # Bits of the level tell which columns are summed over, the last column lowest.
    order = ORDER - F.bit_count(F.col("level"))
    last = F.element_at(F.array(F.lit("x"), *WINDOW), (order + 1).cast("int"))
    return rolled.where(order >= 0).where((last != "") & ((F.col("f") >= least) | (order == 0))).select(
        "lang", order.cast("int").alias("order"), F.concat_ws(" ", *WINDOW).alias("phrase"), "f"
    )


def _part(start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates with the counts of the two parts of their lowest-scoring cut."""
    parts = counts.where("order > 0").select("lang", "phrase", "f")
    cut = F.col("cut")
    cuts = (
        counts.where("order > 1")
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("order") - 1)))
        .select(
            "lang", "phrase", "order", F.col("f").alias("a"), "cut",
            _part(1, cut).alias("left"), _part(cut + 1, F.col("order") - cut).alias("right"),
        )
    )
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # Decimals of 38 digits, since the product may pass 64 bits.
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    return (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .withColumn("score", score)
        .groupBy("lang", "phrase", "order", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("lowest"))
        .select("lang", "phrase", "order", "a", "lowest.l", "lowest.r", "lowest.score")
    )


def without_contained(candidates: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Candidates but those that a longer one contains and nearly always comes with."""
    size, start = F.col("size"), F.col("start")
    inside = (
        counts.where("order > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("order") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("order") - size + 1)))
        .groupBy("lang", _part(start, size).alias("phrase"))
        .agg(F.max("f").alias("longest"))
    )
    joined = candidates.join(inside, ["lang", "phrase"], "left")
    return joined.where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * percent))


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang",
    least: int = 30, percent: int = 80, top: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best-bound phrases of each language."""
    counts = stored(phrase_counts(df, text, lang, least), "phrases")
    total = counts.where("order = 0").select("lang", F.col("f").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (
        without_contained(scored(counts), counts, percent)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
