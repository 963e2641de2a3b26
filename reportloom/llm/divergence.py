"""Source divergence audit by Gustavson row accumulation.

Terms are counted per language and source; the terms that enough documents of the language
hold make a term-major index: for each term the sources that have it. A row of the result
belongs to one source. It is accumulated as in Gustavson's product of sparse matrices: the
source's terms are scattered through the index into a dense accumulator with one place per
peer, inside a task, so no pair of postings is ever a row. A task has the index of one bucket
of terms and the rows of up to ROWS sources; accumulators are added up over the buckets.

Most terms are missing from most sources, yet count with a share above zero. Accumulators
start from the value of two sources without any term (the baseline, taken V times), and
postings add what they change: once for the row's own terms, once for the peer's, and once
more, as a correction of both, for those they share.

Shares and values are whole numbers; sums of them are exact. Buckets of a language hold at
least as many postings as a dense table of its peers has places, so accumulators never
outgrow the index. The number of sources of a language bounds the length of a posting list.

Null texts, languages and sources count as empty. Rows are not identified: repeated rows are
documents of their own; other columns do not matter; an empty table gives no rows. Ties in
value are broken by the item's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm import word_bytes
from reportloom.llm.common import stored

# Bytes that end a term, all ASCII characters but letters.
BLANKS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
KINDS = word_bytes.byte_kinds(BLANKS)

SHARE = 1_000_000_000
ROWS = 256
# Postings of a bucket, and of a stretch of it that is worked on at once.
BUCKET = 1 << 18
STRETCH = 1 << 17
# A task holds about so many counted terms before it hands them on.
HELD = 1 << 20

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _summed(held: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False)
    table = table.aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, pre-aggregated in tasks."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    texts = df.select(*(c.alias(a) for c, a in zip(names, ("lang", "source", "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in counted(batches):
            held.append(part)
            if sum(map(len, held)) > HELD:
                held = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(1 << 17)
        if held:
            yield from _summed(held).to_batches(1 << 17)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            # Rows of one language and source get one number.
            numbers: dict[tuple[str, str], int] = {}
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            group = np.array([numbers.setdefault(p, len(numbers)) for p in pairs], np.int64)
            names = list(numbers)
            for block in word_bytes.blocks(batch.column(2), KINDS, lower=True):
                if not len(block.ids):
                    continue
                # Once per document and term, then once per group and term.
                key, n = np.unique((block.row << 32) | block.ids, return_counts=True)
                key, each = (group[key >> 32] << 32) | (key & 0xFFFFFFFF), n
                order = np.argsort(key, kind="stable")
                key, each = key[order], each[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                count, docs = np.add.reduceat(each, first), np.diff(np.append(first, len(key)))
                of = pa.array(key[first] >> 32)
                words = pa.array(block.words, pa.binary()).cast(pa.string())
                yield pa.Table.from_arrays(
                    [
                        pa.array([n[0] for n in names], pa.string()).take(of),
                        pa.array([n[1] for n in names], pa.string()).take(of),
                        words.take(pa.array(key[first] & 0xFFFFFFFF)),
                        pa.array(count, pa.int64()),
                        pa.array(docs, pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return (
        texts.mapInArrow(run, COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SHARE * (count + 1) / (total + terms)), exactly; 0 if there is nothing to share."""
    over = (total + terms).cast("decimal(20, 0)")
    whole = F.lit(SHARE).cast("decimal(10, 0)") * (count + 1).cast("decimal(20, 0)")
    return F.when(total + terms == 0, F.lit(0).cast("long")).otherwise(
        1 + F.call_function("div", whole, over)
    )


def _value(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / q). Shares are at most SHARE + 1, so the square fits 64 bits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Rows:
    """The accumulators of up to ROWS sources of one language, over a bucket of terms."""

    def __init__(self, first: int, most: int, empty: np.ndarray):
        self.first, self.empty = first, empty
        self.n = min(most, len(empty) - first)
        self.sums = np.zeros((self.n, len(empty)), np.int64)

    def add(self, term: np.ndarray, peer: np.ndarray, share: np.ndarray) -> None:
        """Postings of whole terms, in the order of terms."""
        if not len(peer):
            return
        # The same share of the same source changes the baseline alike, whatever the term.
        order = np.lexsort((share, peer))
        new = np.ones(len(order), bool)
        new[1:] = (peer[order][1:] != peer[order][:-1]) | (share[order][1:] != share[order][:-1])
        first = np.flatnonzero(new)
        kinds = peer[order][first], share[order][first], np.diff(np.append(first, len(order)))
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        size = np.diff(np.append(start, len(term)))
        of_term = np.repeat(np.arange(len(start)), size)
        by_peer = np.argsort(peer, kind="stable")
        bounds = np.searchsorted(peer[by_peer], np.arange(self.first, self.first + self.n + 1))
        own_kinds = np.searchsorted(kinds[0], np.arange(self.first, self.first + self.n + 1))
        for i in range(self.n):
            mine, sums = self.empty[self.first + i], self.sums[i]
            none = _values(mine, self.empty)
            np.add.at(sums, kinds[0], kinds[2] * (_values(mine, kinds[1]) - none[kinds[0]]))
            for k in range(own_kinds[i], own_kinds[i + 1]):
                sums += kinds[2][k] * (_values(kinds[1][k], self.empty) - none)
            rows = by_peer[bounds[i] : bounds[i + 1]]
            if len(rows):
                # Through the index: all postings of each term of this source.
                n = size[of_term[rows]]
                own = np.repeat(share[rows], n)
                at = np.repeat(start[of_term[rows]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                h, q = peer[at], share[at]
                both = _values(own, q) - _values(mine, q) - _values(own, self.empty[h]) + none[h]
                np.add.at(sums, h, both)


def accumulated(postings: DataFrame, headers: DataFrame) -> DataFrame:
    """lang, peer, sums: accumulators by bucket, without the baseline.

    postings: lang, rows, bucket, part, term, peer, share; headers: lang, rows, bucket, part
    (their number) and empty, the shares that the peers give a term they lack, in their
    order. Stretches of postings are cut between terms, so memory depends on the number of
    peers only.

    Rows of a task are sorted by one number, that of their part above a hash of their term,
    which settles nearly all comparisons. A header has no hash and comes first in its part.
    """
    keys = ["lang", "rows", "bucket"]
    both = headers.select(
        *keys, F.lit(None).cast("string").alias("term"), F.lit(-1).alias("peer"),
        F.lit(0).cast("long").alias("share"), "empty", F.shiftleft("part", 32).alias("place"),
    ).unionByName(
        postings.select(
            *keys, "term", "peer", "share", F.lit(None).cast("array<bigint>").alias("empty"),
            F.shiftleft("part", 32).bitwiseOR(1 + F.pmod(F.xxhash64("term"), F.lit((1 << 32) - 1))).alias("place"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, lang, held, n_held = None, None, [], 0

        def flush(last: bool):
            """Adds what is held; the last term may go on and stays unless it has ended."""
            nonlocal held, n_held
            if not held:
                return
            term = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
            term = term.indices.to_numpy(zero_copy_only=False)
            peer = np.concatenate([h[1] for h in held])
            share = np.concatenate([h[2] for h in held])
            done = len(term) if last else int(np.searchsorted(term, term[-1]))
            rows.add(term[:done], peer[:done], share[:done])
            names = pa.chunked_array([h[0] for h in held]).combine_chunks()
            held = [] if last else [(names[done:], peer[done:], share[done:])]
            n_held = len(peer) - done

        def out():
            flush(last=True)
            for at in range(rows.n):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang]),
                        pa.array([rows.first + at], pa.int32()),
                        pa.array([rows.sums[at]], pa.list_(pa.int64())),
                    ],
                    names=["lang", "peer", "sums"],
                )

        for batch in batches:
            head = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False) < 0)
            peer = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            share = batch.column(5).to_numpy(zero_copy_only=False)
            cuts = [*head.tolist(), len(peer)]
            for low, high in zip([0, *head.tolist()], cuts):
                if low < high and peer[low] < 0:
                    if rows is not None:
                        yield from out()
                    lang = batch.column(0)[low].as_py()
                    empty = np.array(batch.column(6)[low].as_py(), np.int64)
                    rows = _Rows(batch.column(1)[low].as_py() * ROWS, ROWS, empty)
                    low += 1
                for at in range(low, high, STRETCH):
                    part = slice(at, min(high, at + STRETCH))
                    held.append((batch.column(3)[part], peer[part], share[part]))
                    n_held += part.stop - part.start
                    if n_held >= STRETCH:
                        flush(last=False)
        if rows is not None:
            yield from out()

    n = headers.select(F.count(F.lit(1))).first()[0]
    return (
        both.repartition(max(1, n), *keys)
        .sortWithinPartitions("place", "term")
        .drop("place")
        .mapInArrow(run, "lang string, peer int, sums array<bigint>")
    )


def divergence(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = 3, top: int = 200,
) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ in their terms.

    Part `pair` compares a source with each other one of its language, part `term` names the
    terms that it has more often than its language.
    """
    counts = stored(term_counts(df, text, lang, source), "counted-terms")
    known = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stored(counts.join(known.drop("docs"), ["lang", "term"]).select("lang", "term", "source", "n"), "terms")

    groups = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    ).distinct()
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("all")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total")
    )
    of_source = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("postings")
    )
    zero = {"terms": 0, "lang_total": 0, "total": 0, "postings": 0}
    sources = (
        groups.join(of_source, ["lang", "source"], "left")
        .join(of_lang, ["lang"], "left")
        .fillna(zero)
        .withColumn("peer", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("empty", _share(F.lit(0), F.col("total"), F.col("terms")))
    )
    sources = stored(sources, "sources")

    shares = kept.join(sources, ["lang", "source"]).withColumn(
        "share", _share(F.col("n"), F.col("total"), F.col("terms"))
    )
    return pairs(shares, sources).unionByName(terms(shares, kept, top))


def pairs(shares: DataFrame, sources: DataFrame) -> DataFrame:
    size = F.count(F.lit(1))
    langs = sources.groupBy("lang").agg(
        size.alias("peers"),
        # A bucket has at least as many postings as a table of all peers has places.
        F.ceil(F.sum("postings") / F.greatest(F.lit(BUCKET), size * size)).alias("buckets"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("peer", "empty"))), lambda s: s["empty"]
        ).alias("empty"),
    ).withColumn("buckets", F.greatest(F.lit(1), F.col("buckets")).cast("int"))
    n_blocks = F.floor((F.col("peers") - 1) / ROWS).cast("long") + 1
    # Languages are few; each takes as many numbers as it has blocks of rows and buckets.
    earlier = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    langs = langs.withColumn(
        "first_part", F.coalesce(F.sum(n_blocks * F.col("buckets")).over(earlier), F.lit(0))
    )
    block = F.sequence(F.lit(0), (n_blocks - 1).cast("int"))
    part = F.col("first_part") + F.col("rows").cast("long") * F.col("buckets") + F.col("bucket")
    headers = (
        langs.where("peers > 1")
        .withColumn("rows", F.explode(block))
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        .select("lang", "rows", "bucket", part.alias("part"), "empty")
    )
    postings = (
        shares.join(langs.where("peers > 1").select("lang", "peers", "buckets", "first_part"), "lang")
        .withColumn("rows", F.explode(block))
        .withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
        .select("lang", "rows", "bucket", part.alias("part"), "term", "peer", "share")
    )
    summed = (
        accumulated(postings, headers)
        .select("lang", "peer", F.posexplode("sums").alias("other", "changed"))
        .groupBy("lang", "peer", "other")
        .agg(F.sum(F.col("changed").cast("decimal(38, 0)")).alias("changed"))
    )
    row = sources.select("lang", "source", "peer", F.col("empty").alias("p"))
    column = sources.select("lang", F.col("source").alias("item"), F.col("peer").alias("other"), F.col("empty").alias("q"), "terms")
    base = F.when(F.col("terms") == 0, F.lit(0)).otherwise(
        F.col("terms").cast("decimal(20, 0)") * _value("p", "q").cast("decimal(18, 0)")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return (
        summed.where("peer <> other")
        .join(row, ["lang", "peer"])
        .join(column, ["lang", "other"])
        .withColumn("value", (F.col("changed") + base).cast("long"))
        .withColumn("rank", F.row_number().over(best))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )


def terms(shares: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return (
        shares.join(of_lang, ["lang", "term"])
        .withColumn("q", _share(F.col("all"), F.col("lang_total"), F.col("terms")))
        .where("share > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                _value("share", "q").alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
