"""Near-duplicates by a chosen-path set similarity join.

Texts become sets of word shingles, sets become minwise tokens: at each place of a tree
the text's token is its smallest shingle under the hash function of that place. A tree
sends a text from a node to BRANCHES children, each named by the node and one token, so two
texts go the same way as often as their sets are alike. Paths are worked out text by
text; a node exists only as the rows that share its path. Small nodes are compared
exhaustively, large ones branch again. Independent trees raise the recall: at the threshold
a pair misses a tree with probability q, where q = (1 - s + s q)^BRANCHES, thus all of
them with q^TREES (at 0.8 about 1.5e-5). This holds at any depth, as every node of every
tree has hash functions of its own: those of the first levels are fixed by place, those of
nodes that branch again are drawn from the name of the node.

What keeps hot groups linear:

1. Texts with equal sets are one class, represented by its smallest number.
2. First links are those of every member of a node to its pivot, a star instead of pairs.
3. Members that are linked by then are one component. Only nodes that still hold several
   components are compared further, and only across components; a node branches again if
   that would be many comparisons, whatever its number of members.

Pairs pass a filter on 2-bit sketches of 64 minwise tokens (five standard errors below the
threshold) and sizes. Within nodes they are then held against each other with all elements
of their sets, and a node gives one link for each component that joins another one. All
links are confirmed on the full sets, which tasks build from the texts themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import stored, whole
from reportloom.llm.components import components

SKETCH = 64
# Elements of the sets that a task keeps while it confirms links.
KEPT = 4_000_000


@dataclass(frozen=True)
class Settings:
    words: int = 5
    # Percent of the union.
    least: int = 80
    trees: int = 4
    branches: int = 2
    depth: int = 3
    # Nodes with more comparisons than this branch again, up to deepest more levels. With
    # None all nodes are compared as they are. At the threshold a pair is missed with about
    # 1.2e-5 then, and with 1.5e-5 when its nodes branch three more levels.
    pairs: int | None = 1 << 20
    deepest: int = 3
    # Members of a block when a node is compared exhaustively.
    block: int = 2048
    # Elements of their sets in a block, as far as blocks can be cut.
    elements: int = 1 << 22
    stars: int = 2
    seed: int = 1


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """A hash per word of the text, A-Z lower-cased."""
    words = text.encode().lower().split()
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


class _Hashes(dict):
    """Hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


LOW_BITS = np.uint64(0x5555555555555555)
# Odd multipliers of a 64-bit mixing function.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of the distinct shingles; fewer words are one shingle of all."""
    hashes = word_hashes(text or "", known)
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    rolled = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        rolled = mixed(rolled * np.uint64(31) + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(rolled)


def _multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def minwise(sets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest token of a set under each hash function, in bounded memory.

    Tokens are 32 bits: what counts is which shingle is the smallest.
    """
    return least_tokens((sets >> np.uint64(32)).astype(np.uint32), multipliers)


def least_tokens(short: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The same for a set that is shortened to 32 bits."""
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    step = max(1, (1 << 16) // len(multipliers))
    for i in range(0, len(short), step):
        part = multipliers[:, None] * short[None, i : i + step]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _sketches(tokens: np.ndarray) -> np.ndarray:
    """Two bits of each token of each row, 32 tokens to a 64-bit number."""
    bits = (mixed(tokens) & np.uint64(3)).reshape(len(tokens), SKETCH // 32, 32)
    shifts = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_or.reduce(bits << shifts, axis=2).view(np.int64)


def _paths(tokens: np.ndarray, settings: Settings) -> np.ndarray:
    """The nodes of each row at the first depth, one per tree and way down it.

    Every way out of a node of a tree has a hash function of its own.
    """
    nodes = []
    place = 0
    for tree in range(settings.trees):
        level = np.full((len(tokens), 1), tree + 1, np.uint64)
        for _ in range(settings.depth):
            ways = level.shape[1] * settings.branches
            level = mixed(
                mixed(np.repeat(level, settings.branches, axis=1)) + tokens[:, place : place + ways]
            )
            place += ways
        nodes.append(level)
    return np.concatenate(nodes, axis=1).view(np.int64)


def functions_needed(settings: Settings) -> int:
    """One for each way out of each inner node of the trees, and those of the sketch."""
    ways = sum(settings.branches ** (d + 1) for d in range(settings.depth))
    return max(SKETCH, settings.trees * ways)


def _lists(values: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list array, a list per row."""
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def _children(nodes: np.ndarray, short: np.ndarray, settings: Settings) -> np.ndarray:
    """The nodes below each of the nodes of one set, by hash functions of each node's own."""
    ways = np.arange(1, settings.branches + 1, dtype=np.uint64)
    names = mixed(mixed(nodes)[:, None] + ways).ravel()
    multipliers = (names >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return mixed(names + least_tokens(short, multipliers))


SUMMARY = "n_shingles bigint, digest binary, sketch array<bigint>, nodes array<bigint>"


def summarise(df: DataFrame, document: str, text: str, settings: Settings) -> DataFrame:
    """Per row: __id, n_shingles, digest of the set, sketch and first nodes.

    An empty set has no digest.
    """
    source = df.select(F.col(document).alias("__id"), whole(F.col(text)).alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        functions = _multipliers(settings.seed, functions_needed(settings))
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            digests: list[bytes | None] = [None] * batch.num_rows
            tokens = np.zeros((batch.num_rows, len(functions)), np.uint64)
            for row, value in enumerate(batch.column(1)):
                found = shingles(value.as_py(), settings.words, known)
                if len(found):
                    sizes[row] = len(found)
                    digests[row] = xxhash.xxh3_128_digest(found.tobytes())
                    tokens[row] = minwise(found, functions)
            lists = (_sketches(tokens[:, :SKETCH]), _paths(tokens, settings))
            columns = [pa.array(sizes), pa.array(digests, pa.binary())]
            columns += [_lists(values) for values in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                names=["__id", "n_shingles", "digest", "sketch", "nodes"],
            )

    return source.mapInArrow(run, f"__id {id_type}, {SUMMARY}")


def _alike(a: str, b: str, settings: Settings) -> Column:
    """Whether sizes and sketches of two representatives allow the threshold."""
    odd_bits = F.lit(0x5555555555555555)
    differing = F.lit(0)
    for i in range(SKETCH // 32):
        x = F.get(F.col(f"{a}.sketch"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.sketch"), F.lit(i)))
        differing = differing + F.bit_count(
            x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd_bits)
        )
    n_a, n_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * settings.least
    return sizes & (differing <= F.lit(_most_differing(settings)))


def _most_differing(settings: Settings) -> int:
    """Tokens that may differ in a sketch: five standard errors more than at the threshold."""
    share = settings.least / 100
    agree = share + (1 - share) / 4
    slack = 5 * (agree * (1 - agree) / SKETCH) ** 0.5
    return int(SKETCH * (1 - agree + slack)) + 1


def _confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs a, b of representatives whose full sets reach the threshold.

    The text of b goes to that of a, which many pairs may share; a join splits such a hot
    text, and a task keeps the sets that it has built last.
    """
    one = texts.select(F.col("__id").alias("a"), F.col("__text").alias("text_a"))
    other = texts.select(F.col("__id").alias("b"), F.col("__text").alias("text_b"))
    joined = pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        sets: dict[object, np.ndarray] = {}
        held = 0

        def set_of(number: object, text: pa.Scalar) -> np.ndarray:
            """The set of a text, kept until all that are kept have KEPT elements."""
            nonlocal held
            if number not in sets:
                if held > KEPT:
                    sets.clear()
                    held = 0
                sets[number] = shingles(text.as_py(), settings.words, known)
                held += len(sets[number])
            return sets[number]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(*batch.columns):
                left, right = set_of(a.as_py(), text_a), set_of(b.as_py(), text_b)
                same = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * same >= settings.least * (len(left) + len(right) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    schema = joined.select("a", "b").schema
    return joined.mapInArrow(run, schema)


def _candidates(pairs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """The distinct pairs that pass the filter on sizes and sketches."""
    facts = F.struct("n_shingles", "sketch")
    left = reps.select(F.col("rep").alias("a"), facts.alias("x"))
    right = reps.select(F.col("rep").alias("b"), facts.alias("y"))
    return (
        pairs.distinct()
        .join(left, "a")
        .join(right, "b")
        .where(_alike("x", "y", settings))
        .select("a", "b")
    )


def _mixed_nodes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their label, of the nodes that hold several labels.

    A member without label is its own component. lo is the smallest label of the node,
    size the number of members, and cross the number of pairs with different labels.
    """
    labelled = members.join(labels, "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    per_label = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    several = (
        per_label.groupBy("node")
        .agg(
            F.min("label").alias("lo"),
            F.count(F.lit(1)).alias("n_labels"),
            F.sum("n").alias("size"),
            F.sum(F.col("n") * F.col("n")).alias("same"),
        )
        .where("n_labels > 1")
        .select("node", "lo", "size", ((F.col("size") * F.col("size") - F.col("same")) / 2).alias("cross"))
    )
    return labelled.select("node", "rep", "label").join(several, "node")


def _stars(mixed_members: DataFrame) -> DataFrame:
    """Pairs of each node's pivot and every member of another label.

    The pivot is the smallest member of the smallest label.
    """
    pivots = (
        mixed_members.where(F.col("label") == F.col("lo"))
        .groupBy("node")
        .agg(F.min("rep").alias("a"))
    )
    return (
        mixed_members.where(F.col("label") != F.col("lo"))
        .join(pivots, "node")
        .select("a", F.col("rep").alias("b"))
    )


def _branched(large: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The members of large nodes in their children at the next level.

    Each text is taken once, with all its large nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = [
                _children(
                    np.array(nodes.as_py(), np.int64).view(np.uint64),
                    (np.frombuffer(held.as_buffer(), "<u8") >> np.uint64(32)).astype(np.uint32),
                    settings,
                ).view(np.int64)
                for nodes, held in zip(batch.column(1), batch.column(2))
            ]
            if below:
                reps = batch.column(0).take(pa.array(np.repeat(np.arange(len(below)), [*map(len, below)])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(below)), reps], names=["node", "rep"]
                )

    id_type = large.schema["rep"].dataType.simpleString()
    per_text = large.groupBy("rep").agg(F.collect_set("node").alias("nodes"))
    return per_text.join(sets, "rep").select("rep", "nodes", "elements").mapInArrow(
        run, f"node bigint, rep {id_type}"
    )


def _whole_sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """rep and elements, the 64-bit elements of its set, sorted.

    Links within nodes are decided on these, as the final check is: what is merged there is
    linked, and no link is missed because elements were shortened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = (shingles(t.as_py(), settings.words, known) for t in batch.column(1))
            elements = pa.array([x.astype("<u8").tobytes() for x in found], pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), elements.cast(pa.binary())], names=["rep", "elements"]
            )

    id_type = texts.schema["__id"].dataType.simpleString()
    return texts.select("__id", "__text").mapInArrow(run, f"rep {id_type}, elements binary")


class _Block:
    """The members of one node that are compared with each other."""

    def __init__(self, part: pa.Table, settings: Settings) -> None:
        self.settings = settings
        self.i, self.j = part["i"][0].as_py(), part["j"][0].as_py()
        self.block = part["block"].to_numpy()
        self.numbers = part["rep"].to_numpy()
        # Components that are linked within the node become one.
        _, self.group = np.unique(part["label"].to_numpy(), return_inverse=True)
        self.sketch = np.array(part["sketch"].to_pylist(), np.int64).view(np.uint64)
        elements = [np.frombuffer(v.as_buffer(), "<u8") for v in part["elements"]]
        self.size = np.array([len(e) for e in elements])
        self.ends = np.cumsum(self.size)
        vocabulary, self.ids = np.unique(np.concatenate(elements), return_inverse=True)
        self.marked = np.zeros(len(vocabulary), np.int32)

    def _near(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of y whose component is not that of x and that may be linked with it."""
        y = y[self.group[y] != self.group[x]]
        least, larger = np.minimum(self.size[y], self.size[x]), np.maximum(self.size[y], self.size[x])
        y = y[least * 100 >= larger * self.settings.least]
        diff = self.sketch[y] ^ self.sketch[x]
        far = np.bitwise_count((diff | (diff >> np.uint64(1))) & LOW_BITS).sum(axis=1)
        return y[far <= _most_differing(self.settings)]

    def _own(self, x: int) -> np.ndarray:
        return self.ids[self.ends[x] - self.size[x] : self.ends[x]]

    def links(self) -> Iterator[tuple]:
        """One link for each component that joins another."""
        right = np.flatnonzero(self.block == self.j)
        for x in np.flatnonzero(self.block == self.i):
            y = self._near(x, right[right > x] if self.i == self.j else right)
            if not len(y):
                continue
            self.marked[self._own(x)] = 1
            hits = self.marked[np.concatenate([self._own(v) for v in y])]
            starts = np.concatenate([[0], np.cumsum(self.size[y])[:-1]])
            same = np.add.reduceat(hits, starts)
            self.marked[self._own(x)] = 0
            linked = y[100 * same >= self.settings.least * (self.size[y] + self.size[x] - same)]
            for v in linked:
                if self.group[v] != self.group[x]:
                    self.group[self.group == self.group[v]] = self.group[x]
                    yield tuple(sorted((self.numbers[x], self.numbers[v])))


def _exhaustive(
    members: DataFrame, reps: DataFrame, sets: DataFrame, settings: Settings
) -> DataFrame:
    """Links between members of different components, block against block.

    A node is cut into blocks of about `block` members or `elements` elements of their sets,
    whichever are more; two of them are held at a time, with their sets. Of all links, a node gives only those that join components within it, fewer
    than it has members.
    """
    known = members.join(reps.select("rep", "sketch", "n_shingles"), "rep")
    large = known.groupBy("node").agg(F.sum("n_shingles").alias("elements_of_node"))
    blocks = F.greatest(
        F.lit(1),
        F.ceil(F.col("size") / settings.block),
        F.ceil(F.col("elements_of_node") / settings.elements),
    ).cast("int")
    rows = known.join(large, "node").join(sets, "rep").select(
        "node", "rep", "label", "sketch", "elements",
        blocks.alias("blocks"), F.pmod(F.xxhash64("rep", "node"), blocks).cast("int").alias("block"),
    )
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")),
    )
    dealt = rows.withColumn("meet", F.explode(meets)).select(
        "node", "meet.i", "meet.j", "block", "rep", "label", "sketch", "elements"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the sorted rows where a node and its blocks end."""
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if held is None:
                continue
            keys = np.stack([held[c].to_numpy() for c in ("node", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist()] + ([held.num_rows] if batch is None else [])
            found = [
                pair
                for start, end in zip(bounds, bounds[1:])
                for pair in _Block(held.slice(start, end - start), settings).links()
            ]
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_pydict({"a": np.array(a), "b": np.array(b)})
            held = held.slice(bounds[-1])

    id_type = reps.schema["rep"].dataType.simpleString()
    grouped = dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return grouped.mapInArrow(run, f"a {id_type}, b {id_type}")


def _labels(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    roots = components(every)
    return stored(roots.select(F.col("id").alias("rep"), F.col("root").alias("label")), "labels")


def link_representatives(texts: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """Rows rep and label for all representatives that are linked to another one.

    texts: __id and __text of the representatives. reps: rep, n_shingles, sketch, nodes,
    one row per class of equal sets.
    """
    rows = reps.select(F.explode(F.array_distinct("nodes")).alias("node"), "rep")
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    members = stored(rows.join(shared, "node"), "nodes")
    id_type = reps.schema["rep"].dataType.simpleString()
    labels = reps.sparkSession.createDataFrame([], f"rep {id_type}, label {id_type}")
    links: list[DataFrame] = []
    # The only time that texts are shuffled, by a merge at every size.
    wanted = members.select(F.col("rep").alias("__id")).distinct().hint("merge")
    chosen = stored(texts.join(wanted, "__id", "left_semi"), "member-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        """Stores the links among the pairs, and gives the components of all links."""
        links.append(stored(_confirmed(pairs.distinct(), chosen, settings), "links"))
        return _labels(links)

    for _ in range(settings.stars):
        stars = _stars(_mixed_nodes(members, labels))
        labels = confirm(_candidates(stars, reps, settings))

    sets = stored(_whole_sets(chosen, settings), "member-sets")
    found: list[DataFrame] = []
    nodes = stored(_mixed_nodes(members, labels).where("size > 2"), "mixed-nodes")
    for level in range(settings.deepest + 1):
        last = level == settings.deepest or settings.pairs is None
        few = nodes if last else nodes.where(F.col("cross") <= settings.pairs)
        found.append(stored(_exhaustive(few, reps, sets, settings), "node-links"))
        large = nodes.where(F.col("cross") > settings.pairs)
        if last or large.isEmpty():
            break
        children = stored(_branched(large, sets, settings), "children")
        nodes = stored(_mixed_nodes(children, labels), "mixed-nodes")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return confirm(every)


def near_duplicates(
    df: DataFrame, document: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row per row: document, n_shingles, component_id, kept.

    Documents are linked if their sets share at least settings.least percent of their
    union. component_id is the smallest number that links reach, kept says whether it is
    the document's own. A text without words is linked with nothing. Numbers should be
    unique; rows that share a number are one document, linked with all that any of them is
    linked with, and a null number is never linked. An empty table gives no rows.
    """
    rows = stored(summarise(df, document, text, settings), "summaries")
    # The smallest number of each set; rows with equal sets are one class.
    classes = stored(
        rows.where("digest is not null and __id is not null")
        .groupBy("digest")
        .agg(F.min("__id").alias("rep")),
        "classes",
    )
    mine = rows.join(classes, "digest").where(F.col("__id") == F.col("rep"))
    reps = stored(
        mine.select("rep", "digest", "n_shingles", "sketch", "nodes")
        .dropDuplicates(["digest"])
        .drop("digest"),
        "representatives",
    )
    texts = df.select(F.col(document).alias("__id"), whole(F.col(text)).alias("__text"))
    labels = link_representatives(texts, reps, settings)
    named = rows.select("__id", "n_shingles", "digest").join(classes, "digest", "left")
    joined = named.join(labels, "rep", "left")
    component = F.coalesce("label", "rep", "__id")
    return joined.select(
        F.col("__id").alias(document),
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("__id")).alias("kept"),
    )
