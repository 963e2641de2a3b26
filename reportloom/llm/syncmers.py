"""Document fingerprints from closed syncmers, with DataFrame expressions only.

A k-mer (K code points) is an anchor if the smallest hash of its s-mers lies at its first
or last s-mer. Whether it is one depends on the k-mer alone, so a passage has the same
anchors wherever it stands, and equal prefixes have equal anchors at equal positions.
Texts are taken with K - 1 marks before them, which gives texts shorter than K anchors too.

An anchor counts together with its occurrence number within the text, so a passage that a
text repeats counts as often as it stands there, and what is inserted or deleted elsewhere
changes nothing, however far it moves the passage.

A fingerprint keeps the smallest hash in each of SLOTS slots, dealt by hash, with its
position, which only positional matching looks at. The likeness of two fingerprints is the
number of slots that agree over the number of slots in use, an estimate of the share of
numbered anchors that two texts share.

Texts are cut into chunks before anything is worked out per character. Of a whole text only
its anchors are held, less than a quarter of its length in numbers: sorted, numbered and
reduced to their slots in one expression per text, so none of them is ever a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm.common import whole

S, WINDOW = 9, 8
K = S + WINDOW - 1
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
# Hashes per slot that are looked at first.
PER_SLOT = 10
CHUNK = 1 << 15
MARK = "\x02"
UTF32 = "UTF-32"
PIECES = "array<struct<at:int,units:binary>>"
# A hash stands above 28 bits of position.
POSITION_BITS = 28
POSITIONS = (1 << POSITION_BITS) - 1
SLOT_SHIFT = 63 - SLOT_BITS


def _let(value: Column, body) -> Column:
    """The body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(text: Column, first: Column) -> Column:
    """The marked text from its k-mer of number first on, as UTF-32 pieces that overlap by
    K - 1 code points; none of a text without such a k-mer."""
    units = F.encode(F.concat(F.lit(MARK * (K - 1)), text), UTF32)
    starts = F.sequence(first, F.greatest(F.char_length(text) - 1, first), F.lit(CHUNK))
    pieces = _let(
        units,
        lambda u: F.transform(
            starts,
            lambda at: F.struct(
                at.alias("at"), F.substring(u, at * 4 + 1, F.lit(4 * (CHUNK + K - 1))).alias("units")
            ),
        ),
    )
    return F.when(F.char_length(text) > first, pieces).otherwise(F.array().cast(PIECES))


def _hashes(chunk: Column) -> Column:
    """The hash of every s-mer of a chunk."""
    return F.transform(
        F.sequence(F.lit(1), F.octet_length(chunk) - (4 * S - 1), F.lit(4)),
        lambda at: F.xxhash64(F.substring(chunk, at, F.lit(4 * S))),
    )


def _lesser(values: Column, by: int) -> Column:
    """Each value or the one `by` places on, the lesser of the two; NULL where that is missing."""
    ahead = F.slice(values, by + 1, F.size(values))
    return F.zip_with(values, ahead, lambda x, y: F.when(x <= y, x).otherwise(y))


def _anchored(h: Column, element) -> Column:
    """An element of place and hash for each k-mer whose smallest s-mer is its first or last.

    Minima of four hashes are worked out once for all k-mers, which hold two of them each.
    """
    half = WINDOW // 2

    def of_window(low: Column, at: Column, fours: Column) -> Column:
        high, first, last = F.get(fours, at + half), F.get(h, at), F.get(h, at + (WINDOW - 1))
        chosen = F.when(low < high, first == low).otherwise(
            (last == high) | ((low == high) & (first == low))
        )
        # The two outer s-mers overlap, so they hold the whole k-mer.
        return F.when(chosen, element(at, F.xxhash64(first, last)))

    def of_all(fours: Column) -> Column:
        windows = F.slice(fours, 1, F.size(h) - (WINDOW - 1))
        return F.array_compact(F.transform(windows, lambda low, at: of_window(low, at, fours)))

    return _let(_lesser(h, 1), lambda twos: _let(_lesser(twos, 2), of_all))


def _found(text: Column, first: Column, element) -> Column:
    """An element of position and hash for each anchor of a text from a position on."""

    def of_chunk(piece: Column) -> Column:
        return _let(
            _hashes(piece["units"]),
            lambda h: _anchored(h, lambda at, a: element((piece["at"] + at).cast("long"), a)),
        )

    return F.flatten(F.transform(_chunks(text, first), of_chunk))


def anchors(df: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """One row per anchor of every text: keys, position, anchor (its hash).

    Positions are those of the k-mer's last code point, from 0. An empty or null text has
    no anchor, and a short one may have none.
    """
    placed = _found(
        whole(F.col(text)), F.lit(0), lambda p, a: F.struct(p.alias("position"), a.alias("anchor"))
    )
    return df.select(*keys, F.explode(placed).alias("__a")).select(
        *keys, F.col("__a.position").alias("position"), F.col("__a.anchor").alias("anchor")
    )


def _packed(text: Column, first: Column, shift: Column | None = None) -> Column:
    """Anchors as numbers: 35 bits of hash above the position, to which a shift is added."""
    moved = (lambda p: p) if shift is None else (lambda p: p + shift)
    return _found(
        text,
        first,
        lambda position, anchor: F.shiftleft(
            F.shiftrightunsigned(anchor, POSITION_BITS + 1), POSITION_BITS
        ).bitwiseOR(F.least(moved(position), F.lit(POSITIONS))),
    )


def _position(x: Column) -> Column:
    return x.bitwiseAND(POSITIONS)


def _slotted(packed: Column, number: Column) -> Column:
    """Slot, 29 bits of hash and position in one number that is smallest, within a slot, for
    the smallest hash."""
    hashed = F.xxhash64(F.shiftrightunsigned(packed, POSITION_BITS), number)
    return F.shiftleft(F.shiftrightunsigned(hashed, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(
        _position(packed)
    )


def _repeated(s: Column, shared: Column, n: Column) -> Column:
    """Of sorted packed anchors of both forms, those that have an equal one before them, with
    their occurrence numbers.

    An edited form's anchor does not count those at positions from `shared` to `n`, which
    only the text has. Only places of repeated anchors are looked at one by one.
    """
    alike = lambda i: F.get(s, i).bitwiseXOR(F.get(s, i - 1)) <= POSITIONS

    def of_run(start: Column, end: Column) -> Column:
        places = F.sequence(start, end)
        dropped = F.filter(
            places, lambda i: (_position(F.get(s, i)) >= shared) & (_position(F.get(s, i)) < n)
        )
        return _let(
            F.size(dropped),
            lambda less: F.transform(
                F.slice(places, 2, F.size(places)),
                lambda i: _slotted(
                    F.get(s, i),
                    i - start - F.when(_position(F.get(s, i)) >= n, less).otherwise(F.lit(0)),
                ),
            ),
        )

    def of_places(places: Column) -> Column:
        # Neighbouring places belong to one run; between two runs lies the next one's first.
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(places) - 1),
            lambda k: (k == 0) | (F.get(places, k) != F.get(places, k - 1) + 1),
        )
        return _let(
            firsts,
            lambda b: F.flatten(
                F.transform(
                    b,
                    lambda k, r: of_run(
                        F.get(places, k) - 1,
                        F.get(places, F.coalesce(F.get(b, r + 1), F.size(places)) - 1),
                    ),
                )
            ),
        )

    none = F.array().cast("array<bigint>")
    places = F.when(
        F.size(s) > 1, F.filter(F.sequence(F.lit(1), F.size(s) - 1), alike)
    ).otherwise(F.array().cast("array<int>"))
    return _let(places, lambda p: F.when(F.size(p) > 0, of_places(p)).otherwise(none))


def _numbered(s: Column, shared: Column, n: Column) -> Column:
    """Hashes of sorted packed anchors with their occurrence numbers, each with its position.

    A repeated anchor is also there as a first one: with a hash that its first has at a
    smaller position, so it is never a minimum.
    """
    firsts = F.transform(s, lambda x: _slotted(x, F.lit(0)))
    return F.concat(firsts, _repeated(s, shared, n))


def _low(numbered: Column) -> Column:
    """Those that are small within their slot, about PER_SLOT to a slot; all of a few."""
    share = F.least(F.lit(1.0), F.lit(float(PER_SLOT * SLOTS)) / F.greatest(F.size(numbered), F.lit(1)))
    bound = (share * float(1 << SLOT_SHIFT)).cast("long")
    chosen = _let(
        bound,
        lambda most: F.filter(
            numbered, lambda x: x.bitwiseAND((1 << SLOT_SHIFT) - 1) < most
        ),
    )
    return F.when(F.size(numbered) > PER_SLOT * SLOTS, chosen).otherwise(numbered)


def _minima(ordered: Column, kept) -> Column:
    """Of sorted hashes the smallest kept one in each slot in use, ordered by slot."""
    return _let(
        F.filter(ordered, kept),
        lambda v: F.filter(
            v,
            lambda x, i: (i == 0) | (x.bitwiseXOR(F.get(v, i - 1)) >= 1 << SLOT_SHIFT),
        ),
    )


def with_minima(df: DataFrame, own: Column, tail: Column) -> DataFrame:
    """The rows with __a and __b, the slot minima of a text and of its edited form.

    `own` holds the text's packed anchors, `tail` those of the edited form from position
    __shared on, with positions that go on from n_chars. What both forms share is numbered
    and hashed once. Every step is a projection, so that arrays are sorted as numbers.
    Few hashes are small enough to be minima; if those leave a slot empty, all are looked at.
    """
    n, shared = F.col("n_chars"), F.col("__shared")
    of_text = lambda x: _position(x) < n
    of_edited = lambda x: (_position(x) < shared) | (_position(x) >= n)
    back = lambda x: F.when(_position(x) >= n, x - (n - shared)).otherwise(x)
    rows = (
        df.withColumn("__s", F.sort_array(F.concat(own, tail)))
        .withColumn("__v", _numbered(F.col("__s"), shared, n))
        .drop("__s")
        .withColumn("__w", F.sort_array(_low(F.col("__v"))))
        .withColumns({"__a": _minima(F.col("__w"), of_text), "__b": _minima(F.col("__w"), of_edited)})
    )
    few = (F.size("__w") < F.size("__v")) & (F.least(F.size("__a"), F.size("__b")) < SLOTS)
    every = F.when(few, F.sort_array("__v"))
    return (
        rows.withColumn("__every", every)
        .withColumns(
            {
                "__a": F.coalesce(_minima(F.col("__every"), of_text), F.col("__a")),
                "__b": F.transform(
                    F.coalesce(_minima(F.col("__every"), of_edited), F.col("__b")), back
                ),
            }
        )
        .drop("__v", "__w", "__every")
    )


def entries(slots: Column) -> Column:
    """Slot and 16 bits of hash of each slot in use, as numbers."""
    return F.transform(
        slots,
        lambda x: (
            F.shiftrightunsigned(x, SLOT_SHIFT) * 65536
            + F.shiftright(x, POSITION_BITS).bitwiseAND(0xFFFF)
        ).cast("int"),
    )


def fingerprint_text(numbers: Column) -> Column:
    """Six hexadecimal digits per slot in use, ordered by slot; empty without anchors."""
    return F.array_join(F.transform(numbers, lambda n: F.lpad(F.lower(F.hex(n)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Slots that agree over slots in use, from two arrays of entries; 1 if both are empty."""
    same = F.size(F.array_intersect(a, b))
    used = F.size(
        F.array_union(
            F.transform(a, lambda n: F.shiftright(n, 16)), F.transform(b, lambda n: F.shiftright(n, 16))
        )
    )
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used).cast("double")


def _text_number(text: Column) -> Column:
    """The first seven bytes of a text as a number that orders texts like their bytes."""
    head = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("double")


def _above(value: Column, edges: list[float]) -> Column:
    """How many of the edges a value has reached."""
    return reduce(Column.__add__, [(value >= e).cast("long") for e in edges], F.lit(0).cast("long"))


def with_stretches(df: DataFrame, document: str, text: str, stretches: int) -> DataFrame:
    """The rows in stretches of neighbours, the first row of each also, as a guest, at the
    end of the stretch before it; columns __stretch and __guest.

    Stretches are quantiles of the number, divided evenly. A number that many rows have, or
    that many lack, is divided again by quantiles of the beginning of the text, which comes
    second in the order of rows; rows that agree in both stay together. The first row of the
    first stretch is the guest of the last one. Only a table with a row per stretch is
    broadcast.
    """
    coarse = min(64, stretches)
    fine = max(1, -(-stretches // coarse))
    shares = [i / coarse for i in range(coarse + 1)]
    number, beginning = F.col(document).cast("double"), _text_number(F.col(text))
    seen = df.agg(
        F.percentile_approx(number, shares, 10_000).alias("bounds"),
        F.count(F.lit(1)).alias("n"),
        F.count(number).alias("numbered"),
    ).first()
    bounds = seen["bounds"] or []
    edges = sorted(set(bounds))
    # Beyond 2 ** 53 different numbers may look equal here.
    hot = sorted({x for x, y in zip(bounds, bounds[1:]) if x == y and abs(x) < 1 << 53})
    unnumbered = (seen["n"] - seen["numbered"]) * coarse >= max(1, seen["n"])

    place = F.lit(0).cast("long")
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = F.floor((number - low) / (high - low) * fine)
        place = F.when(
            number >= low, F.lit(i * fine) + F.greatest(F.lit(0), F.least(inside, F.lit(fine - 1)))
        ).otherwise(place)
    # What lies below, at and above each frequent number is apart.
    place = place * (2 * len(hot) + 1) + _above(number, hot)
    place = place + reduce(Column.__add__, [(number > h).cast("long") for h in hot], F.lit(0))
    sub = F.lit(0).cast("long")
    if hot or unnumbered:
        many = number.isin(hot) if hot else F.lit(False)
        many = (many | number.isNull()) if unnumbered else many
        parts = (
            df.where(many)
            .groupBy(number.alias("number"))
            .agg(F.percentile_approx(beginning, shares, 10_000).alias("b"))
            .collect()
        )
        for value, inner in parts:
            here = number.eqNullSafe(F.lit(value).cast("double"))
            sub = F.when(here, _above(beginning, sorted(set(inner))[1:])).otherwise(sub)
    width = coarse + 1
    # Never null, so that no check for that sets equal shuffles apart.
    placed = df.withColumns(
        {
            "__stretch": F.coalesce(
                F.when(number.isNull(), sub - width).otherwise(place * width + sub), F.lit(0).cast("long")
            ),
            "__mid": F.monotonically_increasing_id(),
        }
    )
    # At most one row per stretch, so a window over all of them is small.
    around = Window.orderBy("__stretch").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    order = F.struct(F.col(document).isNotNull(), F.col(document), F.col(text), F.col("__mid").alias("mid"))
    starts = (
        placed.groupBy("__stretch")
        .agg(F.min(order).alias("__first"))
        .select("__stretch", F.col("__first.mid").alias("__start"))
        .withColumn(
            "__before",
            F.coalesce(
                F.lag("__stretch").over(Window.orderBy("__stretch")),
                F.max("__stretch").over(around),
                F.lit(-1),
            ),
        )
    )
    joined = placed.join(F.broadcast(starts), "__stretch")
    own = F.struct(F.col("__stretch").alias("stretch"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("__before").alias("stretch"), F.lit(1).alias("guest"))
    is_first = F.col("__mid") == F.col("__start")
    return joined.select(
        *df.columns,
        F.explode(F.when(is_first, F.array(own, visit)).otherwise(F.array(own))).alias("__place"),
    ).select(
        *df.columns,
        F.col("__place.stretch").alias("__stretch"),
        F.col("__place.guest").alias("__guest"),
    )


def compare_neighbours(
    df: DataFrame, document: str = "doc_id", text: str = "text", stretches: int | None = None
) -> DataFrame:
    """Fingerprints of every text and of its edited form, compared.

    The edited text has its last quarter of code points (rounded down) replaced by the
    first as many of the next row's text. Rows are ordered by number, nulls first, then
    text; after the last comes the first. Repeated rows are neighbours of each other.

    Columns: document, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_anchors_kept: the slots that text and edited text share at
    the same position. A null text is empty; two empty texts have likeness 1. A table of
    one row is its own neighbour; an empty table gives no rows.

    The texts are shuffled once, by stretch, and only fingerprints are compared after that.
    """
    spark = df.sparkSession
    stretches = stretches or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(document).alias("__id"), whole(F.col(text)).alias("__text"))
    placed = with_stretches(rows, "__id", "__text", stretches)
    order = Window.partitionBy("__stretch").orderBy(
        "__guest", F.col("__id").asc_nulls_first(), "__text"
    )
    n = F.char_length("__text")
    cut = F.floor(n / 4).cast("int")
    key = ("__stretch", "__row")
    texts = placed.select(
        "__stretch",
        F.row_number().over(order).alias("__row"),
        "__guest",
        "__id",
        "__text",
        F.coalesce(F.lead("__text").over(order), F.lit("")).alias("__next"),
    ).select(
        *key,
        "__guest",
        "__id",
        n.cast("long").alias("n_chars"),
        (n - cut).alias("__shared"),
        "__text",
        F.concat(
            F.substring(F.col("__text"), F.lit(1), n - cut),
            F.substring(F.col("__next"), F.lit(1), cut),
        ).alias("__edited"),
    )
    own = _packed(F.col("__text"), F.lit(0))
    # Before the cut both forms have the same anchors.
    tail = _packed(F.col("__edited"), F.col("__shared"), F.col("n_chars") - F.col("__shared"))
    numbered = with_minima(texts, own, tail).select(
        *key,
        "__guest",
        "__id",
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        "__a",
        "__b",
    ).select(
        "*",
        entries(F.col("__a")).alias("__own"),
        entries(F.col("__b")).alias("__other"),
        F.size(F.array_intersect("__a", "__b")).cast("long").alias("n_anchors_kept"),
    )
    next_own = F.lead("__own").over(Window.partitionBy("__stretch").orderBy("__row"))
    return (
        numbered.withColumn("__following", next_own)
        .where("__guest = 0")
        .select(
            F.col("__id").alias(document),
            "n_chars",
            "edited_sha256",
            fingerprint_text(F.col("__own")).alias("fingerprint"),
            fingerprint_text(F.col("__other")).alias("edited_fingerprint"),
            likeness(F.col("__own"), F.col("__other")).alias("near_edited"),
            likeness(F.col("__own"), F.col("__following")).alias("near_next"),
            "n_anchors_kept",
        )
    )
