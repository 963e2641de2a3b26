"""Secret scans: single finds, and credentials whose parts stand near each other.

One pass over each text finds the base kinds and the parts of credentials: identifiers
(`client_id = x`), secrets (long mixed strings, `pwd: x`) and endpoints (addresses). A
part alone is weak, as ordinary text is full of them. An interval join within each text
links identifiers to secrets whose starts are at most `scope` characters apart, and
endpoints to such pairs. Weak parts are reported only if they are linked; base finds are
reported always and may be the other part of a link.

The join is by text and stretch of text, so the rows of one key are as many as fit into a
stretch, however long the text is.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from reportloom.llm.common import stored, whole

# The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
# Parts that count only where a complementary part is near.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|key_?id|client_?id|user_?(?:name|id)?|login|account)\b"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
IDENTIFIER_WORDS = ("key", "client", "user", "login", "account")
SHORT_SECRET = re.compile(
    r"""(?<![A-Za-z0-9])(?:pwd|pass|auth|private_?key|credential)\b["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{4,})""",
    re.ASCII | re.IGNORECASE,
)
SHORT_WORDS = ("pwd", "pass", "auth", "private", "credential")
LONG_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,11}://[^\s"'<>]{4,}""", re.ASCII)
ENTROPY = 3.5
SCOPE = 200

SPAN = ArrayType(
    StructType().add("kind", IntegerType()).add("start", LongType()).add("end", LongType())
)


def _mixed(value: str) -> bool:
    """Whether a string has digits, letters and the entropy of a random one."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The base finds as (kind, start, end), sorted by start, then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [
            (0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers, secrets and endpoints that touch no base find, sorted by start.

    Parts may overlap: an address can hold an identifier and a secret. Only a long string
    without a name is no part where it touches another: paths look like that, and a value
    with a name is that part already.
    """
    low = text.lower()
    found = []
    if any(word in low for word in IDENTIFIER_WORDS):
        found += [(3, *m.span(1)) for m in IDENTIFIER.finditer(text)]
    if any(word in low for word in SHORT_WORDS):
        found += [(4, *m.span(1)) for m in SHORT_SECRET.finditer(text)]
    addresses = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    found += [(5, *span) for span in addresses]
    named = [span for _, *span in found]
    long = [m.span() for m in LONG_SECRET.finditer(text) if _mixed(m[0])]
    found += [(4, *span) for span in _clear_of(long, named)]
    clear = set(_clear_of([p[1:] for p in found], [b[1:] for b in base]))
    return sorted({p for p in found if p[1:] in clear}, key=lambda s: (s[1], s[0], s[2]))


def _clear_of(
    spans: list[tuple[int, int]], taken: list[tuple[int, int]]
) -> list[tuple[int, int]]:
    """The spans that touch none of the taken ones, which may overlap each other."""
    merged: list[list[int]] = []
    for start, end in sorted(taken):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    ends = [end for _, end in merged]

    def free(start: int, end: int) -> bool:
        at = bisect_right(ends, start)
        return at == len(merged) or merged[at][0] >= end

    return [span for span in spans if free(*span)]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with the columns __base and __weak, arrays of (kind, start, end)."""
    clean = df.withColumn("__scanned", whole(F.col(text)))
    span_type = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for value in batch.column(batch.num_columns - 1):
                content = value.as_py()
                base = base_spans(content)
                both.append((base, weak_parts(content, base)))
            columns = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b[i]] for b in both],
                         span_type)
                for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns],
                names=[*batch.schema.names[:-1], "__base", "__weak"],
            )

    schema = StructType([*df.schema.fields]).add("__base", SPAN).add("__weak", SPAN)
    return clean.mapInArrow(run, schema)


def linked_parts(scanned: DataFrame, key: str, scope: int = SCOPE) -> DataFrame:
    """The weak parts that belong to a credential: key, __linked (array of spans).

    The table has one row per key. Where linked parts of one role overlap, the first
    counts, of equal starts the longest; parts of different roles may overlap.
    """
    kind = F.col("s.kind")
    parts = scanned.select(key, F.explode(F.concat("__base", "__weak")).alias("s")).select(
        key,
        kind.alias("kind"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.when(kind.isin(1, 3), "identifier").when(kind == 5, "endpoint").otherwise("secret")
        .alias("role"),
        F.floor(F.col("s.start") / scope).alias("stretch"),
    )

    def near(role: str, prefix: str) -> DataFrame:
        """Parts of a role, in their own stretch and both neighbours."""
        chosen = parts.where(F.col("role") == role)
        around = F.explode(F.array(*[F.col("stretch") + i for i in (-1, 0, 1)]))
        return chosen.select(
            key,
            around.alias("stretch"),
            *[F.col(c).alias(prefix + c) for c in ("kind", "start", "end")],
        )

    def close(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) <= scope

    secrets = parts.where(F.col("role") == "secret")
    pairs = secrets.join(near("identifier", "id_"), [key, "stretch"]).where(
        close("start", "id_start")
    )
    ends = pairs.join(near("endpoint", "at_"), [key, "stretch"]).where(close("start", "at_start"))

    def named(df: DataFrame, prefix: str = "") -> DataFrame:
        return df.select(key, *[F.col(prefix + c).alias(c) for c in ("kind", "start", "end")])

    found = named(pairs).union(named(pairs, "id_")).union(named(ends, "at_"))
    return (
        found.where(F.col("kind") >= 3)
        .groupBy(key)
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("__linked"))
        .withColumn("__linked", first_of_overlaps(F.col("__linked")))
    )


def first_of_overlaps(spans: Column) -> Column:
    """Spans without those that begin within an earlier one of their kind."""
    by_kind = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["kind"], s["start"], (-s["end"]).alias("back"), s["end"]))
    )
    ordered = F.transform(by_kind, lambda s: F.struct(s["kind"], s["start"], s["end"]))

    def take(kept: Column, span: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        inside = (last["kind"] == span["kind"]) & (last["end"] > span["start"])
        return F.when(F.coalesce(inside, F.lit(False)), kept).otherwise(
            F.concat(kept, F.array(span))
        )

    return F.aggregate(ordered, F.array().cast(SPAN), take)


def find_secrets(
    df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", scope: int = SCOPE
) -> DataFrame:
    """The kept columns with base and all, the arrays of (kind, start, end) of every text.

    Positions are code points, the end is excluded; kind counts the names in KINDS; both
    arrays are sorted by start, then kind. A null or empty text has none. Equal rows give
    equal rows; an empty table gives none. Only finds are stored and joined, never texts.
    """
    row = F.monotonically_increasing_id().alias("__row")
    source = df.select(row, *keep, F.col(text).alias("__text"))
    scanned = scan(source, "__text").drop("__text")
    scanned = stored(scanned, "secret-scan")
    hopeful = scanned.where("size(__weak) > 0 and size(__base) + size(__weak) > 1")
    links = linked_parts(hopeful, "__row", scope)
    joined = scanned.join(links, "__row", "left")
    return joined.select(
        *keep,
        F.col("__base").alias("base"),
        sorted_spans(F.concat("__base", F.coalesce("__linked", F.array().cast(SPAN)))).alias(
            "all"
        ),
    )


def sorted_spans(spans: Column) -> Column:
    ordered = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    )
    return F.transform(
        ordered,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def spans_text(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.element_at(names, s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def redact(df: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """The table with every reported span of its text replaced by the mark.

    Spans that overlap are replaced by one mark. A null text stays null.
    """
    key = "__key"
    scanned = stored(scan(df, text), "secret-redact").withColumn(
        key, F.sha2(F.col(text).cast("binary"), 256)
    )
    hopeful = "size(__weak) > 0 and size(__base) + size(__weak) > 1"
    distinct = scanned.where(hopeful).select(key, "__base", "__weak").dropDuplicates([key])
    links = linked_parts(distinct, key, scope)
    none = F.array().cast(SPAN)
    maybe = scanned.where(hopeful).join(links, key, "left")
    rest = scanned.where(f"not ({hopeful})").withColumn("__linked", none)
    spans = sorted_spans(F.concat("__base", F.coalesce("__linked", none)))
    every = maybe.unionByName(rest).withColumn("__spans", spans)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_replace(t, s, mark) for t, s in zip(texts, spans)])

    return every.withColumn(text, replaced(F.col(text), F.col("__spans"))).select(*df.columns)


def _replace(text: str | None, spans, mark: str) -> str | None:
    if not len(spans):
        return text
    out, at, last = [], 0, -1
    for span in spans:
        start, end = span["start"], span["end"]
        if start >= last:
            out += [text[at:start], mark]
        last = max(last, end)
        at = max(at, end)
    return "".join([*out, text[at:]])
