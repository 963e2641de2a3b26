"""Quality rules: statistics of a text, and a decision list learned from labelled ones.

Sequential covering: a rule grows by the condition (statistic, direction, threshold) that
separates low from good texts best, until it covers no good ones or nothing helps. It is
then pruned on texts that it was not grown on. Texts that it covers are set aside, and the
next rule is grown on the rest. The rules leave as ordered conditional expressions of
Spark SQL.

Statistics and verdicts are DataFrame expressions. Learning sees a sample of labelled
texts of at most `fit_rows`, chosen by a hash of their numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import WORD, whole

FIT_ROWS = 20_000
# Statistics that rules may test, as SQL over the columns of `with_statistics`.
MEASURES = {
    "mean_word": "word_chars / n_words",
    "symbols_a_word": "n_symbols / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_lines_a_line": "n_dup_lines / n_lines",
    "words_a_line": "n_words / n_lines",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "marks_a_word": "n_marks / n_words",
    "distinct_share": "n_distinct / n_words",
    "words": "n_words",
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_upper", "n_digits", "n_marks", "n_distinct",
)


def _repeated_words(words: str, windows: str) -> Column:
    """Words that lie in a window that occurs twice or more.

    Windows are sorted by hash with their places; neighbours with equal hashes repeat. A
    repeated window covers its three words, less those of the next repeated one.
    """
    placed = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    )

    def repeats(sorted_windows: Column) -> Column:
        kept = F.filter(
            sorted_windows,
            lambda w, i: (F.get(sorted_windows, i - 1)["h"] == w["h"])
            | (F.get(sorted_windows, i + 1)["h"] == w["h"]),
        )
        return F.sort_array(F.transform(kept, lambda w: w["at"]))

    def covered(places: Column) -> Column:
        own = F.transform(
            places,
            lambda at, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - at, F.lit(3))),
        )
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    found = _let(placed, lambda p: _let(repeats(p), covered))
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, F.lit(0).cast("long")).otherwise(found)


def _let(value: Column, body) -> Column:
    """The body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with the columns in COUNTS for each whole text; a null text is empty.

    A word is a run of characters other than ASCII white space; word_chars are code points
    in words, n_symbols characters of `#*$%&|<>`, n_dup_lines lines with a word that equal
    an earlier one, n_repeat_words words in windows of three found twice or more.
    """
    names = df.columns
    split = df.withColumn("__text", whole(F.col(text))).withColumn(
        "__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))
    )
    w = F.col("__words")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    no_windows = F.array().cast("array<bigint>")
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD))
    staged = split.select(
        *names,
        "__text",
        "__words",
        F.when(F.size(w) >= 3, windows).otherwise(no_windows).alias("__windows"),
        lines.alias("__lines"),
        F.array_join(w, "").alias("__joined"),
    )

    def count(pattern: str) -> Column:
        return F.regexp_count("__joined", F.lit(pattern)).cast("long")

    counts = (
        F.size("__words"),
        F.char_length("__joined"),
        count(r"[#*$%&|<>]"),
        F.size("__lines") - F.size(F.array_distinct("__lines")),
        _repeated_words("__words", "__windows"),
        F.size("__lines"),
        count(r"\p{Lu}"),
        count(r"\d"),
        count(r"[^\p{L}\p{N}]"),
        F.size(F.array_distinct("__words")),
    )
    # A generator of one row: a later filter on a count cannot be moved below it, where
    # Spark would put all of its expressions in place of the count, and into loops.
    one_row = F.stack(F.lit(1), *[c.cast("long") for c in counts])
    return staged.select(*names, one_row.alias(*COUNTS))


def with_measures(df: DataFrame) -> DataFrame:
    """The table with the columns in MEASURES; a ratio to nothing is 0."""
    return df.select(
        "*",
        *[
            F.expr(f"CAST(coalesce(try_divide({a}, {b}), 0) AS DOUBLE)").alias(name)
            for name, (a, _, b) in ((n, e.partition(" / ")) for n, e in MEASURES.items())
            if b
        ],
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in MEASURES.items() if "/" not in e],
    )


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        value = row[self.measure]
        return value > self.threshold if self.above else value <= self.threshold

    @property
    def sql(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction; texts for which it holds are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    @property
    def sql(self) -> str:
        return " AND ".join(c.sql for c in self.conditions)


def _candidates(rows: Sequence[dict], measures: Sequence[str], steps: int):
    """Conditions at the quantiles of what the rows have, each half way between values."""
    for measure in measures:
        values = sorted(row[measure] for row in rows)
        cuts = set()
        for i in range(1, steps):
            at = values[i * (len(values) - 1) // steps]
            above = next((v for v in values[i * (len(values) - 1) // steps :] if v > at), None)
            if above is not None:
                cuts.add((at + above) / 2)
        for cut in sorted(cuts):
            yield Condition(measure, True, cut)
            yield Condition(measure, False, cut)


def _counts(rows: Sequence[dict]) -> tuple[int, int]:
    low = sum(row["low"] for row in rows)
    return low, len(rows) - low


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Low texts kept times the information that the condition adds to each."""
    if not after[0] or not before[0]:
        return 0.0
    bits = math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before))
    return after[0] * bits


def _grow(rows: Sequence[dict], measures: Sequence[str], longest: int, steps: int) -> Rule:
    conditions: list[Condition] = []
    covered = list(rows)
    while len(conditions) < longest and _counts(covered)[1]:
        before = _counts(covered)
        best, best_gain = None, 1e-9
        for condition in _candidates(covered, measures, steps):
            after = _counts([r for r in covered if condition.holds(r)])
            if (gain := _gain(before, after)) > best_gain:
                best, best_gain = condition, gain
        if best is None:
            break
        conditions.append(best)
        covered = [r for r in covered if best.holds(r)]
    return Rule(tuple(conditions))


def _worth(rule: Rule, rows: Sequence[dict]) -> float:
    low, good = _counts([r for r in rows if rule.holds(r)])
    return (low - good) / (low + good) if low + good else -1.0


def _prune(rule: Rule, rows: Sequence[dict]) -> Rule:
    """The shortest of the beginnings of the rule that separate the held-out rows best."""
    heads = [Rule(rule.conditions[:n]) for n in range(1, len(rule.conditions) + 1)]
    return max(heads, key=lambda r: (_worth(r, rows), -len(r.conditions)))


def learn(
    rows: Sequence[dict],
    measures: Sequence[str] = tuple(MEASURES),
    least_precision: float = 0.95,
    most_rules: int = 12,
    longest: int = 4,
    steps: int = 24,
) -> tuple[Rule, ...]:
    """The ordered rules for rows with measures, low (whether rejected) and held_out.

    A rule counts only if, of all rows that it covers, least_precision are low, in both
    parts; the first one that fails ends the list.
    """
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules:
        grow = [r for r in left if not r["held_out"]]
        held = [r for r in left if r["held_out"]]
        if not _counts(grow)[0] or not _counts(grow)[1]:
            break
        rule = _grow(grow, measures, longest, steps)
        if not rule.conditions:
            break
        rule = _prune(rule, held)
        covered = _counts([r for r in left if rule.holds(r)])
        held_covered = _counts([r for r in held if rule.holds(r)])
        precise = all(c[0] >= least_precision * sum(c) for c in (covered, held_covered))
        if sum(covered) < 3 or not sum(held_covered) or not precise:
            break
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return tuple(rules)


def base_failed(least_words: int = 50) -> Column:
    words = F.col("n_words")
    return (words < least_words) | (F.col("n_repeat_words") * 100 > words * 50)


def labelled_rows(
    df: DataFrame, labels: DataFrame, document: str, text: str, fit_rows: int, seed: str
) -> list[dict]:
    """The sample to learn from: at most fit_rows labelled texts that pass the base rule.

    A text with several labels is low if one says so; one without text or label is left out.
    """
    chosen = (
        labels.where(F.col(document).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(document).alias("__id"))
        .agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64(F.lit(seed), "__id"), "__id")
        .limit(fit_rows)
    )
    texts = df.select(F.col(document).alias("__id"), F.col(text).alias("__own"))
    # At most fit_rows rows of two numbers.
    sample = texts.join(F.broadcast(chosen), "__id")
    measured = with_measures(with_statistics(sample, "__own")).where(~base_failed())
    one = measured.groupBy("__id", "__quality").agg(F.min(F.struct(*MEASURES)).alias("m"))
    rows = one.select(
        "m.*",
        (F.col("__quality") == 0).cast("int").alias("low"),
        (F.pmod(F.xxhash64(F.lit(seed + "-held"), "__id"), F.lit(3)) == 0).alias("held_out"),
        "__id",
    ).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: str(r["__id"]))]


def judge(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The table with COUNTS, base_failed, rule (the number of the first rule that rejects
    from 1, else null) and kept. A column of the table with one of these names is kept as
    `own_<name>`.

    Every row is judged by itself, repeated rows alike. A null or empty text has no words
    and fails the base rule. Without rules the base rule decides.
    """
    added = (*COUNTS, "base_failed", "rule", "kept")
    names = {c: f"own_{c}" if c in added else c for c in df.columns}
    whole_row = df.select(F.struct(*df.columns).alias("__whole"), F.col(text).alias("__judged"))
    measured = with_measures(with_statistics(whole_row, "__judged")).withColumn(
        "base_failed", base_failed()
    )
    number = F.lit(None).cast("int")
    for place, rule in reversed(list(enumerate(rules, 1))):
        number = F.when(F.expr(rule.sql), F.lit(place)).otherwise(number)
    judged = measured.withColumn("rule", number).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
    own = [F.col(f"__whole.`{c}`").alias(name) for c, name in names.items()]
    return judged.select(*own, *added)


def judge_by_labels(
    df: DataFrame,
    labels: DataFrame,
    document: str = "doc_id",
    text: str = "text",
    fit_rows: int = FIT_ROWS,
    seed: str = "rules",
) -> DataFrame:
    """`judge` with rules learned from a table of document and quality (0 is low)."""
    rows = labelled_rows(df, labels, document, text, fit_rows, seed)
    return judge(df, learn(rows), text)
