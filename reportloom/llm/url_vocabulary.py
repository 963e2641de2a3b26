"""URL filters: host and path rules, and a weighted vocabulary found by an automaton.

A rule is the longest of those whose host is the URL's host or a parent of it, and whose
path begins the URL's path. URLs without a rule are judged by their terms: an Aho-Corasick
automaton finds all terms in one pass; a term counts where no letter or digit touches it.
One strict term rejects, and so do several distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Terms that reject alone, and terms that reject together.
STRICT = (
    "adult-x", "casino-x", "cheap-pills", "escort", "hentai", "phishing", "porn", "porno",
    "sex-cam", "spam-farm", "viagra", "warez", "xxx",
)
SOFT = (
    "adult", "bet", "bonus", "casino", "cheap", "crack", "dating", "deal", "farm", "free",
    "jackpot", "keygen", "loan", "pills", "poker", "promo", "replica", "sex", "spam", "win",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, else null.

    Of rules that are equally long the one with the longer host counts, then the one
    declared first.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    for rule in reversed(ranked):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        hit = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, hit).otherwise(chosen)
    return chosen


def count_terms(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """A column function: URL to numbers of distinct strict and soft terms in it."""

    @F.pandas_udf("strict_terms bigint, soft_terms bigint")
    def counted(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for weight, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                automaton.add_word(term, (weight, term))
        automaton.make_automaton()

        def distinct(url: str | None) -> tuple[int, int]:
            found = {"strict": set(), "soft": set()}
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
            for end, (weight, term) in automaton.iter(low):
                start = end + 1 - len(term)
                edges = low[start - 1 : start] + low[end + 1 : end + 2]
                if not any(c.isascii() and c.isalnum() for c in edges):
                    found[weight].add(term)
            return len(found["strict"]), len(found["soft"])

        for batch in urls:
            yield pd.DataFrame(
                [distinct(u) for u in batch], columns=["strict_terms", "soft_terms"]
            )

    return counted


def judge_urls(
    df: DataFrame,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
) -> DataFrame:
    """The kept columns with host, path, rule, strict_terms, soft_terms and verdict.

    The verdict is the rule's; without a rule it is block where there is a strict term or
    soft_limit distinct soft ones, else allow. A null URL, and one without `://`, has an
    empty host and path and no rule. Rows are neither joined nor moved, so repeated rows
    stay and an empty table gives no rows.
    """
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    parts = df.select(
        *keep,
        url_host(address).alias("host"),
        url_path(address).alias("path"),
        count_terms(strict, soft)(address).alias("__terms"),
    )
    hit = parts.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    listed = (F.col("__terms.strict_terms") > 0) | (F.col("__terms.soft_terms") >= soft_limit)
    return hit.select(
        *keep,
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(
            F.col("__rule.verdict"), F.when(listed, F.lit("block")).otherwise(F.lit("allow"))
        ).alias("verdict"),
        F.col("__terms.strict_terms").alias("strict_terms"),
        F.col("__terms.soft_terms").alias("soft_terms"),
    )
