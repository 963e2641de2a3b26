"""Collocations, substring dedup and the divergence audit against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportloom.llm import collocations, divergence, substrings, word_bytes
from reportloom.llm.queries import ORACLES, QUERIES

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
NEW = ("op11_collocations", "op12_substrings", "op13_divergence")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- words -------------------------------------------------------------------
def test_words_of_blocks_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB .\n\té— 𝔘", k=rng.randrange(40))) for _ in range(300)]
    texts[5] = None
    kinds = word_bytes.byte_kinds(b" \t", b".\n")
    for size in (1, 50, 1 << 20):
        found = defaultdict(list)
        for block in word_bytes.blocks(pa.array(texts), kinds, lower=True, size=size):
            assert (np.diff(block.row_bounds()) >= 0).all()
            for i, row, piece in zip(block.ids, block.row, block.piece):
                found[row, piece].append(block.words[i].decode())
        got = defaultdict(list)
        for (row, _), words in sorted(found.items()):
            got[row].append(words)
        for row, text in enumerate(texts):
            pieces = [re.findall("[^ \t]+", p) for p in re.split("[.\n]", lower(text or ""))]
            assert got[row] == [p for p in pieces if p]


# -- collocations ------------------------------------------------------------
def brute_collocations(rows, least, percent, top):
    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= least}
        chosen, longest = [], Counter()
        for q, c in often.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    longest[q[i : i + size]] = max(c, longest[q[i : i + size]])
        for p, a in often.items():
            if len(p) < 2 or (p in longest and 100 * longest[p] >= percent * a):
                continue
            score, _, l, r = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                for k in range(1, len(p))
            )
            chosen.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(chosen)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize("least, top", [(30, 2000), (3, 40), (1, 2000)])
def test_collocations_equal_brute_force(spark, least, top):
    rng = random.Random(least)
    words = ["New", "york", "city", "é", "x y", "|", "the", "THE", "of"]
    rows = []
    for i in range(150):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(60)
        )
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "s"))
    rows += [(500, None, "en", "s"), (501, "", "fr", "s"), (502, " . ", None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    found = collocations.collocations(df, least=least, top=top)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, 80, top)


def test_collocations_hold_with_a_full_sieve_and_small_hold(spark, monkeypatch):
    """A sieve that lets everything pass only costs longer windows."""
    rows = [(i, f"a b c d{i % 3} a b. e f{i}", "en", "s") for i in range(90)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    monkeypatch.setattr(collocations, "sieve_of", lambda texts, least, first=None: b"\xff" * (1 << 23))
    found = sorted(map(tuple, collocations.collocations(df).collect()))
    assert found == brute_collocations(rows, 30, 80, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    a, part = 9_007_199_254_740_993, 9_007_199_254_740_995
    counts = spark.createDataFrame(
        [("en", 2, "x y", a), ("en", 1, "x", part), ("en", 1, "y", part), ("en", 0, "", 1)],
        "lang string, order int, phrase string, f bigint",
    )
    assert collocations.scored(counts).first()["score"] == 2_000_000 * a // (2 * part)


# -- substrings --------------------------------------------------------------
def brute_substrings(rows, window=50):
    numbers = {}
    texts = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text, *_ in rows]
    large = float("inf")
    for doc, words in texts:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            numbers[key] = min(numbers.get(key, large), large if doc is None else doc)
    out = []
    for doc, words in texts:
        gone = set()
        for s in range(len(words) - window + 1):
            if numbers[tuple(words[s : s + window])] < (large if doc is None else doc):
                gone.update(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), kept))
    return sorted(out, key=repr)


def check_substrings(spark, rows, window=50):
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    found = substrings.remove_repeats(df, window=window)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_substrings(rows, window)


def test_any_two_positions_meet_in_the_cover():
    p = substrings.PERIOD
    for a in range(p):
        assert any(
            (a + d) % p in substrings.COVER and d in substrings.COVER for d in range(p)
        )


def test_substrings_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]

    def fresh(n):
        return rng.choices(vocabulary, k=n)

    passages = [fresh(n) for n in (49, 50, 51, 60, 85, 140)]
    rows = []
    for i in range(120):
        words = fresh(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            passage = list(rng.choice(passages))
            if rng.random() < 0.3:
                passage[rng.randrange(len(passage))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((rng.randrange(60), " ".join(words), "en", "s"))
    rows += [(100 + i, rows[i][1], "en", "s") for i in range(0, 60, 3)]
    near = rows[4][1].split() + fresh(100)
    for i in range(12):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((300 - i, "  ".join(copy), "en", "s"))
    rows += [(400, "same " * 700, "en", "s"), (401, "same\t" * 300, "en", "s"), (401, None, "en", "s")]
    rows += [(None, rows[4][1], "en", "s"), (None, " ".join(near), None, None), (None, "", None, None)]
    check_substrings(spark, rows)
    check_substrings(spark, rows, window=37)


def test_a_text_that_repeats_itself_stays(spark):
    once = " ".join(f"a{i}" for i in range(60))
    check_substrings(spark, [(1, f"{once} {once}", "en", "s"), (2, "short " * 49, "en", "s"), (3, "short " * 49, "en", "s")])


def test_windows_below_the_period_are_refused(spark, empty):
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty, window=30)


# -- divergence --------------------------------------------------------------
def brute_divergence(rows, least=3, top=200):
    terms, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add((lang, source))
        terms[lang, source].update(words)
        docs[lang].update(set(words))

    def floor(x):
        return x.numerator // x.denominator

    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        mine = {s: {t: terms[g, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}

        def shares(count):
            n = sum(count.values())
            return {t: 1 + floor(Fraction(10**9 * (c + 1), n + len(kept))) for t, c in count.items()}

        p, q = {s: shares(c) for s, c in mine.items()}, shares(whole)
        for s in mine:
            pairs = [
                (-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode())
                for o in mine if o != s
            ]
            more = [
                (-((p[s][t] - q[t]) ** 2 // q[t]), t.encode())
                for t in kept if mine[s][t] > 0 and p[s][t] > q[t]
            ]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # Several blocks of rows, buckets and stretches.
        monkeypatch.setattr(divergence, "ROWS", 3)
        monkeypatch.setattr(divergence, "BUCKET", 100)
        monkeypatch.setattr(divergence, "STRETCH", 7)
    rng = random.Random(13)
    vocabulary = [f"{a}{b}" for a in "abcdefghijéß" for b in ("x", "Y", "zz", "ñ")]
    rows = []
    for i in range(300):
        source = f"s{rng.randrange(11)}"
        words = rng.choices(vocabulary[int(source[1:]) : int(source[1:]) + 30], k=rng.randrange(12))
        sep = rng.choice([" ", "-", "1", "'", "\x7f"])
        rows.append((i, sep.join(words), rng.choice(["en", "de", "", None]), source))
    rows += [(i, None, "en", "no words") for i in range(3)]
    rows += [(1, "1 2 3", "empty", "a"), (2, None, "empty", "b"), (3, "once", "alone", None)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    found = divergence.divergence(df, top=9)
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, top=9)


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 10**15 + 7, 10**6)], "n bigint, total bigint, terms bigint")
    share = row.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert share == 1 + 10**9 * (10**13 + 1) // (10**15 + 7 + 10**6)


# -- all three ---------------------------------------------------------------
def test_statements_of_all_three_are_given():
    assert set(NEW) <= set(QUERIES) and set(NEW) <= set(ORACLES)


def test_odd_rows_clashing_columns_and_empty_tables(spark, odd, odd_rows, empty):
    names = ("term", "n", "part", "doc", "w1", "phrase", "order", "rank", "peer", "value", "kept")
    clashing = odd.withColumns({name: F.lit(name) for name in names})
    plain = [row[:4] for row in odd_rows]
    for df in (odd, clashing):
        found = collocations.collocations(df, least=2)
        assert sorted(map(tuple, found.collect())) == brute_collocations(plain, 2, 80, 2000)
        found = substrings.remove_repeats(df)
        assert sorted(map(tuple, found.collect()), key=repr) == brute_substrings(plain)
        found = divergence.divergence(df)
        assert sorted(map(tuple, found.collect())) == brute_divergence(plain)
    for operator in (collocations.collocations, substrings.remove_repeats, divergence.divergence):
        assert operator(empty).count() == 0


def test_digest_of_kept_words(spark, tmp_path):
    words = [f"v{i}" for i in range(70)]
    rows = [(1, " ".join(words), "en", "s"), (2, "before\n" + " ".join(words[:55]) + " after", "en", "s")]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op12_substrings"](spark, str(tmp_path)).collect()}
    assert (found[2].n_words, found[2].n_removed) == (57, 55)
    assert found[2].kept_sha256 == hashlib.sha256(b"before after").hexdigest()
    assert found[1].n_removed == 0
