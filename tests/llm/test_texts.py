"""Statistics and rules, fingerprints, token counts and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import partial

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from reportloom.llm import decision_list, packing, syncmers, token_counts
from reportloom.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ENCODER = partial(
    packing.byte_bpe_encoder,
    JSON,
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)


# -- quality -----------------------------------------------------------------
def statistics(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_statistics_of_odd_texts(spark, odd):
    extra = [
        (20, "a b c a b c a b c d", "", "", 0),
        (21, "x\nx\n x\n\n\nx|#<\n", "", "", 0),
        (22, "p q r s\np q r t p q r", "", "", 0),
        (23, "a a a a", "", "", 0),
    ]
    df = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for row in decision_list.with_statistics(df).collect():
        assert tuple(row[n] for n in names) == statistics(row["text"]), row["doc_id"]


def test_quality_of_all_documents(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = QUERIES["op3_quality"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    low, good = [], []
    for r in found:
        stats = statistics(texts[r.doc_id])
        counted = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counted == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            (good if labels[r.doc_id] else low).append(r.kept)
    assert sum(good) >= 0.99 * len(good)
    assert sum(low) <= 0.5 * len(low)


def test_rules_hold_on_texts_they_have_not_seen():
    rng = random.Random(3)

    def row(low, held):
        row = {m: rng.random() for m in decision_list.MEASURES} | {"low": low, "held_out": held}
        if low:
            row["symbols_a_word"], row["mean_word"] = 2 + rng.random(), 0.2 * rng.random()
        elif rng.random() < 0.5:
            row["symbols_a_word"], row["mean_word"] = 2 + rng.random(), 0.3 + rng.random()
        else:
            row["mean_word"] = 0.2 * rng.random()
        return row

    rules = decision_list.learn([row(i % 4 == 0, i % 3 == 0) for i in range(1200)])
    assert 1 <= len(rules) <= 3
    fresh = [row(i % 2 == 0, False) for i in range(1000)]
    right = sum(any(r.holds(x) for r in rules) == bool(x["low"]) for x in fresh)
    assert right >= 970


@pytest.mark.parametrize("quality", [[], [0] * 12, [1] * 12])
def test_labels_of_one_kind_give_no_rules(spark, odd, quality):
    labels = spark.createDataFrame(
        [(i, q, 0) for i, q in enumerate(quality)], "doc_id bigint, quality int, toxic int"
    )
    judged = decision_list.judge_by_labels(odd, labels).collect()
    assert len(judged) == 12
    assert {r.rule for r in judged} == {None}


def test_quality_of_an_empty_table(spark, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert decision_list.judge_by_labels(empty, labels).count() == 0


def test_own_columns_with_the_names_of_statistics_are_kept(spark, odd):
    rules = (decision_list.Rule((decision_list.Condition("words", True, 100.0),)),)
    names = [*decision_list.COUNTS, *decision_list.MEASURES, "base_failed", "rule", "kept", "__text"]
    clashing = odd.withColumns({name: F.lit(name) for name in names})
    judged = decision_list.judge(clashing, rules).collect()
    plain = decision_list.judge(odd, rules).collect()
    added = (*decision_list.COUNTS, "base_failed", "rule", "kept")
    show = lambda found: sorted((repr([r[c] for c in ("doc_id", *added)]) for r in found))
    assert show(judged) == show(plain)
    for row in judged:
        assert all(row[f"own_{c}" if c in added else c] == c for c in names)


# -- fingerprints ------------------------------------------------------------
def test_fingerprints(spark, odd, odd_rows):
    found = syncmers.compare_neighbours(odd, stretches=5).collect()
    ordered = sorted(
        ((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])
    )
    expected, prints = Counter(), {}
    for (number, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        expected[number, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    texts = {number: text for number, text in ordered}
    for r in found:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].near_next == 1 and by_id[2].near_next > 0.6
    assert by_id[5].fingerprint == "" and by_id[8].near_edited > 0.4


@pytest.mark.parametrize("n", [0, 1, 2])
def test_fingerprints_of_few_rows(spark, odd, n):
    rows = odd.where("doc_id = 1" if n == 1 else "doc_id in (1, 3)" if n else "false")
    found = syncmers.compare_neighbours(rows.dropDuplicates()).collect()
    assert len(found) == n
    if n == 1:
        assert found[0].near_next == 1


def closed_syncmers(text):
    """Which k-mers are anchors, by the definition, for a stand-in hash."""
    marked = syncmers.MARK * (syncmers.K - 1) + text
    out = set()
    for at in range(len(text)):
        kmer = marked[at : at + syncmers.K]
        inner = [hash(kmer[j : j + syncmers.S]) for j in range(syncmers.WINDOW)]
        if min(inner) in (inner[0], inner[-1]):
            out.add(at)
    return out


def test_anchors_do_not_depend_on_what_stands_around(spark):
    text = "".join(random.Random(5).choices("abcdef ghij", k=3000))
    rows = [(0, text), (1, "QQQ " + text), (2, text * 14)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    found = {i: set() for i in range(3)}
    for r in syncmers.anchors(df, ("id",)).collect():
        found[r.id].add((r.position, r.anchor))
    k = syncmers.K
    assert {(p, a) for p, a in found[0] if p >= k} == {
        (p - 4, a) for p, a in found[1] if p >= k + 4
    }
    # The chunk border lies within the third text.
    inside = {a for p, a in found[0] if p >= k}
    for copy in range(14):
        again = {a for p, a in found[2] if copy * 3000 + k <= p < (copy + 1) * 3000}
        assert again == inside
    share = len(found[0]) / len(closed_syncmers(text))
    assert 0.9 < share < 1.1


MASK = (1 << 64) - 1


def spark_hash(*values):
    """xxhash64 of byte strings and whole numbers, as Spark chains them."""
    seed = 42
    for v in values:
        raw = v if isinstance(v, bytes) else (v & MASK).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_slots(text):
    """slot -> (29 bits of hash, position), by the definition."""
    marked = syncmers.MARK * (syncmers.K - 1) + text
    found = []
    for at in range(len(text)):
        kmer = marked[at : at + syncmers.K]
        h = [
            signed(spark_hash(kmer[j : j + syncmers.S].encode("utf-32-be")))
            for j in range(syncmers.WINDOW)
        ]
        if min(h) in (h[0], h[-1]):
            found.append((spark_hash(h[0], h[-1]) >> (syncmers.POSITION_BITS + 1), at))
    number, slots = Counter(), {}
    for anchor, at in sorted(found):
        value = spark_hash(anchor, number[anchor].to_bytes(4, "little"))
        number[anchor] += 1
        rest = (value >> (syncmers.POSITION_BITS + 1)) & ((1 << 29) - 1), at
        slots[value >> 58] = min(rest, slots.get(value >> 58, rest))
    return {slot: (h & 0xFFFF) for slot, (h, _) in slots.items()}


def brute_likeness(a, b):
    used = {*a, *b}
    return sum(a.get(s) == b.get(s) for s in used) / len(used) if used else 1.0


@pytest.mark.parametrize("chunk", [50, 1 << 15])
def test_fingerprints_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(syncmers, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choices("ab é𝔘", k=rng.randrange(140))) for _ in range(25)]
    texts += ["", "x", texts[3] * 3, "same " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in syncmers.compare_neighbours(df).collect()}
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        own, edited, other = map(brute_slots, (text, text[: len(text) - cut] + following[:cut], following))
        show = "".join(f"{slot * 65536 + h:06x}" for slot, h in sorted(own.items()))
        assert found[i].fingerprint == show
        assert found[i].near_edited == pytest.approx(brute_likeness(own, edited))
        assert found[i].near_next == pytest.approx(brute_likeness(own, other))


def test_fingerprints_of_long_texts_equal_brute_force(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abc ", k=9000))
    words = " ".join(f"word{rng.randrange(60)}" for _ in range(900))
    # Repeated anchors within a text, and ends of one that the edited form takes from the next.
    texts = [long, long[:100] * 30, words, words + long[:4000], "x" * 3000, "abcd" * 700, long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in syncmers.compare_neighbours(df).collect()}
    digits = lambda slots: "".join(f"{s * 65536 + h:06x}" for s, h in sorted(slots.items()))
    for i, text in enumerate(texts):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[(i + 1) % len(texts)][:cut]
        assert found[i].fingerprint == digits(brute_slots(text))
        assert found[i].edited_fingerprint == digits(brute_slots(edited))


def test_slots_that_hold_no_small_hash_are_filled_from_all(spark, monkeypatch):
    # With one hash per slot looked at first, some slot is left empty.
    monkeypatch.setattr(syncmers, "PER_SLOT", 1)
    text = "".join(random.Random(8).choices("abcd ", k=4000))
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    found = syncmers.compare_neighbours(df).first()
    edited = text[:3000] + text[:1000]
    for show, form in ((found.fingerprint, text), (found.edited_fingerprint, edited)):
        own = brute_slots(form)
        assert len(own) == syncmers.SLOTS
        assert show == "".join(f"{s * 65536 + h:06x}" for s, h in sorted(own.items()))


def test_anchors_of_both_forms_are_numbered_once(spark, odd):
    plan = syncmers.compare_neighbours(odd)._jdf.queryExecution().analyzed().toString()
    assert plan.count("xxhash64(shiftrightunsigned(") == 2


def test_many_rows_without_number_or_with_the_same_one(spark):
    rng = random.Random(4)
    rows = [(None, f"{rng.randrange(10**9)} null") for _ in range(4000)]
    rows += [(7, f"{rng.randrange(10**9)} seven") for _ in range(4000)]
    rows += [(i, f"text {i}") for i in range(1000)] + [(7, "equal")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = syncmers.with_stretches(df, "doc_id", "text", 16)
    sizes = {r["__stretch"]: r["count"] for r in placed.groupBy("__stretch").count().collect()}
    assert max(sizes.values()) < 1200
    assert placed.where("__guest = 1").count() == len(sizes)
    found = syncmers.compare_neighbours(df, stretches=16).select("doc_id", "n_chars", "edited_sha256")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = Counter()
    for (number, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        expected[number, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter(map(tuple, found.collect())) == expected


def fingerprint_likeness(spark, rows):
    """near_next of the first of two texts."""
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    return {r.doc_id: r.near_next for r in syncmers.compare_neighbours(df).collect()}[0]


def test_likeness_of_texts_whose_passages_moved(spark):
    rng = random.Random(9)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(5000)]
    front = " ".join(f"front{rng.randrange(10**6)}" for _ in range(60))
    text = " ".join(words)
    # A passage of more than 512 code points in front, and 1% of all words deleted.
    assert len(front) > 512
    assert fingerprint_likeness(spark, [text, f"{front} {text}"]) > 0.85
    fewer = " ".join(w for i, w in enumerate(words) if i % 100 != 50)
    assert fingerprint_likeness(spark, [text, fewer]) > 0.75


def test_repeated_passages_count_as_often_as_they_stand(spark):
    rng = random.Random(10)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    assert 0.2 < fingerprint_likeness(spark, [text, " ".join([text] * 3)]) < 0.5


# -- token counts ------------------------------------------------------------
@pytest.mark.parametrize("path", [MODEL, JSON])
@pytest.mark.parametrize("piece", [40, 1 << 16])
def test_token_counts(spark, clashing, odd_rows, path, piece):
    found = token_counts.count_tokens(clashing, path, piece_chars=piece, batch_bytes=2000)
    if path == MODEL:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    expected = Counter(
        (r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in odd_rows
    )
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found.collect()) == expected


def test_token_counts_of_documents(spark, sf_dir, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op9_tokens"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {
        i: len(model.encode(t or "")) for i, t in texts.items()
    }
    assert token_counts.count_tokens(empty, MODEL).count() == 0


@pytest.mark.parametrize("path", [MODEL, JSON])
def test_cuts_do_not_change_counts(path):
    counter, rng = token_counts.counter_for(path), random.Random(21)
    words = ["data", "x1", "日本語の文", "東京", "。", "、", "(a)", "it's", "é", "e\u0301", "ﬁ", "2024",
             "return", "\u2581", "<0x0A>", "<|endoftext|>", "𝔘", "한국", "กข"]
    for _ in range(300):
        gaps = rng.choice([[""], ["", " "], [" ", "\n"], ["\n    ", "\t", "  "], ["; ", ",", "\r\n"]])
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(80))
        pieces = token_counts.safe_cut(text, 9, counter.place)
        assert "".join(pieces) == text
        counts = counter.count(pieces, [i > 0 for i in range(len(pieces))])
        assert sum(counts) == counter.count([text], [False])[0]


@pytest.mark.parametrize("path", [MODEL, JSON])
def test_texts_without_blanks_are_cut(path):
    place = token_counts.counter_for(path).place
    rng = random.Random(22)
    japanese = "".join(rng.choice("日本語東京都市山川の、。") for _ in range(50_000))
    code = "".join(f"f{i}(x)\n" for i in range(10_000))
    for text in (japanese, code):
        assert max(map(len, token_counts.safe_cut(text, 1000, place))) < 1200


def test_batches_are_balanced_by_bytes():
    import pyarrow as pa

    sizes = []

    def count(pieces, later):
        sizes.append(sum(len(p.encode()) for p in pieces))
        return [1] * len(pieces)

    counter = token_counts.Counter(count, token_counts.blank_place)
    texts = pa.array(["a" * 30, "語" * 10] * 500)
    assert token_counts._lengths(texts, counter, 300, 100) == [1] * 1000
    assert set(sizes) == {300}


# -- packing -----------------------------------------------------------------
def check_packed(found, texts):
    """All that must hold of pieces: found rows, and texts by document."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(JSON)
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in found:
        own = ids[r.doc_id]
        part = b"".join(x.to_bytes(4, "little") for x in own[r.start : r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(own)
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    padding = 0
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_packing_of_odd_texts(odd, odd_rows, block):
    rows = odd.dropDuplicates(["doc_id"])
    found = packing.pack(rows.coalesce(1), ENCODER, block_tokens=block).collect()
    assert check_packed(found, {r[0]: r[1] for r in odd_rows}) < 1024


def test_packing_of_documents(spark, sf_dir, empty, clashing):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op8_packing"](spark, sf_dir).collect()
    assert check_packed(found, texts) < 1024
    steps = Counter()
    for step, tokens in {(r.step_group, r.sequence_id): r.tier for r in found}.items():
        steps[step[0]] += tokens
    assert max(steps.values()) <= packing.STEP_TOKENS
    # One partial step per tier, whatever the number of tasks; no step mixes tiers.
    partial = Counter(s.split("-")[0] for s, n in steps.items() if n < packing.STEP_TOKENS)
    assert set(partial.values()) <= {1}


def test_step_groups_span_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8, "doc_id")
    windows = packing.pack(docs, ENCODER).select("tier", "sequence_id", "step_group").distinct()
    steps = windows.groupBy("tier", "step_group").count().collect()
    for tier in {r.tier for r in steps}:
        sizes = sorted(r["count"] for r in steps if r.tier == tier)
        per_step = packing.STEP_TOKENS // tier
        assert sizes[-1] <= per_step and sizes[1:] == [per_step] * (len(sizes) - 1)


def test_packing_of_nothing(spark, empty, clashing):
    assert packing.pack(empty, ENCODER).count() == 0
    assert packing.pack(clashing, ENCODER).count() >= 12


def test_plain_texts_have_equal_ids_in_both_libraries():
    fast, exact = ENCODER(), packing.byte_bpe_encoder(JSON)
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x20, 0x250) if packing.PLAIN.fullmatch(chr(c))] + list(" \n\t'" * 20)
    for _ in range(300):
        text = "".join(rng.choices(letters, k=200)) + "<|endoftext|>it's"
        assert fast(text) == exact(text)
