"""Chat, WARC, secrets and URLs: exact round trips and plain Python versions."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row, functions as F

import __spark_entry__ as entry_points
from check_oracles import compare, connect
from reportloom.llm import chat, credentials, url_vocabulary, warc
from reportloom.llm.queries import QUERIES, URL_RULES

PARTS = "conv_id bigint, turn bigint, role string, parts " + chat.PART_TYPE


@pytest.mark.parametrize("name", sorted(entry_points.EXTRA_ORACLES))
def test_query_equals_statement(spark, sf_dir, name):
    outcome = compare(
        spark, connect(sf_dir), sf_dir, name, QUERIES[name], entry_points.EXTRA_ORACLES[name]
    )
    assert outcome.startswith("ok"), outcome


# -- chat --------------------------------------------------------------------
def test_chat_round_trip(spark):
    rng = random.Random(2)
    atoms = ["<|", "|>", "<", "|", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<|turn|>", "<|body|>",
             "<|end|>", "a", "é𝔘", "\n", "[", "INST]", "/s>", ""]
    text = lambda: "".join(rng.choices(atoms, k=rng.randrange(9)))
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", text(), None])
            rows.append((conv, turn, role, rng.choice([text(), text(), None])))
    rows += [(None, None, None, None), (7, None, "user", "first"), (8, 0, "user", "x"), (8, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("formatted", F.lit("clash"))
    done = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))))
    found = done.select(
        "conv_id",
        "n_turns",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    ).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        own = [t for t in rows if t[0] == r.conv_id]
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "")
        expected = sorted(own, key=key)
        assert r.n_turns == len(own)
        assert Counter((t.role, t.text) for t in r.turns) == Counter(
            (t[2] or "", t[3] or "") for t in expected
        )
        assert [t.role for t in r.turns] == [t[2] or "" for t in expected]
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        bare = r.formatted
        for own_mark in (chat.TURN, chat.BODY, chat.END):
            bare = bare.replace(own_mark, "")
        assert not re.search(r"<\||</?s>|\[/?INST\]", bare)


def test_typed_parts(spark):
    def part(type, text=None, ref=None, tokens=None):
        return Row(type=type, text=text, ref=ref, tokens=tokens)

    rows = [
        (1, 0, "user", [part("text", "see <"), part("image", ref="a.png"), part("text", "|turn|> end")]),
        (1, 1, "assistant", [part("audio", ref="b.wav", tokens=9), part("table", ref="c"), part(None, "done")]),
        (2, 0, "user", None),
        (2, 1, "assistant", []),
    ]
    done = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, PARTS)).collect()}
    assert [tuple(a) for a in done[1].attachments] == [
        (0, 1, "image", "a.png", 576), (1, 0, "audio", "b.wav", 9), (1, 1, "document", "c", 1024)
    ]
    assert done[1].expanded_tokens == 576 + 9 + 1024
    assert "<|body|>see <\n<|image|>\n|turn|> end<|end|>" in done[1].formatted
    assert done[1].n_turns == 2 and done[2].formatted.count(chat.TURN) == 2
    assert chat.format_conversations(spark.createDataFrame([], PARTS)).count() == 0


# -- WARC --------------------------------------------------------------------
PAGES = "page_id bigint, url string, html string"


def pages(spark):
    big = "<p>ü</p>" * 40_000
    rows = [
        (1, "http://a", big), (2, "http://b", big), (3, "http://c", "short"), (4, "http://d", "short"),
        (5, None, None), (6, "http://e\r\nX: y", ""), (7, "http://f", "\r\n\r\nWARC/1.1\r\n" * 30),
        (0, "http://g", "x" * 100), (9, "http://h", "x" * 100), (None, "http://i", "x" * 100),
        (1, "http://a", big), (10, "http://j", "x" * 99), (11, "http://k", "x" * 99),
    ]
    return rows, spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_round_trip(spark, chunk):
    rows, df = pages(spark)
    archives = warc.write_archives(df, chunk=chunk, file_bytes=200)
    chunks = warc.read_archives(archives, chunk=chunk).collect()
    assert sum(r.records for r in archives.collect()) == len(rows)
    payloads = {}
    for r in rows:
        payloads.setdefault((r[2] or "").encode(), []).append(r[0])
    expected = Counter()
    for body, numbers in payloads.items():
        first = min(n for n in numbers if n is not None)
        for n in numbers:
            again = len(body) >= 100 and n != first
            expected[n, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                     first if again else None] += 1
    to_int = lambda x: None if x is None else int(x)
    assert expected == Counter(
        (to_int(r.record_id), r.n_bytes, r.digest, r.record_type, to_int(r.refers_to))
        for r in chunks
        if r.last
    )
    assert all(len(r.data or b"") <= chunk for r in chunks)
    seven = sorted((r for r in chunks if r.record_id == "7"), key=lambda r: r.chunk_no)
    assert b"".join(r.data for r in seven).decode() == rows[6][2]
    assert seven[0].digest == hashlib.sha256(seven[0].data).hexdigest()


def test_archives_are_plain_warc_files(spark):
    _, df = pages(spark)
    fs, path = warc.open_folder(warc.write_archives(df.where("page_id = 3")).first().file)
    text = gzip.decompress(fs.open_input_stream(path, compression=None).read()).decode()
    head, http, body = text.split("\r\n\r\n")[:3]
    assert head.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and body == "short"
    assert f"Content-Length: {len(http) + 4 + 5}" in head


def test_a_changed_payload_is_noticed(spark):
    import io

    _, df = pages(spark)
    fs, path = warc.open_folder(warc.write_archives(df.where("page_id = 3")).first().file)
    data = gzip.decompress(fs.open_input_stream(path, compression=None).read())
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(data.replace(b"short", b"shore")), 100, True))


def test_archives_are_read_side_by_side(spark):
    rows = [(i, f"http://{i}", f"{i} " * 100) for i in range(80)]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(8), file_bytes=1)
    n_files = archives.count()
    assert n_files == 80
    tasks = warc.read_archives(archives, with_data=False).select(F.spark_partition_id().alias("task"))
    assert tasks.distinct().count() > n_files * 0.8


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(none)).count() == 0


# -- secrets -----------------------------------------------------------------
def base_by_hand(text):
    found = []
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", r"AKIA[A-Z0-9]+"),
        ("hex", r"[0-9a-f]+"),
    )
    for order, (kind, pattern) in enumerate(kinds):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        for m in re.finditer(pattern, text, flags):
            length = len(m[2]) if kind == "assign" else len(m[0])
            if length >= (8, 16, 32)[order]:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


SECRETS = [
    "token: token: abcdefgh12 TOKEN='aaaa.bbbb=cc' api_key = 12345678",
    "ſecret=longenough1 toKen=longenough1",
    "AKIAAKIA12345678 AKIA12345678901 AKIA123456789012x" + "ab" * 16 + " " + "f" * 31,
    "é𝔘 password:hunter2hunter2\npasswd=\x20\x20\"deadbeefdeadbeefdeadbeefdeadbeef",
    "secret=" + "a" * 100_000,
    None,
    "",
]


def test_base_finds(spark):
    rng = random.Random(4)
    atoms = ["token", "PassWord", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "0123456789AB",
             "deadbeef" * 4, "f00d", "x", "é", "\n"]
    texts = SECRETS + ["".join(rng.choices(atoms, k=14)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in credentials.find_secrets(df).select(
        "doc_id", credentials.spans_text(F.col("base")).alias("base"), F.col("all")
    ).collect():
        assert r.base == base_by_hand(texts[r.doc_id] or "")
        starts = [(s.start, s.kind) for s in r["all"]]
        assert starts == sorted(starts)


KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def linked(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = credentials.find_secrets(df).first()["all"]
    return [(credentials.KINDS[s.kind], text[s.start : s.end]) for s in spans]


def test_weak_parts_count_only_together(spark):
    address = "https://api.example.com/v1"
    assert linked(spark, f"see {KEY} there") == []
    assert linked(spark, f"client_id = abc77, at {address}") == []
    assert linked(spark, f"client_id = abc77 uses {KEY} at {address}") == [
        ("identifier", "abc77"), ("secret", KEY), ("endpoint", address)
    ]
    assert linked(spark, "client_id = abc77 " + "x " * 200 + KEY) == []
    assert linked(spark, f"AKIA123456789012 {KEY}") == [("access", "AKIA123456789012"), ("secret", KEY)]
    assert linked(spark, "login: bob, pwd: 12pass") == [("identifier", "bob"), ("secret", "12pass")]
    edge = "y" * 198
    assert len(linked(spark, f"{edge} user=bob {KEY}")) == 2


def test_parts_within_an_address_and_behind_underscores(spark):
    address = "https://h.example/cb?client_id=abc77&pwd=hunter22"
    assert linked(spark, address) == [
        ("endpoint", address), ("identifier", "abc77"), ("secret", "hunter22")
    ]
    assert linked(spark, "DB_USER=bobby DB_PWD=hunter22") == [
        ("identifier", "bobby"), ("secret", "hunter22")
    ]
    # A path is no secret, however long.
    assert linked(spark, "user: bob at https://h.example/a1/b2C3d4E5f6G7h8I9j0K1l2M3n4") == []
    # One secret where both patterns find one; a long identifier is no secret as well.
    assert linked(spark, f"client_id={KEY}") == []
    assert linked(spark, f"user=bob pwd={KEY}") == [("identifier", "bob"), ("secret", KEY)]


def links_by_hand(spans, scope):
    """All linked parts by comparing every triple, then the first of those that overlap."""
    role = {1: "i", 3: "i", 5: "e"}
    of = {r: [s for s in spans if role.get(s[0], "s") == r] for r in "ise"}
    kept = set()
    for s in of["s"]:
        for i in of["i"]:
            if abs(s[1] - i[1]) <= scope:
                kept |= {s, i} | {e for e in of["e"] if abs(s[1] - e[1]) <= scope}
    out = []
    for s in sorted((s for s in kept if s[0] >= 3), key=lambda s: (s[0], s[1], -s[2])):
        if not out or out[-1][0] != s[0] or out[-1][2] <= s[1]:
            out.append(s)
    return set(out)


def test_links_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for key in range(300):
        starts = [rng.randrange(400) for _ in range(rng.randrange(1, 14))]
        spans = {(rng.randrange(6), s, s + rng.randrange(1, 40)) for s in starts}
        base = [s for s in spans if s[0] < 3]
        rows.append((key, base, [s for s in spans if s[0] >= 3]))
    span = "array<struct<kind: int, start: bigint, end: bigint>>"
    df = spark.createDataFrame(rows, f"id bigint, __base {span}, __weak {span}")
    found = {r.id: {tuple(s) for s in r["__linked"]} for r in credentials.linked_parts(df, "id", 25).collect()}
    for key, base, weak in rows:
        assert found.get(key, set()) == links_by_hand(base + weak, 25)


def test_redaction(spark, odd, clashing, empty):
    text = f"a token='abcdefgh1' b login: bob, pwd: 12pass c {KEY}"
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, "login: bob"), (5, "login: bob")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(credentials.redact(df).collect(), key=lambda r: r.doc_id)
    clean = "a [SECRET]' b login: [SECRET], pwd: [SECRET] c [SECRET]"
    assert [r.text for r in found] == [clean, clean, None, "", "login: bob", "login: bob"]
    assert credentials.find_secrets(empty).count() == credentials.redact(empty).count() == 0
    assert credentials.find_secrets(clashing).count() == 12
    assert credentials.redact(clashing).columns == clashing.columns


# -- URLs --------------------------------------------------------------------
def test_urls(spark):
    cases = {
        "HTTP://User@WWW.Example.NET:80/en/x?q#f": ("user@www.example.net:80", "/en/x", None, "allow"),
        "https://a.example.net/en/": ("a.example.net", "/en/", "example.net/en/", "allow"),
        "https://example.net": ("example.net", "", None, "allow"),
        "https://example.net/de": ("example.net", "/de", "net/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://x.example.com/de/porn": ("x.example.com", "/de/porn", "example.com/de/", "block"),
        "https://x.org/fr/porn?xxx": ("x.org", "/fr/porn", "org/fr/", "allow"),
        "https://x.com/porn": ("x.com", "/porn", None, "block"),
        "https://x.com/porno1": ("x.com", "/porno1", None, "allow"),
        "https://x.com/free-free": ("x.com", "/free-free", None, "allow"),
        "https://x.com/free-WIN": ("x.com", "/free-WIN", None, "block"),
        "https://x.com/a://b/c": ("x.com", "/a://b/c", None, "allow"),
        "no address": ("", "", None, "allow"),
        "a\nb://H\n/p": ("h\n", "/p", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(0, next(iter(cases)))]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    found = url_vocabulary.judge_urls(df, rules=URL_RULES).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == cases[rows[r.page_id][1]]
    assert url_vocabulary.judge_urls(df.where("false"), rules=URL_RULES).count() == 0
