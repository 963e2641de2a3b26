"""One query per operator, over whole tables, and the DuckDB statements of those that have one."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.llm import chat, chosen_path, credentials, decision_list, token_counts, url_vocabulary, warc
from reportloom.llm import collocations, divergence, packing, pivotal, substrings, syncmers
from reportloom.llm.common import n_words, table
from reportloom.llm.url_vocabulary import Rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op5_warc(spark, sf_dir):
    """Pages written as WARC records and read back."""
    pages = table(spark, sf_dir, "pages")
    chunks = warc.read_archives(warc.write_archives(pages), with_data=False)
    return chunks.where("last").select(
        F.col("record_id").cast("long").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLES["op5_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
), r AS (
  SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""


@query
def op6_secrets(spark, sf_dir):
    """Single finds and linked parts of credentials in all documents."""
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))

    def kinds(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        kinds(0).alias("n_assign"),
        kinds(1).alias("n_access"),
        kinds(2).alias("n_hex"),
        F.sha2(credentials.spans_text(F.col("base")), 256).alias("base_sha256"),
        credentials.spans_text(F.col("all")).alias("spans"),
    )


URL_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


@query
def op7_urls(spark, sf_dir):
    """Host, path, rule and verdict of every page's address."""
    return url_vocabulary.judge_urls(table(spark, sf_dir, "pages"), rules=URL_RULES)


def _terms_sql(terms: tuple[str, ...]) -> str:
    counted = " + ".join(
        f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS BIGINT)"
        for term in terms
    )
    return f"({counted})"


ORACLES["op7_urls"] = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages
), c AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM u
), h AS (
  SELECT page_id, low,
         translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM c
), r AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    {_terms_sql(url_vocabulary.STRICT)} AS strict_terms,
    {_terms_sql(url_vocabulary.SOFT)} AS soft_terms
  FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL OR strict_terms > 0 OR soft_terms >= 2 THEN 'block'
            ELSE 'allow' END AS verdict,
       strict_terms, soft_terms
FROM r
"""


@query
def op8_packing(spark, sf_dir):
    """All documents as token pieces in sequences of up to 1024 tokens."""
    encoder = partial(
        packing.byte_bpe_encoder,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return packing.pack(table(spark, sf_dir, "documents"), encoder)


@query
def op9_tokens(spark, sf_dir):
    """Numbers of bytes and tokens of every document."""
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op10_chat(spark, sf_dir):
    """All conversations, and one that holds control strings, formatted and read back."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = talk.unionByName(added).withColumn("parts", chat.text_part(F.col("text")))
    done = chat.format_conversations(turns)
    said = F.transform(
        chat.read_turns(F.col("formatted")),
        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
    )
    read = done.select(
        "conv_id",
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("__loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLES["op10_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS safe_role,
            regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS safe_text
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, safe_text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, safe_text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>' || safe_role || '<|body|>' || safe_text || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op4_mixing(spark, sf_dir):
    """Words that a mix of all sources takes of each document."""
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", "source", n_words(F.col("text")).alias("size")
    )
    return pivotal.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_quality(spark, sf_dir):
    """Statistics of every document, and whether the learned rules keep it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decision_list.judge_by_labels(documents, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op1_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and their edited texts, and how near they are."""
    return syncmers.compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op2_near_duplicates(spark, sf_dir):
    """Components of documents that share 80 percent of their pairs of words."""
    return chosen_path.near_duplicates(
        table(spark, sf_dir, "documents"), settings=chosen_path.Settings(words=2)
    )


@query
def op11_collocations(spark, sf_dir):
    """The best-bound phrases of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, phrase, k, count(*) AS f FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, l.f AS l, r.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM often WHERE k > 1) c
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS longest
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s
        FROM (SELECT *, unnest(range(2, k)) AS m FROM often WHERE k > 2))
  GROUP BY ALL
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank,
         c.phrase, a, l, r, score
  FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longest IS NULL OR 100 * i.longest < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_substrings(spark, sf_dir):
    """All documents without the words of passages that an earlier document has."""
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_substrings"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM t WHERE len(w) >= 50)
), repeated AS (
  SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM windows)
  WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM repeated
), listed AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
         CASE WHEN gone IS NULL THEN w
              ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM t LEFT JOIN listed USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""


@query
def op13_divergence(spark, sf_dir):
    """How the sources of each language differ in their terms, pairwise and from the language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), known AS (
  SELECT lang, term, CAST(count(*) AS BIGINT) AS n FROM words
  GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counted AS (
  SELECT lang, source, term, CAST(count(*) AS BIGINT) AS n FROM words SEMI JOIN known USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM known GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, l.v, l.total AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) t USING (lang, source)
  LEFT JOIN langs l USING (lang)
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_total + g.v) AS BIGINT) AS lang_p
  FROM groups g JOIN known k USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - lang_p) * (p - lang_p)) // lang_p AS value
  FROM dense WHERE n > 0 AND p > lang_p
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
