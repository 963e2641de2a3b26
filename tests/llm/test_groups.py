"""Near-duplicates, mixing and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reportloom.llm import chosen_path, components, pivotal
from reportloom.llm.queries import QUERIES

DOCUMENTS = "doc_id bigint, text string"


# -- near duplicates ---------------------------------------------------------
def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_force(texts, n, least=80):
    """doc_id -> (size of the set, component): all pairs that share a shingle are tried."""
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    holders = defaultdict(set)
    for s in classes:
        for shingle in s:
            holders[shingle].add(s)
    for s, members in classes.items():
        if not s:
            continue
        shared = Counter(o for shingle in s for o in holders[shingle])
        for other, same in shared.items():
            if 100 * same >= least * (len(s) + len(other) - same):
                for i in [*members, classes[other][0]]:
                    a, b = root(members[0]), root(i)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


def check(found, texts, n):
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(texts, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(df.select("doc_id", "text").collect())
    check(QUERIES["op2_near_duplicates"](spark, sf_dir).collect(), texts, 2)
    check(chosen_path.near_duplicates(df).collect(), texts, 5)


def family(rng, n, size, edits):
    """Texts that are each an edited form of one of those before."""
    texts = [[f"w{rng.randrange(5000)}" for _ in range(size)]]
    while len(texts) < n:
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"w{rng.randrange(5000)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("sizes", [{"block": 4, "pairs": 20}, {"pairs": None, "elements": 300}, {}])
def test_chains_and_large_groups(spark, sizes):
    rng = random.Random(7)
    texts = family(rng, 250, 120, 12) + family(rng, 80, 60, 9) + family(rng, 200, 150, 2)
    texts += [texts[0]] * 100 + ["a", "A", "b", "", None, " \t", "a b", "A  B\n", "a b"]
    common = " ".join(f"c{i}" for i in range(60))
    texts += [f"{common} {' '.join(f'u{i}_{j}' for j in range(40))}" for i in range(150)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i] * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("label", F.lit("clash"))
    settings = chosen_path.Settings(words=2, **sizes)
    check(chosen_path.near_duplicates(df, settings=settings).collect(), dict(rows), 2)


def test_links_within_large_nodes_below_the_threshold(spark):
    """Pairs at 0.8, each the only link of its texts, in nodes that branch to the last level.

    Words once in their text and one word a shingle, so similarities are exact.
    """
    rng = random.Random(11)
    core = [f"c{i}" for i in range(75)]
    rows = []
    for i in range(400):
        own = [f"s{i}_{j}" for j in range(5)]
        for side in range(2):
            words = core + own + [f"u{i}_{side}_{j}" for j in range(10)]
            rng.shuffle(words)
            rows.append((2 * i + side, " ".join(words)))
    df = spark.createDataFrame(rows, DOCUMENTS)
    settings = chosen_path.Settings(words=1, pairs=20, stars=1)
    found = chosen_path.near_duplicates(df, settings=settings).collect()
    linked = {r.doc_id for r in found if r.component_id != r.doc_id}
    assert linked <= {2 * i + 1 for i in range(400)}
    assert len(linked) >= 399


def test_odd_rows_have_a_component(spark, odd, clashing, empty):
    found = chosen_path.near_duplicates(odd).collect()
    assert len(found) == 12
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.component_id, r.kept))
    assert by_id[2] == by_id[3] == {(1, False)} and by_id[1] == {(1, True)}
    assert by_id[4] == {(4, True)} and by_id[None] == {(None, True)}
    assert chosen_path.near_duplicates(clashing).count() == 12
    assert chosen_path.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(200, 300)) for _ in range(50)]
    links += [(5, 5), (300, 100), (100, 300)]
    rng.shuffle(links)
    parent = {i: i for pair in links for i in pair}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.id: r.root for r in found} == {i: r for i, r in parent.items() if i != 5}
    assert len(found) == len(parent) - 1


# -- mixing ------------------------------------------------------------------
def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        total = sum(weight[s] for s in open_)
        above = {s: most * sizes[s] for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not above:
            return capped | {s: left * weight[s] / total for s in open_}
        capped |= above
        left -= sum(above.values())


@pytest.mark.parametrize("group", [3, 256])
def test_mix(spark, group):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "B", "é", "zz", None, "𝔘"]), int(rng.paretovariate(1.2) * 20))
            for i in range(3000)]
    rows += [(5000 + i, "hot", 40 + i % 7) for i in range(3000)]
    rows += [(9000, "a", 0), (9001, "nothing", 0), (9002, "a", None), (9003, "one", 10), (1, "a", 30), (1, "a", 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    df = df.withColumn("target", F.lit("clash")).repartition(5)
    found = pivotal.mix(df, group=group).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter(
        (i, s, n or 0) for i, s, n in rows
    )
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    expected = targets_by_hand(sizes)
    for r in found:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]
    for source in sizes:
        assert abs(taken[source] - expected[source]) <= largest[source] / 2 + 1e-6
    again = pivotal.mix(df.repartition(2), group=group).collect()
    assert Counter(found) == Counter(again)


def test_documents_of_any_size_are_taken_alike(spark):
    """The expected number of copies depends on the source alone, not on the size."""
    rows = [(i, "ab"[i % 2], 1 + i // 2 % 9) for i in range(7200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    copies, rate = defaultdict(list), {}
    for r in pivotal.mix(df, weights=(3, 2), share=0.9).collect():
        copies[r.source, r.size].append(r.copies)
        rate[r.source] = r.target / r.source_size
    assert rate["a"] == pytest.approx(1.08) and rate["b"] == pytest.approx(0.72)
    for (source, _), own in copies.items():
        assert abs(sum(own) / len(own) - rate[source]) < 0.1


def test_odd_sources(odd, clashing, empty):
    from reportloom.llm.common import n_words

    size = n_words(F.col("text"))
    assert pivotal.mix(odd.withColumn("size", size)).count() == 12
    assert pivotal.mix(clashing.withColumn("size", size)).count() == 12
    assert pivotal.mix(empty.withColumn("size", size)).count() == 0


# -- pipeline ----------------------------------------------------------------
def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = docs.dtypes
    from reportloom.llm.common import stored

    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), "test-stage"))
    assert all(t.dtypes == kinds for t in tables[:-1])
    ids = [Counter(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    # Quality: what the query keeps.
    kept = {r.doc_id for r in QUERIES["op3_quality"](spark, sf_dir).where("kept").collect()}
    assert set(ids[1]) == kept
    # Near duplicates: the smallest of each component of what was left.
    texts = {r.doc_id: r.text for r in tables[1].collect()}
    components_ = brute_force(texts, 5)
    assert set(ids[2]) == {i for i, (_, root) in components_.items() if root == i}
    # Secrets: all stay, and no base find is left.
    assert ids[3] == ids[2]
    from reportloom.llm import credentials

    for r in tables[3].collect():
        assert not credentials.base_spans(r.text) and r.n_chars == len(r.text)
    # Mixing: as many copies as the operator says at most two, nothing else.
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2
    # Packing: the tokens of every copy.
    lengths = tables[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    for r in lengths.collect():
        assert r.n == r.t * ids[4][r.doc_id]
    assert {r.doc_id for r in lengths.collect()} == set(ids[4])


@pytest.mark.parametrize("which", ["odd", "clashing", "empty"])
def test_pipeline_of_odd_tables(spark, sf_dir, which, request):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 0


def test_links_in_nodes_are_decided_on_whole_elements():
    """Two texts at exactly 80 percent whose elements collide in their upper 32 bits."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 80, dtype=np.uint64)
    high = common[:10] & np.uint64(0xFFFFFFFF00000000)
    common[10:20] = high | np.uint64(7)
    own = [rng.integers(0, 2**63, 10, dtype=np.uint64) for _ in range(2)]
    sets = [np.unique(np.concatenate((common, o))) for o in own]
    # One element less in common, where the shortened ones would still agree.
    other = common[79:80] ^ np.uint64(1)
    far = np.unique(np.concatenate((common[:79], own[0], other)))
    settings = chosen_path.Settings()

    def links(a, b):
        rows = {
            "node": [1, 1], "i": [0, 0], "j": [0, 0], "block": [0, 0], "rep": [5, 9], "label": [5, 9],
            "sketch": [[0, 0], [0, 0]], "elements": [x.astype("<u8").tobytes() for x in (a, b)],
        }
        return list(chosen_path._Block(pa.table(rows), settings).links())

    assert links(*sets) == [(5, 9)]
    assert links(sets[1], far) == []


def test_pipeline_keeps_different_texts_under_one_number(spark, odd):
    texts = [" ".join(f"{a}{i}" for i in range(80)) for a in "pqrs"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (4, texts[2]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "'en' as lang", "'s' as source", "1L as n_chars", "'own' as component_id"
    )
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect())
    assert found == sorted(
        [(False, 0, texts[0]), (False, 1, texts[1]), (False, 4, texts[2]), (True, 0, texts[3])]
    )


def test_stored_tables_are_numbered_in_place(spark, tmp_path):
    folder = str(tmp_path / "docs")
    spark.range(1000).selectExpr("id % 7 as doc_id", "'x' as text").repartition(5).write.parquet(folder)
    docs = spark.read.parquet(folder)
    rows = corpus_pipeline.numbered(docs, "none")
    assert set(rows.inputFiles()) == set(docs.inputFiles())
    seen = [sorted(map(tuple, rows.collect())), sorted(map(tuple, rows.coalesce(1).collect()))]
    assert seen[0] == seen[1] and len({r[2] for r in seen[0]}) == 1000
    twice = docs.withColumn("text", F.explode(F.array("text", "text")))
    again = corpus_pipeline.numbered(twice, "twice").collect()
    assert len({r["__row"] for r in again}) == 2000
    made = corpus_pipeline.numbered(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), "made")
    assert made.select("__row").distinct().count() == 2
