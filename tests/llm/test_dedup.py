"""Exact and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberframe.llm import exact_dedup, near_dedup
from emberframe.session import table

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def exact_brute(rows):
    """{(doc_id, keep_id, size, digest): rows}, without kept."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[hashlib.sha256(WHITE.sub("", text or "").encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for digest, own in groups.items():
        best = min(own)
        out += [(None if null else i, None if best[1] else best[2], len(own), digest) for _, null, i in own]
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_exact_against_brute_force(docs):
    rows = docs.collect()
    found = exact_dedup.exact_dedup(docs).collect()
    assert by_text((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == by_text(exact_brute(rows))
    kept = defaultdict(int)
    for r in found:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_with_all_or_no_history(docs):
    from pyspark.sql import functions as F

    want = by_text(exact_brute(docs.collect()))
    for history in (F.lit(True), F.lit(False)):
        found = exact_dedup.exact_dedup(docs, history).collect()
        assert by_text((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_minimal_perfect_hash(keys, others):
    keys = np.array(sorted(keys), dtype=np.uint64)
    levels, bits, slots = exact_dedup.build_hash(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (exact_dedup.look_up(levels, bits, keys) == slots).all()
    found = exact_dedup.look_up(levels, bits, np.array(sorted(others), dtype=np.uint64))
    assert ((found >= -1) & (found < max(1, len(keys)))).all()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def near_brute(rows, n):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [(i, shingles(t, n)) for i, t, *_ in rows]
    over = {}

    def top(x):
        while over.get(x, x) != x:
            x = over[x]
        return x

    linked = [(i, s) for i, s in sets if i is not None and s]
    for at, (i, s) in enumerate(linked):
        for j, t in linked[:at]:
            both = len(s & t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = top(i), top(j)
                over[max(a, b)] = min(a, b)
    return by_text((i, len(s), top(i) if i is not None else None) for i, s in sets)


def near_found(frame):
    rows = frame.collect()
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in rows)
    return by_text((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_near_against_brute_force(docs):
    assert near_found(near_dedup.near_groups(docs, words=4)) == near_brute(docs.collect(), 4)


def test_near_on_given_documents(spark, small):
    docs = table(spark, small, "documents")
    assert near_found(near_dedup.near_groups(docs)) == near_brute(docs.select("doc_id", "text").collect(), 5)


def test_near_of_nothing(no_docs, docs):
    assert near_dedup.near_groups(no_docs).collect() == []
    assert {r.component_id == r.doc_id for r in near_dedup.near_groups(docs.where("doc_id IN (2, 4, 7)")).collect()} == {True}


def test_components_in_rounds(spark):
    """Chains and stars over many tasks, joined by rounds."""
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 301), (301, 300), (302, 302)]
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), in_task=5)
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {300: 300, 301: 300}
    assert {r.id: r.component for r in found.collect()} == want


def test_block_comparison_of_large_nodes(spark, monkeypatch):
    """Nodes beyond a block's size lose no pair."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    sets = [near_dedup.shingle_set(" ".join(f"t{j}" for j in range(100 + i % 3)), 5) for i in range(30)]
    for main in (0, 20):  # members in the main component
        rows = [(i, 1, 0 if i < main else i, 0, 30, max(1, main), len(s), bytearray(near_dedup.signature(s)[::4]), bytearray(near_dedup.sketch(s))) for i, s in enumerate(sets)]
        members = spark.createDataFrame(rows, "id long, node long, component long, main long, size long, most long, n long, marks binary, sketch binary")
        found = [tuple(sorted((r.a, r.b))) for r in near_dedup.node_pairs(members, (80, 100)).collect()]
        assert sorted(found) == [(i, j) for i in range(30) for j in range(i + 1, 30) if j >= main]


def test_a_repeated_doc_id_with_different_texts_loses_no_link(spark):
    one, two = (" ".join(f"{x}{j}" for j in range(200)) for x in "pq")
    rows = [(5, one), (5, two), (7, two + " more"), (9, one + " more"), (9, one + " more"), (3, "quite another text of a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_found(near_dedup.near_groups(docs, words=4)) == near_brute(rows, 4)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_groups(docs, words=4).collect()} == {(5, 5), (7, 5), (9, 5), (3, 3)}


def large_group(spark, count):
    """Near copies of one text, each with runs of its own at some of many places, so that copies differ from each other more than from the text."""
    rng = np.random.default_rng(5)
    base = [f"b{j}" for j in range(150)]
    rows = []
    for i in range(count):
        words = list(base)
        for place in rng.choice(30, size=rng.integers(0, 5), replace=False):
            words[5 * place] = f"x{rng.integers(3)}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_a_large_group_of_near_copies_is_not_branched(spark, monkeypatch):
    made, branches = [], near_dedup.branches
    monkeypatch.setattr(near_dedup, "branches", lambda members, depth: made.append(members.count()) or branches(members, depth))
    rows = near_dedup.near_groups(large_group(spark, 6000), words=4).collect()
    assert len(rows) == 6000 and sum(r.component_id == 0 for r in rows) >= 0.99 * len(rows)
    assert sum(made) * near_dedup.BRANCHES < 6000


def test_worn_down_nodes_lose_no_link(spark, monkeypatch):
    """With nodes that are large from a few pairs on, the same components as by brute force."""
    monkeypatch.setattr(near_dedup, "FEW", 200)
    docs = large_group(spark, 300)
    assert near_found(near_dedup.near_groups(docs, words=4)) == near_brute(docs.collect(), 4)


def test_decisions_hold_when_a_later_scan_is_split_otherwise(spark, small, monkeypatch):
    import corpus_pipeline
    from emberframe.llm import rows
    from emberframe.session import stored, table

    docs = stored(table(spark, small, "documents").unionByName(table(spark, small, "documents")).coalesce(1), "twice")
    key, cut = "spark.sql.files.maxPartitionBytes", rows.cut
    before = spark.conf.get(key)

    def shifting(df):
        out = cut(df)
        spark.conf.set(key, "20000")
        return out

    monkeypatch.setattr(rows, "cut", shifting)
    try:
        found = corpus_pipeline.exact(spark, docs, small)
        assert found.columns == docs.columns
        texts = ["".join((r.text or "").split()) for r in found.collect()]
    finally:
        spark.conf.set(key, before)
    assert len(texts) == len(set(texts)) <= docs.count() / 2
