"""Packing, token frames, mixing and nearest neighbours: exact round trips and brute force."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberframe.llm import curriculum, nearest, packing, token_frames, tokens
from emberframe.session import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoded(docs):
    plain = Tokenizer.from_file(VOCABULARY)
    return [(r.doc_id, np.array(plain.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4")) for r in docs.select("doc_id", "text").collect()]


def test_frames_round_trip(spark, docs, no_docs, encoded):
    found = token_frames.token_frames(spark, docs, VOCABULARY).collect()
    want = [(i, len(x) + 1, zlib.crc32(np.append(x, 2).astype("<u4").tobytes())) for i, x in encoded]
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in found))) == sorted(map(str, want))
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert token_frames.token_frames(spark, no_docs, VOCABULARY).collect() == []


    some = {2, 7, 18, None}
    manifest = token_frames.write_frames(docs, VOCABULARY, shard_bytes=2000)
    assert manifest.count() > 4
    read = token_frames.read_documents(manifest, [2, 7, 18, None, 10**9]).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in read) == sorted((str(i), np.append(x, 2).astype("<u4").tobytes()) for i, x in encoded if i in some)
    assert token_frames.read_documents(manifest, []).collect() == []


BITS = ["a", "B", "word", "'s", " 's", "'", "1", "23", ".", ", ", ") ", "!?", " ", "  ", "\n", "\n\n", "\r\n", "\t", " \n", "\n ", "\u00a0", "\u3000", "é", "中文", "<|endoftext|>", "😀", "_", "-", "x.", "y,\n", "#", "...", "the ", "\x1c", "\x85"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=40))
def test_encoder_agrees_with_the_library(texts):
    """Also a special token's string is the id that the untouched library gives it."""
    plain = Tokenizer.from_file(VOCABULARY)
    found = [np.frombuffer(x, dtype="<u4").tolist() for x in tokens.encoder(VOCABULARY).encode(pa.array([*texts, None, "hello <|endoftext|> world"], pa.string()))]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, "", "hello <|endoftext|> world"]]


def test_encoder_begins_anew_and_takes_other_vocabularies(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 3)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 20)
    texts = [f"Word{i} and, word{i % 3}\nnext line {i}" for i in range(60)] + ["x" * 5000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        found = [np.frombuffer(x, dtype="<u4").tolist() for x in tokens.Encoder(path).encode(pa.array(texts))]
        assert found == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, encoded, window=1024):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sum(r.length for r in rows) == sum(len(x) + 1 for _, x in encoded)
    whole = {i: np.append(x, 0).astype("<u4") for i, x in encoded if i is not None and i != 10}
    pieces = defaultdict(list)
    for r in rows:
        if r.doc_id in whole:
            pieces[r.doc_id].append((r.start, r.length))
            assert r.doc_tokens == len(whole[r.doc_id]) and zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, own in pieces.items():
        own.sort()
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) == len(whole[i])
    return len(sequences)


def test_every_id_is_packed_once(docs, no_docs, encoded):
    ids = sum(len(x) + 1 for _, x in encoded)
    assert check_packed(packing.pack(docs.coalesce(1), VOCABULARY).collect(), encoded) <= 1.03 * ids / 1024 + 1  # every window comes from differencing, so some are short
    check_packed(packing.pack(docs, VOCABULARY, block=2).collect(), encoded)
    check_packed(packing.pack(docs, VOCABULARY, cut=False).collect(), encoded)
    assert packing.pack(no_docs, VOCABULARY).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.booleans())
def test_windows_hold_everything_once(sizes, cut):
    windows = packing.pack_sizes(sizes, 100, cut)
    assert all(sum(n for _, _, n in w) <= 100 for w in windows)
    for i, size in enumerate(sizes):
        own = sorted((s, n) for w in windows for j, s, n in w if j == i)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == size
        assert len(own) == (2 if cut and size > 50 else 1)
    if len(windows) > 1:  # near-equal: no two differ by more than the longest piece
        sums = [sum(n for _, _, n in w) for w in windows]
        assert max(sums) - min(sums) <= max(n for w in windows for _, _, n in w)


def test_the_window_count_rises_where_capacity_is_exceeded():
    assert len(packing.pack_sizes([60, 60, 60], 100)) == 3  # two windows would have room in sum
    assert len(packing.pack_sizes([60, 60, 60], 100, cut=True)) == 2  # halves fit
    assert len(packing.pack_sizes([50, 50, 50, 50, 1], 100, cut=True)) == 3
    assert sorted(sum(n for _, _, n in w) for w in packing.pack_sizes([8, 7, 6, 5, 4], 17)) in ([13, 17], [14, 16], [15, 15])


def test_mix_keeps_to_its_targets(docs, no_docs):
    rows = curriculum.ordered_plan(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert curriculum.mix(docs).columns == docs.columns
    assert curriculum.ordered_plan(no_docs).collect() == []


def test_nearest_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(dict)
    for r in nearest.nearest(vectors).collect():
        found[r.query_id][r.vec_id] = r.score
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[i]
        cosine[i] = -2
        best = ids[np.lexsort((ids, -cosine))[:5]]
        hits, total = hits + len(set(best.tolist()) & set(found[ids[i]])), total + len(best)
    assert hits >= 0.9 * total


def test_nearest_recall_with_many_more_lists_than_probes(spark):
    x = np.random.default_rng(3).standard_normal((40_000, 64)).astype(np.float32)  # 200 lists; without structure, neighbours lie on many
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    found = defaultdict(set)
    for r in nearest.nearest(frame, every=200).collect():
        found[r.query_id].add(r.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x[::200] @ x.T
    cosine[np.arange(200), np.arange(0, len(x), 200)] = -2
    hits = sum(len(set(np.argsort(-c)[:5].tolist()) & found[200 * i]) for i, c in enumerate(cosine))
    assert hits >= 0.9 * 1000


def test_nearest_recall_of_vectors_that_share_a_large_part_or_have_extreme_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 32)) + 2e4  # cosines differ in the ninth digit and beyond
    x[1::7] *= 1e200
    x[3::7] *= 1e-200
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    found = defaultdict(set)
    for r in nearest.nearest(frame).collect():
        assert abs(r.score - 1) < 1e-6
        found[r.query_id].add(r.vec_id)
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for i in range(0, len(x), 50):
        far = ((unit - unit[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        hits += len(set(np.argsort(far)[:5].tolist()) & found[i])
    assert hits >= 0.95 * 400


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (2, [2.0, 2.0]), (1, [-1.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (12, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (13, [1e39, 1.2e39]), (13, [0.0, -1.0])]
    frame = spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], "vec_id long, embedding array<double>, query string, list int")
    found = defaultdict(list)
    for r in sorted(nearest.nearest(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, round(r.score, 9)))
    half = round(0.5**0.5, 9)
    assert found[0] == [(2, half), (3, half), (13, 0.640184400), (13, 0.0), (50, 0.0)]
    assert found[50][:3] == [(13, 0.76822128), (2, half), (3, half)] and len(found) == 2
    assert nearest.nearest(frame.limit(0)).collect() == nearest.nearest(frame.where("vec_id IN (7, 8)")).collect() == []
    assert nearest.nearest(frame.where("vec_id = 0")).collect() == []
