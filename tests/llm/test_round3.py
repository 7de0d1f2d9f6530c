"""Alignment, periodic runs and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberframe.llm import alignment, periodic, registry, simhash
from emberframe.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


# alignment


def aligned_brute(rows):
    """Rows of the query, from (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    source, starts, lengths = alignment.byte_tables(A, B)[0]
    held = []
    for doc_id, text in rows:
        full = (" " + (text or "")).encode()
        a, b = one.encode(" " + (text or ""), add_special_tokens=False).ids, two.encode(text or "")
        of_a = [source[starts[i] : starts[i] + lengths[i]].tobytes() for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
        if not text or b"".join(of_a) != full or b"".join(of_b) != full:
            held.append((doc_id, [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (of_a, of_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, p, q = [], 0, 0
        for end in common:
            x, y = ends[0].index(end, p) + 1, ends[1].index(end, q) + 1
            groups.append((a[p:x], b[q:y]))
            p, q = x, y
        held.append((doc_id, a, b, groups))
    counts = Counter()
    for _, _, _, groups in held:
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups in held:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), text))
    return sorted(out, key=str)


def test_alignment_against_brute_force(docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(alignment.align(docs, A, B)) == aligned_brute(rows)


def test_alignment_of_odd_texts(spark):
    rng = random.Random(5)
    texts = ["", " ", "▁", "a▁b", "<s> x </s>", "<|endoftext|>", "tab\tline\nend ", "  two  spaces ", "漢字かな交じり文", "naïve 😀😀", "x" * 5000, " é́", "a\x00b", "👩‍👩‍👧‍👦"]
    texts += ["".join(rng.choice(" \n\tabcé漢▁0<>|") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = list(enumerate(texts))
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert rows_of(found) == aligned_brute(rows)


def test_alignment_in_small_pieces(spark):
    """Spans, slices, blocks and lists of links of any size give the same rows."""
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(26, size=1 + int(n))) for n in rng.integers(9, size=40)) for _ in range(12)] + ["", "漢字" * 30]
    press = [(i, i if i % 5 else None, t) for i, t in enumerate(texts)]
    import pyarrow as pa

    import emberframe.llm.alignment as m

    def result():
        batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in press]) for i in range(3)], names=["row", "doc_id", "text"])
        events = pa.Table.from_batches(m._events(iter([batch]), A, B)).sort_by([("row", "ascending"), ("span", "ascending"), ("side", "ascending")])
        class Context:
            partitionId = staticmethod(lambda: 0)
        m.TaskContext.get, kept = staticmethod(lambda: Context), m.TaskContext.get
        try:
            blocks = pa.Table.from_batches(m._sweep(iter(events.to_batches(max_chunksize=3)), [t[2] for t in m.byte_tables(A, B)]))
        finally:
            m.TaskContext.get = kept
        asked = pa.Table.from_batches(m._asked(iter(blocks.to_batches())))
        n = asked.group_by("pair").aggregate([("docs", "sum")]).rename_columns(["pair", "n"])
        n = n.append_column("best", pa.array([1] * len(n)))
        return sorted((tuple(r.values()) for i in range(len(blocks)) for r in m._aligned(blocks.slice(i, 1), n).to_pylist()), key=str), dict(zip(n["pair"].to_pylist(), n["n"].to_pylist(), strict=True))

    whole = result()
    held = {name: getattr(m, name) for name in ("SPAN", "SLICE_ROWS", "BLOCK_TOKENS", "LINKS", "SLICE_BYTES")}
    try:
        m.SPAN, m.SLICE_ROWS, m.BLOCK_TOKENS, m.LINKS, m.SLICE_BYTES = 16, 2, 50, 3, 100
        assert result() == whole
    finally:
        for name, value in held.items():
            setattr(m, name, value)


def test_alignment_of_nothing(no_docs):
    assert alignment.align(no_docs, A, B).collect() == []


def test_alignment_query(spark, small):
    found = registry.op11_alignment(spark, small).toPandas().set_index("doc_id")
    want = aligned_brute([(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()])
    assert len(found) == len(want)
    for doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, text in want:
        row = found.loc[doc_id]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert row.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if n_a else "")


# periodic runs


def runs_brute(words, least=12):
    """All runs, straight from the definition."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(least, 2 * q) and not any(all(words[start + k] == words[start + k + p] for k in range(length - p)) for p in range(1, q)):
                out.add((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 13))
def test_runs_against_brute_force(ids, least):
    assert periodic.runs_of(ids, least) == [r for r in runs_brute(ids, least) if r[1] >= least]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8)), max_size=8))
def test_runs_of_repeated_parts(parts):
    words = [f"w{x}" for part, times in parts for x in part * times]
    runs, rest = periodic.text_runs(" ".join(words))
    assert runs == runs_brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    assert rest == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_long_words_of_few_letters():
    """Fibonacci and Thue-Morse sequences, and periods of many words: long extensions, and hashes that collide."""
    for n in (60, 150):
        fibonacci, thue = [0], [bin(i).count("1") & 1 for i in range(n)]
        other = [0, 1]
        while len(fibonacci) < n:
            fibonacci, other = other, other + fibonacci
        for ids in (fibonacci[:n], thue, ([*range(37)] * 5)[:n], [0] * n):
            assert periodic.runs_of(ids) == runs_brute(ids)
    thue = [bin(i).count("1") & 1 for i in range(4096)]
    reach = periodic.Extensions(thue)
    for i, j in ((0, 2048), (5, 1024), (0, 1536), (100, 3000)):
        same = next((k for k in range(4096 - j) if thue[i + k] != thue[j + k]), 4096 - j)
        assert reach.ahead(i, j, 4096 - j) == same


def changed(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digests_brute(doc_id, words):
    runs = periodic.runs_of([*map({w: i for i, w in enumerate(dict.fromkeys(words))}.get, words)])  # held against brute force above
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_against_brute_force(docs, no_docs):
    query = lambda d: periodic.digests(periodic.periodic_runs(d.withColumn("text", periodic.repeated_text(F.col("doc_id"), F.col("text")))))
    want = [digests_brute(r.doc_id, changed(r.doc_id, r.text)) for r in docs.collect()]
    assert rows_of(query(docs)) == sorted(want, key=str)
    assert query(no_docs).collect() == []


def test_runs_query(spark, small):
    want = [digests_brute(r.doc_id, changed(r.doc_id, r.text)) for r in table(spark, small, "documents").collect()]
    assert sum(x[1] for x in want) > 0
    assert rows_of(registry.op12_periodic_runs(spark, small)) == sorted(want, key=str)


# SimHash


def print_brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components_brute(rows):
    """(doc_id, fingerprint, component_id), from (doc_id, fingerprint)."""
    ids = sorted({p for _, p in rows})
    over = {p: p for p in ids}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for a, b in combinations(ids, 2):
        if (a ^ b).bit_count() <= 4:
            over[top(a)] = top(b)
    least = {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[top(p)] = min(least.get(top(p), doc_id), doc_id)
    return sorted(((doc_id, f"{p:016x}", least.get(top(p))) for doc_id, p in rows), key=str)


def test_triples_cover_all_fours():
    found = simhash.triples()
    assert len(found) == 20
    assert all(any(set(t) <= set(four) for t in found) for four in combinations(range(8), 4))


def test_simhash_against_brute_force(docs, no_docs):
    want = components_brute([(r.doc_id, print_brute(r.text)) for r in docs.collect()])
    assert rows_of(simhash.simhash_groups(docs)) == want
    assert simhash.simhash_groups(no_docs).collect() == []


def test_simhash_query(spark, small):
    want = components_brute([(r.doc_id, print_brute(r.text)) for r in table(spark, small, "documents").collect()])
    assert rows_of(registry.op13_simhash(spark, small)) == want


def test_fingerprint_in_parts(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PART", 100)
    assert simhash.fingerprint(text) == whole == print_brute(text)


def test_simhash_links_of_a_dense_group(spark, monkeypatch):
    """A group larger than a block, chains of few bits, and pairs at the limit: no link is lost and a group costs a row a member, not a pair."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = int(rng.integers(1 << 62))
    ids = {base}
    for i in range(150):
        ids.add(base ^ sum(1 << int(b) for b in rng.choice(64, size=3, replace=False)))
    lone = [int(x) for x in rng.integers(1 << 62, size=200)]
    for x in lone[:60]:
        ids.add(x ^ sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(3, 7)), replace=False)))
    ids |= set(lone)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in ids]
    members = spark.createDataFrame([(x,) for x in signed], "id long").repartition(5)
    links = simhash.edges(members).collect()
    want = components_brute([(i, x) for i, x in enumerate(sorted(ids))])
    over = {x & (1 << 64) - 1: x & (1 << 64) - 1 for x in signed}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for r in links:
        over[top(r.a & (1 << 64) - 1)] = top(r.b & (1 << 64) - 1)
    number = {x: i for i, x in enumerate(sorted(ids))}
    least = {}
    for x in sorted(ids):
        least.setdefault(top(x), number[x])
    assert sorted(((number[x], f"{x:016x}", least[top(x)]) for x in ids), key=str) == want
