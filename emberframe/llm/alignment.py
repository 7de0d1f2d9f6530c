"""Cross-tokenizer alignment by an event sweep.

Each text is encoded by a byte-level vocabulary (A, with a space before the text) and a sentencepiece model (B, which adds the
space). The end of every token is an event. One scan of the texts yields the events of both, in rows of one document, side and
SPAN of bytes: an event's offset follows from the lengths of its row's tokens, so that a token travels as its id alone. Rows are
dealt by document and sorted by offset within partitions; a machine that holds no more than the open group sweeps over
them: where tokens of A and B end at the same byte, a group closes. Every pair of an A and a B token of a group is a link.

How many documents hold an id pair linked is counted corpus-wide. Documents lie in blocks; each block asks once for its distinct
pairs, a join gives counts, and the answers go back to the block, so that neither counts nor links meet on the driver or
in a broadcast. Only the greatest count of each A id is broadcast: a row per entry of the vocabulary.

Defined results. A text that is null or empty, or that one of the vocabularies doesn't give back byte for byte (one with U+2581,
which B reads as a space), has no tokens: zeros and groups ''. Special tokens' strings are plain text. Every row is a document of its own, also rows
with the same doc_id or none; both count for a pair. A group's links are counted as products of distinct ids where it is very
large. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.rows import row_of
from emberframe.llm.tokens import Encoder, PieceEncoder, encoder, forget, gathered
from emberframe.session import cut, shuffle_partitions, stored

SPAN = 1 << 18  #: bytes of a document whose events travel in one row
SLICE_BYTES = 2_000_000  #: of texts that are encoded together
SLICE_ROWS = 256  #: event rows that are swept together, at most
MEMO = 400_000  #: pieces that a worker remembers of either vocabulary
BLOCK_TOKENS = 1 << 20  #: tokens of a block of documents, about; a longer document is a block of its own
LINKS = 1 << 19  #: links that are listed at once; a larger group is counted by distinct ids
SHIFT = 32  #: an id pair is a << SHIFT | b

EVENTS = "row long, span long, side int, doc_id long, start long, ids binary"
BLOCKS = "block long, docs binary, a binary, b binary, a_ends binary, b_ends binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _encoders(a: str, b: str) -> tuple[Encoder, PieceEncoder]:
    return encoder(a, plain=True, memo=MEMO), encoder(b, PieceEncoder, memo=MEMO)


def byte_tables(a: str, b: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For A and B: (bytes of all tokens, start of each, length of each)."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level vocabularies write as themselves
    hidden = [x for x in range(256) if x not in visible]
    plain = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
    of_a, of_b = _encoders(a, b)[0].tokenizer, _encoders(a, b)[1].model
    tokens = [[b""] * of_a.get_vocab_size(), []]
    for token, i in of_a.get_vocab().items():
        tokens[0][i] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
    for i in range(of_b.get_piece_size()):
        piece = of_b.id_to_piece(i)
        tokens[1].append(bytes([int(piece[3:5], 16)]) if of_b.is_byte(i) else piece.replace("▁", " ").encode())
    out = []
    for own in tokens:
        lengths = np.array([len(t) for t in own], dtype=np.int64)
        out.append((np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths))
    return out


def _given_back(ids: np.ndarray, counts: np.ndarray, table: tuple, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text whether its tokens' bytes are its bytes. raw: all texts' bytes, sizes: each text's."""
    source, starts, lengths = table
    of, doc = lengths[ids], np.repeat(np.arange(len(counts)), counts)
    fine = np.bincount(doc, weights=of, minlength=len(counts)).astype(np.int64) == sizes
    mine, texts = fine[doc], np.repeat(fine, sizes)
    wrong = np.flatnonzero(gathered(source, starts[ids[mine]], of[mine]) != raw[texts])
    if len(wrong):
        fine[np.repeat(np.arange(len(counts)), sizes)[texts][wrong]] = False
    return fine


def _events(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """The end events of both encodings. A document without tokens is a row without ids."""
    encoders, tables = _encoders(a, b), byte_tables(a, b)
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        every = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
        upto, at = np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False)), 0
        while at < len(every):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            texts, rows, doc_ids = every.slice(at, to - at), batch.column(0)[at:to].to_pylist(), batch.column(1)[at:to].to_pylist()
            full = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
            sizes = pc.binary_length(full).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.frombuffer(b"".join(x.encode() for x in full.to_pylist()), dtype=np.uint8)
            fine, found = sizes > 1, []
            for one, table, given in zip(encoders, tables, (full, texts), strict=True):
                ids, counts = one._batch(given)
                fine &= _given_back(ids, counts, table, raw, sizes)
                ends = np.cumsum(counts)
                found.append((ids, ends - counts, ends, table[2]))
            out: list[tuple] = []
            for i, good in enumerate(fine.tolist()):
                if not good:
                    out.append((rows[i], 0, 0, doc_ids[i], 0, b""))
                    continue
                for side, (ids, starts, ends, lengths) in enumerate(found):
                    own = ids[starts[i] : ends[i]]
                    if sizes[i] <= SPAN:
                        out.append((rows[i], 0, side, doc_ids[i], 0, press.compress(own.astype("<u4" if len(lengths) > 1 << 16 else "<u2").tobytes())))
                        continue
                    closes = np.cumsum(lengths[own])
                    spans = (closes - 1) // SPAN
                    cuts = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(own)]
                    for x, y in zip(cuts, cuts[1:]):  # noqa: B905
                        start = int(closes[x - 1]) if x else 0
                        out.append((rows[i], int(spans[x]), side, doc_ids[i], start, press.compress(own[x:y].astype("<u4" if len(lengths) > 1 << 16 else "<u2").tobytes())))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "span", "side", "doc_id", "start", "ids"])
            at = to


class _Block:
    """Documents that have been swept: per document (doc_id, has one, n_a, n_b, n_groups, n_links), and all their tokens."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.parts: list[list[np.ndarray]] = [[], [], [], []]  # a, b, a_ends, b_ends
        self.tokens = 0

    def add(self, parts: list[np.ndarray]) -> None:
        for own, part in zip(self.parts, parts, strict=True):
            own.append(part.astype(np.uint32) if part.dtype == np.int64 else part)
        self.tokens += len(parts[0]) + len(parts[1])

    def row(self, block: int) -> dict:
        press = zstandard.ZstdCompressor(level=3)
        a, b, a_ends, b_ends = (np.concatenate(p) if p else np.zeros(0, np.uint16) for p in self.parts)
        blob = lambda x: press.compress(x.tobytes())
        small = lambda x: x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4")
        wide = lambda x: bytes([small(x).itemsize]) + blob(small(x))
        return {"block": block, "docs": blob(np.array(self.docs, dtype=np.int64)), "a": wide(a), "b": wide(b), "a_ends": blob(np.packbits(a_ends.astype(bool))), "b_ends": blob(np.packbits(b_ends.astype(bool)))}


def _sweep(batches: Iterator[pa.RecordBatch], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of swept documents from event rows in the order of row, span and side. lengths: of each token of A and of B, in bytes."""
    forget()
    open_zstd = zstandard.ZstdDecompressor()
    kinds = ["<u4" if len(x) > 1 << 16 else "<u2" for x in lengths]
    first, seq, block = TaskContext.get().partitionId() << 32, 0, _Block()
    now: list = [None, None]  # the document that is being swept: its row, its counts
    carry = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # the open group: ids and end offsets of each side

    def finish() -> Iterator[pa.RecordBatch]:
        nonlocal block, seq
        if now[0] is not None:
            block.docs.append(tuple(now[1]))
        if block.docs and block.tokens >= BLOCK_TOKENS or block.docs and len(block.docs) >= 4096:
            yield pa.RecordBatch.from_pylist([block.row(first + seq)])
            seq, block = seq + 1, _Block()

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            rows, sides, starts = (some.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 4))
            docs = np.concatenate([[0], np.cumsum(rows[1:] != rows[:-1])])
            if now[0] != rows[0]:  # the last slice's document has ended there
                yield from finish()
                now, carry = [None, None], [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
            blobs = some.column(5).to_pylist()
            events = []
            for side in (0, 1):
                own = [(i, np.frombuffer(open_zstd.decompress(blobs[i]), dtype=kinds[side])) for i in np.flatnonzero(sides == side).tolist() if blobs[i]]
                ids = np.concatenate([carry[side][0], *(x.astype(np.int64) for _, x in own)])
                n = np.array([len(x) for _, x in own], dtype=np.int64)
                which = np.array([i for i, _ in own], dtype=np.int64)
                size = lengths[side][ids[len(carry[side][0]) :]].astype(np.int64)
                total = np.cumsum(size)
                heads = np.cumsum(n) - n
                ends = total - np.repeat(total[heads] - size[heads], n) + np.repeat(starts[which], n) if len(n) else total
                doc = np.concatenate([np.zeros(len(carry[side][0]), np.int64), np.repeat(docs[which], n)])
                events.append((ids, doc, np.concatenate([carry[side][1], ends])))
            (ia, da, ea), (ib, db, eb) = events
            ka, kb = (da << 40) + ea, (db << 40) + eb
            place = np.searchsorted(kb, ka)
            hit = np.zeros(len(ka), dtype=bool)
            inside = place < len(kb)
            hit[inside] = kb[place[inside]] == ka[inside]
            hit_b = np.zeros(len(kb), dtype=bool)
            hit_b[place[hit]] = True
            # what stands after the last common end is open; it belongs to the slice's last document
            upto_a, upto_b = (int(np.flatnonzero(h)[-1]) + 1 if h.any() else 0 for h in (hit, hit_b))
            carry = [(ia[upto_a:], ea[upto_a:]), (ib[upto_b:], eb[upto_b:])]
            ia, da, hit, ib, db, hit_b = ia[:upto_a], da[:upto_a], hit[:upto_a], ib[:upto_b], db[:upto_b], hit_b[:upto_b]
            last_a, last_b = np.flatnonzero(hit), np.flatnonzero(hit_b)
            links = np.diff(last_a, prepend=-1) * np.diff(last_b, prepend=-1)
            held = int(docs[-1]) + 1
            per = np.zeros((held, 4), dtype=np.int64)
            per[:, 0], per[:, 1], per[:, 2] = np.bincount(da, minlength=held), np.bincount(db, minlength=held), np.bincount(da[last_a], minlength=held)
            upto = np.concatenate([[0], np.cumsum(links)])
            groups = np.concatenate([[0], np.cumsum(per[:, 2])])
            per[:, 3] = np.diff(upto[groups])
            names = some.column(3)
            heads = np.flatnonzero(np.diff(docs, prepend=-1)).tolist()
            edge_a, edge_b = np.searchsorted(da, np.arange(held + 1)), np.searchsorted(db, np.arange(held + 1))
            for i in range(held):
                if i or now[0] is None:
                    if i:
                        yield from finish()
                    name = names[heads[i]].as_py()
                    now = [int(rows[heads[i]]), [name or 0, name is not None, 0, 0, 0, 0]]
                now[1][2:] = [x + y for x, y in zip(now[1][2:], per[i].tolist(), strict=True)]
                p, q, r, s = edge_a[i], edge_a[i + 1], edge_b[i], edge_b[i + 1]
                if q > p:
                    block.add([ia[p:q], ib[r:s], hit[p:q], hit_b[r:s]])
    yield from finish()
    if block.docs:
        yield pa.RecordBatch.from_pylist([block.row(first + seq)])


def _opened(block: dict) -> tuple[np.ndarray, ...]:
    """docs, a, b, the groups' first token and number of tokens on either side, and each group's document."""
    open_zstd = zstandard.ZstdDecompressor()
    docs = np.frombuffer(open_zstd.decompress(block["docs"]), dtype=np.int64).reshape(-1, 6)
    wide = lambda x: np.frombuffer(open_zstd.decompress(x[1:]), dtype=f"<u{x[0]}").astype(np.int64)
    a, b = wide(block["a"]), wide(block["b"])
    ends = lambda x, n: np.flatnonzero(np.unpackbits(np.frombuffer(open_zstd.decompress(x), dtype=np.uint8), count=n))
    a_ends, b_ends = ends(block["a_ends"], len(a)), ends(block["b_ends"], len(b))
    starts = lambda e: np.concatenate([[0], e[:-1] + 1]) if len(e) else e
    a_start, b_start = starts(a_ends), starts(b_ends)
    return docs, a, b, a_start, a_ends - a_start + 1, b_start, b_ends - b_start + 1, np.repeat(np.arange(len(docs)), docs[:, 4])


def _links(opened: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, document, how often) of a block's links, in the order of documents, about LINKS at once."""
    _, a, b, a_start, na, b_start, nb, doc = opened
    n = na * nb
    upto, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, side="right")))
        if n[at] > LINKS:
            p, times = np.unique(a[a_start[at] : a_start[at] + na[at]], return_counts=True)
            q, often = np.unique(b[b_start[at] : b_start[at] + nb[at]], return_counts=True)
            step = max(1, LINKS // len(q))
            for x in range(0, len(p), step):
                pair = ((p[x : x + step, None] << SHIFT) | q).ravel()
                yield pair, np.full(len(pair), doc[at]), (times[x : x + step, None] * often).ravel()
        else:
            own = n[at:to]
            group = np.repeat(np.arange(at, to), own)
            k = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            pair = (a[a_start[group] + k // nb[group]] << SHIFT) | b[b_start[group] + k % nb[group]]
            yield pair, doc[group], np.ones(len(pair), dtype=np.int64)
        at = to


def _distinct(x: np.ndarray) -> np.ndarray:
    found = np.sort(x)
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct pairs with the number of its documents that hold them linked."""
    forget()
    for batch in batches:
        for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            found, numbers, rest = [], [], (-1, np.zeros(0, np.int64))  # rest: the last document's pairs, which the next part may go on with
            for pair, doc, _ in _links(_opened(block)):
                codes, of = np.unique(pair, return_inverse=True)
                seen = _distinct(doc * len(codes) + of)
                doc, pair = seen // max(1, len(codes)), codes[seen % max(1, len(codes))]
                begins = np.searchsorted(doc, rest[0], side="right")
                if begins:
                    rest = (rest[0], np.union1d(rest[1], pair[:begins]))
                    doc, pair = doc[begins:], pair[begins:]
                if len(doc):
                    found.append(rest[1])
                    tail = np.searchsorted(doc, doc[-1])
                    rest = (int(doc[-1]), pair[tail:])
                    some, n = np.unique(pair[:tail], return_counts=True)
                    found.append(some)
                    numbers += [np.ones(len(found[-2]), np.int64), n]
            found.append(rest[1])
            numbers.append(np.ones(len(rest[1]), np.int64))
            pairs, of = np.unique(np.concatenate(found), return_inverse=True)
            total = np.bincount(of, weights=np.concatenate(numbers), minlength=len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block["block"])), pa.array(pairs), pa.array(total)], names=["block", "pair", "docs"])


def _written(opened: tuple[np.ndarray, ...]) -> pa.Array:
    """Each document's groups as a1,a2|b1;a3|b2,b3."""
    docs, a, b, a_start, na, b_start, nb, doc = opened
    if not len(doc):
        return pa.array([""] * len(docs), pa.string())
    group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    at_a = np.arange(len(a)) + b_start[group_a]
    at_b = np.arange(len(b)) + (a_start + na)[group_b]
    last = np.zeros(len(na), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    last[-1] = True
    mark_a = np.where(np.arange(len(a)) == (a_start + na - 1)[group_a], 1, 0)
    mark_b = np.where(np.arange(len(b)) == (b_start + nb - 1)[group_b], np.where(last[group_b], 3, 2), 0)
    code = np.empty(len(a) + len(b), dtype=np.int64)
    code[at_a], code[at_b] = a * 4 + mark_a, b * 4 + mark_b
    codes, of = np.unique(code, return_inverse=True)
    texts = pa.array([f"{c >> 2}{(',', '|', ';', '')[c & 3]}" for c in codes.tolist()], pa.string()).take(pa.array(of))
    offsets = np.concatenate([[0], np.cumsum(docs[:, 2] + docs[:, 3])])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), texts), "")


def _aligned(block: pa.Table, answers: pa.Table) -> pa.Table:
    """A row per document of one block, with the corpus-wide counts of its pairs."""
    forget()
    out = []
    order = pc.sort_indices(answers["pair"])
    pairs, counts, best = (answers[c].take(order).to_numpy() for c in ("pair", "n", "best"))
    for one in block.to_pylist():
        opened = _opened(one)
        docs = opened[0]
        total, at_best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for pair, doc, often in _links(opened):
            place = np.searchsorted(pairs, pair)
            edges = np.searchsorted(doc, np.arange(len(docs) + 1))
            for to, value in ((total, often * counts[place]), (at_best, often * best[place])):
                to += np.diff(np.concatenate([[0], np.cumsum(value)])[edges])
        names = pa.array(docs[:, 0], mask=docs[:, 1] == 0)
        out.append(pa.table([names, *(pa.array(docs[:, i]) for i in range(2, 6)), pa.array(at_best), pa.array(total), _written(opened)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
    return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())]))


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups. a: path of a byte-level tokenizers file, b: of a sentencepiece model."""
    spark = docs.sparkSession
    given = docs.select(row_of().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    events = given.mapInArrow(partial(_events, a=a, b=b), EVENTS)
    dealt = events.repartition(shuffle_partitions(spark), "row").sortWithinPartitions("row", "span", "side")
    lengths = [t[2].astype(np.uint32) for t in byte_tables(a, b)]
    blocks = stored(dealt.mapInArrow(partial(_sweep, lengths=lengths), BLOCKS), "aligned")
    asked = cut(blocks.mapInArrow(_asked, "block long, pair long, docs long"))
    counted = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    most = counted.groupBy(F.shiftright("pair", SHIFT).alias("of_a")).agg(F.max("n").alias("most"))
    rated = counted.withColumn("of_a", F.shiftright("pair", SHIFT)).join(F.broadcast(most), "of_a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    answers = asked.select("block", "pair").join(rated, "pair")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_aligned, ALIGNED)
