"""Token ids of whole texts from a tokenizers file, in batches.

A byte-level vocabulary begins a new run of characters at every single space, and at every single line break, between
two characters that aren't white space. So a text is the sequence of its space-led and break-led pieces. A batch's
pieces are counted as Arrow columns, each distinct one is encoded once, and the texts' ids are gathered from them.
Short pieces are remembered from batch to batch. Where white space stands beside white space, the text
isn't cut there. Texts that hold a special token's string, and all texts of vocabularies of another kind, are encoded
whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 1_200_000  #: pieces that a worker remembers, about 60 MB; then it begins anew
MEMO_BYTES = 40  #: longer pieces aren't remembered
BATCH_BYTES = 8_000_000  #: of texts that are encoded together; a longer text goes alone
JOINED = 32_768  #: pieces that are handed to the tokenizer as one text
ENDINGS = ".,;:!?#$%&*|)"  #: where these follow a letter or a digit, a new run of characters begins, whatever they are
#: white space: the space and the line break apart from the rest, whose part beyond ASCII is written as code points
OTHER_WHITE = r"\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNCUT = rf"[ \n{OTHER_WHITE}][ \n{OTHER_WHITE}]|\A[{OTHER_WHITE}]|[{OTHER_WHITE}]\z"
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")

_encoders: dict[str, "Encoder"] = {}


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices source[starts[i] : starts[i] + lengths[i]] one after another."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts - (ends - lengths), lengths)
    return source[at]


class Encoder:
    """encode(texts) gives each text's ids."""

    memo, batch = MEMO_PIECES, BATCH_BYTES

    def __init__(self, vocabulary: str, plain: bool = False, memo: int = MEMO_PIECES, batch: int = BATCH_BYTES) -> None:
        """plain: special tokens' strings in texts are plain text. memo: pieces that are remembered. batch: bytes of texts that are encoded together."""
        self.memo, self.batch = memo, batch
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = plain
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # each piece comes once, so remembering it there as well is of no use
            self.tokenizer.model = model
        self.specials = [] if plain else [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        #: whether texts may be cut: bytes as they are, split by the usual pattern, no space put before a text
        self.cuts = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.tokenizer.normalizer is None and self.tokenizer.truncation is None
        #: of each id whether its bytes start with the space, which byte-level vocabularies write as U+0120
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith("Ġ")
        self.line = self._ids(["\n"])[0]
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        self.pieces, self.at, self.size, self.held = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, stems: pa.Array, of_line: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of plain stems that all begin with a line break, or of stems before which a space stands."""
        ids, lengths = [], []
        for at in range(0, len(stems), JOINED):
            some = stems.slice(at, JOINED)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some.cast(pa.string())), "" if of_line else " ")[0].as_py()
            (found,) = self._ids([text if of_line else " " + text])
            begins = np.flatnonzero(found == self.line[0] if of_line else self.leads[found])
            if len(begins) != len(some):
                raise ValueError("this vocabulary joins text across a space or a line break")
            ids.append(found)
            lengths.append(np.diff(np.append(begins, len(found))))
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of distinct stems: those with white space at an end or beside white space one by one, the others as joined texts."""
        of_line = pc.starts_with(stems, "\n").to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(stems, rf"\A\n?\z|\A[ {OTHER_WHITE}]|[ \n{OTHER_WHITE}][ \n{OTHER_WHITE}]|[ \n{OTHER_WHITE}]\z").to_numpy(zero_copy_only=False)
        starts, lengths, ids, held = np.zeros(len(stems), np.int64), np.zeros(len(stems), np.int64), [], 0
        for kind in (True, False):
            mine = np.flatnonzero(~alone & (of_line == kind))
            found, sizes = self._joined(stems.take(pa.array(mine)), kind)
            lengths[mine], starts[mine] = sizes, held + np.cumsum(sizes) - sizes
            ids.append(found)
            held += len(found)
        mine = np.flatnonzero(alone)
        for i, found in zip(mine.tolist(), self._ids([s if s[:1] == "\n" else " " + s for s in stems.take(pa.array(mine)).to_pylist()]), strict=True):
            starts[i], lengths[i] = held, len(found)
            ids.append(found)
            held += len(found)
        return np.concatenate(ids), starts, lengths

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of distinct pieces. A word and its ending are encoded apart, so that a word is encoded once for all its endings."""
        words = pc.utf8_rtrim(pieces, characters=ENDINGS)
        ended = pc.and_(pc.not_equal(words, pieces), pc.match_substring_regex(words, r"[\pL0-9]\z"))
        stems = pc.if_else(ended, words, pieces).dictionary_encode()
        ids, starts, lengths = self._stems(stems.dictionary)
        which = stems.indices.to_numpy(zero_copy_only=False)
        ended = ended.to_numpy(zero_copy_only=False)
        if not ended.any():
            return ids, starts[which], lengths[which]
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)[ended]
        tails = [p[n:] for p, n in zip(pieces.filter(pa.array(ended)).to_pylist(), sizes.tolist(), strict=True)]
        tails = pa.array(tails, pa.large_string()).dictionary_encode()
        endings = self._ids(tails.dictionary.to_pylist())
        tail_sizes = np.array([len(e) for e in endings], dtype=np.int64)
        tail_starts = len(ids) + np.cumsum(tail_sizes) - tail_sizes
        of_tail = tails.indices.to_numpy(zero_copy_only=False)
        # each piece is its stem and, where it has one, its ending
        first, second = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        first[ended], second[ended] = tail_starts[of_tail], tail_sizes[of_tail]
        parts = np.stack([starts[which], first], axis=1).ravel(), np.stack([lengths[which], second], axis=1).ravel()
        out = gathered(np.concatenate([ids, *endings]), *parts)
        whole = lengths[which] + second
        return out, np.cumsum(whole) - whole, whole

    def _pieces(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of these pieces."""
        if len(self.pieces) > self.memo:
            self._forget_pieces()
        coded = flat.dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        known = pc.index_in(distinct, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(known < 0)
        pieces = distinct.take(pa.array(fresh))
        ids, starts, lengths = self._new(pieces) if len(fresh) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        old = known >= 0
        begin[old], size[old] = self.at[known[old]], self.size[known[old]]
        begin[fresh], size[fresh] = len(self.held) + starts, lengths
        source = np.concatenate([self.held, ids])
        again = pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= MEMO_BYTES
        if again.any():
            mine = gathered(ids, starts[again], lengths[again])
            self.at = np.concatenate([self.at, len(self.held) + np.cumsum(lengths[again]) - lengths[again]])
            self.size = np.concatenate([self.size, lengths[again]])
            self.held = np.concatenate([self.held, mine])
            self.pieces = pa.concat_arrays([self.pieces, pieces.filter(pa.array(again))])
        return source, begin[code], size[code]

    def _cut(self, texts: pa.Array, uncut: np.ndarray) -> tuple[pa.Array, np.ndarray, list[str]]:
        """(all pieces, how many each text has, first pieces that stand for themselves). Other texts begin like a line; the break's id is taken off again."""
        led = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        if not uncut.any():
            lists = pc.split_pattern(led, " ")
            return lists.flatten().cast(pa.large_string()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), []
        # each text by itself, in order; the break is kept as the first character of what follows it
        lists, heads = [], []
        for text, whole in zip(texts.to_pylist(), uncut.tolist(), strict=True):
            if whole:
                ends = [m.start() for m in _CUT.finditer(text)]
                ends.append(len(text))
                heads.append(text[: ends[0]])
                lists.append(["\n", *(text[a + (text[a] == " ") : b] for a, b in zip(ends, ends[1:]))])  # noqa: B905
            else:
                lists.append(("\n" + text.replace("\n", " \n")).split(" "))
        return pa.array([p for own in lists for p in own], pa.large_string()), np.array([len(own) for own in lists], dtype=np.int64), heads

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers. A missing text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        upto, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + self.batch, side="right")))
            ids, lengths = self._batch(texts.slice(at, to - at))
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            for a, b in zip([0, *ends], ends):  # noqa: B905
                yield raw[a:b]
            at = to

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, each text's number of ids)."""
        apart = np.full(len(texts), not self.cuts)
        for special in self.specials if self.cuts else ():
            apart |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if apart.all():
            found = self._ids(texts.to_pylist())
            return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)
        mine = texts.filter(pa.array(~apart)) if apart.any() else texts
        uncut = pc.match_substring_regex(mine, UNCUT).to_numpy(zero_copy_only=False)
        flat, counts, first = self._cut(mine, uncut)
        source, begin, size = self._pieces(flat)
        heads = np.cumsum(counts) - counts
        if first:
            first = self._ids(first)
            own = np.array([len(x) for x in first], dtype=np.int64)
            begin[heads[uncut]], size[heads[uncut]] = len(source) + np.cumsum(own) - own, own
            source = np.concatenate([source, *first])
        begin[heads[~uncut]] += 1
        size[heads[~uncut]] -= 1
        ids, own = gathered(source, begin, size), np.add.reduceat(size, heads)
        if not apart.any():
            return ids, own
        whole = self._ids(texts.filter(pa.array(apart)).to_pylist())
        lengths, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        lengths[~apart], lengths[apart] = own, [len(x) for x in whole]
        starts[~apart], starts[apart] = np.cumsum(own) - own, len(ids) + np.cumsum(lengths[apart]) - lengths[apart]
        return gathered(np.concatenate([ids, *whole]), starts, lengths), lengths


class PieceEncoder(Encoder):
    """Ids of texts by a sentencepiece model that puts a space before each text.

    Where no piece has a space after another character, a text is the sequence of its units, each some spaces and
    what follows up to the next space; distinct units are encoded once and remembered. Texts of other models are encoded whole.
    """

    def __init__(self, model: str, memo: int = MEMO_PIECES) -> None:
        import sentencepiece

        self.memo = memo
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self._forget_pieces()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in self.model.encode(texts, num_threads=1)]

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units = pieces.to_pylist()
        found = [ids if unit else np.array([self.space], np.uint32) for unit, ids in zip(units, self._ids(units), strict=True)]
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        return np.concatenate(found), np.cumsum(lengths) - lengths, lengths

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            found = self._ids(texts.to_pylist())
            return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)
        odd = pc.match_substring_regex(texts, r"\A |  | \z|▁").to_numpy(zero_copy_only=False)
        if odd.any():
            lists = [[unit[1:] for unit in _UNITS.findall(" " + text.replace("▁", " "))] if one else text.split(" ") for text, one in zip(texts.to_pylist(), odd.tolist(), strict=True)]
            flat, counts = pa.array([u for own in lists for u in own], pa.large_string()), np.array([len(own) for own in lists], dtype=np.int64)
        else:
            lists = pc.split_pattern(texts, " ")
            flat, counts = lists.flatten().cast(pa.large_string()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        source, begin, size = self._pieces(flat)
        ids, heads = gathered(source, begin, size), np.cumsum(counts) - counts
        own = np.add.reduceat(size, heads) if len(size) else np.zeros(0, np.int64)
        own[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0  # the empty text has no space put before it
        if len(ids) != own.sum():
            ids = ids[np.repeat(~pc.equal(texts, "").to_numpy(zero_copy_only=False), np.add.reduceat(size, heads))]
        return ids, own


_UNITS = re.compile(r" +[^ ]*")


def encoder(vocabulary: str, kind: type[Encoder] = Encoder, **options) -> Encoder:
    """The worker's encoder of this vocabulary."""
    key = f"{kind.__name__} {vocabulary} {options}"
    if key not in _encoders:
        _encoders[key] = kind(vocabulary, **options)
    return _encoders[key]


def forget() -> None:
    """Frees what the worker remembers of earlier encoding: stages of another kind that Spark runs in the same worker need the memory."""
    _encoders.clear()
    trim()


def trim() -> None:
    """Hands memory that earlier tasks of this worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library knows it
        ctypes.CDLL(None).malloc_trim(0)
