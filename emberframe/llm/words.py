"""Words of whole texts as 64-bit hashes, and their shingles."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20  #: bytes of a text that are hashed at once; a word is never cut
A = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95  #: odd, so that it has an inverse among 64-bit integers
BYTE = np.random.default_rng(77).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for step in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 12), np.uint64(step))
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _part_hashes(raw: np.ndarray) -> np.ndarray:
    white = np.ones(len(raw) + 2, dtype=bool)
    white[1:-1] = WHITE[raw]
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[raw] * power[: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverse[starts])  # the same wherever the word stands


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ in UTF-8, A-Z lower-cased."""
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8) if text else np.zeros(0, dtype=np.uint8)
    found, at = [], 0
    while len(raw) - at > CHUNK:
        rest = np.flatnonzero(WHITE[raw[at + CHUNK : at + 2 * CHUNK]])
        to = at + CHUNK + int(rest[0]) if len(rest) else len(raw)  # a word beyond all measure: the rest at once
        found.append(_part_hashes(raw[at:to]))
        at = to
    found.append(_part_hashes(raw[at:]))
    return np.concatenate(found) if len(found) > 1 else found[0]


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n successive words; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(count, n, dtype=np.uint64)
        for i in range(n):
            h = h * A + hashes[i : i + count]
    return mixed(h)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """In ascending order; sorting takes a fraction of the time that numpy's own way takes."""
    found = np.sort(hashes)
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-word shingles; of its whole sequence if it has fewer words; none without words."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    return distinct(sequence_hashes(hashes, min(n, len(hashes))))
