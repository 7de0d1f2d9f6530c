"""Word hashes tell words apart wherever they stand."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from emberframe.llm import words

TEXT = st.text(alphabet="abAB \t\n\x0bäÄ\U0001f600\x1c\xa0", max_size=60)


def plain(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]  # bytes.lower: A-Z alone


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_same_hash_for_same_word(texts):
    of_hash, of_word = {}, {}
    for text in texts:
        found, want = words.word_hashes(text).tolist(), plain(text)
        assert len(found) == len(want)
        for h, w in zip(found, want, strict=True):
            assert of_hash.setdefault(h, w) == w and of_word.setdefault(w, h) == h


def test_many_words_and_chunks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(200_000))
    whole = words.word_hashes(text)
    assert len(set(whole.tolist())) == 200_000
    monkeypatch.setattr(words, "CHUNK", 1000)
    assert (words.word_hashes(text) == whole).all()
    long = "x" * 5000 + " " + "y" * 5000
    assert len(words.word_hashes(long)) == 2
    assert words.word_hashes(None).tolist() == words.word_hashes("").tolist() == []
