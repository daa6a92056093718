"""Vectorised words and sentences against regular expressions."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthlog.llm.subwords import VOCABULARY, Pieces, lexicons, public_pieces, ragged
from hearthlog.llm.tokens import Hasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="aAbB \t\n\r.é \x00", max_size=40)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_match_the_regular_expression(texts):
    seen, found = {}, []
    for w in Hasher().words(pa.array(texts, pa.string())):
        for lo, hi in zip(w.bounds[:-1], w.bounds[1:]):
            spelled = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])]
            found.append(spelled)
            for word, h in zip(spelled, w.hashes[lo:hi].tolist()):
                assert seen.setdefault(word, h) == h
    assert found == [WORD.findall(folded(t)) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_words_in_many_chunks(monkeypatch):
    monkeypatch.setattr("hearthlog.llm.tokens.CHUNK_BYTES", 16)
    texts = ["one two", "x" * 50, "", None, "three  four", " five"]
    found = {}
    for w in Hasher().words(pa.array(texts)):
        for k, (lo, hi) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
            found[w.first + k] = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])]
    assert [found[k] for k in range(len(texts))] == [WORD.findall(t or "") for t in texts]


def test_pieces_spell_every_word():
    texts = ["The weather in Zürich: ünknown, 42 <b>", "naïve 日本語 the the", ""]
    pieces = Pieces(public_pieces(VOCABULARY)[:2000])
    spelling = {i: bytes([i]) for i in range(256)} | {256 + i: p for i, p in enumerate(pieces.pieces)}
    for lexicon in lexicons(pa.array(texts), Hasher()):
        ids, bounds = pieces.cut(lexicon.data, lexicon.starts, lexicon.ends)
        flat, places = ragged(ids, bounds, lexicon.numbers)
        for k, text in enumerate(texts):
            own = flat[places[lexicon.bounds[k]] : places[lexicon.bounds[k + 1]]]
            assert b"".join(spelling[i] for i in own).decode() == "".join(" " + w for w in WORD.findall(folded(text)))
        # Greedy: no piece could have been longer.
        known = set(pieces.pieces)
        for k in range(len(lexicon.hashes)):
            word = b" " + bytes(lexicon.data[lexicon.starts[k] : lexicon.ends[k]])
            at = 0
            for i in ids[bounds[k] : bounds[k + 1]]:
                n = next((n for n in range(7, 1, -1) if len(word) - at >= n and word[at : at + n] in known), 1)
                assert len(spelling[i]) == n
                at += n
