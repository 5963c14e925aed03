import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \n\t\x0b漢1,", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_match_the_pattern(texts):
    data, offsets = T.text_bytes(pa.array(texts, pa.string()))
    split = T.split_words(data, offsets, T.ASCII_SPACE, T.SAME_CASE)
    for d, text in enumerate(texts):
        part = split.of(d)
        mine = [data[a:b].tobytes().decode() for a, b in zip(split.starts[part], split.ends[part], strict=True)]
        assert mine == re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB ", max_size=30), min_size=1, max_size=5))
def test_equal_words_and_runs_have_equal_hashes(texts):
    data, offsets = T.text_bytes(pa.array(texts, pa.string()))
    split = T.split_words(data, offsets)
    words, seen, runs = [w.lower() for t in texts for w in t.split(" ") if w], {}, {}
    assert len(words) == len(split.hashes)
    for w, h in zip(words, split.hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for n in (2, 5):
        for hashes in (T.ngrams(split.hashes, n), T.windows(split.hashes, n), T.windows(split.hashes, n, check=True)):
            runs = {}
            for i, h in enumerate(hashes.tolist()):
                assert runs.setdefault(tuple(words[i : i + n]), h) == h
            assert len(set(runs.values())) == len(runs)


def test_a_long_text_is_hashed_in_pieces_like_a_short_one(monkeypatch):
    text = "alpha beta gamma delta " * 50
    data, offsets = T.text_bytes(pa.array([text], pa.string()))
    whole = T.split_words(data, offsets).hashes
    monkeypatch.setattr(T, "CHUNK_BYTES", 40)
    assert (T.split_words(data, offsets).hashes == whole).all()


def test_sliding_min():
    values = np.random.default_rng(0).integers(0, 99, 60)
    for width in (1, 2, 7, 43):
        assert T.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(61 - width)]
