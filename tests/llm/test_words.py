import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redressa.llm import words as w


def plain(texts, lower):
    out = []
    for t in texts:
        data = (t or "").encode()
        out.append((data.lower() if lower else data).split())
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x0c\r\x1c\x85 東x", max_size=40)), max_size=8), st.booleans())
def test_words_are_those_of_split(texts, lower):
    got = w.words_of(pa.array(texts, pa.string()), lower)
    flat = [x for row in plain(texts, lower) for x in row]
    assert [got.data[a:z].tobytes() for a, z in zip(got.starts, got.ends)] == flat
    assert list(got.counts) == [len(x) for x in plain(texts, lower)]
    assert len(set(flat)) == len(set(got.hashes.tolist()))
    same = {}
    assert all(same.setdefault(x, h) == h for x, h in zip(flat, got.hashes.tolist()))


@pytest.mark.parametrize("segment", [7, 64, 1000])
def test_segments_split_no_word(monkeypatch, segment):
    monkeypatch.setattr(w, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["".join(rng.choice("abcdé   \n") * rng.choice([1, 1, 9]) for _ in range(rng.randrange(200))) for _ in range(30)] + [None, "y" * 5000]
    got = w.words_of(pa.array(texts).slice(2))
    flat = [x for row in plain(texts[2:], False) for x in row]
    assert [got.data[a:z].tobytes() for a, z in zip(got.starts, got.ends)] == flat
    assert w.rolling(got.hashes, 5).tolist() == [w.rolling(got.hashes[i:i + 5], 5)[0] for i in range(len(flat) - 4)]


def test_letters_only():
    got = w.words_of(pa.array(["été's 3-fold, über"]), gap=w.NOT_LETTER)
    assert [got.data[a:z].tobytes().decode() for a, z in zip(got.starts, got.ends)] == ["été", "s", "fold", "über"]


def test_rolling_tells_order_and_length():
    h = w.mix(np.arange(1, 7, dtype=np.uint64))
    assert w.rolling(h, 3)[0] != w.rolling(h[[1, 0, 2]], 3)[0] and len(w.rolling(h, 7)) == 0


def test_row_groups_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 1, 1, 90, 2)] + [None])], names=["text"])
    parts = [len(p) for p in w.row_groups(batch, limit=20)]
    assert sum(parts) == 8 and max(parts) < 8
