"""The byte arrays behind the operators, against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import boosting, words
from sheaf.llm.decontamination import suffix_array
from sheaf.llm.repeats import covered, interleave, repeated_windows

TEXT = st.text(st.sampled_from("ab \té\n0.Zß😀"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_of_slices(texts, limit):
    got = []
    for part in words.slices(pa.array(texts, pa.string()), limit):
        starts, ends, owner = part.words(words.NOT_BLANK)
        held = [[] for _ in range(len(part))]
        for a, b, t in zip(starts, ends, owner, strict=True):
            held[t].append(part.data[a:b].tobytes().decode())
        got += held
    assert got == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]


def test_stretch_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"xxabcabyabc", np.uint8)
    sums = words.prefix_sums(data)
    h = words.stretch_hashes(sums, np.array([2, 8, 2, 5]), np.array([5, 11, 4, 7]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(ids):
    order = suffix_array(np.array(ids), 64).tolist()
    assert sorted(order) == list(range(len(ids)))
    assert [ids[i:] for i in order] == sorted(ids[i:] for i in range(len(ids)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.integers(1, 40))
def test_repeated_windows(strings, shard):
    docs = np.arange(len(strings)) // 2
    got = repeated_windows(strings, docs, 4, shard)
    first = {}
    for d, s in zip(docs.tolist(), strings, strict=True):
        for i in range(len(s) - 3):
            first.setdefault(s[i : i + 4], d)
    want = [[first[s[i : i + 4]] < d for i in range(len(s) - 3)] for d, s in zip(docs.tolist(), strings, strict=True)]
    assert [g.tolist() for g in got] == want


def test_interleave_of_two_shards():
    # shards "ab$" and "cab$": symbols before the sorted suffixes ($, ab$, b$ and $, ab$, b$, cab$)
    suffix, interval = interleave([np.array([2, 0, 1], np.uint8), np.array([2, 3, 1, 0], np.uint8)], [1, 1], 2)
    # "ab" begins in both and stays together; all other suffixes are alone
    assert suffix.tolist() == [1, 4] and len(set(interval.tolist())) == 1


def test_covered():
    starts, ends = covered(np.array([5, 0, 3, 10]), np.array([7, 4, 5, 12]))
    assert (starts.tolist(), ends.tolist()) == ([0, 10], [7, 12])


def test_boosting_is_monotonic_and_fits():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.random(2000) < 0.7).astype(float)
    trees = boosting.fit(x[:1500], y[:1500], [-1, 0, 0])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.9
    grid = np.repeat(x[:50], 30, axis=0)
    grid[:, 0] = np.tile(np.linspace(-1, 2, 30), 50)
    assert (np.diff(trees.margin(grid).reshape(50, 30), axis=1) <= 1e-9).all()


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0, 0.0]])
def test_boosting_with_one_class(y):
    trees = boosting.fit(np.zeros((len(y), 2)), np.array(y), [0, 1])
    margin = trees.margin(np.array([[np.nan, 0.0]]))
    assert (margin > 0).all() == (y != [0.0, 0.0])
