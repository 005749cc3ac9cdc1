import random

import numpy as np
import pyarrow as pa
import pytest
from brute import shingle_set, words

from almanac.llm.ranges import cuts, pack, unpack
from almanac.llm.textbytes import blocks, shingles, texts_of, windows

random.seed(4)
TEXTS = [" ".join(random.choice(["a", "bb", "é", "c\n", "\td", "\u00a0"]) for _ in range(random.randint(0, 40))) for _ in range(200)]
TEXTS += [None, "", " ", "x", "y z", "\n\n", "one two three four", "w" * 5000]


@pytest.mark.parametrize("limit", [1, 60, 1 << 18])
def test_words_and_windows_are_those_of_the_text(limit):
    for width in (1, 2, 3, 7, 35):
        known = {}
        for low, high, texts in blocks(texts_of(pa.array(TEXTS)), limit):
            hashes, first = texts.words()
            found, begin = windows(hashes, first, width)
            for row in range(low, high):
                w = words(TEXTS[row])
                expected = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
                own = found[begin[row - low] : begin[row - low + 1]].tolist()
                assert len(own) == len(expected)
                for text, value in zip(expected, own):
                    assert known.setdefault(text, value) == value
        assert len(set(known.values())) == len(known)


def test_shingle_sets_have_the_right_sizes():
    texts = texts_of(pa.chunked_array([pa.array(TEXTS[:50]), pa.array(TEXTS[50:])]))
    hashes, begin = shingles(*texts.lowered().words())
    assert np.diff(begin).tolist() == [len(shingle_set(t)) for t in TEXTS]
    for a, b in zip(begin[:-1], begin[1:]):
        assert (np.diff(hashes[a:b].astype(object)) > 0).all()


def test_packed_hashes_come_back():
    for values in ([], [0], [0, 0, 1], [2**64 - 1], sorted(random.getrandbits(64) for _ in range(500))):
        keys = np.array(values, np.uint64)
        assert (unpack(pack(keys)) == keys).all()
        edges = cuts(keys, 64, 7)
        assert edges[0] == 0 and edges[-1] == len(keys) and (np.diff(edges) >= 0).all()
