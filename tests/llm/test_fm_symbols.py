"""Searches for symbols that an index does not hold."""

import numpy as np
import pytest

from skyaccord.llm import decontam
from skyaccord.llm.common import word_hashes


@pytest.mark.parametrize("most", [1, 2, 3, 7, 15])
def test_symbols_above_the_largest_are_not_found(most):
    index = decontam.FMIndex(np.arange(1, most + 1))
    patterns = np.array([[0, most + 1], [most, most + 1], [most + 1, 1], [0, most + 2], [0, most]])
    low, high = index.search(patterns)
    assert (high - low).tolist() == [0, 0, 0, 0, 1]
    assert index.locate(np.arange(low[4], high[4])).tolist() == [most - 1]


def test_windows_that_end_with_the_next_word():
    windows = decontam.Windows.of([("a", b"x y"), ("b", b"y z")], width=2)  # x, y, z: 2, 3, 4 in the index
    assert windows.find([b"x y"]) == [(2, [(0, 2)], {"a"})]
    assert windows.find([b"q y z", b"y y"]) == [(3, [(1, 3)], {"b"}), (2, [], set())]


@pytest.mark.parametrize("bits", [7, 8, 10, 11, 12])
def test_words_that_only_a_polynomial_confuses_stay_apart(bits):
    """Thue-Morse words and their complements: for any odd step their polynomials agree modulo 2^64 from 2^10 letters on."""
    odd = [bin(k).count("1") % 2 for k in range(1 << bits)]
    one, other = (bytes(97 + (b ^ flip) for b in odd) for flip in (0, 1))
    windows = decontam.Windows.of([("item", one)])
    for text, hits in ((b"before " + other + b" after", 0), (b"before " + one + b" after", 1)):
        found = decontam.ShardIndex.of([(0, 0, decontam.hashes_of(text))]).find(windows)
        assert len(found) == hits
    assert word_hashes(one)[0] != word_hashes(other)[0]
    assert word_hashes(b"x " + one + b" y " + one)[1] == word_hashes(one)[0] == word_hashes(b"x " + one + b" y " + one)[3]
