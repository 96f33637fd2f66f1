import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from convoy.llm import words as W
from tests.llm.conftest import TRICKY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.,\x0b日", max_size=40)), max_size=12), st.integers(1, 64))
def test_words_are_the_patterns(texts, chunk):
    got = []
    for w in W.words(pa.array(texts, pa.string()), chunk=chunk):
        for d in range(w.rows.stop - w.rows.start):
            got.append([bytes(w.data[s:e]).decode() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_hashes_depend_on_the_word_alone():
    w = next(W.words(pa.array(["b a", "a  a\nb", None, "a"])))
    a = {int(w.hash[k]) for k in (1, 2, 3, 5)}
    assert len(a) == 1 and w.hash[0] == w.hash[4] and int(w.hash[0]) not in a


def test_shingles_of_short_and_long_texts():
    w = next(W.words(pa.array(TRICKY, pa.string()), lower=True, chunk=1 << 20))
    _, first = W.shingles(w)
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TRICKY]
    assert np.diff(first).tolist() == [n - 4 if n >= 5 else int(n > 0) for n in want]
