import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from mendlake.llm.words import ALNUM, SPACED, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {"spaced": (SPACED, r"[^\x20\x09-\x0D]+"), "alnum": (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}
text = st.text(st.sampled_from("abAB 19\t\n-_éß漢\x00\x7f "), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=6))
def test_words_and_sets(texts):
    for kind, pattern in PATTERNS.values():
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        seen = {}
        for a, b, w in words(pa.array(texts, pa.string()), kind):
            sets = list(w.sets(5))
            for i in range(a, b):
                lo, hi = w.first[i - a], w.first[i - a + 1]
                assert hi - lo == len(want[i])
                for x, h in zip(want[i], w.hash[lo:hi], strict=True):
                    assert seen.setdefault(x, h) == h
                n = len(want[i])
                grams = {tuple(want[i][j : j + 5]) for j in range(n - 4)} if n >= 5 else {tuple(want[i])} - {()}
                assert len(sets[i - a]) == len(grams)
        assert len(set(seen.values())) == len(seen)


def test_slices_and_prefixes():
    column = pa.array(["one", "two three", None, "four fourteen"])
    got = [(a, b, np.diff(w.first).tolist()) for a, b, w in words(column.slice(1), SPACED)]
    assert got == [(0, 3, [2, 0, 2])]
    _, _, w = next(words(pa.array(["fourteen fourth four"]), ALNUM))
    p = w.prefix(4)
    assert p[0] == p[1] != 0 and p[2] == 0


def test_pieces(monkeypatch):
    """Long texts in small pieces give the same words."""
    import mendlake.llm.words as W

    texts = pa.array(["ab " * 50, "x" * 100 + " tail", "", "é" * 40 + "end of it", " " * 70 + "a"])
    whole = [(w.start.tolist(), w.end.tolist(), w.hash.tolist(), w.first.tolist()) for _, _, w in words(texts, SPACED)]
    _, _, data, offsets = next(W.chunks(texts))
    for size in (1, 7, 30, 64):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        w = W.Words(data, offsets, SPACED)
        assert [(w.start.tolist(), w.end.tolist(), w.hash.tolist(), w.first.tolist())] == whole
