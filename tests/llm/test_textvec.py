import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from inkwell.llm import textvec

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x0c\r\x85\xa0ß漢", max_size=40)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 64))
def test_words_equal_bytes_split(texts, lower, target):
    seen = 0
    for a, b, w in textvec.word_slices(pa.array(texts, pa.string()), lower, target):
        raw = w.data.tobytes()
        for r in range(b - a):
            text = (texts[a + r] or "").encode()
            want = (text.lower() if lower else text).split()
            i, j = w.first[r], w.first[r + 1]
            assert [raw[x:y] for x, y in zip(w.start[i:j], w.end[i:j])] == want
            assert (w.row[i:j] == r).all()
        seen += b - a
    assert seen == len(texts)


def test_hash_is_a_function_of_the_word_and_the_sequence():
    words = ["ab", "ba", "a", "b", "aab", "aba"]
    _, _, w = next(textvec.word_slices(pa.array([" ".join(words * 2)]), False))
    assert len(np.unique(w.hash)) == len(words) and (w.hash[:6] == w.hash[6:]).all()
    g, ok = w.ngrams(3)
    assert ok.all() and (g[:4] == g[6:10]).all() and len(np.unique(g[:6])) == 6
    assert (textvec.span_hash(w.hash, np.arange(10), np.arange(10) + 3) == g).all()


def test_long_texts_hash_alike_in_any_stretch(monkeypatch):
    text = " ".join(f"w{i % 997}" + "x" * (i % 50) for i in range(3000))
    _, _, whole = next(textvec.word_slices(pa.array([text]), False))
    monkeypatch.setattr(textvec, "SLICE", 100)
    _, _, cut = next(textvec.word_slices(pa.array([text]), False, 1 << 20))
    assert (whole.hash == cut.hash).all()
