import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import textkernel as K

from .helpers import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\n\x0b.é\x1cñ|", max_size=40)), max_size=12)


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(1, 60))
def test_words_are_those_of_the_pattern(values, limit):
    seen = []
    hashes = {}
    for first, data, offsets in K.blocks(pa.array(values, pa.string()), limit):
        starts, ends, at = K.word_spans(data, offsets)
        h, same = K.words(data, offsets)
        assert (at == same).all()
        raw = K.LOWER[data].tobytes()
        for i in range(len(offsets) - 1):
            assert first + i == len(seen)
            seen.append([raw[s:e].decode() for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])])
            for w, x in zip(seen[-1], h[at[i] : at[i + 1]].tolist()):
                assert hashes.setdefault(w, x) == x
    assert seen == [words(v) for v in values]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=6))
def test_shingles_are_equal_where_the_words_are(docs):
    flat = np.array([x for d in docs for x in d], np.uint64)
    first = np.cumsum([0, *map(len, docs)])
    got, at = K.shingles(K.mix(flat + np.uint64(1)), first)
    names = {}
    for i, d in enumerate(docs):
        want = [tuple(d[k : k + 5]) for k in range(len(d) - 4)] if len(d) >= 5 else ([tuple(d)] if d else [])
        part = got[at[i] : at[i + 1]].tolist()
        assert len(part) == len(want)
        for w, h in zip(want, part):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_slices_of_arrow_columns_keep_their_rows():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1, 3)
    data, offsets = K.flat(column)
    assert [bytes(data[offsets[i] : offsets[i + 1]]) for i in range(3)] == [b"", b"c", b"d e f"]
