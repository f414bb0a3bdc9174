import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import textbytes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aàb \n\t\x0b 的\x1c"), max_size=40)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_runs_of_non_space_bytes(texts):
    data, at = textbytes.flat(pa.array(texts, pa.string()))
    starts, ends, first = textbytes.words(data, at)
    got = textbytes.pieces(data, starts, ends)
    want = [[w for w in (t or "").encode().replace(b"\x0b", b" ").replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w] for t in texts]
    assert got == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]
    hashes = textbytes.span_hash(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(got))
    one, which = textbytes.distinct(hashes)
    assert [got[one[k]] for k in which] == got


def test_hashes_do_not_depend_on_place_or_block():
    word = b"w" * 300_000
    data = np.frombuffer(b"x " + word + b" y " + word + b" " + b"z" * 10, np.uint8)
    starts, ends, _ = textbytes.words(data, np.array([0, len(data)]))
    h = textbytes.span_hash(data, starts, ends)
    assert h[1] == h[3] and len(set(h.tolist())) == 4


def test_slices_and_large_strings():
    column = pa.array(["skip", "a b", None, "c"], pa.large_string()).slice(1)
    data, at = textbytes.flat(column)
    assert bytes(data) == b"a bc" and at.tolist() == [0, 3, 3, 4]


def test_ragged():
    assert textbytes.ragged(np.array([5, 9, 0]), np.array([2, 0, 3])).tolist() == [5, 6, 0, 1, 2]
