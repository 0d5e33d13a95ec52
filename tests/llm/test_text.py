import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeworks.llm import text as X
from fringeworks.llm.sql import _LOWER, _UPPER

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .\néÉß×中🙂", max_size=30)), max_size=8)


def words(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(str.maketrans(_UPPER, _LOWER)))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_match_a_regular_expression(texts):
    data, offsets, valid = X.utf8(pa.array(texts, pa.string()))
    assert valid.tolist() == [t is not None for t in texts]
    f = X.folded(data)
    starts, ends, first = X.spans(f, offsets)
    got = [[f[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [words(t) for t in texts]
    h = X.hashes(f, starts, ends)
    seen = {}
    for w, x in zip(sum(got, []), h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(b"ab cd " * 5000, np.uint8)
    f = X.folded(data)
    starts, ends, _ = X.spans(f, np.array([0, len(data)]))
    whole = X.hashes(f, starts, ends)
    monkeypatch.setattr(X, "BLOCK_BYTES", 100)
    assert (X.hashes(f, starts, ends) == whole).all()


def test_slices_keep_every_row():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 100, 1, 0, 300)])], ["t"])
    parts = list(X.slices([b], "t", 101))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([b]).to_pydict()
    assert len(parts) > 2
