import itertools

import numpy as np
import pytest

from fringeworks.llm import bpe as B
from fringeworks.llm import wavelet as W


@pytest.mark.parametrize("n,top", [(0, 4), (1, 1), (511, 3), (512, 50257), (5000, 300)])
def test_access_count_occurrences(n, top):
    r = np.random.default_rng(n)
    x = r.integers(0, top, n)
    m = W.WaveletMatrix.frombytes(W.WaveletMatrix.build(x, np.array([7]), np.array([0, n]), np.zeros(1, np.uint8)).tobytes())
    assert m.access(np.arange(n)).tolist() == x.tolist()
    for t in {*x[:5].tolist(), 0, top - 1, top + 5}:
        assert m.occurrences(t).tolist() == np.flatnonzero(x == t).tolist()
        assert m.count(t) == (x == t).sum() and m.count(t, n // 3, n // 2) == (x[n // 3 : n // 2] == t).sum()


def test_skewed_tokens_take_less_than_plain_ones():
    x = np.random.default_rng(1).zipf(1.3, 200_000) % 50257
    raw = W.WaveletMatrix.build(x, np.array([7]), np.array([0, len(x)]), np.zeros(1, np.uint8)).tobytes()
    m = W.WaveletMatrix.frombytes(raw)
    assert len(raw) < 0.9 * 2 * len(x) and {p.form for p in m.planes} >= {2, 3}
    i = np.random.default_rng(2).integers(0, len(x), 2000)
    assert (m.access(i) == x[i]).all()
    for t in (1, 2, 17, int(x[5]), 50256):
        assert m.occurrences(t).tolist() == np.flatnonzero(x == t).tolist()


def test_block_code_is_a_bijection():
    r = np.random.default_rng(3)
    words = np.concatenate([r.integers(0, 2**63, 500, dtype=np.uint64), np.array([0, 2**63 - 1], np.uint64), np.uint64(1) << np.arange(63, dtype=np.uint64)])
    ones = np.bitwise_count(words)
    index = W._index(words, ones)
    assert (W._word(index, ones) == words).all() and all(int(i) < 2 ** int(W.WIDTH[k]) or W.WIDTH[k] == 0 for i, k in zip(index, ones))


def test_plane_rank_select():
    r = np.random.default_rng(0)
    for density, n in itertools.product((0.0, 0.005, 0.05, 0.2, 0.5, 0.9, 0.997, 1.0), (1, 63, 64, 1008, 3000)):
        bits = r.random(n) < density
        p = W.Plane.of(bits)
        assert (p.get(np.arange(n)) == bits).all()
        assert p.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
        for one in (True, False):
            at = np.flatnonzero(bits == one)
            assert p.select(np.arange(len(at)), one).tolist() == at.tolist()


def test_messy(spark, messy, nothing, tmp_path):
    small = messy
    made = W.shards(small, W.Params(shard_tokens=20)).collect()
    vocab = B.vocabulary(B.Params().vocabulary)
    got = []
    for r in made:
        m = W.WaveletMatrix.frombytes(bytes(r.payload))
        assert (m.n, len(m.doc_ids)) == (r.n_tokens, r.n_docs)
        for k in range(r.n_docs):
            text = None if m.flags[k] & 1 else vocab.decode(m.document(k)).tobytes().decode()
            got.append((repr(None if m.flags[k] & 2 else int(m.doc_ids[k])), repr(text)))
    assert sorted(got) == sorted((repr(r.doc_id), repr(r.text)) for r in small.collect())
    assert W.shards(nothing).count() == 0
    files = W.write(W.shards(small), "file://" + str(tmp_path)).collect()
    assert all((tmp_path / f"{f.shard_id}.wm").stat().st_size == f.size for f in files) and files
    W.WaveletMatrix.frombytes((tmp_path / f"{files[0].shard_id}.wm").read_bytes())
