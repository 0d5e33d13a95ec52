import numpy as np
import pyarrow as pa
import pytest

from fringeworks.llm import bpe
from fringeworks.llm import lm as L
from fringeworks.llm.workspace import Workspace, documents

from .conftest import SF

P = L.Params(rounds=1)
VOCAB = bpe.vocabulary(P.bpe.vocabulary)


def ids_of(texts):
    enc = bpe.Encoder(VOCAB)
    return [enc.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].astype(np.uint16) for t in texts]


def test_contexts_stay_within_documents():
    docs = [[5, 6, 7, 8, 9], [], [1], [2, 3], [], [4, 4, 4, 4]]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = L.grams(np.array(sum(docs, []), np.uint16), at, 99)
    want = [sum((d[i - k] if i >= k else 99) << (16 * k) for k in range(4)) for d in docs for i in range(len(d))]
    assert got.tolist() == want and L.grams(np.zeros(0, np.uint16), np.zeros(1, np.int64), 9).tolist() == []


@pytest.mark.parametrize("counts", [np.zeros(500), np.arange(500) ** 3.0, np.concatenate([[1e9], np.zeros(499)])])
def test_classes_hold_every_token_once(counts):
    lay = L.Layout(counts)
    assert sorted(lay.token.tolist()) == list(range(500)) and (lay.token[lay.rank] == np.arange(500)).all()
    assert lay.starts[0] == 0 and lay.starts[-1] == 500 and (np.diff(lay.starts) > 0).all()
    assert np.isclose(lay.class_p.sum(), 1) and np.allclose(np.add.reduceat(lay.word_p, lay.starts[:-1]), 1)


def test_sums_by_row():
    r = np.random.default_rng(0)
    rows, x = r.integers(0, 30, 1000), r.normal(size=(1000, 3))
    assert np.allclose(L._summed(rows, x, 31), [x[rows == k].sum(0) for k in range(31)], atol=1e-5)


def test_sums_by_several_rows_are_kept_apart():
    r = np.random.default_rng(4)
    rows, x = [r.integers(0, n, 2500) for n in (3, 40, 1)], r.normal(size=(2500, 6)).astype(np.float32)
    got = L._summed_each(rows, x, 40)
    assert got.shape == (3, 40, 6)
    for k, sums in zip(rows, got, strict=True):
        assert np.allclose(sums, [x[k == i].astype(float).sum(0) for i in range(40)], atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_grouped_keeps_every_place_and_contexts_together(n):
    x = np.random.default_rng(n).integers(0, 9, n).astype(np.uint16) * 7001  # ranks of up to 16 bits
    g = L.grams(x, np.array([0, n]), 65_000)
    order, some, times = L.grouped(g)
    assert sorted(order.tolist()) == list(range(n)) and (some.repeat(times) == g[order]).all()
    contexts = some >> np.uint64(16)
    assert np.count_nonzero(contexts[1:] != contexts[:-1]) + (n > 0) == len(np.unique(g >> np.uint64(16)))


def test_grouped_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(L.X, "mixed", lambda h: h * np.uint64(0))
    lay = L.Layout(np.arange(500) ** 2.0)
    m = L.Model.start(L.Params(dim=4), lay)
    g = L.grams(np.random.default_rng(6).integers(0, 500, 3000).astype(np.uint16), np.array([0, 3000]), 500)
    order, some, times = L.grouped(g)
    got = np.empty(3000)
    got[order] = L.scores(m, m.turned(), lay, some).repeat(times)
    distinct, place = np.unique(g, return_inverse=True)
    assert np.allclose(got, L.scores(m, m.turned(), lay, distinct)[place], atol=1e-5)


def test_a_batch_steps_along_the_gradient_of_noise_contrast():
    p = L.Params(dim=4, noise=2, batch=4096)
    lay = L.Layout(np.concatenate([[4000.0, 900, 800], np.full(40, 9.0), np.zeros(200)]))
    sizes = np.diff(lay.starts)
    assert (sizes == 1).any() and ((sizes > 1) & (sizes <= 8)).any() and (sizes > 8).any()  # each of the ways
    r = np.random.default_rng(7)
    x = r.choice(lay.size, 3000, p=np.concatenate([[0.4, 0.2, 0.2], np.full(240, 0.2 / 240)])).astype(np.uint16)
    g = L.grams(x, np.array([0, 1200, 3000]), lay.size)
    start = L.Model.start(p, lay).m
    t = L.Trainer(start, lay, p, 11, 0.1)
    t.chunk(g)
    # term by term in double precision, with the same noise
    rng = np.random.default_rng(11)
    g, n = np.unique(g, return_counts=True)
    rng.permutation(len(g))
    common = np.searchsorted(lay.class_cum, rng.random(2))
    within = [np.clip(np.searchsorted(lay.word_cum, c + u), lay.starts[c], lay.starts[c + 1] - 1) for c, u in enumerate(rng.random((lay.classes, 2)))]
    m = L.Model(start.astype(float), lay.size, 4)
    want = L.Model(np.zeros(start.shape), lay.size, 4)
    for i, w in zip(g.tolist(), n / n.sum(), strict=True):
        token, ctx = i & 0xFFFF, [i >> 16 * k & 0xFFFF for k in (1, 2, 3)]
        c = int(lay.of[token])
        h = np.append(sum(m.r[u] @ a for u, a in zip(ctx, m.c)), 1)
        seen = [(m.s, want.s, c, 1, lay.class_p)] + [(m.s, want.s, k, 0, lay.class_p) for k in common]
        if sizes[c] > 1:
            seen += [(m.q, want.q, token, 1, lay.word_p)] + [(m.q, want.q, k, 0, lay.word_p) for k in within[c]]
        dh = np.zeros(4)
        for a, to, k, real, q in seen:
            z = w * (1 / (1 + np.exp(np.log(2 * q[k]) - a[k] @ h)) - real)
            to[k] += z * h
            dh += z * a[k, :4]
        for j, u in enumerate(ctx):
            want.r[u] += m.c[j] @ dh
            want.c[j] += np.outer(m.r[u], dh)
    assert np.allclose(t.sum.m, want.m**2 + 1e-8, rtol=1e-3, atol=1e-9)
    assert np.allclose(t.model.m - start, -0.1 * want.m / np.sqrt(want.m**2 + 1e-8), atol=2e-3)


@pytest.mark.parametrize("scale", [0.0, 3.0, 59.0, 500.0])
def test_log_probabilities_of_rows_that_repeat(scale):
    r = np.random.default_rng(2)
    e = np.clip(r.normal(size=(50, 300)), -1, 1) * scale
    rows, at = np.sort(r.integers(0, 50, 400)), r.integers(0, 300, 400)
    want = e[rows, at] - np.logaddexp.reduce(e, axis=1)[rows]
    assert np.allclose(L.log_probability(e.astype(np.float32), at, rows), want, atol=2e-4)
    at = at[:50]
    assert np.allclose(L.log_probability(e.astype(np.float32), at), e[np.arange(50), at] - np.logaddexp.reduce(e, axis=1), atol=2e-4)


def test_scores_are_the_same_in_blocks_of_any_size(monkeypatch):
    lay = L.Layout(np.arange(500) ** 2.0)
    m = L.Model.start(L.Params(dim=4), lay)
    x = np.random.default_rng(3).integers(0, 500, 3000).astype(np.uint16)
    g = np.unique(L.grams(x, np.array([0, 3000]), 500))
    want = L.scores(m, m.turned(), lay, g)
    monkeypatch.setattr(L, "_BLOCK", 700)
    assert np.allclose(L.scores(m, m.turned(), lay, g), want, atol=1e-5) and len(L.scores(m, m.turned(), lay, g[:0])) == 0


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(Workspace(spark, "t"), documents(spark, SF, "doc_id", "text"), L.Params())


def test_every_token_is_counted(spark, model):
    texts = [r.text for r in documents(spark, SF, "text").collect() if r.text]
    assert model[3] == sum(len(x) for x in ids_of(texts))


def test_every_position_is_visited_once_a_round():
    lay = L.Layout(np.ones(50))
    t = L.Trainer(L.Model.start(L.Params(dim=4), lay).m, lay, L.Params(dim=4, batch=64), 0, 0.1)
    r = np.random.default_rng(1)
    total = np.zeros(50)
    for n in (1, 700, 3000):
        x = r.integers(0, 50, n).astype(np.uint16)
        t.chunk(L.grams(x, np.array([0, n]), 50))
        total += np.bincount(x, minlength=50)
    _, a, b, c = t.model.at
    assert (t.touched[b:c] == total).all() and t.touched[c:].sum() == total.sum() == t.touched[a] and np.isfinite(t.model.m).all()


def brute(model, lay, ids):
    """Log-probabilities of all tokens of the vocabulary after each prefix, token by token in double precision."""
    m, d = model.m.astype(float), model.dim
    _, a, b, c = model.at
    out = []
    ranks = [lay.size] * 3 + [int(lay.rank[i]) for i in ids]
    for i in range(3, len(ranks)):
        h = sum(m[ranks[i - k], :d] @ m[a + (k - 1) * d : a + k * d, :d] for k in (1, 2, 3))
        s = m[c:, :d] @ h + m[c:, d]
        q = m[b:c, :d] @ h + m[b:c, d]
        lp = np.empty(lay.size)
        for k in range(lay.classes):
            x, y = lay.starts[k], lay.starts[k + 1]
            lp[x:y] = s[k] - np.logaddexp.reduce(s) + q[x:y] - np.logaddexp.reduce(q[x:y])
        out.append(lp[lay.rank])
    return out


def test_scores_equal_brute_force_and_are_normalised(model):
    m, lay, _, _ = model
    texts = ["Thing and that with the.", "ß 中文 qzxj", "a", " \n\n 1234"]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([bpe.blob(x) for x in ids_of(texts)], pa.binary())], ["doc_id", "ids"])
    got = next(L._scores(m.m, lay, L.Params())(iter([rows])))
    for k, ids in enumerate(ids_of(texts)):
        every = brute(m, lay, ids)
        assert all(np.isclose(np.exp(lp).sum(), 1) for lp in every)
        want = sum(lp[i] for lp, i in zip(every, ids))
        assert got.column(1)[k].as_py() == len(ids) and abs(got.column(2)[k].as_py() - want) < 1e-3 * max(1, abs(want))


def test_better_than_token_frequencies(spark, model):
    m, lay, table, total = model
    rows = table.toArrow()
    ids = np.concatenate([bpe.unblob(x.as_py()) for x in rows.column("ids") if x.is_valid])
    p = np.bincount(ids, minlength=lay.size) / len(ids)
    lp = sum(r.logprob or 0 for r in spark.createDataFrame(next(L._scores(m.m, lay, L.Params())(iter(rows.combine_chunks().to_batches()))).to_pandas()).collect())
    assert -lp / total < 0.9 * -np.log(p[ids]).mean()


def test_chunks_keep_rows_whole():
    rows = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([None if i % 4 == 3 else bpe.blob(np.arange(i, dtype=np.uint16)) for i in k], pa.binary())], ["doc_id", "ids"]) for k in ([0, 1, 2, 3], [], [7, 8], [9])]
    for most in (1, 5, 1000):
        seen = []
        for b, ids, at in L._chunks(iter(rows), 1, most):
            assert len(at) == b.num_rows + 1 and at[-1] == len(ids)
            seen += [(i, len(range(x, y))) for i, x, y in zip(b.column(0).to_pylist(), at, at[1:])]
        assert seen == [(0, 0), (1, 1), (2, 2), (3, 0), (7, 0), (8, 8), (9, 9)]


def test_messy(messy, nothing):
    rows = L.scored(messy, P).collect()
    assert len(rows) == messy.count()
    for r in rows:
        if r.doc_id == 3:
            assert r.n_tokens is None and r.logprob is None and r.perplexity is None
        elif r.doc_id in (4, 5):
            assert (r.n_tokens, r.logprob, r.mean_logprob, r.perplexity) == (0, 0.0, None, None)
        elif r.doc_id is not None:
            assert r.n_tokens > 0 and r.logprob < 0 and r.perplexity > 1
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert L.scored(nothing, P).count() == 0
