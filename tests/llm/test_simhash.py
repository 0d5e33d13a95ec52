import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from fringeworks.llm import golay as G
from fringeworks.llm import simhash as S
from fringeworks.llm import text as X
from fringeworks.llm.workspace import documents

BIG = "/root/testdata/sf0.01"


def test_code_is_perfect_and_keys_meet():
    r = np.random.default_rng(0)
    u = r.integers(0, 1 << 23, 3000)
    idx, n = G.indices(u)
    assert set(n.tolist()) == {1, 6}
    for k in (0, 1, 2):
        for _ in range(5):
            v = u.copy()
            for row in range(len(u)):
                for b in r.choice(23, k, replace=False):
                    v[row] ^= 1 << int(b)
            jdx, m = G.indices(v)
            assert all(set(a[:p]) & set(b[:q]) for a, p, b, q in zip(idx.tolist(), n, jdx.tolist(), m))
    words = np.array([m << 11 | G._mod(m << 11) for m in range(4096)])
    for w, keys, c in zip(u[:200].tolist(), idx.tolist(), n):
        near = [bin(w ^ int(words[i])).count("1") for i in keys[:c]]
        assert max(near) <= 4 and (c == 6) == (min(near) == 3)


def test_messy(messy, nothing):
    got = {r.doc_id: (r.group_id, r.is_kept) for r in S.grouped(messy).collect()}
    assert got[1] == (1, True) and got[2] == (1, False)
    assert got[8] == (8, True) and got[9] == (8, False)
    assert all(got[i] == (i, True) for i in (3, 4, 5, 6, 7, 10, 11, 12))
    assert got[None] == (None, True)
    kept = S.kept(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 3, 4, 5, 6, 7, 8, 10, 11, 12] and ids.count(None) == 2
    assert S.grouped(nothing).count() == 0 and S.kept(nothing).count() == 0


def pairs_of(text):
    w = re.findall(r"\w+", text.lower())
    return set(zip(w, w[1:])) or set(w)


def test_recall_and_precision_against_all_pairs(spark):
    docs = [(r.doc_id, pairs_of(r.text)) for r in documents(spark, BIG).collect()]
    group = {r.doc_id: r.group_id for r in S.grouped(documents(spark, BIG)).collect()}
    rep = {g: dict(docs)[g] for g in set(group.values())}
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(docs, 2) if x and y and min(len(x), len(y)) > 0.6 * max(len(x), len(y)) and len(x & y) >= 0.6 * len(x | y)]
    assert len(near) > 30
    assert sum(group[a] == group[b] for a, b in near) >= 0.9 * len(near)
    copies = [(i, g) for i, g in group.items() if i != g]
    share = [len(dict(docs)[i] & rep[g]) / max(1, len(dict(docs)[i] | rep[g])) for i, g in copies]
    assert np.mean(np.array(share) > 0.4) > 0.95


def test_thousands_of_copies_form_one_group(spark):
    r = np.random.default_rng(1)
    words = ["w" + str(x) for x in r.integers(0, 5000, 200)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(r.integers(0, 200, 1500).tolist())]
    rows += [(5000 + i, " ".join("v" + str(x) for x in r.integers(0, 5000, 200))) for i in range(200)]
    got = S.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.is_kept for x in got) == 201
    assert sum(x.group_id == 0 for x in got) == 1500


def test_bucket_components_equal_brute_force():
    r = np.random.default_rng(2)
    p = S.Params(hamming=4, minima=0)
    base = r.integers(0, 1 << 46, 12)
    lo = (base[r.integers(0, 12, 150)] ^ (1 << r.integers(0, 46, 150)) ^ (1 << r.integers(0, 46, 150))).astype(np.uint64)
    hi, ids = np.zeros(150, np.uint64), r.permutation(150)
    def roots(edges):
        up = list(range(150))
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in edges:
            up[find(a)] = find(b)
        return [find(x) for x in range(150)]
    got = roots([(int(a), int(b)) for u, v in S.bucket_edges(ids, [hi, lo, hi], p) for a, b in zip(u, v)])
    want = roots([(int(ids[a]), int(ids[b])) for a, b in itertools.combinations(range(150), 2) if bin(int(lo[a] ^ lo[b])).count("1") <= 4])
    same = lambda x: {tuple(i for i in range(150) if x[i] == r) for r in set(x)}
    assert same(got) == same(want)


def bucket_table(r, sizes, copies):
    """Rows of buckets of two equal segments: random ones, and ``copies`` in each that differ in few bits."""
    fp, bits, ids = [], [], r.permutation(10 * sum(sizes))[: sum(sizes)]
    for n in sizes:
        f, b = r.integers(0, 1 << 23, (n, S.SEGMENTS)), r.random((n, S.MINIMA)) < 0.5
        f[:, :2] = f[0, :2]
        some = r.permutation(n)[: min(n, copies)]
        f[some, 2:] = f[some[:1], 2:] ^ (1 << r.integers(0, 23, (len(some), S.SEGMENTS - 2)))
        b[some] = b[some[:1]] ^ (r.random((len(some), S.MINIMA)) < 0.1)
        fp.append(f), bits.append(b)
    words = S.packed(np.concatenate(fp).astype(np.int32), np.concatenate(bits))
    index, count = G.indices(S.segment(unsigned(words), 0))
    row, slot = np.nonzero(np.arange(6) < count[:, None])
    k = index[row, slot].astype(np.int32)
    order = np.argsort(k, kind="stable")
    row, k = row[order], k[order]
    return words, ids, pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids[row]), *(pa.array(w[row]) for w in words)], ["k", "id", *S.NAMES])


def test_buckets_are_compared_many_at_once(monkeypatch):
    """The number of comparisons in Python doesn't follow the number of buckets or of their rows that are alike by nothing but chance."""
    calls, alike = [], S.alike
    monkeypatch.setattr(S, "alike", lambda *x: calls.append(1) or alike(*x))
    r = np.random.default_rng(8)
    _, _, rows = bucket_table(r, [*[5] * 500, *[70] * 20], 3)
    assert sum(x.num_rows for x in S._edge_rows(S.Params(), 0)(iter([rows]))) >= 1000
    assert len(calls) < 1000  # some for each size, and one for each bucket of more than 48 rows


@pytest.mark.parametrize("copies", [0, 3, 40])
def test_edges_of_buckets_connect_all_that_is_alike(copies):
    r = np.random.default_rng(9)
    words, ids, rows = bucket_table(r, [1, 2, 3, 7, 48, 49, 120, 300], copies)
    w, at = unsigned(words), dict(zip(ids.tolist(), range(len(ids))))
    got = [(at[u], at[v]) for x in S._edge_rows(S.Params(), 0)(iter([rows])) for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert all(S.alike(w, np.array([a]), np.array([b]), S.Params())[0] for a, b in got)
    up = list(range(len(ids)))
    for a, b in got:
        x, y = up[a], up[b]
        up = [x if u == y else u for u in up]
    keys = [set(i[:n]) for i, n in zip(*(x.tolist() for x in G.indices(S.segment(w, 0))))]
    two = [set(i[:n]) for i, n in zip(*(x.tolist() for x in G.indices(S.segment(w, 1))))]
    a, b = np.triu_indices(len(ids), 1)
    near = S.alike(w, a, b, S.Params())
    pairs = [(x, y) for x, y in zip(a[near].tolist(), b[near].tolist()) if keys[x] & keys[y] and two[x] & two[y]]
    assert all(up[x] == up[y] for x, y in pairs) and len(pairs) >= copies


def test_split_keys_give_the_same_groups(spark):
    docs = documents(spark, BIG)
    want = sorted(map(tuple, S.grouped(docs).collect()))
    assert sorted(map(tuple, S.grouped(docs, S.Params(split=5)).collect())) == want


def unsigned(words):
    return [w.view(np.uint64) for w in words]


def test_words_hold_the_segments():
    r = np.random.default_rng(6)
    fp, bits = r.integers(0, 1 << 23, (500, S.SEGMENTS)).astype(np.int32), r.random((500, S.MINIMA)) < 0.5
    words = unsigned(S.packed(fp, bits))
    assert all((S.segment(words, s) == fp[:, s]).all() for s in range(S.SEGMENTS))
    a, b = r.integers(0, 500, (2, 2000))
    apart = sum(np.bitwise_count((fp[a, s] ^ fp[b, s]).astype(np.uint32)).astype(int) for s in range(S.SEGMENTS))
    same = (bits[a] == bits[b]).sum(1)
    for p in (S.Params(hamming=92, minima=32), S.Params(hamming=85, minima=0), S.Params(hamming=184, minima=36)):
        assert (S.alike(words, a, b, p) == ((apart <= p.hamming) & (same >= p.minima))).all()


def zipf_pairs(block, n=200, pairs=1500, vocabulary=20000):
    """Texts and edited copies, by a block or by scattered words replaced, and the Jaccard index of their word pairs."""
    r = np.random.default_rng(5)
    chance = 1 / np.arange(1, vocabulary + 1)
    chance /= chance.sum()
    left, right, index = [], [], []
    for _ in range(pairs):
        x = r.choice(vocabulary, n, p=chance)
        y, m = x.copy(), int(n * r.uniform(0.02, 0.35))
        at = r.integers(0, n - m) + np.arange(m) if block else r.choice(n, m // 2, replace=False)
        y[at] = r.choice(vocabulary, len(at), p=chance)
        a, b = set(zip(x.tolist(), x[1:].tolist())), set(zip(y.tolist(), y[1:].tolist()))
        left.append(" ".join(f"w{i}" for i in x)), right.append(" ".join(f"w{i}" for i in y)), index.append(len(a & b) / len(a | b))
    return left, right, np.array(index)


@pytest.mark.parametrize("block,least", [(True, {0.5: 0.7, 0.6: 0.9, 0.7: 0.95, 0.8: 0.97}), (False, {0.5: 0.9, 0.6: 0.95, 0.7: 0.97, 0.8: 0.97})])
def test_retrieval_by_similarity(block, least):
    """The share of pairs that meet in a bucket and pass the filters, by bands of the Jaccard index."""
    left, right, index = zipf_pairs(block)
    data, offsets, _ = X.utf8(pa.array(left + right))
    f = X.folded(data)
    starts, ends, first = X.spans(f, offsets)
    h = X.hashes(f, starts, ends)
    words = unsigned(S.packed(S.fingerprints(h, first), S.sketches(h, first)[1]))
    a, b = np.arange(len(left)), len(left) + np.arange(len(left))
    shared = 0
    for s in range(S.SEGMENTS):
        (i, n), (j, m) = (G.indices(S.segment([w[at] for w in words], s)) for at in (a, b))
        i, j = np.where(np.arange(6) < n[:, None], i, -1), np.where(np.arange(6) < m[:, None], j, -2)
        shared = shared + (i[:, :, None] == j[:, None, :]).any((1, 2))
    found = (shared >= 2) & S.alike(words, a, b, S.Params())
    for lo, share in least.items():
        band = (index >= lo) & (index < lo + 0.1)
        assert band.sum() > 30 and found[band].mean() >= share, (lo, found[band].mean())


def test_pairs_that_meet_are_found_by_the_rows(spark):
    """Direct edges equal all pairs of small tables that share two indices and are alike, connected as they are."""
    left, right, _ = zipf_pairs(True, pairs=60)
    texts = left + right
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group_id for r in S.grouped(docs, S.Params(jaccard=0.0)).collect()}
    data, offsets, _ = X.utf8(pa.array(texts))
    f = X.folded(data)
    starts, ends, first = X.spans(f, offsets)
    h = X.hashes(f, starts, ends)
    words = unsigned(S.packed(S.fingerprints(h, first), S.sketches(h, first)[1]))
    keys = [[set(i[:n]) for i, n in zip(*(x.tolist() for x in G.indices(S.segment(words, s))))] for s in range(S.SEGMENTS)]
    up = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sum(bool(k[a] & k[b]) for k in keys) >= 2 and S.alike(words, np.array([a]), np.array([b]), S.Params())[0]:
            x, y = sorted((up[a], up[b]))
            up = [x if u == y else u for u in up]
    assert group == dict(enumerate(up))
