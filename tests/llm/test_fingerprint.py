import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fringeworks.llm import fingerprint as P
from fringeworks.llm import text as X


def brute(h, k, w):
    """Windows of w k-grams; the rightmost least of each."""
    m = 2**64
    g = []
    for i in range(len(h) - k + 1):
        acc = 0
        for x in h[i : i + k]:
            acc = (acc * int(X.BASE) + int(x)) % m
        g.append(int(X.mixed(np.array([acc], np.uint64))[0]) >> 1)
    out = set()
    for s in range(max(1, len(g) - w + 1)) if g else []:
        win = g[s : s + w]
        at = max(i for i, x in enumerate(win) if x == min(win)) + s
        out.add((at, g[at]))
    return sorted(out)


@pytest.mark.parametrize("k,w", [(1, 1), (2, 3), (3, 4), (4, 7), (16, 35)])
def test_equals_brute_force(k, w):
    r = np.random.default_rng(k * 100 + w)
    docs = [r.integers(0, 3, n).astype(np.uint64) for n in (0, 1, 2, 3, 5, 8, 40, 200, 0, 6)]
    h = np.concatenate(docs)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    g, at = P.grams(h, first, k)
    chosen = P.winnow(g, at, w)
    for d, doc in enumerate(docs):
        mine = chosen[(chosen >= at[d]) & (chosen < at[d + 1])]
        assert [(int(i - at[d]), int(g[i])) for i in mine] == brute(doc.tolist(), k, w)


def test_a_shared_passage_is_found(spark):
    r = np.random.default_rng(0)
    say = lambda n: " ".join("w" + str(x) for x in r.integers(0, 10**6, n))
    passage = say(50)
    df = spark.createDataFrame([(1, say(37) + " " + passage + " " + say(60)), (2, say(80) + "\n" + passage.upper()), (3, say(200))], "doc_id long, text string")
    got = {}
    for x in P.fingerprints(df).collect():
        got.setdefault(x.doc_id, set()).add(x.hash)
    assert got[1] & got[2] and not got[3] & (got[1] | got[2])


def test_messy(messy, nothing):
    rows = P.fingerprints(messy).collect()
    ids = {r.doc_id for r in rows}
    assert ids == {1, 2, 6, 12}
    one = sorted((r.pos, r.hash) for r in rows if r.doc_id == 2)
    assert sorted((r.pos, r.hash) for r in rows if r.doc_id == 1) == sorted(one * 2)
    assert P.fingerprints(nothing).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_benchmark_item_is_found_inside_a_document(sf):
    items = pq.read_table(f"/root/testdata/{sf}/benchmark.parquet")["text"].to_pylist()
    r = np.random.default_rng(3)
    say = lambda n: " ".join("w" + str(x) for x in r.integers(0, 10**6, n))
    texts = items + [f"{say(40 + i % 50)} {t}\n{say(60)}" for i, t in enumerate(items)]
    found = [set() for _ in texts]
    for b in P._rows(P.Params())(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])):
        for d, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            found[d].add(h)
    assert all(a & b for a, b in zip(found, found[len(items) :]))
