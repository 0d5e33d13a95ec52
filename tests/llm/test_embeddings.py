import numpy as np
from pyspark.sql import functions as F

from fringeworks.llm import embeddings as E


def brute(m, least):
    u = m / np.linalg.norm(m, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= least, 1))
    return set(zip(i.tolist(), j.tolist()))


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(0)
    m = r.standard_normal((1500, 64)).astype(np.float32)
    m[1000:] = m[r.integers(0, 1000, 500)] + 0.2 * r.standard_normal((500, 64))
    m = m.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {(x.vec_a, x.vec_b) for x in E.pairs(df).collect()}
    want = brute(m.astype(float), 0.95)
    assert len(want) > 300
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_messy(spark):
    a, b = [1.0] * 8, [1.0] * 7 + [1.01]
    far = [float((-1) ** i) for i in range(8)]
    rows = [(1, a, 0, "x"), (1, a, 0, "x"), (2, b, None, "y"), (3, far, 1, None), (None, a, 1, "z"), (4, None, 1, "z"), (5, [], 1, "z"), (6, [0.0] * 8, 1, "z"), (7, [float("nan")] + a[1:], 1, "z"), (8, [None] + a[1:], 1, "z"), (9, [1.0] * 3, 1, "z"), (10, [float("inf")] + a[1:], 0, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    for c in ("id", "k", "a", "b", "v", "va", "vb", "n", "cosine"):  # names used inside
        df = df.withColumn(c, F.lit("z"))
    got = E.pairs(df).collect()
    assert [(x.vec_a, x.vec_b) for x in got] == [(1, 2)] and got[0].cosine > 0.99
    assert E.pairs(df.limit(0)).count() == 0
    assert E.pairs(df.where("vec_id = 3")).count() == 0


def test_pairs_are_made_once():
    parts = E._widths(64, 4)
    r = np.random.default_rng(1)
    a = r.integers(-(2**63), 2**63 - 1, 300)
    for bits in (0, 1, 2, 5, 11):
        b = a.copy()
        for i in range(300):
            for k in r.choice(64, bits, replace=False):
                b[i] = int(np.array([b[i]]).view(np.uint64)[0] ^ np.uint64(1 << int(k))) - (2**64 if int(np.array([b[i]]).view(np.uint64)[0] ^ np.uint64(1 << int(k))) >= 2**63 else 0)
        for x, y in zip(a[:60], b[:60]):
            keys = lambda c: {t << 40 | (int(E._part(np.int64(c), f, w)) ^ z) for t, (f, w) in enumerate(parts) for z in (0, *(1 << i for i in range(w)))}
            meet = keys(x) & keys(y)
            made = [k for k in meet if E._here(k, np.array([x]), np.array([y]), parts)[0]]
            assert len(made) == 1


def test_sql_equals_the_pairs(spark):
    import duckdb

    r = np.random.default_rng(4)
    m = r.standard_normal((300, 64)).astype(np.float32)
    m[200:] = m[:100] + 0.15 * r.standard_normal((100, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    c = duckdb.connect()
    c.register("embeddings", df.toArrow())
    want = {(a, b): x for a, b, x in c.sql(E.PAIRS).fetchall()}
    got = {(x.vec_a, x.vec_b): round(x.cosine, 5) for x in E.pairs(df).collect()}
    assert len(want) > 90 and len(got.keys() & want.keys()) >= 0.9 * len(want) and all(abs(want[k] - v) < 2e-5 for k, v in got.items())


def test_classes_equal_their_sql(spark):
    """Chains, copies that are equal, and vectors alone; one row each, whatever the number of pairs."""
    import duckdb

    r = np.random.default_rng(5)
    m = r.standard_normal((340, 64)).astype(np.float32)
    m[100:200] = m[:100] + 0.1 * r.standard_normal((100, 64)).astype(np.float32)
    m[200:240] = m[0]
    m[240:300] = m[1] + 0.05 * r.standard_normal((60, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m[r.permutation(340)])], "vec_id long, embedding array<float>")
    c = duckdb.connect()
    c.register("embeddings", df.toArrow())
    got = E.classes(df)
    assert got.columns == ["vec_id", "class_id", "links"] and sorted(map(tuple, got.collect())) == sorted(c.sql(E.ORACLE).fetchall())
    assert got.where("links >= 40").count() >= 100


def test_classes_of_messy_rows(spark):
    a, b = [1.0] * 8, [1.0] * 7 + [1.01]
    far, zero = [float((-1) ** i) for i in range(8)], [0.0] * 8
    rows = [(1, a), (1, a), (2, b), (3, a), (4, far), (4, a), (5, far), (None, a), (6, None), (7, zero), (8, zero), (9, [1.0] * 3), (10, [float("nan")] + a[1:]), (11, [float("inf")] + a[1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("id", "v", "h1", "h2", "n", "owner", "u", "k", "c", "top", "others", "several", "class_id", "links"):  # names used inside
        df = df.withColumn(c, F.lit("z"))
    got = {r.vec_id: (r.class_id, r.links) for r in E.classes(df).collect()}
    # 4 has two vectors: through it 5 is in the class of 1
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 4), 5: (1, 1)} | {i: (i, 0) for i in range(6, 12)}
    assert E.classes(df.limit(0)).count() == 0
    assert [tuple(r) for r in E.classes(df.where("vec_id = 6")).collect()] == [(6, 6, 0)]
