import numpy as np

from fringeworks.llm import quality as Q
from fringeworks.llm.workspace import documents

BIG = "/root/testdata/sf0.01"


def test_messy(messy, nothing, labels):
    rows = Q.scored(messy, labels).collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.quality_score is None and r.toxic_score is None and not r.keep for i in (3, 4, 7) for r in by[i])
    assert all(r.keep for r in by[1])  # too few labels to reject anything
    assert len({tuple(r) for r in by[1]}) == 1
    kept = Q.kept(messy, labels)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {1, 2, None, 6, 8, 9, 10, 11, 12}
    assert Q.scored(nothing, labels).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, BIG), spark.read.parquet(f"{BIG}/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("text", "quality", "toxic").toArrow()
    _, _, keep, _ = model.score(rows.column("text").combine_chunks())
    q, t = rows.column("quality").to_numpy(), rows.column("toxic").to_numpy()
    clean = (q == 1) & (t == 0)
    assert keep[clean].mean() > 0.97
    assert keep[q == 0].mean() < 0.25


def test_tables_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit(x, y, Q.Params(rounds=20))
    z = r.random((1000, 3))
    assert ((m.logit(z) > 0) == ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5))).mean() > 0.9
