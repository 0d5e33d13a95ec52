"""Eigenproblems of many groups at once equal those of each group alone."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fringeworks.functions import linalg as L
from fringeworks.operators import eigen as EG
from fringeworks.plans.observation_queries import QUERIES

WL = 2.0


def _matrices(n, beams, seed=7):
    """Lower triangles, some without some beams and one without any."""
    r = np.random.default_rng(seed)
    s = np.tril(r.normal(size=(n, beams, beams)) + 1j * r.normal(size=(n, beams, beams)))
    for m in s:
        off = r.random(beams) < 0.25
        m[off], m[:, off] = 0, 0
    s[0] = 0
    return s


def _rows(s):
    """Visibilities of matrix k as time k // 2 (null for 0) and channel k % 2."""
    i, j = np.tril_indices(s.shape[1])
    return [(k // 2 or None, k % 2, int(a), int(b), float(m[a, b].real), float(m[a, b].imag)) for k, m in enumerate(s) for a, b in zip(i, j)]


SCHEMA = "time_id bigint, channel_id bigint, beam_i bigint, beam_j bigint, re double, im double"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_group_costs_no_call_of_its_own(spark):
    """6,000 groups of three rows are solved in few calls (each was one before)."""
    k = F.col("id")
    vis = spark.range(18_000).select(F.floor(k / 3).cast("bigint").alias("time_id"), F.greatest(k % 3 - 1, F.lit(0)).alias("beam_i"), F.greatest(k % 3 - 1, F.lit(0)).alias("beam_j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))

    def solve(first, s):
        return [first["time_id"], np.full(len(s), len(s))]

    got = EG.solved(vis, ["time_id"], 2, solve, "time_id bigint, together bigint").toPandas()
    assert sorted(got.time_id) == list(range(6_000))
    assert (1 / got.together).sum() < 60  # calls


@pytest.mark.parametrize("name", ["eigen_gram", "eigen_plain", "eigen_positive", "eigen_two_gram", "eigen_two_plain"])
def test_no_query_goes_group_by_group(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("positions", [False, True])
@pytest.mark.parametrize("entries", [1, 40, 1 << 18])
def test_stage_equals_each_group_alone(spark, small_batches, monkeypatch, positions, entries):
    """Groups cut by batches, in stacks of one, few and many; null keys, beams that don't work, an empty matrix."""
    monkeypatch.setattr(EG, "_ENTRIES", entries)
    r = np.random.default_rng(3)
    s, xyz, w = _matrices(21, 4), r.normal(0, 20, (6, 3)), r.normal(size=(6, 4)) + 1j * r.normal(size=(6, 4))
    vis = spark.createDataFrame(_rows(s), SCHEMA).repartition(3)
    got = {(x.time_id, x.channel_id): x for x in EG.eigen_stage(vis, w, xyz if positions else None, WL).collect()}
    assert len(got) == len(s)
    for k, m in enumerate(s):
        v, d, scale = L.eigh_gram(WL, m, w, xyz) if positions else L.eigh(WL, m, w)
        x = got[k // 2 or None, k % 2]
        assert np.allclose(x.d, d) and x.scale == pytest.approx(scale)
        assert np.allclose(np.array(x.v_re) + 1j * np.array(x.v_im), v.ravel(order="F"))


def test_samples_equal_each_group_alone(spark, small_batches):
    """Positions, weights and wavelength are each group's own."""
    r = np.random.default_rng(4)
    it = EG.Instrument(r.normal(0, 20, (5, 3)), np.array([0, 1, 1, 2, 3]), 1.0, 0.5)
    s = _matrices(8, 4)
    rows = [(t or 0, c, 56000.0 + (t or 0) / 24, 2.0 + c, *rest) for t, c, *rest in _rows(s)]
    vis = spark.createDataFrame(rows, "time_id bigint, channel_id bigint, time double, wl double, beam_i bigint, beam_j bigint, re double, im double")
    got = {x.sample_id: x for x in EG.solved_samples(vis, it, 2).collect()}
    assert sorted(got) == list(range(8))
    for k, m in enumerate(s):
        x, t, wl = got[k], 56000.0 + k // 2 / 24, 2.0 + k % 2
        p = it.positions(t)
        v, d, scale = L.eigh_gram(wl, m, it.weights(p, wl), p)
        assert (x.time, x.wl) == (t, wl) and np.allclose(x.d, d) and x.scale == pytest.approx(scale)
        assert np.allclose(np.array(x.v_re) + 1j * np.array(x.v_im), v.ravel(order="F"))
        assert np.allclose(np.array(x.uvw).reshape(3, 5, 5)[:, 2, 4], (p[4] - p[2]) @ EG.uvw_basis(1.0, 0.5))


def test_groups_stay_whole():
    keys = [0, 0, 0, None, None, 1, 2, 2, 2, 2, 2, 2, 2, 3]
    table = pa.table({"g": pa.array(keys, pa.int64()), "row": range(len(keys))})
    for size in range(1, 16):
        parts = list(EG.whole_groups(table.to_batches(max_chunksize=size), ["g"]))
        assert pa.concat_tables(parts).equals(table)
        assert all(a["g"][-1].as_py() != b["g"][0].as_py() for a, b in zip(parts, parts[1:]))
    assert not list(EG.whole_groups([], ["g"])) and not list(EG.whole_groups(table.slice(0, 0).to_batches(), ["g"]))


def test_stacks_of_positive_pairs():
    h = _matrices(12, 4) * 3
    h = h + np.tril(h, -1).conj().swapaxes(1, 2)
    b = np.eye(4) * 2 + 0.1
    for args in ((), (b,), (b, 0.7), (None, 0.7, 2), (None, 1.0, 6)):
        d, v = L.eigh_psd(h, *args)
        for k, m in enumerate(h):
            dk, vk = L.eigh_psd(m, *args)
            assert np.allclose(d[k, : len(dk)], dk) and not d[k, len(dk) :].any()
            assert np.allclose(v[k, :, : len(dk)], vk) and not v[k, :, len(dk) :].any()


def test_a_singular_gram_matrix_in_a_stack():
    s = np.stack([np.zeros((2, 2), complex), np.eye(2, dtype=complex)])
    assert not L.eigh_gram(WL, s[:1], np.eye(2, dtype=complex), np.zeros((2, 3)))[1].any()
    with pytest.raises(L.EigensolverError):
        L.eigh_gram(WL, s, np.eye(2, dtype=complex), np.zeros((2, 3)))


def test_values_above_the_diagonal_dont_count():
    s = _matrices(3, 3)
    other = s.copy()
    other[:, 0, 2] = np.inf
    for a, b in zip(L.eigh(WL, s, np.eye(3)), L.eigh(WL, other, np.eye(3))):
        assert (a == b).all()
