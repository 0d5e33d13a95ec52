import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions import checks as C
from fringeworks.functions import filters as FL
from fringeworks.functions import frame as FR
from fringeworks.functions import grids as GR
from fringeworks.functions import linalg as L
from fringeworks.functions import projections as PJ
from fringeworks.functions import sphere as SP
from fringeworks.functions import thresholds as TH
from fringeworks.functions import windows as WN


def test_rotations():
    assert np.allclose(SP.rot([0, 0, 1], math.pi / 2) @ [1, 0, 0], [0, 1, 0])
    assert SP.z_rot2angle(SP.rot([0, 0, 2], -0.7)) == pytest.approx(-0.7)
    with pytest.raises(ValueError):
        SP.z_rot2angle(SP.rot([1, 0, 0], 0.3))
    with pytest.raises(ValueError):
        SP.rot([0, 0, 0], 1)
    b = FR.uvw_basis(0.3, -0.4)
    assert np.allclose(b.T @ b, np.eye(3)) and np.allclose(b[:, 2], SP.unit(-0.4, 0.3))


def test_grid_counts_and_unit_length(spark):
    assert GR.equal_angle(spark, 3).count() == 64
    colat = sorted(r[0] for r in GR.equal_angle(spark, 3).select("colat").distinct().collect())
    assert np.round(colat, 2).tolist() == [0.2, 0.59, 0.98, 1.37, 1.77, 2.16, 2.55, 2.95]
    f = GR.fibonacci(spark, 2).toPandas()
    assert len(f) == 36 and np.allclose((f[["x", "y", "z"]] ** 2).sum(axis=1), 1)
    for n, want in ((0, 0), (1, 12), (2, 12), (3, 48)):
        h = GR.healpix(spark, n).toPandas()
        assert len(h) == want
        if want:
            assert np.allclose((h[["x", "y", "z"]] ** 2).sum(axis=1), 1) and np.allclose(h[["x", "y", "z"]].mean(), 0, atol=1e-12)
    d = SP.unit(0.2, 2.0)
    for g in (GR.spherical(spark, d, 0.4, (5, 6)), GR.uniform(spark, d, 0.4, (5, 5)), GR.fibonacci(spark, 9, d, 0.6)):
        p = g.toPandas()[["x", "y", "z"]].to_numpy()
        assert len(p) and (p @ d > math.cos(0.31)).all()
    south = GR.spherical(spark, [0, 0, -1], 0.2, (2, 3)).toPandas()
    assert (south.z < 0).all()
    with pytest.raises(ValueError):
        GR.equal_angle(spark, 3, [0, 0, 1], 0.5)
    with pytest.raises(ValueError):
        GR.fibonacci(spark, 3, [1, 0, 0])


def test_sphere_errors(spark):
    x, _, _ = SP.pol2cart(F.lit(-1.0), F.lit(0.1), F.lit(0.1))
    with pytest.raises(Exception, match="non-negative"):
        spark.range(1).select(x).collect()


def test_windows(spark):
    w = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.1, 0.5, 0.95, 1.0, 2.0)], "x double").select(WN.tukey(F.col("x"), 1, 0.5, 0.4)).toPandas().iloc[:, 0]
    assert np.round(w, 4).tolist() == [0, 0, 0.5, 1, round(math.sin(math.pi / 0.4 * 0.05) ** 2, 4), 0, 0]
    t = np.array([-1, -0.2, 0.3, 0.9, 1.0])
    k = spark.createDataFrame([(float(v),) for v in t], "x double").select(WN.dirichlet(F.col("x"), 4)).toPandas().iloc[:, 0]
    assert np.allclose(k, WN.dirichlet_np(t, 4)) and k.iloc[-1] == pytest.approx(25 / (4 * math.pi))
    with pytest.raises(Exception, match="lie in"):
        spark.range(1).select(WN.dirichlet(F.lit(1.5), 3)).collect()
    s, near = WN.DirichletSpline(30), np.cos(np.linspace(0, 0.3, 50))
    assert np.abs(s(near) - WN.dirichlet_np(near, 30)).max() < 0.02 * WN.dirichlet_np(1.0, 30)[0]
    with pytest.raises(ValueError):
        WN.DirichletSpline(10)


def test_kent_integrates_to_one(spark):
    g = GR.fibonacci(spark, 60).toPandas()[["x", "y", "z"]].to_numpy()
    k = WN.Kent(20.0, 0.6, [0, 0, 1], [1, 0, 0])
    assert k(g).mean() * 4 * math.pi == pytest.approx(1, rel=1e-3)
    a = WN.Kent.angular_support(20.0, 0.6)
    assert WN.Kent.min_scale(a, 0.6) == pytest.approx(20, rel=1e-3)
    with pytest.raises(ValueError):
        WN.Kent(1, 0.5, [1, 0, 0], [1, 0, 0])


def test_thresholds():
    assert [TH.jv_threshold(x) for x in (1, 2, 1000)] == [7, 9, 1041] and TH._order("j", 1500.0) == 1547
    assert [TH.spherical_jn_threshold(x) for x in (1, 2, 1000)] == [6, 8, 1029] and TH._order("sph", 1500.0) == 1531
    assert [TH.ive_threshold(x) for x in (1, 2, 1000)] == [11, 13, 194]
    assert [TH.spherical_jn_series_threshold(x) for x in (1, 2, 3, 4)] == [3, 4, 5, 6]
    assert [TH.jv_series_threshold(x) for x in (1, 51, 101)] == [2, math.ceil(53 / 51 * 51), 103]
    assert TH.spherical_jn_series_threshold(7.3) == math.ceil(TH.spherical_jn_series_threshold(7.0) / 7 * 7.3)
    assert TH.spherical_jn_series_threshold(12.0, table_lookup=False, epsilon=0.5) < TH.spherical_jn_series_threshold(12.0)
    with pytest.raises(ValueError):
        TH.spherical_jn_series_threshold(1.0, False, 2.0)


def test_filters(spark):
    with pytest.raises(ValueError):
        FL.apply_filter("nope", F.lit(1.0))
    df = spark.createDataFrame([(-4.0,), (0.0,), (4.0,), (9.0,)], "d double")
    got = df.select(*(FL.masked_filter(n, F.col("d"), -5, 4).alias(n) for n in FL.FILTERS)).toPandas()
    assert got.lsq.tolist() == [-4, 0, 4, 0] and got["std"].tolist() == [-1, 0, 1, 0] and got.sqrt.tolist() == [-2, 0, 2, 0]
    assert got.inv.tolist() == [-0.25, 0, 0.25, 0] and got.inv_sqrt.tolist() == [-0.5, 0, 0.5, 0]
    FL.register(spark)
    df.createOrReplaceTempView("evs")
    assert [r[0] for r in spark.sql("select ev_inv_sqrt(d) from evs order by d").collect()] == [-0.5, 0, 0.5, pytest.approx(1 / 3)]


def test_projection_centre(spark):
    for k in ("AEQD", "LAEA", "GNOM", "LCC"):
        x, y = PJ.project(k, F.lit(0.3), F.lit(0.7), 0.3, 0.7)
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert abs(r.x) < 1e-12 and abs(r.y) < 1e-12
    x, y = PJ.project("ROBIN", F.lit(math.pi), F.lit(0.0))
    assert spark.range(1).select(x.alias("x")).first().x == pytest.approx(0.8487 * math.pi)
    with pytest.raises(ValueError):
        PJ.project("MOON", F.lit(0.0), F.lit(0.0))


def _psd(r, n):
    a = r.normal(size=(n, n)) + 1j * r.normal(size=(n, n))
    return a @ a.conj().T


def test_generalised_eigenproblem():
    r = np.random.default_rng(0)
    xyz, w, s = r.normal(0, 20, (9, 3)), r.normal(size=(9, 5)) + 1j * r.normal(size=(9, 5)), _psd(r, 5)
    v, d, scale = L.eigh_gram(2.0, np.tril(s), w, xyz)
    g = L.gram(xyz, w, 2.0)
    y = np.linalg.lstsq(w, v, rcond=None)[0]
    assert np.allclose(s @ y, g @ y * d) and np.allclose(y.conj().T @ g @ y, np.eye(5))
    assert (np.diff(d) >= 0).all() and scale == pytest.approx(1 / 25)
    assert np.allclose(L.gram(xyz, w, 2.0, four_pi=True), 4 * math.pi * g)
    s[2, :] = s[:, 2] = 0
    v, d, scale = L.eigh_gram(2.0, s, w, xyz)
    assert d[-1] == 0 and np.allclose(v[:, -1], 0) and scale == pytest.approx(1 / 16)
    with pytest.raises(L.EigensolverError):
        L.eigh_gram(2.0, np.eye(2, dtype=complex), np.eye(2, dtype=complex), np.zeros((2, 3)))
    v, d, scale = L.eigh(1.0, np.zeros((3, 3), complex), np.eye(3, dtype=complex))
    assert scale == 0 and not d.any()


def test_psd_eigen():
    r = np.random.default_rng(1)
    a = np.diag([5.0, 3.0, 2.0, -1.0]).astype(complex)
    d, v = L.eigh_psd(a)
    assert np.allclose(d, [5, 3, 2])
    assert np.allclose(L.eigh_psd(a, tau=0.8)[0], [5, 3]) and np.allclose(L.eigh_psd(a, n=5)[0], [5, 3, 2, 0, 0])
    b = _psd(r, 4)
    d, v = L.eigh_psd(_psd(r, 4), b)
    assert np.allclose(v.conj().T @ b @ v, np.eye(4))


def test_sums_agree():
    r = np.random.default_rng(2)
    pos, v, d, lmn = r.normal(size=(5, 3)), r.normal(size=(5, 4)) + 1j * r.normal(size=(5, 4)), r.random(4), r.normal(size=(30, 3))
    uvw = (pos[None, :, :] - pos[:, None, :]).reshape(-1, 3)
    assert np.allclose(L.separable(uvw, 5), pos - pos[0])
    want = L.direct_sum(L.virtual_vis(v, d).ravel(order="F"), uvw, lmn)
    assert np.allclose(L.factorised(v, d[None], L.separable(uvw, 5), lmn)[0], want)
    uvw[3] += 0.1
    assert L.separable(uvw, 5) is None


def test_wishart_mean():
    r = np.random.default_rng(3)
    s = _psd(r, 3)
    x = L.Wishart(s, 50, r)(4000)
    assert np.allclose(x.mean(0) / 50, s, atol=0.1 * np.abs(s).max())
    with pytest.raises(ValueError):
        L.Wishart(s, 2, r)
    with pytest.raises(ValueError):
        L.Wishart(np.array([[1, 2], [0, 1.0]]), 5, r)
    assert np.allclose(np.abs(L.steering(r.normal(size=(3, 4)), r.normal(size=(3, 6)), 2.0)), 1)


def test_checks():
    @C.check(n=C.is_even, x=C.allow_none(C.has_reals))
    def f(n, x=None):
        return n

    assert f(2) == 2 and f(4, [1.0, 2.0]) == 4
    for bad in ((3,), (True,), (2, "a")):
        with pytest.raises(ValueError):
            f(*bad)
    with pytest.raises(ValueError):
        C.check(nope=C.is_real)(lambda a: a)
    assert C.is_pow2(8) and not C.is_pow2(0) and C.has_pow2s([1, 2]) and C.has_odds((1, 3)) and not C.has_evens([1])
    assert C.has_shape((2, 2))(np.eye(2)) and C.has_ndim(1)([1]) and C.is_array_shape((2, 3)) and not C.is_array_shape(())
    assert C.accept_any(C.is_real, C.is_complex)(1j) and not C.require_all(C.is_real, C.is_integer)(1.5) and C.is_instance(int)(1)
    assert C.has_booleans([True]) and C.has_complex([1j]) and C.has_integers([1]) and C.is_scalar(np.float64(1)) and C.is_odd(3)


def test_quadrature_and_interpolation(spark):
    from fringeworks.operators import interpolate as IP

    n = 6
    grid = IP.equal_angle_weights(GR.equal_angle(spark, n), n)
    assert grid.agg(F.sum("weight")).first()[0] == pytest.approx(4 * math.pi)
    x, y, z = SP.pol2cart(F.lit(1.0), F.col("colat"), F.col("lon"))
    support = grid.select((F.col("q") * 100 + F.col("l")).alias("s_id"), "weight", x.alias("x"), y.alias("y"), z.alias("z")).withColumn("f", 2 + F.col("z") * F.col("x"))
    target = GR.fibonacci(spark, 2).withColumnRenamed("pixel_id", "r_id")
    got = IP.interpolate(support, target, n).join(target, "r_id").toPandas()
    assert np.allclose(got.value, 2 + got.z * got.x)
    mask = IP.sparsity_mask(support, target, n, lobes=2.0)
    assert 0 < mask.count() < support.count() * target.count() and IP.interpolate(support, target, n, mask).count() == target.count()
