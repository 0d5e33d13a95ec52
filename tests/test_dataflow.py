import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks import cli
from fringeworks import schema as S
from fringeworks.functions import frame as FR
from fringeworks.functions import linalg as L
from fringeworks.functions import sphere as SP
from fringeworks.operators import geometry as G
from fringeworks.operators.eigen import Instrument
from fringeworks.operators import partition as PT
from fringeworks.operators import selection as SE
from fringeworks.operators import synthesis as SY
from fringeworks.operators import visibility as V
from fringeworks.plans import dataflow as D
from fringeworks.sources import observations as OB
from fringeworks.sources import stores as ST
from fringeworks.streaming.images import Accumulator, append_samples, running_images, sample_stream

WL, N, RA, DEC = 2.0, 6, 0.8, 0.5


def _source(l0, m0):
    return np.array([l0, m0, math.sqrt(1 - l0 * l0 - m0 * m0)])


@pytest.fixture(scope="module")
def observation(spark, tmp_path_factory):
    """Four integrations of six antennas that see one source at (l, m) = (0.05, -0.03)."""
    path = str(tmp_path_factory.mktemp("ms"))
    r = np.random.default_rng(0)
    xyz = r.normal(0, 15, (N, 3))
    src = FR.uvw_basis(RA, DEC) @ _source(0.05, -0.03)
    a = np.exp(2j * np.pi / WL * (xyz @ src))
    w = np.exp(-2j * np.pi / WL * ((xyz - xyz.mean(0)) @ SP.unit(DEC, RA)))  # the stations' beams look at the field centre
    s = np.outer(np.conj(w * a), w * a)
    rows = []
    for t in range(4):
        for i in range(N):
            for j in range(i, N):  # antenna1 <= antenna2: the lower triangle is [j, i]
                v = s[j, i]
                rows.append((56879.0 + t / 1e4, i, j, [[float(v.real), 0.0, 0.0, float(v.real)]] * 2, [[float(v.imag), 0.0, 0.0, float(v.imag)]] * 2, [[False] * 4, [t == 3, False, False, False]], [[1.0] * 4] * 2))
    spark.createDataFrame(rows, "time double, antenna1 int, antenna2 int, data_re array<array<double>>, data_im array<array<double>>, flag array<array<boolean>>, weight_spectrum array<array<double>>").write.parquet(f"{path}/main")
    spark.createDataFrame([(RA, DEC)], "ra double, dec double").write.parquet(f"{path}/field")
    spark.createDataFrame([([OB.C / WL, OB.C / WL * 1.01],)], "chan_freq array<double>").write.parquet(f"{path}/spectral_window")
    spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(xyz)], "ordinal int, position array<double>").write.parquet(f"{path}/antenna")
    return path, xyz


def test_the_source_is_found_at_its_pixel(spark, observation, tmp_path):
    path, _ = observation
    ms = OB.MeasurementSet(spark, path)
    assert ms.channels().count() == 2 and ms.times().count() == 4 and ms.field_center() == (RA, DEC)
    ds = D.build_dataset(ms, OB.plain_stations(ms.table("antenna")), f"{tmp_path}/ds", "mwa", channels=(0, 1), earth_fixed=False)
    assert ds.num_samples() == 4 and len(ds.field("d", 0)) == N and ds.header["n_beam"] == N
    with pytest.raises(IndexError):
        ds.field("wl", 99)
    px = D.build_pixels(spark, f"{tmp_path}/px", 41, math.degrees(2 * math.asin(0.2)))
    img = D.build_images(ds, px, f"{tmp_path}/img")
    assert img.tags() == ["full_image"]
    best = img.get("full_image").orderBy(F.desc("value")).first()
    at = px.pixels.where(F.col("pixel_id") == best.pixel_id).first()
    assert abs(at.l - 0.05) < 0.011 and abs(at.m + 0.03) < 0.011
    sel = D.build_selection(ds, f"{tmp_path}/sel", ["lsq,2,1,none,0.0001,1e9", "std,1,1,none,0.0001,1e9"])
    assert sel.select("tag").distinct().count() == 3
    img2 = D.build_images(ds, px, f"{tmp_path}/img", f"{tmp_path}/sel")
    assert len(img2.tags()) == 4
    with pytest.raises(KeyError):
        img2.get("nothing")
    flagged = V.visibilities(ms.main(), channels=(1, 2))
    assert flagged.select("time_id").distinct().count() == 3  # the last integration of channel 1 is flagged


@pytest.fixture(scope="module")
def turning(spark, tmp_path_factory):
    """Eight earth-fixed antennas, four integrations an hour apart, two channels, one source at (l, m) = (0.05, -0.03)."""
    path = str(tmp_path_factory.mktemp("turning"))
    r = np.random.default_rng(3)
    xyz, basis = r.normal(0, 12, (8, 3)), FR.uvw_basis(RA, DEC)
    freq = [OB.C / WL, OB.C / WL * 1.25]
    rows = []
    for t in range(4):
        mjd = 56879.0 + t / 24
        a = FR.sidereal_angle(mjd)
        p = xyz @ np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]])
        s = []
        for f in freq:
            k = 2 * np.pi * f / OB.C
            v = np.exp(1j * k * (p @ (basis @ _source(0.05, -0.03)))) * np.exp(-1j * k * ((p - p.mean(0)) @ basis[:, 2]))
            s.append(np.outer(np.conj(v), v))
        for i in range(8):
            for j in range(i, 8):
                v = [m[j, i] for m in s]
                rows.append((mjd, i, j, [[float(x.real), 0.0, 0.0, float(x.real)] for x in v], [[float(x.imag), 0.0, 0.0, float(x.imag)] for x in v], [[False] * 4] * 2, [[1.0] * 4] * 2))
    schema = "time double, antenna1 int, antenna2 int, {}_re array<array<double>>, {}_im array<array<double>>, flag array<array<boolean>>, weight_spectrum array<array<double>>"
    df = spark.createDataFrame(rows, schema.format("data", "data"))
    df.withColumns({f"corrected_data_{c}": F.col(f"data_{c}") for c in ("re", "im")}).write.parquet(f"{path}/main")
    spark.createDataFrame([(RA, DEC)], "ra double, dec double").write.parquet(f"{path}/field")
    spark.createDataFrame([(freq,)], "chan_freq array<double>").write.parquet(f"{path}/spectral_window")
    spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(xyz)], "ordinal int, position array<double>").write.parquet(f"{path}/antenna")
    return path, xyz, freq


def test_a_turning_array_sees_the_source_at_its_pixel(spark, turning, tmp_path):
    path, _, freq = turning
    ms = OB.MeasurementSet(spark, path)
    ds = D.build_dataset(ms, OB.plain_stations(ms.table("antenna")), f"{tmp_path}/ds", "skalow")
    got = ds.samples.orderBy("sample_id").toPandas()
    assert got.sample_id.tolist() == list(range(8)) and np.allclose(got.wl, [OB.C / f for f in freq] * 4)
    assert len(set(map(tuple, got.uvw))) == 4  # a channel's baselines are its time's
    px = D.build_pixels(spark, f"{tmp_path}/px", 41, math.degrees(2 * math.asin(0.2)))
    lmn = px.pixels.orderBy("pixel_id").toPandas()
    for channels, n in (((0, -1), 8), ((1, 2), 4)):
        one = D.build_dataset(ms, OB.plain_stations(ms.table("antenna")), f"{tmp_path}/d{n}", "skalow", channels=channels, column="corrected_data")
        assert one.num_samples() == n
        img = D.build_images(one, px, f"{tmp_path}/i{n}").get("full_image").toPandas()
        best = lmn[lmn.pixel_id == img.pixel_id[img.value.argmax()]].iloc[0]
        assert abs(best.l - 0.05) < 0.011 and abs(best.m + 0.03) < 0.011
    fewer = D.build_dataset(ms, OB.plain_stations(ms.table("antenna")), f"{tmp_path}/few", "skalow", times=(0, 1, 1), n_station=5)
    assert fewer.header["n_antenna"] == 5 and fewer.num_samples() == 2
    with pytest.raises(ValueError):
        D.build_dataset(ms, OB.plain_stations(ms.table("antenna")), f"{tmp_path}/no", "skalow", channels=(1, 5))


def test_levels_add_up_to_the_whole(spark):
    r = np.random.default_rng(1)
    n, b = 4, 3
    rows = []
    for s in range(3):
        v = r.normal(size=(n, b)) + 1j * r.normal(size=(n, b))
        uvw = r.normal(size=(n * n, 3)) if s == 1 else (lambda p: (p[None] - p[:, None]).reshape(-1, 3))(r.normal(size=(n, 3)))
        f = v.ravel(order="F")
        rows.append((s, 0.0, WL, 0.5, r.random(b).tolist(), f.real.tolist(), f.imag.tolist(), uvw.ravel(order="F").tolist()))
    samples = spark.createDataFrame(rows, S.SAMPLES)
    px = FR.lmn_grid(spark, 6, 0.3)
    cuts = [(0.0, 0.3), (0.3, 0.6), (0.6, 2.0)]
    sel = None
    for k, (lo, hi) in enumerate([(0.0, 2.0), *cuts]):
        part = samples.select(F.lit(f"t{k}").alias("tag"), "sample_id", F.transform("d", lambda x: F.when((x >= lo) & (x < hi), x).otherwise(0.0)).alias("d"))
        sel = part if sel is None else sel.unionByName(part)
    o = SY.Options(precision="double", batch=7)
    img = SY.image_synthesis(samples, sel, px, n, b, o, pixel_block=10).toPandas().pivot(index="pixel_id", columns="tag", values="value")
    assert len(img) == 36 and np.allclose(img.t0, img.t1 + img.t2 + img.t3)
    lmn = px.orderBy("pixel_id").toPandas()[["l", "m", "n"]].to_numpy()
    want = 0
    for _, _, wl, scale, d, re, im, uvw in rows:
        v = (np.array(re) + 1j * np.array(im)).reshape(n, b, order="F")
        want = want + L.direct_sum(L.virtual_vis(v, np.array(d), scale).ravel(order="F"), np.array(uvw).reshape(n * n, 3, order="F") * 2 * math.pi / wl, lmn)
    assert np.allclose(img.t0, want / 3)
    raw = SY.image_synthesis(samples, sel.where("tag = 't0'"), px, n, b, o.with_(normalize=False)).toPandas().sort_values("pixel_id").value
    assert np.allclose(raw, want)


def test_selection_errors(spark):
    samples = spark.createDataFrame([(0,), (1,)], "sample_id long")
    def sel(*rows):
        return spark.createDataFrame(list(rows), "tag string, sample_id long, d array<double>")
    S.check_selection(sel(("a", 0, [1.0]), ("b", 0, [2.0])), samples, 1)
    for bad in ([("a", 0, [1.0])] * 2, [("a", 7, [1.0])], [("a", 0, [1.0]), ("b", 1, [1.0])], [("a", 0, [1.0, 2.0])], [("a.b", 0, [1.0])]):
        with pytest.raises(ValueError):
            S.check_selection(sel(*bad), samples, 1)
    with pytest.raises(ValueError):
        SE.infer_intervals(sel().select("sample_id", F.lit(0).alias("eig_idx"), F.lit(1.0).alias("d")), 2, 1, "log", -1, 1)
    with pytest.raises(ValueError):
        SE.infer_intervals(sel().select("sample_id", F.lit(0).alias("eig_idx"), F.lit(1.0).alias("d")), 2, 1, "cube", 0, 1)
    with pytest.raises(ValueError):
        SE.Spec.parse("lsq,3,1")
    assert SE.level_tag(0, "lsq", 0.5, 2) == "s0_lsq_[5_0000E-01,2_0000E+00)"
    with pytest.raises(ValueError):
        SY.Options().with_(precision="half")


def test_intervals(spark):
    c = spark.createDataFrame([(1.0,), (9.0,), (4.0,)], "c double")
    got = [(r.level, r.lo, r.hi) for r in SE.centroid_intervals(c, 0.5, 20.0).orderBy("level").collect()]
    assert got == [(0, 6.5, 20.0), (1, 2.5, 6.5), (2, 0.5, 2.5)]
    one = SE.centroid_intervals(c.limit(1), 0.5, 20.0).first()
    assert (one.lo, one.hi) == (0.5, 20.0)
    v = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([1, 1, 1, 5, 5, 90])], "sample_id long, eig_idx int, d double")
    assert SE.trimmed(v, 0.999).count() == 6 and SE.trimmed(v, 0.5).count() == 3 and SE.trimmed(v, 1.0).count() == 6
    heavy = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([*(2.0**-k for k in range(40)), *[1e9] * 3])], "sample_id long, eig_idx int, d double")
    whole = sorted(r.d for r in heavy.collect())
    for most in (1, 4, 100):
        assert sorted(r.d for r in SE.trimmed(heavy, 0.4, most).collect()) == whole[: 43 - 25]
    for most in (1, 5, 1000):
        assert SE.quantiles(heavy, "d", [0.0, 0.25, 0.5, 0.77, 1.0], most) == pytest.approx(np.quantile(whole, [0.0, 0.25, 0.5, 0.77, 1.0]))
    assert SE.quantiles(heavy.limit(0), "d", [0.5]) == [] and SE.quantiles(v.where("d = 1"), "d", [0.5], 1) == [1.0]
    assert SE.kmeans_1d(v, 3) == pytest.approx([90, 5, 1])
    assert SE.trimmed(v.where("d = 1"), 0.5).count() == 2 and SE.trimmed(v.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("n", [1, 100, 4000])
def test_partition_properties(spark, n):
    r = np.random.default_rng(42)
    p = np.c_[r.uniform(-5, 10, n), r.uniform(2, 20, n), r.uniform(100, 5000, n)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i long, x double, y double, z double")
    cells = PT.grid_cells(df, (2, 3, 4))
    perm = PT.permutation(cells, "i").toPandas()
    assert sorted(perm.target) == list(range(n))
    off = PT.offsets(cells).toPandas()
    assert off["size"].sum() == n
    for c, g in perm.groupby("cell"):
        row = off[off.cell == c].iloc[0]
        assert g.target.min() == row.begin and len(g) == row["size"]
        for k, col in enumerate("xyz"):
            assert g[col].max() - g[col].min() <= (df_extent := p[:, k].max() - p[:, k].min()) / (2, 3, 4)[k] + 1e-9 * df_extent
    assert PT.auto_dims((100, 10, 1), (1, 1, 1), 1e12) == (1, 1, 1)
    assert max(PT.auto_dims((1e4, 10, 1), (1, 1, 1), 1e5)) > 1 and PT.Partition.grid((1, 2, 3)).dims == (1, 2, 3)
    with pytest.raises(ValueError):
        PT.Partition.grid((0, 1, 1))


def test_stores(spark, tmp_path):
    px = ST.PixelSet.create(spark, f"{tmp_path}/p", 2, 2, 5.0, FR.lmn_grid(spark, 2, 0.1))
    px.set_meta("a", 3), px.set_meta("b", 2.5), px.set_meta("c", [1.0, 2.0])
    assert px.meta_data() == {"a": 3, "b": 2.5, "c": [1.0, 2.0]} and ST.PixelSet.open(spark, f"{tmp_path}/p").pixels.count() == 4
    for k, v in (("a", 1), ("d", [])):
        with pytest.raises(ValueError):
            px.set_meta(k, v)
    im = ST.Images.create(spark, f"{tmp_path}/i", 1, 2, 5.0, 0.0, 0.0)
    im.set(spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("y", 0, 1.0)], "tag string, pixel_id long, value double"))
    im.set(spark.createDataFrame([("x", 0, 7.0), ("x", 1, 8.0)], "tag string, pixel_id long, value double"))
    assert im.tags() == ["x", "y"] and [r.value for r in im.get("x").collect()] == [7.0, 8.0]
    with pytest.raises(S.FormatError):
        im.get("y")
    with pytest.raises(ValueError):
        im.set(spark.createDataFrame([("a b", 0, 1.0)], "tag string, pixel_id long, value double"))
    ds = ST.Dataset.create(spark, f"{tmp_path}/d", "", 1, 1, 0, 0)
    with pytest.raises(Exception, match="array lengths"):
        ds.append(spark.createDataFrame([(0, 0.0, 1.0, 1.0, [1.0, 2.0], [1.0], [0.0], [0.0] * 3)], S.SAMPLES))
    with pytest.raises(S.FormatError):
        S.check_version(2, 0)
    sel = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 0, [0.5, 1.5])], S.SELECTION)
    j = json.loads(ST.selection_to_json(sel).first().json)
    assert j == {"a": {"0": [0.5, 1.5], "1": [1.0, 2.0]}}


def test_instruments(spark, tmp_path):
    (tmp_path / "i.csv").write_text("STATION_ID,X,Y,Z\n0,1.0,2.0,3.0\n3,4.0,5.0,6.0\n")
    a = OB.instrument_csv(spark, str(tmp_path / "i.csv"))
    assert a.count() == 2 and OB.instrument_csv(spark, str(tmp_path / "i.csv"), 1).first().x == 1.0
    with pytest.raises(ValueError):
        OB.first_stations(a, 5)
    e = OB.tile_elements(a).toPandas()
    assert len(e) == 32 and np.allclose(e[e.station_id == 3][["x", "y", "z"]].mean(), [4, 5, 6])
    f = spark.createDataFrame([(0, [1.0, 1.0, 1.0], [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [9.0, 9.0, 9.0]], [[False], [False], [True]])], "station_id long, position array<double>, element_offset array<array<double>>, element_flag array<array<boolean>>")
    assert OB.element_stations(f).count() == 2 and OB.element_stations(f, station_only=True).first().x == 1.5
    (tmp_path / "c.tsv").write_text("RA\tDEC\tTotal_flux\n10.0\t0.0\t2.0\n200.0\t45.0\t9.0\n")
    cat = OB.catalogue(spark, str(tmp_path / "c.tsv")).withColumn("src_id", F.lit(1))
    assert G.top_sources(cat, 1, [1, 0, 0], 1.0).first().intensity == 2.0
    with pytest.raises(ValueError):
        G.top_sources(cat, 2, [1, 0, 0], 1.0)
    with pytest.raises(ValueError):
        OB.MeasurementSet(spark, str(tmp_path / "none"))
    o = G.ordinals(a, "station_id")
    assert G.nyquist_rate(o, 1.0) > 30 and G.kernel_bandwidth(o, 1.0, np.eye(3)) % 2 == 1 and G.same_index(a, a, "station_id") and not G.same_index(a, a.limit(1), "station_id")
    turning = np.stack([[[math.cos(t), math.sin(t), 0.1] for t in np.linspace(0, 1, 20)]])
    assert np.allclose(np.abs(G.rotation_plane(turning)[2]), [0, 0, 1], atol=1e-6)


def test_the_plane_that_antennas_turn_in():
    r = np.random.default_rng(0)
    i = Instrument(r.normal(size=(5, 3)), np.arange(5), RA, DEC)
    m = i.rotation(56879.0, 56879.4)
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(np.abs(m[2]), [0, 0, 1])
    turned = np.stack([i.positions(t) for t in (56879.0, 56879.2)]) @ m.T
    assert np.allclose(turned[0, :, 2], turned[1, :, 2])
    with pytest.raises(ValueError):
        i.rotation(2.0, 1.0)


def test_slices(spark):
    ids = lambda *a: [r.id for r in spark.range(10).where(V.in_slice(F.col("id"), *a)).collect()]
    assert ids(2, -1, 3) == [2, 5, 8] and ids(0, 4, 1) == [0, 1, 2, 3]
    for bad in ((0, -2, 1), (-1, 3, 1), (0, 3, 0)):
        with pytest.raises(ValueError):
            V.in_slice(F.col("id"), *bad)
    for bad in ((-1, 3), (4, 4), (0, -2)):
        with pytest.raises(ValueError):
            OB.channel_range(spark.range(3).withColumnRenamed("id", "channel_id"), *bad)
    steps = spark.createDataFrame([(i, float(t)) for i, t in enumerate([0, 1, 5, 4, 6, 2, 7, 8])], "ordinal long, time double")
    for block in (1, 2, 3, 100):
        assert sorted(r.ordinal for r in V.unsorted_times(steps.repartition(3), block).collect()) == [3, 5]
    parts = {r.sample_id: r.part for r in PT.sample_blocks(spark.range(10).withColumnRenamed("id", "sample_id"), 4).collect()}
    assert [parts[i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError):
        V.reduce_polarisations(spark.range(1))


def test_streams(spark, tmp_path):
    ds = ST.Dataset.create(spark, f"{tmp_path}/a", "", 1, 1, 0, 0)
    to = ST.Dataset.create(spark, f"{tmp_path}/b", "", 1, 1, 0, 0)
    for k in range(3):
        ds.append(spark.createDataFrame([(k, 0.0, 1.0, 1.0, [1.0 + k], [1.0], [0.0], [0.0] * 3)], S.SAMPLES))
    q = append_samples(sample_stream(spark, ds, 1), to, f"{tmp_path}/c1")
    q.processAllAvailable(), q.stop()
    assert sorted(r.sample_id for r in to.samples.collect()) == [0, 1, 2]
    px = FR.lmn_grid(spark, 2, 0.1)
    acc = Accumulator(spark, f"{tmp_path}/acc", lambda df: SY.image_synthesis(df, ST.default_selection(df), px, 1, 1, SY.Options(precision="double", normalize=False)))
    q = sample_stream(spark, ds, 1).writeStream.foreachBatch(acc).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable(), q.stop()
    assert [r.value for r in acc.images().collect()] == pytest.approx([2.0] * 4)
    vis = sample_stream(spark, ds).select(F.lit("t").alias("tag"), "sample_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), F.lit(0).alias("j"), *(F.lit(0.0).alias(c) for c in "uvw"), F.col("d")[0].alias("re"), F.lit(0.0).alias("im"))
    q = running_images(vis, px).writeStream.outputMode("complete").format("memory").queryName("imgs").start()
    q.processAllAvailable(), q.stop()
    assert [(r["sum"], r.samples) for r in spark.table("imgs").collect()] == [(12.0, 3)] * 4


def test_command_line(spark, observation, tmp_path, monkeypatch, capsys):
    path, _ = observation
    cli.main(["dataset", "--ms", path, "--telescope", "mwa", "-o", f"{tmp_path}/ds"])
    cli.main(["dataset", "--ms", path, "--telescope", "mwa", "-o", f"{tmp_path}/two", "--channel", "1", "2", "--data", "DATA", "--station", "4"])
    two = ST.Dataset.open(spark, f"{tmp_path}/two")
    assert two.header["n_antenna"] == 4 and two.num_samples() == 3
    cli.main(["selection", "--json", "--dataset", f"{tmp_path}/ds", "-s", "sqrt,1,1,none,0.001,1e9", "-o", f"{tmp_path}/s"])
    cli.main(["image_prop", "--npixel", "5", "--fov", "4", "-o", f"{tmp_path}/p"])
    cli.main(["synthesis", "--dataset", f"{tmp_path}/ds", "--image_prop", f"{tmp_path}/p", "--selection", f"{tmp_path}/s", "-o", f"{tmp_path}/i"])
    assert ST.stored_selection(spark, f"{tmp_path}/s.json").exceptAll(ST.stored_selection(spark, f"{tmp_path}/s")).isEmpty()
    cli.main(["plot", "--images", f"{tmp_path}/i"])
    assert "s0_sqrt" in capsys.readouterr().out
