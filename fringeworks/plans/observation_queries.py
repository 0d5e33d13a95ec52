"""More registered queries: observations, stores and instruments, written and read again, and closed forms.

Stores live in the folder of ``spark.checkpoint.dir``, or in a temporary one where a local session has none.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frame as FR
from ..functions import linalg as L
from ..functions import projections as PJ
from ..functions import sphere as SP
from ..functions import windows as WN
from ..operators import eigen as EG
from ..operators import geometry as G
from ..operators import partition as PT
from ..operators import visibility as V
from ..sources import observations as OB
from ..sources import stores as ST
from . import dataflow as D
from .queries import _WEIGHTS, _WL, ORACLES, QUERIES, _ant_sql, _antennas, _config, _points, _r, _t, query

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fringeworks-")
    return f"{root}/{uuid.uuid4().hex[:12]}"


# -- observations


_MAIN = """m AS (SELECT event_id, event_id // 64 AS t, user_id % 6 AS a1, event_id % 6 AS a2, value FROM events WHERE event_id < 6400),
f AS (SELECT t, least(a1, a2) AS a1, greatest(a1, a2) AS a2, max(value) AS value, min(event_id) AS e FROM m GROUP BY ALL),
p AS (SELECT *, c AS channel_id, value * (c + 1) AS p0, value + c AS p3, (e + c) % 7 = 0 OR (e + c) % 11 = 0 AS flagged FROM f, range(4) r(c))"""


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main table of 100 integrations, six antennas and four channels, made of events."""
    e = _t(spark, sf_dir, "events").where("event_id < 6400")
    i, j = F.col("user_id") % 6, F.col("event_id") % 6
    g = e.groupBy(F.floor(F.col("event_id") / 64).alias("t"), F.least(i, j).cast("int").alias("antenna1"), F.greatest(i, j).cast("int").alias("antenna2")).agg(F.max("value").alias("v"), F.min("event_id").alias("e"))
    chan = F.sequence(F.lit(0), F.lit(3))
    val = lambda s: F.transform(chan, lambda c: F.array(F.col("v") * (c + 1) * s, F.lit(0.0), F.lit(0.0), (F.col("v") + c) * s))
    flag = F.transform(chan, lambda c: F.array((F.col("e") + c) % 7 == 0, F.lit(False), F.lit(False), (F.col("e") + c) % 11 == 0))
    weight = F.transform(chan, lambda c: F.array(F.col("v") + 1, F.lit(1.0), F.lit(1.0), F.col("v") + 2))
    return g.select((56000 + F.col("t") / 24).alias("time"), "antenna1", "antenna2", val(1.0).alias("data_re"), val(0.5).alias("data_im"), flag.alias("flag"), weight.alias("weight_spectrum"))


def _observation(spark: SparkSession, sf_dir: str) -> OB.MeasurementSet:
    path = _folder(spark)
    _main(spark, sf_dir).write.parquet(f"{path}/main")
    spark.createDataFrame([(1.1, 0.6)], "ra double, dec double").write.parquet(f"{path}/field")
    spark.createDataFrame([([1e8 + k * 1e6 for k in range(4)],)], "chan_freq array<double>").write.parquet(f"{path}/spectral_window")
    a = _antennas(spark, sf_dir, 6).select(F.col("ordinal").cast("int").alias("ordinal"), F.array(F.col("x") * 10, F.col("y") * 10, F.col("z") * 10).alias("position"))
    a.write.parquet(f"{path}/antenna")
    return OB.MeasurementSet(spark, path)


_REDUCED = f"""{_MAIN}, d AS (SELECT t, channel_id, a2 AS beam_i, a1 AS beam_j, CASE WHEN flagged OR a1 = a2 THEN 0 ELSE (p0 + p3) / 2 END AS re, CASE WHEN flagged THEN 0 ELSE value + 1 END AS weight FROM p),
n AS (SELECT *, sum(CASE WHEN re <> 0 THEN weight ELSE 0 END) OVER g AS sw, sum((re <> 0)::INT) OVER g AS nz FROM d WINDOW g AS (PARTITION BY t, channel_id)),
w AS (SELECT t, channel_id, beam_i, beam_j, re * CASE WHEN sw = 0 THEN 1 ELSE CASE WHEN re <> 0 THEN weight ELSE 0 END * nz / sw END AS re FROM n),
v AS (SELECT * FROM (SELECT *, max(abs(re)) OVER (PARTITION BY t, channel_id) AS top FROM w) WHERE top > 1e-8)"""
_IDS = "i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS time_id FROM (SELECT DISTINCT t FROM m))"


@query(f"WITH {_REDUCED}, {_IDS} SELECT time_id::BIGINT AS time_id, channel_id::BIGINT AS channel_id, beam_i::BIGINT AS beam_i, beam_j::BIGINT AS beam_j, round(re, 6) + 0.0 AS re, round(-re / 2, 6) + 0.0 AS im FROM v JOIN i USING (t) WHERE time_id >= 1 AND time_id < 60 AND (time_id - 1) % 2 = 0 AND channel_id >= 1 AND channel_id < 3")
def observation_visibilities(spark, sf_dir):
    """The whole source: time slice, channel range, polarisations, flags, weights, autocorrelations, empty groups, conjugation."""
    v = V.visibilities(_observation(spark, sf_dir).main(), times=(1, 60, 2), channels=(1, 3), conjugate=True)
    return v.select("time_id", "channel_id", "beam_i", "beam_j", _r("re").alias("re"), _r("im").alias("im"))


@query(f"""WITH {_REDUCED}, {_IDS}, {_ant_sql(6)}, s AS (SELECT time_id, t, channel_id, 1.0 / sum(CASE WHEN re = 0 THEN 0 WHEN beam_i = beam_j THEN 1 ELSE 2 END) AS scale FROM v JOIN i USING (t) WHERE time_id < 12 GROUP BY ALL),
g AS (SELECT sum(((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) * 100) AS len FROM ant a, ant b)
SELECT (time_id * 4 + channel_id)::BIGINT AS sample_id, round(56000 + t / 24, 6) AS time, round(299792458.0 / (1e8 + channel_id * 1e6), 9) AS wl, round(scale, 9) AS scale, round(len, 3) AS baselines FROM s, g""")
def dataset_samples(spark, sf_dir):
    """A dataset of twelve integrations of four channels: ids, times, wavelengths, scales, and the squared length of all baselines, which turning doesn't change."""
    ms = _observation(spark, sf_dir)
    ds = D.build_dataset(ms, OB.plain_stations(ms.table("antenna")), _folder(spark), "mwa", times=(0, 12, 1))
    length = F.aggregate("uvw", F.lit(0.0), lambda a, x: a + x * x)
    return ds.samples.select("sample_id", F.round("time", 6).alias("time"), F.round("wl", 9).alias("wl"), F.round("scale", 9).alias("scale"), F.round(length, 3).alias("baselines"))


@query("SELECT event_id AS ordinal FROM (SELECT event_id, t, lag(t) OVER (ORDER BY event_id) AS b FROM (SELECT event_id, event_id * 7919 % 1009 AS t FROM events)) WHERE b > t")
def unsorted_times(spark, sf_dir):
    """Rows whose time is before the row's before; blocks of 700 rows."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), (F.col("event_id") * 7919 % 1009).alias("time"))
    return V.unsorted_times(e, 700).select("ordinal")


@query(f"WITH {_MAIN} SELECT t::BIGINT AS t, channel_id::BIGINT AS channel_id, count(*) AS entries, round(min(p0), 6) AS min_re, round(max(p0), 6) AS max_re, round(sum(p0), 4) AS sum_re FROM p GROUP BY ALL")
def matrix_stats(spark, sf_dir):
    m = _main(spark, sf_dir).select(F.round((F.col("time") - 56000) * 24).cast("bigint").alias("t"), F.posexplode("data_re").alias("channel_id", "v"))
    v = m.select("t", F.col("channel_id").cast("bigint").alias("channel_id"), F.col("v")[0].alias("re"), F.lit(0.0).alias("im"))
    return V.matrix_stats(v, "t", "channel_id").select("t", "channel_id", "entries", F.round("min_re", 6).alias("min_re"), F.round("max_re", 6).alias("max_re"), F.round("sum_re", 4).alias("sum_re"))


@query("SELECT channel_id::BIGINT AS channel_id, round(299792458.0 / (1e8 + channel_id * 1e6), 9) AS wl FROM range(64) t(channel_id) WHERE channel_id >= 5 AND channel_id < 21")
def channel_range(spark, sf_dir):
    w = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.lit(1e8) + k * 1e6).alias("chan_freq"))
    return OB.channel_range(OB.channel_table(w), 5, 21).select(F.col("channel_id").cast("bigint").alias("channel_id"), F.round("wl", 9).alias("wl"))


@query("SELECT 1.1 AS ra, 0.6 AS dec, 4::BIGINT AS channels, count(DISTINCT event_id // 64) AS times FROM events WHERE event_id < 6400")
def observation_tables(spark, sf_dir):
    """Field centre, channels and times of a measurement set."""
    ms = _observation(spark, sf_dir)
    ra, dec = ms.field_center()
    return ms.times().agg(F.lit(ra).alias("ra"), F.lit(dec).alias("dec"), F.lit(ms.channels().count()).cast("bigint").alias("channels"), F.count("*").alias("times"))


# -- instruments and catalogues


_ELEMENTS = "e AS (SELECT s_suppkey::BIGINT AS station_id, k::BIGINT AS antenna_id, s_acctbal + k AS x, s_nationkey + k * 2.0 AS y, 1.0 - k AS z FROM supplier, range(5) r(k) WHERE (s_suppkey + k) % 4 <> 0)"


@query(f"WITH {_ELEMENTS} SELECT station_id, antenna_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) + 0.0 AS z FROM e WHERE station_id IN (SELECT DISTINCT station_id FROM e ORDER BY 1 LIMIT 5)")
def element_stations(spark, sf_dir):
    """Positions plus offsets of elements without a flag, of the first five stations."""
    return OB.element_stations(_fields(spark, sf_dir), 5).select("station_id", "antenna_id", *(_r(c).alias(c) for c in "xyz"))


@query(f"WITH {_ELEMENTS} SELECT station_id, 0::BIGINT AS antenna_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) + 0.0 AS z FROM e GROUP BY station_id")
def element_centroids(spark, sf_dir):
    return OB.element_stations(_fields(spark, sf_dir), station_only=True).select("station_id", "antenna_id", *(_r(c).alias(c) for c in "xyz"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sequence(F.lit(0), F.lit(4))
    s = _t(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("bigint").alias("station_id"), F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double"), F.lit(1.0)).alias("position"),
        F.transform(k, lambda x: F.array(x.cast("double"), x * 2.0, -x.cast("double"))).alias("element_offset"), F.transform(k, lambda x: F.array((F.col("s_suppkey") + x) % 4 == 0, F.lit(False))).alias("element_flag"),
    )


@query("SELECT (s_suppkey - 1)::BIGINT AS station_id, 0::BIGINT AS antenna_id, s_acctbal AS x, s_nationkey::DOUBLE AS y, 2.5 AS z FROM supplier")
def plain_stations(spark, sf_dir):
    a = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("ordinal"), F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double"), F.lit(2.5)).alias("position"))
    return OB.plain_stations(a).select("station_id", "antenna_id", "x", "y", "z")


@query("SELECT s_suppkey::BIGINT AS station_id, (s_suppkey % 3)::BIGINT AS antenna_id, s_acctbal AS x, s_nationkey::DOUBLE AS y, 0.5 AS z FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5)")
def instrument_csv(spark, sf_dir):
    """Suppliers as an instrument file, written and read again; the first five stations."""
    path = _folder(spark)
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("STATION_ID"), (F.col("s_suppkey") % 3).alias("ANTENNA_ID"), F.col("s_acctbal").alias("X"), F.col("s_nationkey").cast("double").alias("Y"), F.lit(0.5).alias("Z"))
    s.write.csv(path, header=True)
    return OB.instrument_csv(spark, path, 5).select("station_id", "antenna_id", "x", "y", "z")


_CATALOGUE = "c AS (SELECT s_suppkey, cos(radians(s_nationkey * 3.0)) * cos(radians(s_suppkey * 3.5)) AS x, cos(radians(s_nationkey * 3.0)) * sin(radians(s_suppkey * 3.5)) AS y, sin(radians(s_nationkey * 3.0)) AS z, s_acctbal AS intensity FROM supplier)"


@query(f"WITH {_CATALOGUE} SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(intensity, 2) AS intensity FROM c")
def catalogue(spark, sf_dir):
    """Suppliers as a tab-separated catalogue in degrees, written and read again."""
    path = _folder(spark)
    _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3.5).alias("RA"), (F.col("s_nationkey") * 3.0).alias("DEC"), F.col("s_acctbal").alias("Total_flux")).write.csv(path, header=True, sep="\t")
    return OB.catalogue(spark, path).select(*(_r(c).alias(c) for c in "xyz"), F.round("intensity", 2).alias("intensity"))


@query(f"WITH {_WEIGHTS} SELECT station_id, antenna_id, beam_id, round(cos(ph), 6) + 0.0 AS re, (row_number() OVER (ORDER BY station_id, antenna_id, beam_id) - 1)::BIGINT AS place FROM wt")
def sorted_weights(spark, sf_dir):
    """Weights in order of station, antenna and beam; the place is the row's."""
    w = G.sorted_weights(G.beam_weights(_antennas(spark, sf_dir), _config(spark, sf_dir), _WL)).select("station_id", "antenna_id", "beam_id", _r("re").alias("re"))
    return w.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(f"""WITH {_ant_sql()}, o AS (SELECT count(*) = 0 AS same FROM (SELECT station_id, antenna_id FROM ant EXCEPT SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey <= 24))
SELECT same AS equal_sets, false AS unequal_sets FROM o""")
def same_index(spark, sf_dir):
    a = _antennas(spark, sf_dir)
    return spark.createDataFrame([(G.same_index(a, a.repartition(3), "station_id", "antenna_id"), G.same_index(a, a.where("ordinal > 0"), "antenna_id"))], "equal_sets boolean, unequal_sets boolean")


@query(f"""WITH {_ant_sql(10)}, s AS (SELECT s_suppkey::BIGINT AS src_id, cos(s_suppkey * 0.1) AS l, sin(s_suppkey * 0.1) AS m FROM supplier WHERE s_suppkey <= 5)
SELECT src_id, ordinal, round(cos(2 * pi() / {_WL} * (l * x + m * y)), 6) + 0.0 AS re, round(-sin(2 * pi() / {_WL} * (l * x + m * y)), 6) + 0.0 AS im FROM s, ant""")
def steering(spark, sf_dir):
    a = F.col("s_suppkey") * 0.1
    d = _t(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(F.col("s_suppkey").cast("bigint").alias("src_id"), F.cos(a).alias("x"), F.sin(a).alias("y"), F.lit(0.0).alias("z"))
    return G.steering(d, _antennas(spark, sf_dir, 10), _WL).select("src_id", "ordinal", _r("re").alias("re"), _r("im").alias("im"))


@query(f"""WITH {_WEIGHTS}, w AS (SELECT ordinal, beam_id, cos(ph) AS re, -sin(ph) AS im FROM wt),
d AS (SELECT a.ordinal i, b.ordinal j, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS dist FROM ant a, ant b), s AS (SELECT i, j, CASE WHEN dist = 0 THEN 1 ELSE sin(2*pi()/{_WL}*dist)/(2*pi()/{_WL}*dist) END AS s FROM d),
k AS (SELECT DISTINCT beam_id, dense_rank() OVER (ORDER BY beam_id) - 1 AS at FROM wt)
SELECT l.at AS beam_i, r.at AS beam_j, round(4 * pi() * sum(s * (a.re * b.re + a.im * b.im)), 5) + 0.0 AS re FROM s JOIN w a ON a.ordinal = i JOIN w b ON b.ordinal = j JOIN k l ON l.beam_id = a.beam_id JOIN k r ON r.beam_id = b.beam_id GROUP BY ALL""")
def four_pi_gram(spark, sf_dir):
    """The kernel's Gram matrix in the convention that is 4 pi times as large."""
    a = _antennas(spark, sf_dir).orderBy("ordinal").toPandas()
    w = G.beam_weights(_antennas(spark, sf_dir), _config(spark, sf_dir), _WL).toPandas()
    beams = sorted(set(w.beam_id))
    m = np.zeros((len(a), len(beams)), complex)
    m[np.searchsorted(a.antenna_id, w.antenna_id), [beams.index(b) for b in w.beam_id]] = w.re + 1j * w.im
    g = L.gram(a[["x", "y", "z"]].to_numpy(float), m, _WL, four_pi=True)
    i, j = np.indices(g.shape)
    return spark.createDataFrame(pd.DataFrame({"beam_i": i.ravel(), "beam_j": j.ravel(), "re": g.real.ravel()})).select("beam_i", "beam_j", _r("re", 5).alias("re"))


# -- eigenproblems of two beams, as roots of a quadratic


_TWO = """e AS (SELECT event_id // 20 AS g, greatest(user_id % 2, event_id % 2) AS i, least(user_id % 2, event_id % 2) AS j, value FROM events),
c AS (SELECT g, i, j, sum(value) AS re, sum(value) / 4 AS im FROM e GROUP BY ALL), q AS (SELECT g, max(re) FILTER (i = 0) AS a, max(re) FILTER (i = 1 AND j = 1) AS b, max(re) FILTER (i <> j) AS c, max(im) FILTER (i <> j) AS s FROM c GROUP BY g HAVING count(*) = 3 AND min(re) > 0.001)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    i, j = F.col("user_id") % 2, F.col("event_id") % 2
    c = e.groupBy(F.floor(F.col("event_id") / 20).alias("time_id"), F.greatest(i, j).cast("bigint").alias("beam_i"), F.least(i, j).cast("bigint").alias("beam_j")).agg(F.sum("value").alias("re"), (F.sum("value") / 4).alias("im"))
    full = c.groupBy("time_id").agg(F.count("*").alias("n"), F.min("re").alias("least")).where("n = 3 and least > 0.001").select("time_id")
    return c.join(full, "time_id").select("time_id", F.lit(0).cast("bigint").alias("channel_id"), "beam_i", "beam_j", "re", F.when(F.col("beam_i") == F.col("beam_j"), 0.0).otherwise(F.col("im")).alias("im"))


def _pair(df: DataFrame) -> DataFrame:
    return df.select(F.col("time_id").alias("g"), F.round("scale", 9).alias("scale"), _r(F.col("d")[0], 5).alias("d0"), _r(F.col("d")[1], 5).alias("d1"))


@query(f"WITH {_TWO} SELECT g, 0.25 AS scale, round((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c + s * s), 5) + 0.0 AS d0, round((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c + s * s), 5) + 0.0 AS d1 FROM q")
def eigen_two_plain(spark, sf_dir):
    return _pair(EG.eigen_stage(_two(spark, sf_dir), np.eye(2, dtype=complex), None, _WL))


_GAP = 0.7
_S = math.sin(2 * math.pi / _WL * _GAP) / (2 * math.pi / _WL * _GAP)


@query(f"WITH {_TWO}, k AS (SELECT g, 1 - {_S!r}::DOUBLE ** 2 AS p, 2 * c * {_S!r}::DOUBLE - a - b AS q, a * b - c * c - s * s AS r FROM q) SELECT g, 0.25 AS scale, round((-q - sqrt(q * q - 4 * p * r)) / (2 * p), 5) + 0.0 AS d0, round((-q + sqrt(q * q - 4 * p * r)) / (2 * p), 5) + 0.0 AS d1 FROM k")
def eigen_two_gram(spark, sf_dir):
    """Two antennas 0.7 apart: the generalised problem with their Gram matrix."""
    return _pair(EG.eigen_stage(_two(spark, sf_dir), np.eye(2, dtype=complex), np.array([[0.0, 0, 0], [_GAP, 0, 0]]), _WL))


@query(f"WITH {_TWO}, k AS (SELECT g, (a + b) / 2 AS h, sqrt(((a - b) / 2) ** 2 + c * c + s * s) AS w FROM q) SELECT g, round(h + w, 5) AS d0, round(greatest(h - w, 0), 5) + 0.0 AS d1 FROM k")
def eigen_positive(spark, sf_dir):
    """Positive eigenvalues in falling order, padded to two."""

    def solve(first: pa.Table, s: np.ndarray) -> list:
        d, _ = L.eigh_psd(s + np.tril(s, -1).conj().swapaxes(1, 2), n=2)
        return [first["time_id"], d[:, 0], d[:, 1]]

    return EG.solved(_two(spark, sf_dir), ["time_id"], 2, solve, "g bigint, d0 double, d1 double").select("g", _r("d0", 5).alias("d0"), _r("d1", 5).alias("d1"))


# -- stores


@query("SELECT vec_id AS sample_id, 0.5 AS wl, round(list_sum(embedding[1:4]::DOUBLE[]), 6) + 0.0 AS total, 2::BIGINT AS beams FROM embeddings WHERE vec_id < 60")
def stored_dataset(spark, sf_dir):
    """Samples appended in two parts, opened again; a pruned read."""
    path = _folder(spark)
    ds = ST.Dataset.create(spark, path, "queries", 2, 2, 10.0, 20.0)
    x = F.col("embedding").cast("array<double>")
    s = _t(spark, sf_dir, "embeddings").where("vec_id < 60").select(F.col("vec_id").alias("sample_id"), F.lit(0.0).alias("time"), F.lit(0.5).alias("wl"), F.lit(1.0).alias("scale"), F.slice(x, 5, 2).alias("d"), F.slice(x, 1, 4).alias("v_re"), F.slice(x, 1, 4).alias("v_im"), F.slice(x, 1, 12).alias("uvw"))
    ds.append(s.where("sample_id < 25")), ds.append(s.where("sample_id >= 25"))
    back = ST.Dataset.open(spark, path)
    return back.samples.select("sample_id", "wl", _r(F.aggregate("v_re", F.lit(0.0), lambda a, b: a + b)).alias("total"), F.lit(back.header["n_beam"]).cast("bigint").alias("beams"))


@query("""WITH i AS (SELECT label, generate_subscripts(embedding, 1)::BIGINT - 1 AS pixel_id, unnest(embedding)::DOUBLE AS d FROM embeddings)
SELECT 't' || label AS tag, pixel_id, round((CASE WHEN label = 1 THEN 2 ELSE 1 END * v)::FLOAT::DOUBLE, 3) + 0.0 AS value FROM (SELECT label, pixel_id, sum(d) AS v FROM i WHERE label < 3 GROUP BY ALL)""")
def stored_images(spark, sf_dir):
    """Three images set, one of them set again; tags in order, read tag by tag."""
    e = _t(spark, sf_dir, "embeddings").where("label < 3").select(F.concat(F.lit("t"), "label").alias("tag"), F.posexplode("embedding").alias("pixel_id", "d"))
    img = e.groupBy("tag", F.col("pixel_id").cast("bigint").alias("pixel_id")).agg(F.sum(F.col("d").cast("double")).alias("value"))
    path = _folder(spark)
    im = ST.Images.create(spark, path, 8, 8, 5.0, 0.0, 0.0)
    im.set(img)
    im.set(img.where("tag = 't1'").withColumn("value", F.col("value") * 2))
    back, out = ST.Images.open(spark, path), None
    for t in back.tags():
        g = back.get(t)
        out = g if out is None else out.unionByName(g)
    return out.select("tag", "pixel_id", _r(F.col("value").cast("double"), 3).alias("value"))


@query("SELECT 'count' AS name, 7::BIGINT AS i, 0.0::DOUBLE AS f, 0::BIGINT AS n UNION ALL SELECT 'gain', 0, 2.5, 0 UNION ALL SELECT 'list', 0, 0, 3")
def pixel_meta(spark, sf_dir):
    """Meta data of a pixel set by kind, written one by one and read again."""
    px = ST.PixelSet.create(spark, _folder(spark), 2, 2, 5.0, FR.lmn_grid(spark, 2, 0.1))
    for name, value in (("count", 7), ("gain", 2.5), ("list", [1.0, 2.0, 3.0])):
        px.set_meta(name, value)
    rows = [(k, v if isinstance(v, int) else 0, v if isinstance(v, float) else 0.0, len(v) if isinstance(v, list) else 0) for k, v in ST.PixelSet.open(spark, px.path).meta_data().items()]
    return spark.createDataFrame(rows, "name string, i bigint, f double, n bigint")


@query("SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b_[1,2)' END AS tag, vec_id AS sample_id, round(list_sum(embedding[1:4]::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def stored_selection(spark, sf_dir):
    """As Parquet, a folder per tag, and read again."""
    s = _t(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "a").otherwise("b_[1,2)").alias("tag"), F.col("vec_id").alias("sample_id"), F.slice("embedding", 1, 4).cast("array<double>").alias("d"))
    path = _folder(spark)
    ST.store_selection(s, path)
    return ST.stored_selection(spark, path).select("tag", "sample_id", _r(F.aggregate("d", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# -- partitions, frames, functions


@query("""WITH b AS (SELECT min(l_quantity)::DOUBLE x0, max(l_quantity)::DOUBLE x1, min(l_extendedprice)::DOUBLE y0, max(l_extendedprice)::DOUBLE y1, min(l_discount)::DOUBLE z0, max(l_discount)::DOUBLE z1 FROM lineitem),
p AS (SELECT (least(trunc(4.0*(l_discount-z0)/(z1-z0))::BIGINT,3)*3+least(trunc(3.0*(l_extendedprice-y0)/(y1-y0))::BIGINT,2))*2+least(trunc(2.0*(l_quantity-x0)/(x1-x0))::BIGINT,1) AS cell FROM lineitem, b)
SELECT max(n) AS size FROM (SELECT count(*) AS n FROM p GROUP BY cell)""")
def largest_cell(spark, sf_dir):
    return spark.createDataFrame([(PT.largest(PT.grid_cells(_points(spark, sf_dir), (2, 3, 4))),)], "size bigint")


@query("SELECT sample_id, ((row_number() OVER (ORDER BY sample_id) - 1) // ceil(count(*) OVER () / 7.0)::BIGINT)::INTEGER AS part FROM (SELECT vec_id * 3 AS sample_id FROM embeddings)")
def sample_blocks(spark, sf_dir):
    """Samples in seven contiguous blocks."""
    return PT.sample_blocks(_t(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("sample_id")), 7).select("sample_id", "part")


@query("SELECT event_id, round(pi() / 2 - c, 6) + 0.0 AS lat, round(r * sin(c) * cos(lon), 6) + 0.0 AS x, round(r * sin(c) * sin(lon), 6) + 0.0 AS y, round(r * cos(c), 6) + 0.0 AS z FROM (SELECT event_id, 1 + value / 100 AS r, (event_id % 100) / 100.0 AS c, (user_id % 60) / 10.0 AS lon FROM events)")
def polar_transforms(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (1 + F.col("value") / 100).alias("r"), (F.col("event_id") % 100 / 100.0).alias("c"), (F.col("user_id") % 60 / 10.0).alias("lon"))
    x, y, z = SP.pol2cart(F.col("r"), F.col("c"), F.col("lon"))
    return e.select("event_id", _r(SP.pol2eq(F.col("c"))).alias("lat"), _r(x).alias("x"), _r(y).alias("y"), _r(z).alias("z"))


@query("""SELECT k, round(cos(a) + x * x * (1 - cos(a)), 9) + 0.0 AS xx, round(x * y * (1 - cos(a)) - z * sin(a), 9) + 0.0 AS xy, round(z * y * (1 - cos(a)) + x * sin(a), 9) + 0.0 AS zy, round(a - 2 * pi() * round(a / (2 * pi())), 9) + 0.0 AS turn
FROM (SELECT range AS k, range * 0.3 AS a, 1 / sqrt(14 + 2 * range + range * range) AS x, 2 / sqrt(14 + 2 * range + range * range) AS y, (range + 3 - 2) / sqrt(14 + 2 * range + range * range) AS z, range FROM range(10)) WHERE true""".replace("14 + 2 * range + range * range", "6 + 2 * range + range * range"))
def rotations(spark, sf_dir):
    """Entries of rotations about an axis, and the angle of one about z."""
    rows = []
    for k in range(10):
        r = SP.rot([1, 2, k + 1], 0.3 * k)
        rows.append((k, float(r[0, 0]), float(r[0, 1]), float(r[2, 1]), SP.z_rot2angle(SP.rot([0, 0, 1], 0.3 * k))))
    return spark.createDataFrame(rows, "k long, xx double, xy double, zy double, turn double").select("k", *(_r(c, 9).alias(c) for c in ("xx", "xy", "zy", "turn")))


_PARALLELS = (math.radians(33), math.radians(45))
_N = math.log(math.cos(_PARALLELS[0]) / math.cos(_PARALLELS[1])) / math.log(math.tan(math.pi / 4 + _PARALLELS[1] / 2) / math.tan(math.pi / 4 + _PARALLELS[0] / 2))


@query(f"""WITH e AS (SELECT event_id, (user_id % 60) / 30.0 - 1 AS lon, (event_id % 100) / 100.0 - 0.5 AS lat FROM events), f AS (SELECT *, {_N!r}::DOUBLE AS n, cos(radians(33)) * tan(pi() / 4 + radians(33) / 2) ** {_N!r}::DOUBLE / {_N!r}::DOUBLE AS f FROM e),
t AS (SELECT [1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427] AS len, [0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434] AS h), g AS (SELECT *, degrees(abs(lat)) / 5 AS deg, floor(degrees(abs(lat)) / 5)::INTEGER AS i FROM f, t)
SELECT event_id, round(f / tan(pi() / 4 + lat / 2) ** n * sin(n * (lon - 0.1)), 6) + 0.0 AS cx, round(f / tan(pi() / 4 + 0.1) ** n - f / tan(pi() / 4 + lat / 2) ** n * cos(n * (lon - 0.1)), 6) + 0.0 AS cy,
round(0.8487 * (len[i + 1] + (len[i + 2] - len[i + 1]) * (deg - i)) * (lon - 0.1), 6) + 0.0 AS rx, round(1.3523 * (h[i + 1] + (h[i + 2] - h[i + 1]) * (deg - i)) * sign(lat), 6) + 0.0 AS ry FROM g""")
def conic_projections(spark, sf_dir):
    """Lambert's conformal conic and Robinson's projection."""
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 60 / 30.0 - 1).alias("lon"), (F.col("event_id") % 100 / 100.0 - 0.5).alias("lat"))
    (cx, cy), (rx, ry) = (PJ.project(k, F.col("lon"), F.col("lat"), 0.1, 0.2) for k in ("LCC", "ROBIN"))
    return e.select("event_id", _r(cx).alias("cx"), _r(cy).alias("cy"), _r(rx).alias("rx"), _r(ry).alias("ry"))


@query("""WITH p AS (SELECT range AS id, 5.0 + range AS k, 0.05 * range AS b FROM range(1, 15)), c AS (SELECT *, (1 - sqrt(1 - 2 * b * (1 + ln(0.01) / k - 0.5 * b))) / b AS c FROM p)
SELECT id, round(ceil(acos(c) / (pi() / 99999)) * (pi() / 99999), 7) AS support, round(abs(ln(0.01) / (cos(0.1 * id) + 0.5 * b * sin(0.1 * id) ** 2 - 1)), 6) AS scale FROM c""")
def kent_support(spark, sf_dir):
    """Angular support and least scale of Kent densities."""
    rows = [(i, WN.Kent.angular_support(5.0 + i, 0.05 * i), WN.Kent.min_scale(0.1 * i, 0.05 * i)) for i in range(1, 15)]
    return spark.createDataFrame(rows, "id long, support double, scale double").select("id", F.round("support", 7).alias("support"), F.round("scale", 6).alias("scale"))


@query("""WITH e AS (SELECT event_id, (user_id % 60) / 10.0 AS lon, (event_id % 300) / 100.0 - 1.5 AS lat FROM events), d AS (SELECT event_id, lat, lon - 0.1 + pi() - 2 * pi() * floor((lon - 0.1 + pi()) / (2 * pi())) - pi() AS d, sin(lat) AS z FROM e),
c AS (SELECT *, sqrt(greatest(3 * (1 - abs(z)), 0)) AS s, (2 * least(floor((d + pi()) * 2 / pi()), 3) + 1) * pi() / 4 - pi() AS c FROM d)
SELECT event_id, round(CASE WHEN abs(z) <= 2.0 / 3 THEN d ELSE c + (d - c) * s END, 6) + 0.0 AS x, round(CASE WHEN abs(z) <= 2.0 / 3 THEN 3 * pi() / 8 * z ELSE sign(z) * (2 - s) * pi() / 4 END, 6) + 0.0 AS y FROM c""")
def healpix_projection(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 60 / 10.0).alias("lon"), (F.col("event_id") % 300 / 100.0 - 1.5).alias("lat"))
    x, y = PJ.project("HEALPIX", F.col("lon"), F.col("lat"), 0.1)
    return e.select("event_id", _r(x).alias("x"), _r(y).alias("y"))
