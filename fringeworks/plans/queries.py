"""Registered queries and their oracle SQL, over the driver's tables.

The tables hold no antenna data, so operators run on surrogate columns: embedding
vectors as eigenvalues or eigenvectors, suppliers as stations, events as
visibilities, line items as points in space.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import filters as FL
from ..functions import frame as FR
from ..functions import grids as GR
from ..functions import projections as PJ
from ..functions import sphere as SP
from ..functions import thresholds as TH
from ..functions import windows as WN
from ..operators import eigen as EG
from ..operators import geometry as G
from ..operators import interpolate as IP
from ..operators import partition as PT
from ..operators import selection as SE
from ..operators import synthesis as SY
from ..operators import visibility as V
from ..sources import observations as OB
from ..sources import stores as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# -- eigenvalue filters and levels


def _eigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("eig_idx", "d")).withColumn("d", F.col("d").cast("double"))


_EIGS = "eigs AS (SELECT vec_id AS sample_id, generate_subscripts(embedding, 1) - 1 AS eig_idx, unnest(embedding)::DOUBLE AS d FROM embeddings)"
_LO, _HI = -0.05, 0.2
_MASKED = f"CASE WHEN d >= {_LO} AND d <= {_HI} THEN d ELSE 0 END"
_FILTER_SQL = {
    "lsq": "x", "std": "sign(x)", "sqrt": "sign(x) * sqrt(abs(x))", "inv": "CASE WHEN x = 0 THEN 0 ELSE 1 / x END",
    "inv_sqrt": "CASE WHEN x = 0 THEN 0 ELSE 1 / (sign(x) * sqrt(abs(x))) END",
}


def _filter_query(name: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _eigs(spark, sf_dir)
        return SE.masked(e, name, _LO, _HI).select("sample_id", F.col("eig_idx").cast("bigint").alias("eig_idx"), _r("d").alias("value"))

    f.__name__ = f"filter_{name}"
    query(f"WITH {_EIGS}, m AS (SELECT sample_id, eig_idx, {_MASKED} AS x FROM eigs) SELECT sample_id, eig_idx::BIGINT AS eig_idx, round({_FILTER_SQL[name]}, 6) + 0.0 AS value FROM m")(f)


for _n in FL.FILTERS:
    _filter_query(_n)


@query(f"WITH {_EIGS}, r AS (SELECT sample_id, eig_idx, d, row_number() OVER (ORDER BY d, sample_id, eig_idx) AS rn, count(*) OVER () AS n FROM eigs WHERE d <> 0 AND d BETWEEN -0.3 AND 0.4) SELECT sample_id, eig_idx::BIGINT AS eig_idx, round(d, 6) + 0.0 AS d FROM r WHERE rn <= n - floor((1 - 0.95) * n)")
def sigma_trim(spark, sf_dir):
    e = SE.trimmed(SE.in_range(_eigs(spark, sf_dir), -0.3, 0.4), 0.95)
    return e.select("sample_id", F.col("eig_idx").cast("bigint").alias("eig_idx"), _r("d").alias("d"))


@query(f"""WITH {_EIGS}, c AS (SELECT round(avg(d), 9) AS c FROM eigs JOIN embeddings ON sample_id = vec_id WHERE d > 0 GROUP BY label),
w AS (SELECT c, row_number() OVER (ORDER BY c DESC) - 1 AS level, lag(c) OVER (ORDER BY c DESC) AS up, lead(c) OVER (ORDER BY c DESC) AS down FROM c)
SELECT level::INTEGER AS level, round(coalesce((c + down) / 2, 0.0), 6) + 0.0 AS lo, round(coalesce((c + up) / 2, 1.0), 6) + 0.0 AS hi FROM w""")
def centroid_intervals(spark, sf_dir):
    label = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    c = _eigs(spark, sf_dir).where("d > 0").join(label, "sample_id").groupBy("label").agg(F.round(F.avg("d"), 9).alias("c"))
    return SE.centroid_intervals(c, 0.0, 1.0).select("level", _r("lo").alias("lo"), _r("hi").alias("hi"))


def _lloyd_sql(k: int, rounds: int) -> str:
    q = ", ".join(f"quantile_cont(x, {(i + 0.5) / k}) AS c{i}" for i in range(k))
    ctes = [f"{_EIGS}", "v AS (SELECT d AS x FROM eigs WHERE d > 0)", f"r0 AS (SELECT {q} FROM v)"]
    for n in range(rounds):
        lst = "[" + ", ".join(f"abs(x - c{i})" for i in range(k)) + "]"
        ctes.append(f"a{n} AS (SELECT x, list_position({lst}, list_min({lst})) - 1 AS g FROM v, r{n})")
        ctes.append(f"r{n + 1} AS (SELECT " + ", ".join(f"avg(x) FILTER (g = {i}) AS c{i}" for i in range(k)) + f" FROM a{n})")
    return f"WITH {', '.join(ctes)} SELECT unnest(range({k}))::INTEGER AS level, round(unnest(list_reverse_sort([" + ", ".join(f"c{i}" for i in range(k)) + f"])), 6) + 0.0 AS centroid FROM r{rounds}"


@query(_lloyd_sql(4, 3))
def lloyd_k(spark, sf_dir):
    cent = SE.kmeans_1d(_eigs(spark, sf_dir).where("d > 0"), 4, rounds=3, fixed=True)
    return spark.createDataFrame([(i, c) for i, c in enumerate(cent)], "level int, c double").select("level", _r("c").alias("centroid"))


_LEVELS = [("lsq", [(0.05, 1.0), (0.0, 0.05)]), ("std", [(-0.1, 0.1)]), ("inv_sqrt", [(0.1, 0.3)])]


def _levels_sql() -> str:
    """A row per tag: the sum, and the number, of the filtered values that aren't 0."""
    parts = []
    for i, (name, cuts) in enumerate(_LEVELS):
        for lo, hi in cuts:
            parts.append(f"SELECT '{SE.level_tag(i, name, lo, hi)}' AS tag, sample_id, {_FILTER_SQL[name]} AS v FROM (SELECT sample_id, CASE WHEN d >= {lo} AND d <= {hi} THEN d ELSE 0 END AS x FROM eigs WHERE sample_id < 200 AND sample_id % 2 = 0)")
    return f"WITH {_EIGS}, v AS ({' UNION ALL '.join(parts)}) SELECT tag, sample_id, count(*) FILTER (v <> 0) AS n, round(sum(v), 5) + 0.0 AS total FROM v GROUP BY ALL"


@query(_levels_sql())
def level_selection(spark, sf_dir):
    """Tags, samples and masked eigenvalues of given intervals of three filters, every second sample."""
    s = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("d")).where(V.in_slice(F.col("vec_id"), 0, 200, 2))
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    return SE.levels(s, _LEVELS).select("tag", "sample_id", F.size(F.filter("d", lambda x: x != 0)).cast("bigint").alias("n"), _r(total, 5).alias("total"))


@query()
def fitted_levels(spark, sf_dir):
    """The same with intervals from k-means to convergence, of two specs."""
    s = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("d"))
    return SE.select(s, [SE.Spec.parse("lsq,3,0.95,none,0.0,1.0"), SE.Spec.parse("std,2,1,log,0.01,1")], (0, 200, 2))


@query(f"WITH {_EIGS}, p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d DESC, eig_idx) AS rank FROM eigs WHERE d > 0 AND sample_id < 50) SELECT sample_id, eig_idx::BIGINT AS eig_idx, rank::INTEGER AS rank, round(sum(d) OVER (PARTITION BY sample_id ORDER BY rank) / sum(d) OVER (PARTITION BY sample_id), 6) + 0.0 AS ratio FROM p")
def energy_ratio(spark, sf_dir):
    e = SE.energy(_eigs(spark, sf_dir).where("d > 0 and sample_id < 50"))
    return e.select("sample_id", F.col("eig_idx").cast("bigint").alias("eig_idx"), "rank", _r("ratio").alias("ratio"))


@query("SELECT vec_id AS sample_id, 'full_image' AS tag, len(embedding)::INTEGER AS n FROM embeddings")
def default_selection(spark, sf_dir):
    s = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("d"))
    return ST.default_selection(s).select("sample_id", "tag", F.size("d").alias("n"))


@query("SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS tag, vec_id AS sample_id, round(list_sum(embedding[1:4]::DOUBLE[]), 6) + 0.0 AS total FROM embeddings WHERE vec_id < 100")
def selection_json(spark, sf_dir):
    """Written to JSON and read again."""
    s = _t(spark, sf_dir, "embeddings").where("vec_id < 100").select(F.when(F.col("label") < 5, "a").otherwise("b").alias("tag"), F.col("vec_id").alias("sample_id"), F.slice("embedding", 1, 4).cast("array<double>").alias("d"))
    back = ST.selection_from_json(ST.selection_to_json(s))
    return back.select("tag", "sample_id", _r(F.aggregate("d", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# -- visibilities from events


def _vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    i, j = F.col("user_id") % 8, F.col("event_id") % 8
    return e.select(F.to_date("ts").alias("time"), (F.floor(F.col("value")) % 3).cast("bigint").alias("channel_id"), F.greatest(i, j).cast("bigint").alias("beam_i"), F.least(i, j).cast("bigint").alias("beam_j"), F.col("value").alias("re"), (F.col("value") / 2).alias("im"), F.col("value").alias("weight")).groupBy("time", "channel_id", "beam_i", "beam_j").agg(F.round(F.sum("re"), 4).alias("re"), F.round(F.sum("im"), 4).alias("im"), F.round(F.min("weight"), 4).alias("weight"))


_VIS = """vis AS (SELECT ts::DATE AS time, (floor(value)::BIGINT % 3) AS channel_id, greatest(user_id % 8, event_id % 8)::BIGINT AS beam_i, least(user_id % 8, event_id % 8)::BIGINT AS beam_j,
round(sum(value), 4) AS re, round(sum(value / 2), 4) AS im, round(min(value), 4) AS weight FROM events GROUP BY ALL)"""


@query("WITH d AS (SELECT DISTINCT ts::DATE AS time FROM events) SELECT time_id, strftime(time, '%Y-%m-%d') AS day FROM (SELECT row_number() OVER (ORDER BY time) - 1 AS time_id, time FROM d) WHERE time_id >= 2 AND (time_id - 2) % 3 = 0 AND time_id < 40")
def time_slice(spark, sf_dir):
    days = OB.time_table(_t(spark, sf_dir, "events").select(F.to_date("ts").alias("time")))
    return days.where(V.in_slice(F.col("time_id"), 2, 40, 3)).select("time_id", F.date_format("time", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, round(epoch_us(ts) / 86400e6 + 40587, 6) AS mjd FROM events")
def mjd_time(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.round(FR.mjd(F.col("ts")), 6).alias("mjd"))



@query("""WITH m AS (SELECT event_id, user_id % 8 AS a1, event_id % 8 AS a2, value FROM events),
p AS (SELECT event_id, a1, a2, c AS channel_id, value * (c + 1) AS p0, value + c AS p3, (event_id + c) % 7 = 0 AS f0, (event_id + c) % 11 = 0 AS f3 FROM m, range(3) t(c))
SELECT event_id, channel_id::BIGINT AS channel_id, a2::BIGINT AS beam_i, a1::BIGINT AS beam_j, round(CASE WHEN f0 OR f3 THEN 0 ELSE (p0 + p3) / 2 END, 6) + 0.0 AS re, round(CASE WHEN f0 OR f3 THEN 0 ELSE least(p0, p3) END, 6) + 0.0 AS weight FROM p""")
def vis_reduce(spark, sf_dir):
    """Mean of two polarisations, flags and the lesser weight, into the lower triangle."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    chan = F.sequence(F.lit(0), F.lit(2))
    val = lambda c: F.array(F.col("value") * (c + 1), F.lit(0.0), F.lit(0.0), F.col("value") + c)
    main = e.select(F.col("event_id").alias("time"), (F.col("user_id") % 8).alias("antenna1"), (F.col("event_id") % 8).alias("antenna2"), F.transform(chan, val).alias("data_re"), F.transform(chan, val).alias("data_im"), F.transform(chan, lambda c: F.array((F.col("event_id") + c) % 7 == 0, F.lit(False), F.lit(False), (F.col("event_id") + c) % 11 == 0)).alias("flag"), F.transform(chan, val).alias("weight_spectrum"))
    return V.reduce_polarisations(main).select(F.col("time").alias("event_id"), "channel_id", "beam_i", "beam_j", _r("re").alias("re"), _r("weight").alias("weight"))


@query(f"""WITH {_VIS}, f AS (SELECT * REPLACE (CASE WHEN beam_i = beam_j THEN 0 ELSE re END AS re, CASE WHEN beam_i = beam_j THEN 0 ELSE im END AS im) FROM vis),
w AS (SELECT *, CASE WHEN re <> 0 OR im <> 0 THEN weight ELSE 0 END AS ww, (re <> 0 OR im <> 0)::INT AS nz FROM f),
s AS (SELECT *, sum(ww) OVER g AS sw, sum(nz) OVER g AS n FROM w WINDOW g AS (PARTITION BY time, channel_id))
SELECT strftime(time, '%Y-%m-%d') AS day, channel_id, beam_i, beam_j, round(re * CASE WHEN sw = 0 THEN 1 ELSE ww * n / sw END, 7) + 0.0 AS re, round(im * CASE WHEN sw = 0 THEN 1 ELSE ww * n / sw END, 7) + 0.0 AS im FROM s""")
def vis_weighting(spark, sf_dir):
    v = V.weighted(V.flag_autocorrelations(_vis(spark, sf_dir)))
    return v.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "channel_id", "beam_i", "beam_j", _r("re", 7).alias("re"), _r("im", 7).alias("im"))


@query(f"WITH {_VIS} SELECT strftime(time, '%Y-%m-%d') AS day, channel_id, sum(CASE WHEN re <> 0 OR im <> 0 THEN CASE WHEN beam_i = beam_j THEN 1 ELSE 2 END ELSE 0 END)::BIGINT AS n_vis FROM vis GROUP BY time, channel_id")
def vis_scale(spark, sf_dir):
    v = _vis(spark, sf_dir).withColumnRenamed("time", "time_id")
    return V.count_scale(v).select(F.date_format("time_id", "yyyy-MM-dd").alias("day"), "channel_id", "n_vis")


@query(f"WITH {_VIS}, n AS (SELECT * FROM vis WHERE re <> 0 OR im <> 0) SELECT strftime(time, '%Y-%m-%d') AS day, channel_id, beam_i AS beam_id FROM n UNION SELECT strftime(time, '%Y-%m-%d'), channel_id, beam_j FROM n")
def working_beams(spark, sf_dir):
    v = _vis(spark, sf_dir).withColumnRenamed("time", "time_id")
    return V.working_beams(v).select(F.date_format("time_id", "yyyy-MM-dd").alias("day"), "channel_id", "beam_id")


@query(f"WITH {_VIS} SELECT strftime(time, '%Y-%m-%d') AS day, channel_id, beam_i, beam_j, re, im + 0.0 AS im FROM vis UNION ALL SELECT strftime(time, '%Y-%m-%d'), channel_id, beam_j, beam_i, re, 0.0 - im FROM vis WHERE beam_i <> beam_j")
def vis_mirror(spark, sf_dir):
    v = V.mirrored(_vis(spark, sf_dir).select("time", "channel_id", "beam_i", "beam_j", "re", "im"))
    return v.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "channel_id", "beam_i", "beam_j", "re", (F.col("im") + 0.0).alias("im"))


@query(f"WITH {_VIS}, v AS (SELECT time, channel_id, beam_i, beam_j, CASE WHEN channel_id = 1 THEN 0 ELSE re END AS re FROM vis), m AS (SELECT *, max(abs(re)) OVER (PARTITION BY time, channel_id) AS mx FROM v) SELECT strftime(time, '%Y-%m-%d') AS day, channel_id, beam_i, beam_j, re FROM m WHERE mx > 1e-8")
def vis_drop_empty(spark, sf_dir):
    v = _vis(spark, sf_dir).select("time", "channel_id", "beam_i", "beam_j", F.when(F.col("channel_id") == 1, 0.0).otherwise(F.col("re")).alias("re"), F.lit(0.0).alias("im"))
    return V.drop_empty(v).select(F.date_format("time", "yyyy-MM-dd").alias("day"), "channel_id", "beam_i", "beam_j", "re")



# -- geometry from suppliers


def _antennas(spark: SparkSession, sf_dir: str, n: int = 24) -> DataFrame:
    """Stations are nations; an antenna is one of the first n suppliers, its place made of its numbers."""
    s = _t(spark, sf_dir, "supplier").where(F.col("s_suppkey") <= n)
    return s.select(F.col("s_nationkey").cast("bigint").alias("station_id"), F.col("s_suppkey").cast("bigint").alias("antenna_id"), (F.col("s_suppkey") - 1).cast("bigint").alias("ordinal"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") * 1.5).alias("y"), (F.col("s_suppkey") % 7 * 0.25).alias("z"))


def _ant_sql(n: int = 24) -> str:
    return f"ant AS (SELECT s_nationkey::BIGINT AS station_id, s_suppkey::BIGINT AS antenna_id, (s_suppkey - 1)::BIGINT AS ordinal, s_acctbal / 1000 AS x, s_nationkey * 1.5 AS y, s_suppkey % 7 * 0.25 AS z FROM supplier WHERE s_suppkey <= {n})"


@query(f"WITH {_ant_sql()} SELECT b.ordinal * 24 + a.ordinal AS k, a.ordinal AS i, b.ordinal AS j, round(a.x - b.x, 6) + 0.0 AS x, round(a.y - b.y, 6) + 0.0 AS y, round(a.z - b.z, 6) + 0.0 AS z FROM ant a, ant b")
def baselines(spark, sf_dir):
    return G.baselines(_antennas(spark, sf_dir), 24).select("k", "i", "j", *(_r(c).alias(c) for c in "xyz"))


_RA, _DEC = 1.1, 0.6
_B = FR.uvw_basis(_RA, _DEC).tolist()


@query(f"WITH {_ant_sql()}, d AS (SELECT b.ordinal * 24 + a.ordinal AS k, a.x - b.x AS x, a.y - b.y AS y, a.z - b.z AS z FROM ant a, ant b) SELECT k, " + ", ".join(f"round(x * {_B[0][c]!r}::DOUBLE + y * {_B[1][c]!r}::DOUBLE + z * {_B[2][c]!r}::DOUBLE, 6) + 0.0 AS {'uvw'[c]}" for c in range(3)) + " FROM d")
def baselines_uvw(spark, sf_dir):
    return G.baselines(_antennas(spark, sf_dir), 24, FR.uvw_basis(_RA, _DEC)).select("k", *(_r(c).alias(c) for c in "uvw"))


@query(f"WITH {_ant_sql(60)} SELECT a.ordinal AS i, b.ordinal AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) + 0.0 AS dist FROM ant a JOIN ant b ON a.ordinal < b.ordinal")
def distances(spark, sf_dir):
    return G.distances(_antennas(spark, sf_dir, 60)).select("i", "j", _r("dist").alias("dist"))


@query(f"WITH {_ant_sql(100000)} SELECT station_id, 0::BIGINT AS antenna_id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM ant GROUP BY station_id")
def station_centroid(spark, sf_dir):
    return OB.station_centroids(_antennas(spark, sf_dir, 100000)).select("station_id", "antenna_id", *(_r(c).alias(c) for c in "xyz"))


@query(f"WITH {_ant_sql(100000)}, m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz FROM ant) SELECT antenna_id, round(x - mx, 6) + 0.0 AS x, round(y - my, 6) + 0.0 AS y, round(z - mz, 6) + 0.0 AS z FROM ant, m")
def array_centroid(spark, sf_dir):
    return G.centred(_antennas(spark, sf_dir, 100000)).select("antenna_id", *(_r(c).alias(c) for c in "xyz"))


@query(f"WITH {_ant_sql(100000)}, s AS (SELECT DISTINCT station_id FROM ant ORDER BY station_id LIMIT 5) SELECT antenna_id, station_id FROM ant WHERE station_id IN (SELECT station_id FROM s)")
def first_stations(spark, sf_dir):
    return OB.first_stations(_antennas(spark, sf_dir, 100000), 5).select("antenna_id", "station_id")


@query(f"WITH {_ant_sql(100000)} SELECT antenna_id, dense_rank() OVER (ORDER BY station_id) - 1 AS ordinal FROM ant")
def dense_ordinals(spark, sf_dir):
    a = _antennas(spark, sf_dir, 100000).drop("ordinal")
    return G.ordinals(a, "station_id").select("antenna_id", "ordinal")


_WL = 2.5


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    a = F.col("n_nationkey") * 0.2
    return n.select(F.col("n_nationkey").cast("bigint").alias("station_id"), F.col("n_nationkey").cast("bigint").alias("beam_id"), F.cos(a).alias("x"), F.sin(a).alias("y"), F.lit(0.0).alias("z"))


_WEIGHTS = f"""{_ant_sql()}, m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz FROM ant),
wt AS (SELECT station_id, antenna_id, ordinal, n_nationkey::BIGINT AS beam_id, 2 * pi() / {_WL} * ((x - mx) * cos(n_nationkey * 0.2) + (y - my) * sin(n_nationkey * 0.2)) AS ph FROM ant JOIN nation ON station_id = n_nationkey, m)"""


@query(f"WITH {_WEIGHTS} SELECT station_id, antenna_id, beam_id, round(cos(ph), 6) + 0.0 AS re, round(-sin(ph), 6) + 0.0 AS im FROM wt")
def beam_weights(spark, sf_dir):
    w = G.beam_weights(_antennas(spark, sf_dir), _config(spark, sf_dir), _WL)
    return w.select("station_id", "antenna_id", "beam_id", _r("re").alias("re"), _r("im").alias("im"))


@query(f"""WITH {_WEIGHTS}, b AS (SELECT DISTINCT beam_id FROM wt), r AS (SELECT row_number() OVER (ORDER BY station_id, antenna_id) - 1 AS "row", antenna_id FROM ant), c AS (SELECT row_number() OVER (ORDER BY beam_id) - 1 AS col, beam_id FROM b)
SELECT "row", col, round(coalesce(cos(ph), 0), 6) + 0.0 AS re, round(coalesce(-sin(ph), 0), 6) + 0.0 AS im FROM r CROSS JOIN c LEFT JOIN wt USING (antenna_id, beam_id)""")
def dense_beam_weights(spark, sf_dir):
    w = G.dense_weights(G.beam_weights(_antennas(spark, sf_dir), _config(spark, sf_dir), _WL))
    return w.select("row", "col", _r("re").alias("re"), _r("im").alias("im"))


@query(f"""WITH {_WEIGHTS}, w AS (SELECT ordinal, beam_id, cos(ph) AS re, -sin(ph) AS im FROM wt),
d AS (SELECT a.ordinal i, b.ordinal j, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS dist FROM ant a, ant b), s AS (SELECT i, j, CASE WHEN dist = 0 THEN 1 ELSE sin(2*pi()/{_WL}*dist)/(2*pi()/{_WL}*dist) END AS s FROM d)
SELECT l.beam_id AS beam_i, r.beam_id AS beam_j, round(sum(s * (l.re * r.re + l.im * r.im)), 6) + 0.0 AS re, round(sum(s * (l.re * r.im - l.im * r.re)), 6) + 0.0 AS im FROM s JOIN w l ON l.ordinal = i JOIN w r ON r.ordinal = j GROUP BY ALL""")
def gram(spark, sf_dir):
    a = _antennas(spark, sf_dir)
    w = G.beam_weights(a, _config(spark, sf_dir), _WL).join(a.select("antenna_id", "ordinal"), "antenna_id").select("ordinal", "beam_id", "re", "im")
    return G.gram(a, w, _WL).select("beam_i", "beam_j", _r("re").alias("re"), _r("im").alias("im"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.radians(F.col("s_nationkey") * 3.0), F.radians(F.col("s_suppkey") * 3.6)
    x, y, z = SP.eq2cart(F.lit(1.0), lat, lon)
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("src_id"), x.alias("x"), y.alias("y"), z.alias("z"), F.col("s_acctbal").alias("intensity"))


_SRC = "src AS (SELECT s_suppkey::BIGINT AS src_id, cos(radians(s_nationkey * 3.0)) * cos(radians(s_suppkey * 3.6)) AS x, cos(radians(s_nationkey * 3.0)) * sin(radians(s_suppkey * 3.6)) AS y, sin(radians(s_nationkey * 3.0)) AS z, s_acctbal AS intensity FROM supplier)"
_DIR = SP.unit(0.5, 0.7).tolist()


@query(f"WITH {_SRC} SELECT src_id, round(intensity, 2) AS intensity FROM src WHERE x * {_DIR[0]!r}::DOUBLE + y * {_DIR[1]!r}::DOUBLE + z * {_DIR[2]!r}::DOUBLE >= cos(1.5) ORDER BY intensity DESC, src_id LIMIT 2")
def top_sources(spark, sf_dir):
    return G.top_sources(_sources(spark, sf_dir), 2, _DIR, 3.0).select("src_id", F.round("intensity", 2).alias("intensity"))


@query(f"""WITH {_ant_sql(8)}, {_SRC}, p AS (SELECT src_id, ordinal, intensity, 2*pi()/{_WL}*(s.x*a.x+s.y*a.y+s.z*a.z) AS ph FROM src s, ant a WHERE src_id <= 10)
SELECT a.ordinal AS i, b.ordinal AS j, round(sum(a.intensity * cos(b.ph - a.ph)), 4) + 0.0 AS re, round(sum(a.intensity * sin(b.ph - a.ph)), 4) + 0.0 AS im FROM p a JOIN p b USING (src_id) GROUP BY ALL""")
def expected_visibility(spark, sf_dir):
    v = G.expected_visibility(_sources(spark, sf_dir).where("src_id <= 10"), _antennas(spark, sf_dir, 8), _WL)
    return v.select("i", "j", _r("re", 4).alias("re"), _r("im", 4).alias("im"))


@query(f"""WITH {_ant_sql(100000)}, s AS (SELECT station_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ant GROUP BY station_id), g AS (SELECT *, sqrt(x * x + y * y + z * z) AS r, sqrt(x * x + y * y) AS f FROM s WHERE x <> 0 OR y <> 0),
e AS (SELECT station_id, k::BIGINT AS antenna_id, x, y, z, -1.65 + 1.1 * (k % 4) AS gx, -1.65 + 1.1 * (k // 4) AS gy, z / r AS ct, f / r AS st, x / f AS cp, y / f AS sp FROM g, range(16) t(k))
SELECT station_id, antenna_id, round(x + gx * ct * cp - gy * sp, 6) + 0.0 AS x, round(y + gx * ct * sp + gy * cp, 6) + 0.0 AS y, round(z - gx * st, 6) + 0.0 AS z FROM e""")
def tile_elements(spark, sf_dir):
    a = OB.station_centroids(_antennas(spark, sf_dir, 100000)).where("x <> 0 or y <> 0")
    return OB.tile_elements(a).select("station_id", "antenna_id", *(_r(c).alias(c) for c in "xyz"))


# -- frames, grids, functions


@query("""WITH p AS (SELECT range AS pixel_id, range // 32 AS "row", range % 32 AS col FROM range(1024)), c AS (SELECT sin(0.1) AS lim),
q AS (SELECT pixel_id, "row", col, -lim + lim / 32 + col * (2 * lim / 31) AS l, -lim - lim / 32 + "row" * (2 * lim / 31) AS m FROM p, c)
SELECT pixel_id, "row"::INTEGER AS "row", col::INTEGER AS col, round(l, 9) AS l, round(m, 9) AS m, round(sqrt(1 - l * l - m * m), 9) AS n FROM q""")
def lmn_grid(spark, sf_dir):
    return FR.lmn_grid(spark, 32, 0.2).select("pixel_id", "row", "col", *(F.round(c, 9).alias(c) for c in "lmn"))


@query("""SELECT range AS id, round(-sin(r), 9) + 0.0 AS ux, round(cos(r), 9) + 0.0 AS uy, round(-cos(r) * sin(d), 9) + 0.0 AS vx, round(cos(d), 9) + 0.0 AS vz, round(cos(r) * cos(d), 9) + 0.0 AS wx, round(sin(r) * cos(d), 9) + 0.0 AS wy
FROM (SELECT range, range * 0.7 AS r, range * 0.1 - 0.5 AS d FROM range(10))""")
def uvw_basis(spark, sf_dir):
    rows = []
    for k in range(10):
        b = FR.uvw_basis(k * 0.7, k * 0.1 - 0.5)
        rows.append((k, *(float(x) for x in (b[0, 0], b[1, 0], b[0, 1], b[2, 1], b[0, 2], b[1, 2]))))
    df = spark.createDataFrame(rows, "id long, ux double, uy double, vx double, vz double, wx double, wy double")
    return df.select("id", *(_r(c, 9).alias(c) for c in df.columns[1:]))


@query("""SELECT range AS pixel_id, round(s * cos(p), 6) + 0.0 AS x, round(s * sin(p), 6) + 0.0 AS y, round(c, 6) + 0.0 AS z FROM
(SELECT range, 1 - (2 * range + 1) / 484.0 AS c, sin(acos(1 - (2 * range + 1) / 484.0)) AS s, range * (4 * pi() / (1 + sqrt(5))) AS p FROM range(484))""")
def fibonacci_grid(spark, sf_dir):
    return GR.fibonacci(spark, 10).select("pixel_id", *(_r(c).alias(c) for c in "xyz"))


@query("""SELECT range // 8 AS q, range % 8 AS l, round(pi() / 8 * (range // 8 + 0.5), 6) AS colat, round(2 * pi() / 8 * (range % 8), 6) AS lon FROM range(64)""")
def equal_angle_grid(spark, sf_dir):
    return GR.equal_angle(spark, 3).select("q", "l", F.round("colat", 6).alias("colat"), F.round("lon", 6).alias("lon"))


@query("""WITH e AS (SELECT range // 22 AS q, range % 22 AS l, pi() / 22 * (range // 22 + 0.5) AS colat, 2 * pi() / 22 * (range % 22) AS lon FROM range(484))
SELECT q, l FROM e WHERE colat BETWEEN pi() / 2 - 0.6 AND pi() / 2 + 0.6 AND (lon >= 2 * pi() - 0.6 + 0.2 OR lon <= 0.8)""")
def equal_angle_region(spark, sf_dir):
    return GR.equal_angle(spark, 10, SP.unit(0.0, 0.2), 1.2).select("q", "l")


def _healpix_sql(s: int) -> str:
    """Ring by ring: ring i has min(4i, 4s, 4(4s - i)) pixels."""
    return f"""WITH r AS (SELECT range AS i, CASE WHEN range < {s} THEN range WHEN range > {3 * s} THEN {4 * s} - range ELSE {s} END AS k FROM range(1, {4 * s})),
b AS (SELECT i, k, coalesce(sum(4 * k) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM r),
p AS (SELECT i, k, first, unnest(range(4 * k)) AS j FROM b),
v AS (SELECT (first + j)::BIGINT AS pixel_id, CASE WHEN i < {s} THEN 1 - i * i / (3.0 * {s} * {s}) WHEN i > {3 * s} THEN -1 + k * k / (3.0 * {s} * {s}) ELSE (2 * {s} - i) * 2.0 / (3 * {s}) END AS z,
CASE WHEN i < {s} OR i > {3 * s} THEN (j + 0.5) * pi() / (2 * k) ELSE (j + CASE WHEN (i + {s}) % 2 = 0 THEN 0.5 ELSE 0 END + 0.0) * pi() / (2 * {s}) END AS phi FROM p)
SELECT pixel_id, round(sqrt(1 - z * z) * cos(phi), 6) + 0.0 AS x, round(sqrt(1 - z * z) * sin(phi), 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM v"""


@query(_healpix_sql(3))
def healpix_grid(spark, sf_dir):
    return GR.healpix(spark, 5).select("pixel_id", *(_r(c).alias(c) for c in "xyz"))


def _about_sql(lat: float, lon: float, turn: bool) -> list[str]:
    """x, y, z turned from the pole to a direction: about z by -lon (unless ``turn``), about y by the colatitude, about z by lon."""
    ct, st, cp, sp = (f"{v!r}::DOUBLE" for v in (math.sin(lat), math.cos(lat), math.cos(lon), math.sin(lon)))
    px, py = ("x", "y") if turn else (f"({cp} * x + {sp} * y)", f"({cp} * y - {sp} * x)")
    qx, qz = f"({ct} * {px} + {st} * z)", f"({ct} * z - {st} * {px})"
    return [f"round({e}, 6) + 0.0 AS {c}" for e, c in ((f"{cp} * {qx} - {sp} * {py}", "x"), (f"{sp} * {qx} + {cp} * {py}", "y"), (qz, "z"))]


_D = SP.unit(0.4, 1.0).tolist()


@query(f"""WITH p AS (SELECT range AS pixel_id, range // 7 AS r, range % 7 AS c FROM range(42)), s AS (SELECT pixel_id, sin(r * 0.05) * cos(c * pi() / 3) AS x, sin(r * 0.05) * sin(c * pi() / 3) AS y, cos(r * 0.05) AS z FROM p),
u AS (SELECT pixel_id, x, y, sqrt(1 - x * x - y * y) AS z FROM (SELECT pixel_id, -sin(0.25) + c * sin(0.25) / 3 AS x, -sin(0.25) + r * 2 * sin(0.25) / 5 AS y FROM p)),
f AS (SELECT range AS pixel_id, sin(acos(1 - (2 * range + 1) / 676.0)) * cos(range * (4 * pi() / (1 + sqrt(5)))) AS x, sin(acos(1 - (2 * range + 1) / 676.0)) * sin(range * (4 * pi() / (1 + sqrt(5)))) AS y, 1 - (2 * range + 1) / 676.0 AS z FROM range(676))
SELECT 'spherical' AS grid, pixel_id, {', '.join(_about_sql(0.4, 1.0, False))} FROM s UNION ALL SELECT 'uniform', pixel_id, {', '.join(_about_sql(0.4, 1.0, True))} FROM u
UNION ALL SELECT 'fibonacci', pixel_id, round(x, 6) + 0.0, round(y, 6) + 0.0, round(z, 6) + 0.0 FROM f WHERE x * {_D[0]!r}::DOUBLE + y * {_D[1]!r}::DOUBLE + z * {_D[2]!r}::DOUBLE >= cos(0.4)""")
def region_grids(spark, sf_dir):
    """Spherical, uniform and Fibonacci grids about one direction."""
    d = SP.unit(0.4, 1.0)
    parts = [("spherical", GR.spherical(spark, d, 0.5, (6, 7))), ("uniform", GR.uniform(spark, d, 0.5, (6, 7))), ("fibonacci", GR.fibonacci(spark, 12, d, 0.8))]
    out = None
    for name, g in parts:
        g = g.select(F.lit(name).alias("grid"), "pixel_id", *(_r(c).alias(c) for c in "xyz"))
        out = g if out is None else out.unionByName(g)
    return out


@query("""SELECT event_id, round(r * cos(lat) * cos(lon), 6) + 0.0 AS x, round(r * cos(lat) * sin(lon), 6) + 0.0 AS y, round(r * sin(lat), 6) + 0.0 AS z, round(r, 6) AS r2, round(lat, 6) + 0.0 AS lat2, round(lon, 6) AS lon2, round(pi() / 2 - lat, 6) AS colat
FROM (SELECT event_id, 1 + value / 100 AS r, (event_id % 100) / 100.0 - 0.5 AS lat, (user_id % 60) / 10.0 AS lon FROM events)""")
def sphere_transforms(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (1 + F.col("value") / 100).alias("r"), (F.col("event_id") % 100 / 100.0 - 0.5).alias("lat"), (F.col("user_id") % 60 / 10.0).alias("lon"))
    x, y, z = SP.eq2cart(F.col("r"), F.col("lat"), F.col("lon"))
    c = e.select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))
    r, lat, lon = SP.cart2eq(F.col("x"), F.col("y"), F.col("z"))
    return c.select("event_id", *(_r(k).alias(k) for k in "xyz"), _r(r).alias("r2"), _r(lat).alias("lat2"), _r(lon).alias("lon2"), _r(SP.cart2pol(F.col("x"), F.col("y"), F.col("z"))[1]).alias("colat"))


@query("""SELECT event_id, round(((value * 7 + 180) - 360 * floor((value * 7 + 180) / 360)) - 180, 6) + 0.0 AS deg FROM events""")
def wrap_degrees(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", _r(SP.wrap_degrees(F.col("value") * 7)).alias("deg"))


@query("""WITH y AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_discount * 20 - 1.0 + 0.8 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN y >= 0.2 AND y <= 1.4 THEN 1 WHEN y >= 0 AND y < 0.2 THEN sin(pi() / 0.4 * y) ** 2 WHEN y > 1.4 AND y <= 1.6 THEN sin(pi() / 0.4 * (1.6 - y)) ** 2 ELSE 0 END, 6) + 0.0 AS w FROM y""")
def tukey_window(spark, sf_dir):
    w = WN.tukey(F.col("l_discount") * 20, 1.6, 1.0, 0.25)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _r(w).alias("w"))


@query("""WITH x AS (SELECT event_id, (event_id % 201) / 100.0 - 1 AS t FROM events)
SELECT event_id, round(5 / (4 * pi()) * CASE WHEN t = 1 THEN 5 ELSE ((63*t**5 - 70*t**3 + 15*t) / 8 - (35*t**4 - 30*t**2 + 3) / 8) / (t - 1) END, 6) + 0.0 AS k FROM x""")
def dirichlet_kernel(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", _r(WN.dirichlet(F.col("event_id") % 201 / 100.0 - 1, 4)).alias("k"))


@query()
def dirichlet_spline(spark, sf_dir):
    """Spline approximation against the exact kernel near 1."""
    spline = WN.DirichletSpline(20)

    def run(it):
        for pdf in it:
            t = np.cos(pdf.event_id.to_numpy() % 50 / 500)
            yield pdf.assign(exact=WN.dirichlet_np(t, 20).round(4), spline=spline(t).round(4))

    return _t(spark, sf_dir, "events").select("event_id").mapInPandas(run, "event_id bigint, exact double, spline double")


def _kent_norm(k: float, beta: float) -> float:
    """The density's integral over the sphere, by quadrature."""
    t, w = np.polynomial.legendre.leggauss(200)
    phi = np.arange(400) * (2 * math.pi / 400)
    e = t[:, None] - 1 + 0.5 * beta * (1 - t[:, None] ** 2) * np.cos(2 * phi)
    return float((w @ np.exp(k * e)).sum() * 2 * math.pi / 400)


@query(f"""WITH f AS (SELECT range AS pixel_id, 1 - (2 * range + 1) / 1764.0 AS z, range * (4 * pi() / (1 + sqrt(5))) AS p FROM range(1764))
SELECT pixel_id, round(exp(12.0 * (z - 1 + 0.2 * (1 - z * z) * (cos(p) ** 2 - sin(p) ** 2))) / {_kent_norm(12.0, 0.4)!r}::DOUBLE, 6) + 0.0 AS density FROM f""")
def kent_density(spark, sf_dir):
    k = WN.Kent(12.0, 0.4, [0, 0, 1.0], [1.0, 0, 0.2])
    return GR.fibonacci(spark, 20).select("pixel_id", _r(k.column(F.col("x"), F.col("y"), F.col("z"))).alias("density"))


_TABLE = [(1.0, 3), (2.0, 4), (5.0, 8), (10.0, 13), (20.0, 24), (40.0, 45)]


@query("WITH t(x, n) AS (VALUES " + ", ".join(f"({x}, {n})" for x, n in _TABLE) + f""") SELECT p_partkey, CASE WHEN p_size < 1 THEN {_TABLE[0][1]} ELSE ceil((SELECT arg_max(n / x, x) FROM t WHERE x <= p_size) * p_size) END::INTEGER AS n_threshold FROM part""")
def threshold_lookup(spark, sf_dir):
    t = spark.createDataFrame(_TABLE, "x double, n_threshold int")
    return TH.lookup(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v")), "v", t).select("p_partkey", "n_threshold")


@query("""WITH e AS (SELECT event_id, (user_id % 60) / 30.0 - 1 AS lon, (event_id % 100) / 100.0 - 0.5 AS lat FROM events), c AS (SELECT *, sin(0.2)*sin(lat)+cos(0.2)*cos(lat)*cos(lon-0.1) AS cc, cos(lat)*sin(lon-0.1) AS ea, cos(0.2)*sin(lat)-sin(0.2)*cos(lat)*cos(lon-0.1) AS no FROM e)
SELECT event_id, round(ea/cc, 6) + 0.0 AS gx, round(no/cc, 6) + 0.0 AS gy, round(sqrt(2/(1+cc))*ea, 6) + 0.0 AS lx, round(sqrt(2/(1+cc))*no, 6) + 0.0 AS ly, round(CASE WHEN sin(acos(cc))=0 THEN 1 ELSE acos(cc)/sin(acos(cc)) END*ea, 6) + 0.0 AS ax FROM c""")
def map_projections(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 60 / 30.0 - 1).alias("lon"), (F.col("event_id") % 100 / 100.0 - 0.5).alias("lat"))
    p = lambda k: PJ.project(k, F.col("lon"), F.col("lat"), 0.1, 0.2)
    (gx, gy), (lx, ly), (ax, _) = p("GNOM"), p("LAEA"), p("AEQD")
    return e.select("event_id", _r(gx).alias("gx"), _r(gy).alias("gy"), _r(lx).alias("lx"), _r(ly).alias("ly"), _r(ax).alias("ax"))


@query("""WITH s AS (SELECT s_suppkey AS s_id, s_acctbal AS f, cos(radians(s_nationkey*3.0))*cos(radians(s_suppkey*3.6)) AS x, cos(radians(s_nationkey*3.0))*sin(radians(s_suppkey*3.6)) AS y, sin(radians(s_nationkey*3.0)) AS z FROM supplier WHERE s_suppkey <= 20),
r AS (SELECT n_nationkey AS r_id, cos(n_nationkey*0.1) AS x, sin(n_nationkey*0.1) AS y, 0.0 AS z FROM nation),
d AS (SELECT r_id, f, greatest(-1, least(1, s.x*r.x+s.y*r.y+s.z*r.z)) AS t FROM s, r)
SELECT r_id::BIGINT AS r_id, round(sum(0.01 * f * 3/(4*pi()) * CASE WHEN t = 1 THEN 3 ELSE ((5*t**3-3*t)/2 - (3*t**2-1)/2)/(t-1) END), 4) + 0.0 AS value FROM d GROUP BY r_id""")
def zonal_interpolation(spark, sf_dir):
    s = _sources(spark, sf_dir).where("src_id <= 20").select(F.col("src_id").alias("s_id"), F.lit(0.01).alias("weight"), F.col("intensity").alias("f"), "x", "y", "z")
    a = F.col("n_nationkey") * 0.1
    r = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("r_id"), F.cos(a).alias("x"), F.sin(a).alias("y"), F.lit(0.0).alias("z"))
    return IP.interpolate(s, r, 2).select("r_id", _r("value", 4).alias("value"))


# -- partitions


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_discount").cast("double").alias("z"))


_CELLS = """b AS (SELECT min(l_quantity)::DOUBLE x0, max(l_quantity)::DOUBLE x1, min(l_extendedprice)::DOUBLE y0, max(l_extendedprice)::DOUBLE y1, min(l_discount)::DOUBLE z0, max(l_discount)::DOUBLE z1 FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_extendedprice AS y, l_discount AS z, (least(trunc(4.0*(l_discount-z0)/(z1-z0))::BIGINT,3)*3+least(trunc(3.0*(l_extendedprice-y0)/(y1-y0))::BIGINT,2))*2+least(trunc(2.0*(l_quantity-x0)/(x1-x0))::BIGINT,1) AS cell FROM lineitem, b)"""


@query(f"WITH {_CELLS}, c AS (SELECT cell, count(*) AS size FROM p GROUP BY cell) SELECT cell, size, coalesce(sum(size) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM c")
def partition_offsets(spark, sf_dir):
    return PT.offsets(PT.grid_cells(_points(spark, sf_dir), (2, 3, 4)))


_PERM = f"{_CELLS}, q AS (SELECT *, row_number() OVER (ORDER BY cell, l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y) - 1 AS target FROM p)"


@query(f"WITH {_PERM} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, target FROM q")
def partition_permutation(spark, sf_dir):
    cells = PT.grid_cells(_points(spark, sf_dir), (2, 3, 4))
    p = PT.permutation(cells, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y")
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cell", F.col("target").cast("bigint").alias("target"))


@query("SELECT event_id AS i, round(value, 6) AS value FROM events")
def permutation_round_trip(spark, sf_dir):
    """Scattered and gathered again: every value comes home."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").cast("double").alias("x"), "value", (F.col("event_id") % 13).cast("double").alias("z"))
    perm = PT.permutation(PT.grid_cells(e, (3, 2, 4), ("x", "value", "z")), "i").select("i", "target")
    there = PT.apply_permutation(e.select("i", "value"), perm)
    return PT.reverse_permutation(there, perm).select("i", F.round("value", 6).alias("value"))


# -- images


def _small(spark: SparkSession, sf_dir: str, samples: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors of 8 antennas and 8 eigenpairs, filtered values and uvw from the first vectors."""
    e = _eigs(spark, sf_dir).where(F.col("sample_id") < samples)
    v = e.select("sample_id", (F.col("eig_idx") % 8).alias("antenna"), F.floor(F.col("eig_idx") / 8).alias("eig_idx"), F.col("d").alias("re"), (F.col("d") / 2).alias("im"))
    d = SE.masked(e.where("eig_idx < 8").select("sample_id", F.col("eig_idx").cast("bigint").alias("eig_idx"), "d"), "sqrt", 0.0, 0.3).withColumn("tag", F.lit("level"))
    pos = e.where("eig_idx < 8").select("sample_id", F.col("eig_idx").alias("a"), (F.col("d") * 40).alias("p"))
    i, j = pos.select("sample_id", F.col("a").alias("i"), F.col("p").alias("pi")), pos.select("sample_id", F.col("a").alias("j"), F.col("p").alias("pj"))
    u = F.col("pi") - F.col("pj")
    uvw = i.join(j, "sample_id").select("sample_id", "i", "j", u.alias("u"), (u * 0.5).alias("v"), (u * 0.1).alias("w"))
    return v, d, uvw


def _img(samples: int) -> str:
    return f"""{_EIGS}, e AS (SELECT * FROM eigs WHERE sample_id < {samples}), v AS (SELECT sample_id, eig_idx % 8 AS antenna, eig_idx // 8 AS k, d AS re, d / 2 AS im FROM e),
f AS (SELECT sample_id, eig_idx AS k, sqrt(CASE WHEN d >= 0 AND d <= 0.3 THEN d ELSE 0 END) AS d FROM e WHERE eig_idx < 8),
vv AS (SELECT a.sample_id, a.antenna AS i, b.antenna AS j, sum(f.d * (a.re * b.re + a.im * b.im)) AS re, sum(f.d * (a.im * b.re - a.re * b.im)) AS im FROM v a JOIN f USING (sample_id, k) JOIN v b USING (sample_id, k) WHERE f.d <> 0 GROUP BY ALL)"""


@query(f"WITH {_img(40)} SELECT sample_id, i::BIGINT AS i, j::BIGINT AS j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM vv")
def virtual_vis(spark, sf_dir):
    v, d, _ = _small(spark, sf_dir, 40)
    return SY.virtual_visibilities(v, d).select("sample_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), _r("re").alias("re"), _r("im").alias("im"))


@query(f"""WITH {_img(40)}, pos AS (SELECT sample_id, eig_idx AS a, d * 40 AS p FROM e WHERE eig_idx < 8), uv AS (SELECT x.sample_id, x.a AS i, y.a AS j, x.p - y.p AS u FROM pos x JOIN pos y USING (sample_id)),
px AS (SELECT range AS pixel_id, sin(0.1) AS lim, range // 8 AS r, range % 8 AS c FROM range(64)), lm AS (SELECT pixel_id, -lim + lim / 8 + c * (2 * lim / 7) AS l, -lim - lim / 8 + r * (2 * lim / 7) AS m FROM px),
g AS (SELECT pixel_id, l, m, sqrt(1 - l * l - m * m) AS n FROM lm)
SELECT 'level' AS tag, pixel_id, round(sum(re * cos(l * u + m * u * 0.5 + n * u * 0.1) - im * sin(l * u + m * u * 0.5 + n * u * 0.1)) / 40, 6) + 0.0 AS value FROM vv JOIN uv USING (sample_id, i, j), g GROUP BY pixel_id""")
def nudft_image(spark, sf_dir):
    """Filter, virtual visibilities, direct sum and normalisation, all relational."""
    v, d, uvw = _small(spark, sf_dir, 40)
    img = SY.direct_sum(SY.virtual_visibilities(v, d), uvw, FR.lmn_grid(spark, 8, 0.2))
    return SY.normalised(img, 40).select("tag", "pixel_id", _r("value").alias("value"))


@query(ORACLES["nudft_image"])
def image_synthesis(spark, sf_dir):
    """The same image from the vectorised kernels: arrays per sample, partial images per task."""
    e = _t(spark, sf_dir, "embeddings").where("vec_id < 40").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x"))
    u = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("x")[i - 1] - F.col("x")[j - 1]) * 40)))
    wl = 2 * math.pi
    s = e.select("sample_id", F.lit(0.0).alias("time"), F.lit(wl).alias("wl"), F.lit(1.0).alias("scale"), F.slice("x", 1, 8).alias("d"), F.col("x").alias("v_re"), F.transform("x", lambda a: a / 2).alias("v_im"), F.concat(u, F.transform(u, lambda a: a * 0.5), F.transform(u, lambda a: a * 0.1)).alias("uvw"))
    sel = s.select(F.lit("level").alias("tag"), "sample_id", FL.array_filter("sqrt", F.col("d"), 0.0, 0.3).alias("d"))
    img = SY.image_synthesis(s, sel, FR.lmn_grid(spark, 8, 0.2), 8, 8, SY.Options(precision="double"))
    return img.select("tag", "pixel_id", _r("value").alias("value"))


@query("SELECT label::VARCHAR AS tag, pos AS pixel_id, round(sum(d) / 200, 6) + 0.0 AS value FROM (SELECT label, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest(embedding)::DOUBLE AS d FROM embeddings WHERE vec_id < 200) GROUP BY ALL")
def image_norm(spark, sf_dir):
    """Sums of images divided by the number of samples."""
    e = _t(spark, sf_dir, "embeddings").where("vec_id < 200").select(F.col("label").cast("string").alias("tag"), F.posexplode("embedding").alias("pixel_id", "d"))
    img = e.groupBy("tag", F.col("pixel_id").cast("bigint").alias("pixel_id")).agg(F.sum(F.col("d").cast("double")).alias("value"))
    return SY.normalised(img, 200).select("tag", "pixel_id", _r("value").alias("value"))


@query("SELECT pos AS pixel_id, round(sum(d), 6) + 0.0 AS value FROM (SELECT label, generate_subscripts(embedding, 1)::BIGINT - 1 AS pos, unnest(embedding)::DOUBLE AS d FROM embeddings WHERE label IN (1, 3)) GROUP BY pos")
def layer_sum(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("tag"), F.posexplode("embedding").alias("pixel_id", "value"))
    return IP.layer_sum(e.select("tag", F.col("pixel_id").cast("bigint").alias("pixel_id"), F.col("value").cast("double").alias("value")), ["1", "3"]).select("pixel_id", _r("value").alias("value"))


# -- eigenproblems


def _instrument(n: int = 6) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(5)
    return r.normal(0, 30, (n, 3)), np.eye(n, dtype=complex)


@query()
def eigen_gram(spark, sf_dir):
    """Eigenvalues of simulated visibilities, generalised by the Gram matrix."""
    xyz, w = _instrument()
    src = GR.fibonacci(spark, 1).orderBy("pixel_id").limit(5).toPandas()[["x", "y", "z"]].to_numpy()
    vis = EG.simulate(spark, 6, xyz, w, _WL, src, np.arange(1.0, 6.0), 30.0, 8.0, 100.0)
    out = EG.eigen_stage(vis, w, xyz, _WL)
    return out.select("time_id", "channel_id", F.round("scale", 9).alias("scale"), F.transform("d", lambda x: F.round(x, 4)).alias("d"))


@query()
def eigen_plain(spark, sf_dir):
    """Eigenvalues of event visibilities without a Gram matrix; one matrix per day and channel."""
    v = _vis(spark, sf_dir).select(F.unix_date("time").cast("bigint").alias("time_id"), "channel_id", "beam_i", "beam_j", "re", "im")
    return EG.eigen_stage(v, np.eye(8, dtype=complex), None, _WL).select("time_id", "channel_id", F.round("scale", 9).alias("scale"), F.transform("d", lambda x: F.round(x, 4)).alias("d"))


@query()
def wishart_visibility(spark, sf_dir):
    xyz, w = _instrument()
    v = EG.simulate(spark, 4, xyz, w, _WL, np.eye(3), np.array([1.0, 2.0, 3.0]), 20.0, 1.0, 500.0)
    return v.select("time_id", "beam_i", "beam_j", _r("re").alias("re"), _r("im").alias("im"))



