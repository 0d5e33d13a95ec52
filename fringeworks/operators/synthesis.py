"""Image synthesis: the relational form, and vectorised kernels in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import complexes as Z
from ..functions import linalg as L
from .partition import Partition


@dataclass(frozen=True)
class Options:
    """``tolerance`` has no effect on exact sums; ``batch`` bounds a kernel's phase matrix in numbers."""

    precision: str = "single"
    tolerance: float = 1e-3
    batch: int = 4_000_000
    partition: Partition = field(default_factory=Partition.auto)
    normalize: bool = True
    apply_scaling: bool = True

    def with_(self, **changes) -> Options:
        o = replace(self, **changes)
        if o.precision not in ("single", "double"):
            raise ValueError("precision is single or double")
        if o.tolerance <= 0 or o.batch < 1:
            raise ValueError("tolerance and batch must be positive")
        return o


def virtual_visibilities(vectors: DataFrame, values: DataFrame) -> DataFrame:
    """``tag, sample_id, i, j, re, im``: sum over e of d v_i conj(v_j).

    ``vectors``: sample_id, antenna, eig_idx, re, im; ``values``: tag, sample_id, eig_idx, d (scaled).
    Zero eigenvalues go before the join.
    """
    d = values.where("d <> 0")
    a = vectors.select("sample_id", "eig_idx", F.col("antenna").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = vectors.select("sample_id", "eig_idx", F.col("antenna").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    re, im = Z.mul((F.col("ar"), F.col("ai")), Z.conj((F.col("br"), F.col("bi"))))
    return a.join(d, ["sample_id", "eig_idx"]).join(b, ["sample_id", "eig_idx"]).groupBy("tag", "sample_id", "i", "j").agg(F.sum(F.col("d") * re).alias("re"), F.sum(F.col("d") * im).alias("im"))


def direct_sum(vis: DataFrame, uvw: DataFrame, pixels: DataFrame) -> DataFrame:
    """``tag, pixel_id, value``: pixels against baselines (uvw already times 2 pi / wl); for checks and small grids."""
    phase = F.col("l") * F.col("u") + F.col("m") * F.col("v") + F.col("n") * F.col("w")
    term = F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase)
    return vis.join(uvw, ["sample_id", "i", "j"]).crossJoin(pixels).groupBy("tag", "pixel_id").agg(F.sum(term).alias("value"))


def normalised(images: DataFrame, samples: int) -> DataFrame:
    return images.withColumn("value", F.col("value") / F.lit(float(max(samples, 1))))


_COMPACT = "ds array<array<double>>, k double, v_re array<double>, v_im array<double>, pos array<double>, uvw array<double>"


def _compact_rows(n: int, o: Options):
    """Scaled filters, vectors of the eigenvalues in use, and positions where uvw are their differences."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                d = np.stack([np.asarray(x, float) for x in r.ds]) * (r.scale if o.apply_scaling else 1.0)
                on = (d != 0).any(0)
                if not on.any():
                    continue
                v = [np.asarray(x).reshape(n, -1, order="F")[:, on].ravel(order="F") for x in (r.v_re, r.v_im)]
                k = 2 * math.pi / r.wl
                pos = L.separable(np.asarray(r.uvw).reshape(n * n, 3, order="F") * k, n)
                out.append((list(d[:, on]), k, *v, None if pos is None else pos.ravel(), r.uvw if pos is None else None))
            yield pd.DataFrame(out, columns=["ds", "k", "v_re", "v_im", "pos", "uvw"])

    return run


def _partial_image(n: int, tags: int, o: Options):
    """The sums of some samples over a block of pixels: factorised where there are positions, else pairwise."""
    kind = np.float32 if o.precision == "single" else np.float64

    def run(samples: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        lmn = block[["l", "m", "n"]].to_numpy(kind)
        total = np.zeros((tags, len(lmn)))
        for r in samples.itertuples(index=False):
            d = np.stack([np.asarray(x, float) for x in r.ds])
            v = (np.asarray(r.v_re) + 1j * np.asarray(r.v_im)).reshape(n, d.shape[1], order="F")
            alone = r.pos is not None
            place = np.asarray(r.pos).reshape(n, 3).astype(kind) if alone else (np.asarray(r.uvw).reshape(n * n, 3, order="F") * r.k).astype(kind)
            step = max(1, o.batch // len(place))
            for a in range(0, len(lmn), step):
                p = lmn[a : a + step]
                if alone:
                    total[:, a : a + step] += L.factorised(v, d, place, p)
                else:
                    for t in range(tags):
                        total[t, a : a + step] += L.direct_sum(L.virtual_vis(v, d[t]).ravel(order="F"), place, p)
        if not len(samples) or not len(lmn):
            return pd.DataFrame({"t": np.zeros(0, np.int32), "pixel_id": np.zeros(0, np.int64), "value": np.zeros(0)})
        return pd.DataFrame({"t": np.repeat(np.arange(tags, dtype=np.int32), len(lmn)), "pixel_id": np.tile(block.pixel_id.to_numpy(), tags), "value": total.ravel()})

    return run


def image_synthesis(samples: DataFrame, selection: DataFrame, pixels: DataFrame, n_antenna: int, n_beam: int, options: Options = Options(), pixel_block: int = 200_000, share: int = 64 << 20) -> DataFrame:
    """``tag, pixel_id, value`` images of every tag, in one plan.

    A sample meets its tags in one row, so phases are computed once for all images.  Rows are made small
    (positions in place of baselines where these are differences), then samples in shares of about ``share``
    bytes meet pixels in blocks of ``pixel_block``: each pair is a group of one task, and the groups' partial images
    are added up by a partial and a final aggregation.
    """
    tags, count = S.check_selection(selection, samples, n_beam)
    if not tags:
        return samples.sparkSession.createDataFrame([], S.IMAGES)
    wide = selection.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("tag", "d"))).alias("t")).select("sample_id", F.col("t.d").alias("ds"))
    rows = samples.join(wide, "sample_id").select("ds", "scale", "wl", "v_re", "v_im", "uvw")
    small = rows.mapInPandas(_compact_rows(n_antenna, options), _COMPACT)
    blocks = -(-pixels.count() // pixel_block)
    cores = samples.sparkSession.sparkContext.defaultParallelism
    shares = max(-(-count * 8 * (2 * n_antenna * n_beam + 3 * n_antenna + len(tags) * n_beam) // share), min(count, -(-cores // max(blocks, 1))), 1)
    left = small.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    block = F.pmod(F.xxhash64("pixel_id"), F.lit(max(blocks, 1))).cast("int")
    right = pixels.select("pixel_id", "l", "m", "n", block.alias("block")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    keys = ["block", "share"]
    tasks = max(blocks, 1) * shares
    out = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(_partial_image(n_antenna, len(tags), options), "t int, pixel_id bigint, value double")
    full = pixels.select(F.explode(F.sequence(F.lit(0), F.lit(len(tags) - 1))).alias("t"), "pixel_id", F.lit(0.0).alias("value"))  # pixels without signal are 0
    total = out.unionByName(full).groupBy("t", "pixel_id").agg(F.sum("value").alias("value"))
    total = total.select(F.element_at(F.array(*map(F.lit, tags)), F.col("t") + 1).alias("tag"), "pixel_id", "value")
    if options.normalize:
        total = normalised(total, count)
    return total.select("tag", "pixel_id", F.col("value").cast("float" if options.precision == "single" else "double").alias("value"))
