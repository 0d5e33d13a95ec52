"""Eigenproblems of each (time, channel), many groups of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .. import schema as S
from ..functions import linalg as L
from ..functions.frame import sidereal_angle, uvw_basis
from .geometry import rotation_plane

OUT = "time_id bigint, channel_id bigint, scale double, d array<double>, v_re array<double>, v_im array<double>"
_ENTRIES = 1 << 18  # of the dense matrices made at a time, 4 MB of complex numbers


def _starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Places of the rows whose key isn't that of the row before; nulls are equal."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = rows.column(k)
        for x in (c.is_null(), pc.fill_null(c, 0)):
            x = x.to_numpy() if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of ``batches``, sorted by ``keys``, cut only between groups; at most one group is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(_starts(batch, keys)[-1])
        if held and cut == 0 and len(_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 1:
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def lists(values: np.ndarray) -> pa.ListArray:
    """A list per row, of all that is in it."""
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def vectors(v: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Real and imaginary parts of each matrix, column-major."""
    v = v.swapaxes(1, 2)
    return lists(v.real), lists(v.imag)


def solved(vis: DataFrame, keys: list[str], beams: int, solve: Callable[[pa.Table, np.ndarray], list], out: str, entries: int | None = None) -> DataFrame:
    """What ``solve`` makes of the first row of each group (``keys``, integers) and of the stack of the groups' matrices.

    Rows are sorted by group within partitions, and as many groups of a batch are solved at once as their
    dense matrices (or what else takes ``entries`` each) allow; so a group costs no call of its own.
    """
    at_once = max(1, _ENTRIES // max(1, entries or beams * beams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            starts = _starts(rows, keys)
            first = rows.take(pa.array(starts))
            i, j, re, im = (rows.column(c).to_numpy() for c in ("beam_i", "beam_j", "re", "im"))
            ends = np.append(starts[1:], rows.num_rows)
            for lo in range(0, len(starts), at_once):
                hi = min(lo + at_once, len(starts))
                part = slice(starts[lo], ends[hi - 1])
                s = np.zeros((hi - lo, beams, beams), complex)
                s[np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi]), i[part], j[part]] = re[part] + 1j * im[part]
                cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) if isinstance(c, np.ndarray) else c for c in solve(first.slice(lo, hi - lo), s)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [field.split()[0] for field in out.split(", ")]
    return vis.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def eigen_stage(vis: DataFrame, weights: np.ndarray, positions: np.ndarray | None, wl: float) -> DataFrame:
    """``scale, d, v`` per group; with positions the generalised problem.  Vectors are column-major.

    ``weights`` (antennas x beams) and ``positions`` belong to the instrument, so their size doesn't
    grow with the observation; groups are independent and each is one small matrix.
    """
    antennas, beams = weights.shape

    def solve(first: pa.Table, s: np.ndarray) -> list:
        v, d, scale = L.eigh(wl, s, weights) if positions is None else L.eigh_gram(wl, s, weights, positions)
        return [first["time_id"], first["channel_id"], scale, lists(d), *vectors(v)]

    return solved(vis.select("time_id", "channel_id", "beam_i", "beam_j", "re", "im"), ["time_id", "channel_id"], beams, solve, OUT, max(antennas, beams) * beams)


@dataclass(frozen=True)
class Instrument:
    """Antennas (``xyz``), the beam that each belongs to, and the field centre they look at (radians).

    Earth-fixed positions are turned to the sky's frame at each time before anything is made of them;
    the size of all this is the instrument's and doesn't grow with the observation.
    """

    xyz: np.ndarray
    beam: np.ndarray
    ra: float
    dec: float
    earth_fixed: bool = True

    @property
    def beams(self) -> int:
        return int(self.beam.max()) + 1

    def positions(self, mjd: float | np.ndarray) -> np.ndarray:
        """Of one time, or a stack of those of several."""
        if not self.earth_fixed:
            return np.broadcast_to(self.xyz, (*np.shape(mjd), *self.xyz.shape))
        a = np.asarray(sidereal_angle(mjd))[..., None]
        c, s = np.cos(a), np.sin(a)
        x, y, z = self.xyz.T
        return np.stack([x * c - y * s, x * s + y * c, np.broadcast_to(z, (*np.shape(mjd), len(z)))], -1)

    def weights(self, positions: np.ndarray, wl: float | np.ndarray) -> np.ndarray:
        """exp(-i 2 pi <x - mean, centre> / wl) where an antenna belongs to the beam."""
        w = np.zeros((*positions.shape[:-1], self.beams), complex)
        phase = (positions - positions.mean(-2, keepdims=True)) @ uvw_basis(self.ra, self.dec)[:, 2]
        w[..., np.arange(len(self.beam)), self.beam] = np.exp(-2j * np.pi / np.asarray(wl)[..., None] * phase)
        return w

    def rotation(self, start: float, end: float, samples: int = 20) -> np.ndarray:
        """Rotation into the plane that the antennas turn in between two times, from evenly spaced ones."""
        if start > end:
            raise ValueError("start must not be after end")
        return rotation_plane(np.stack([self.positions(t) for t in np.linspace(start, end, samples)], 1))

    def uvw(self, positions: np.ndarray) -> np.ndarray:
        """Differences x_i - x_j in the local frame, in order k = j N + i, column-major."""
        q = positions @ uvw_basis(self.ra, self.dec)
        m = q[..., None, :, :] - q[..., :, None, :]
        return np.moveaxis(m, -1, -3).reshape(*q.shape[:-2], -1)


def solved_samples(vis: DataFrame, instrument: Instrument, channels: int, first: int = 0) -> DataFrame:
    """A sample per (time, channel): eigenpairs with the positions, weights and wavelength of that time and channel.

    ``vis``: time_id, time, channel_id, wl and the reduced visibilities; ``sample_id`` is dense over
    times and ``channels`` channels from ``first`` on.
    """

    def solve(rows: pa.Table, s: np.ndarray) -> list:
        t, channel, time, wl = (rows[c].to_numpy() for c in ("time_id", "channel_id", "time", "wl"))
        p = instrument.positions(time)
        v, d, scale = L.eigh_gram(wl, s, instrument.weights(p, wl), p)
        return [t * channels + channel - first, rows["time"], rows["wl"], scale, lists(d), *vectors(v), lists(instrument.uvw(p))]

    vis = vis.select("time_id", "channel_id", "time", "wl", "beam_i", "beam_j", "re", "im")
    return solved(vis, ["time_id", "channel_id"], instrument.beams, solve, S.SAMPLES, 3 * len(instrument.xyz) ** 2)


def simulate(spark, times: int, xyz: np.ndarray, w: np.ndarray, wl: float, src: np.ndarray, intensity: np.ndarray, snr_db: float, duration: float, rate: float, seed: int | None = 42) -> DataFrame:
    """Synthetic visibilities, one matrix per time id; without a seed the expectation."""

    def run(it):
        for pdf in it:
            for t in pdf.id:
                s = L.synthetic_visibility(xyz, w, wl, src, intensity, snr_db, duration, rate, None if seed is None else np.random.default_rng([seed, int(t)]))
                i, j = np.tril_indices(len(s))
                yield pd.DataFrame({"time_id": t, "channel_id": 0, "beam_i": i, "beam_j": j, "re": s[i, j].real, "im": s[i, j].imag})

    return spark.range(times).mapInPandas(run, "time_id bigint, channel_id bigint, beam_i bigint, beam_j bigint, re double, im double")
