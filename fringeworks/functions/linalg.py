"""Dense kernels run on Arrow batches: Gram matrix, eigenproblems, virtual visibilities, sums.

Matrices are complex128; A antennas, B beams, E eigenpairs, P pixels.
"""

from __future__ import annotations

import math

import numpy as np


class EigensolverError(ArithmeticError):
    """The Gram matrix isn't positive definite (for example, antennas coincide)."""


def gram(xyz: np.ndarray, w: np.ndarray, wl: float | np.ndarray, four_pi: bool = False) -> np.ndarray:
    """W^H sinc(2 d / wl) W; ``four_pi`` gives the variant that is 4 pi times as large.  Stacks give a stack."""
    d = np.linalg.norm(xyz[..., :, None, :] - xyz[..., None, :, :], axis=-1)
    g = _h(w) @ np.sinc(2 * d / np.asarray(wl)[..., None, None]) @ w
    return 4 * math.pi * g if four_pi else g


def _h(m: np.ndarray) -> np.ndarray:
    """Conjugate transpose of each matrix."""
    return m.conj().swapaxes(-1, -2)


def _lower(s: np.ndarray) -> np.ndarray:
    """Hermitian matrix that the lower triangle stands for."""
    low, at = np.tril(s, -1), np.arange(s.shape[-1])
    full = low + _h(low)
    full[..., at, at] = s[..., at, at].real
    return full


def _working(s: np.ndarray, squared: bool) -> np.ndarray:
    """Whether each beam has any non-zero visibility, per matrix."""
    eps = np.finfo(float).eps
    on = np.abs(s) ** 2 > eps if squared else (np.abs(s.real) >= eps) | (np.abs(s.imag) >= eps)
    on = np.tril(on)
    return on.any(-1) | on.any(-2)


def _by_working(s: np.ndarray, squared: bool):
    """Matrices that have as many working beams at a time: their places, their working beams, and what is left of them."""
    on = _working(s, squared)
    count = on.sum(1)
    for k in np.unique(count[count > 0]):
        at = np.flatnonzero(count == k)
        beams = np.nonzero(on[at])[1].reshape(-1, k)
        yield at, beams, _lower(s[at[:, None, None], beams[:, :, None], beams[:, None, :]])


def visibility_scale(s: np.ndarray) -> np.ndarray:
    """1 / number of non-zero visibilities, those off the diagonal counting twice; 0 if none.  One per matrix."""
    on = np.abs(s) ** 2 > np.finfo(float).eps
    n = np.diagonal(on, axis1=-2, axis2=-1).sum(-1) + 2 * np.tril(on, -1).sum((-1, -2))
    return np.where(n > 0, 1 / np.maximum(n, 1), 0.0)


def eigh_gram(wl: float | np.ndarray, s: np.ndarray, w: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Generalised eigenpairs of S v = d G v on the working beams, back-projected by W.

    Eigenvalues ascend and are padded with zeros, as are the vectors' columns.  A stack of matrices gives
    stacks; wavelengths, weights and positions are then one for all or a stack too.
    """
    if s.ndim == 2:
        return tuple(x[0] for x in eigh_gram(wl, s[None], w, xyz))
    beams = s.shape[-1]
    d, v = np.zeros(s.shape[:2]), np.zeros((len(s), w.shape[-2], beams), complex)
    g = gram(xyz, w, wl)
    for at, on, sub in _by_working(s, True):
        inv = _whitening(g if g.ndim == 2 else g[at], on)
        dk, y = np.linalg.eigh(inv @ sub @ _h(inv))
        d[at, : on.shape[1]] = dk
        v[at, :, : on.shape[1]] = _columns(w if w.ndim == 2 else w[at], on) @ (_h(inv) @ y)
    return v, d, visibility_scale(s)


def _columns(w: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Columns ``on`` of one matrix, or of each of a stack."""
    return np.moveaxis(w[:, on], 0, 1) if w.ndim == 2 else np.take_along_axis(w, on[:, None, :], 2)


def _whitening(g: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Inverse Cholesky factors of the Gram matrix of each row's beams; of one for all once per set of beams."""
    try:
        if g.ndim == 2:
            sets, which = np.unique(on, axis=0, return_inverse=True)
            low = np.linalg.cholesky(_lower(g[sets[:, :, None], sets[:, None, :]]))
            return np.linalg.inv(low)[which.ravel()]
        n = np.arange(len(g))[:, None, None]
        return np.linalg.inv(np.linalg.cholesky(_lower(g[n, on[:, :, None], on[:, None, :]])))
    except np.linalg.LinAlgError as e:
        raise EigensolverError("the Gram matrix is not positive definite") from e


def eigh(wl: float, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without a Gram matrix; the wavelength has no part in it."""
    if s.ndim == 2:
        return tuple(x[0] for x in eigh(wl, s[None], w))
    beams = s.shape[-1]
    d, v = np.zeros(s.shape[:2]), np.zeros((len(s), w.shape[-2], beams), complex)
    for at, on, sub in _by_working(s, False):
        dk, y = np.linalg.eigh(sub)
        d[at, : on.shape[1]] = dk
        v[at, :, : on.shape[1]] = _columns(w if w.ndim == 2 else w[at], on) @ y
    return v, d, visibility_scale(s)


def eigh_psd(a: np.ndarray, b: np.ndarray | None = None, tau: float = 1.0, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Descending positive eigenpairs up to the energy ratio tau, cut or padded to n.

    A stack of matrices gives stacks, padded to n or else to the matrices' size.
    """
    if not 0 < tau <= 1:
        raise ValueError("tau must be in (0, 1]")
    a = np.asarray(a, complex)
    stack = a if a.ndim == 3 else a[None]
    if b is None:
        d, v = np.linalg.eigh(stack)
    else:
        inv = np.linalg.inv(np.linalg.cholesky(b))
        d, y = np.linalg.eigh(inv @ stack @ _h(inv))
        v = _h(inv) @ y
    size = d.shape[1]
    d, v = d[:, ::-1], v[:, :, ::-1]
    least = np.maximum(1e-12, np.finfo(float).eps * size * np.abs(d).max(1, initial=0))
    d = np.where(d > least[:, None], d, 0.0)  # those kept come first, as they fall
    total = d.sum(1, keepdims=True)
    on = (d > 0) & (np.cumsum(d, 1) / np.where(total > 0, total, 1.0) <= tau + 1e-12)
    d, v = np.where(on, d, 0.0), np.where(on[:, None, :], v, 0)
    if a.ndim == 2 and n is None:
        k = int(on.sum())
        return d[0, :k], v[0, :, :k]
    if n is not None:
        k = min(n, size)
        dn, vn = np.zeros((len(d), n)), np.zeros((len(d), size, n), complex)
        dn[:, :k], vn[:, :, :k] = d[:, :k], v[:, :, :k]
        d, v = dn, vn
    return (d, v) if a.ndim == 3 else (d[0], v[0])


def virtual_vis(v: np.ndarray, d: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """V diag(scale d) V^H; zero eigenvalues are left out."""
    on = d != 0
    return (v[:, on] * (scale * d[on])) @ v[:, on].conj().T


def direct_sum(vis: np.ndarray, uvw: np.ndarray, lmn: np.ndarray) -> np.ndarray:
    """Real part of the sum over baselines of vis exp(i uvw.lmn), per pixel."""
    phase = lmn @ uvw.T
    return np.cos(phase) @ vis.real - np.sin(phase) @ vis.imag


def factorised(v: np.ndarray, d: np.ndarray, pos: np.ndarray, lmn: np.ndarray) -> np.ndarray:
    """The same for uvw_ij = pos_i - pos_j and any number of filters: ``d`` is (images, E), the result (images, P)."""
    phase = lmn @ pos.T
    e = np.empty(phase.shape, np.result_type(phase, 1j))
    e.real, e.imag = np.cos(phase), np.sin(phase)  # vectorised in either precision, as a complex exponential isn't
    a = e @ v.astype(e.dtype)
    return d.astype(phase.dtype) @ (a.real**2 + a.imag**2).T


def separable(uvw: np.ndarray, n: int, tol: float = 1e-4) -> np.ndarray | None:
    """Positions with uvw_ij = pos_i - pos_j (pos_0 = 0), or None; uvw in order k = j n + i."""
    m = uvw.reshape(n, n, 3)  # [j, i]
    pos = m[0] - m[0, 0]
    want = pos[None, :, :] - pos[:, None, :]
    size = max(1.0, float(np.abs(uvw).max(initial=0)))
    return pos if np.abs(want - m).max(initial=0) <= tol * size else None


def steering(xyz: np.ndarray, directions: np.ndarray, wl: float) -> np.ndarray:
    """exp(-i 2 pi / wl XYZ^T R) for (3, A) positions and (3, P) directions."""
    if wl <= 0:
        raise ValueError("wavelength must be positive")
    return np.exp((-2j * math.pi / wl) * (xyz.T @ directions))


class Wishart:
    """Samples of the Wishart distribution with scale V and n degrees of freedom (real Bartlett factor)."""

    def __init__(self, v: np.ndarray, n: int, rng: np.random.Generator):
        v = np.asarray(v)
        if v.ndim != 2 or v.shape[0] != v.shape[1] or not np.allclose(v, v.conj().T):
            raise ValueError("V must be Hermitian")
        if n <= v.shape[0]:
            raise ValueError("n must exceed the dimension")
        q, r = np.linalg.eigh(v)
        self.low = r * np.sqrt(np.maximum(q, 0))
        self.n, self.p, self.rng = n, v.shape[0], rng

    def __call__(self, samples: int = 1) -> np.ndarray:
        if samples < 1:
            raise ValueError("at least one sample")
        a = np.zeros((samples, self.p, self.p))
        i = np.arange(self.p)
        a[:, i, i] = np.sqrt(self.rng.chisquare(self.n - i, (samples, self.p)))
        lo = np.tril_indices(self.p, -1)
        a[:, lo[0], lo[1]] = self.rng.standard_normal((samples, len(lo[0])))
        x = self.low @ a
        return x @ x.conj().transpose(0, 2, 1)


def synthetic_visibility(xyz: np.ndarray, w: np.ndarray, wl: float, src: np.ndarray, intensity: np.ndarray, snr_db: float, duration: float, rate: float, rng: np.random.Generator | None) -> np.ndarray:
    """Covariance of sky and noise; a Wishart draw over int(T fs) + 1 samples if ``rng`` is given."""
    a = np.exp((2j * math.pi / wl) * (src @ xyz.T))
    sky = (w.conj().T @ (a.conj().T * intensity)) @ (a @ w)
    noise = intensity.sum() / (2 * 10 ** (snr_db / 10))
    cov = sky + noise * (w.conj().T @ w)
    if rng is None:
        return cov
    n = int(duration * rate) + 1
    return Wishart(cov, n, rng)()[0] / n
