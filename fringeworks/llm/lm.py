"""Language-model scores from a log-bilinear model trained with noise contrast.

Tokens are the BPE ids of ``bpe``; the context is the three tokens before, within
the text.  The model predicts a vector from the context's tokens, each turned by
the matrix of its place.  A token's probability is that of its class times that of
the token within the class, each from products of the predicted vector with the
classes' or tokens' own vectors plus biases, so both are normalised exactly over a
few hundred products in place of the whole vocabulary's.  Classes are ranges of
the tokens ordered by their number in the corpus, cut so that the products expected
for a token are few; every token of the vocabulary is in one, seen or not.

Training sees every position of every text, once a round: a task goes through its
texts in chunks, counts the chunk's 4-grams and visits each distinct one, weighted
by its count, by noise-contrastive estimation at both levels (noise is drawn from
the corpus's own frequencies of classes, and of tokens within the class; Adagrad).
The tasks' parameters are averaged row by row, each weighted by the positions that
touched it, round by round.  Texts are encoded once, to a written table.

Scoring multiplies the vectors of all distinct contexts of a chunk with the classes
at once, and with the tokens of each class in turn.

Defined results: a null text has null scores; an empty one has no tokens, log-
probability 0 and null mean and perplexity.  Every row is scored alone, so
repeated rows score alike, though each counts in training; a text of any length is
scored whole.  Tokens of equal number are ordered by id.  Without any text the
tokens are equally likely within a class, and the result is empty for an empty
table.  ``doc_id`` must be castable to bigint; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import text as X
from .workspace import Workspace, documents

ORDER, WIDTH = 3, 16
MASK = np.uint64((1 << WIDTH) - 1)


@dataclass(frozen=True)
class Params:
    dim: int = 32
    noise: int = 16
    rounds: int = 2
    batch: int = 16384
    rate: float = 0.1
    chunk: int = 2_000_000  # tokens that a task holds at once
    seed: int = 5
    bpe: bpe.Params = field(default_factory=bpe.Params)


class Layout:
    """Tokens by falling number (their rank), classes as ranges of ranks, and the frequencies of both."""

    def __init__(self, counts: np.ndarray):
        f = counts + 0.5
        self.size = len(f)
        if self.size >= 1 << WIDTH:
            raise ValueError("ids must be below 65,535")
        self.token = np.lexsort((np.arange(self.size), -f))
        self.rank = np.empty(self.size, np.uint16)
        self.rank[self.token] = np.arange(self.size)
        p = f[self.token] / f.sum()
        self.starts = self._cut(p)
        n = np.diff(self.starts)
        self.classes = len(n)
        self.of = np.repeat(np.arange(self.classes, dtype=np.uint16), n)
        self.class_p = np.add.reduceat(p, self.starts[:-1])
        self.word_p = p / np.repeat(self.class_p, n)
        self.class_cum = np.cumsum(self.class_p)
        self.word_cum = np.cumsum(self.word_p)  # falls back to whole numbers at the classes' ends

    @staticmethod
    def _cut(p: np.ndarray) -> np.ndarray:
        """First ranks of the classes, and the end: mass times size is at most a bound, the best of some."""
        cum = np.concatenate([[0.0], np.cumsum(p)])

        def cut(bound: float) -> np.ndarray:
            at, out = 0, [0]
            while at < len(p):
                lo, hi = at + 1, len(p)
                while lo < hi:  # mass times size grows with the end
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if (cum[mid] - cum[at]) * (mid - at) <= bound else (lo, mid - 1)
                at = lo
                out.append(at)
            return np.array(out)

        def cost(s: np.ndarray) -> float:
            return len(s) + float(((cum[s[1:]] - cum[s[:-1]]) * np.diff(s)).sum())

        return min((cut(b) for b in np.geomspace(0.05, 50, 25)), key=cost)


class Model:
    """One matrix: a row per context token (and one for the text's start), the places' matrices, a row per token and per class.

    The last column holds the biases.
    """

    def __init__(self, m: np.ndarray, size: int, dim: int):
        self.m, self.dim = m, dim
        a, b, c = size + 1, size + 1 + ORDER * dim, 2 * size + 1 + ORDER * dim
        self.at = (0, a, b, c)
        self.r, self.q, self.s = m[:a, :dim], m[b:c], m[c:]
        self.c = m[a:b, :dim].reshape(ORDER, dim, dim)

    @classmethod
    def start(cls, p: Params, lay: Layout) -> Model:
        g, d, n = np.random.default_rng(p.seed), p.dim, lay.size
        m = np.zeros((2 * n + 1 + ORDER * d + lay.classes, d + 1), np.float32)
        out = cls(m, n, d)
        out.r[:] = g.normal(0, 0.3, (n + 1, d))
        out.c[:] = [np.eye(d) * 0.5 + g.normal(0, 0.02, (d, d)) for _ in range(ORDER)]
        out.q[:, :d], out.q[:, d] = g.normal(0, 0.1, (n, d)), np.log(lay.word_p)
        out.s[:, :d], out.s[:, d] = g.normal(0, 0.1, (lay.classes, d)), np.log(lay.class_p)
        return out

    def turned(self) -> np.ndarray:
        """Every token's vector at each place of the context."""
        return np.stack([self.r @ c for c in self.c])


def log_probability(e: np.ndarray, at: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Of each of ``rows`` (all), the log-probability of column ``at`` under the row's softmax; ``e`` is overwritten."""
    n, k = e.shape
    hit = e.ravel().take(at + (np.arange(0, n * k, k) if rows is None else rows * k))
    if n and (e.max() > _SAFE or e.min() < -_SAFE):  # exp would leave the range of floats
        top = e.max(1)
        e -= top[:, None]
    else:
        top = 0
    np.exp(e, out=e)
    norm = top + np.log(e @ np.ones(k, np.float32))
    return hit - (norm if rows is None else norm.take(rows))


def grams(ranks: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
    """For each token the packed three before it (nearest lowest; ``start`` before the text) and, lowest, itself."""
    n = len(ranks)
    w = ranks.astype(np.uint64)
    out = w.copy()
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER + 1):
        prev = np.full(n, start, np.uint64)
        prev[k:] = w[: n - k]
        prev[place < k] = start
        out |= prev << np.uint64(WIDTH * k)
    return out


def context(g: np.ndarray, k: int) -> np.ndarray:
    """The k-th token before."""
    return (g >> np.uint64(WIDTH * k) & MASK).astype(np.int64)


def grouped(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal 4-grams, and those of a context, together; the 4-gram of each run, and how long it is.

    Parts of hashes with the places behind them are sorted, which takes far less than sorting indirectly.
    Where hashes meet by chance runs are cut, so that a 4-gram may have several.
    """
    n = len(g)
    bits = max(n - 1, 1).bit_length()
    half = np.uint64(0xFFFFFFFF)
    key = X.mixed(g >> np.uint64(WIDTH)) & ~half | (g & MASK) << np.uint64(bits) & half | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    some = g.take(order)
    first = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), some[1:] != some[:-1]]))
    return order, some.take(first), np.diff(np.append(first, n))


_CELLS = 150_000  # of a block of products, so that it stays in a core's cache
_BLOCK = 65_536  # 4-grams whose contexts' vectors are made together
_SAFE = 60.0  # logits whose exponentials, and sums of 65,535 of them, are normal floats


def scores(model: Model, turned: np.ndarray, lay: Layout, g: np.ndarray) -> np.ndarray:
    """Log-probabilities of 4-grams, those of a context together, normalised over classes and within them."""
    parts = [np.ascontiguousarray(model.q[a:b].T) if b - a > 1 else None for a, b in zip(lay.starts[:-1].tolist(), lay.starts[1:].tolist(), strict=True)]
    out = [_block_scores(model, turned, lay, parts, g[a : a + _BLOCK]) for a in range(0, len(g), _BLOCK)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _block_scores(model: Model, turned: np.ndarray, lay: Layout, parts: list[np.ndarray | None], g: np.ndarray) -> np.ndarray:
    d = model.dim
    target = (g & MASK).astype(np.int64)
    ctx = g >> np.uint64(WIDTH)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(g)]])))
    cls = lay.of.take(target)
    h = np.ones((len(first), d + 1), np.float32)  # with a one for the bias
    some = g.take(first)
    for a in range(0, len(first), 4096):
        v = turned[0].take(context(some[a : a + 4096], 1), 0)
        for k in range(2, ORDER + 1):
            v += turned[k - 1].take(context(some[a : a + 4096], k), 0)
        h[a : a + 4096, :d] = v
    out = np.empty(len(g), np.float32)
    step = max(1, _CELLS // lay.classes)
    for a in range(0, len(g), step):
        # grams of a context follow each other: its products are made once a block
        lo, hi = owner[a], owner[min(a + step, len(g)) - 1] + 1
        out[a : a + step] = log_probability(h[lo:hi] @ model.s.T, cls[a : a + step].astype(np.int64), owner[a : a + step] - lo)
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls.take(order), np.arange(lay.classes + 1)).tolist()
    for c, q in enumerate(parts):
        if q is None:
            continue
        step = max(1, _CELLS // q.shape[1])
        for a in range(edge[c], edge[c + 1], step):
            rows = order[a : min(a + step, edge[c + 1])]
            out[rows] += log_probability(h.take(owner.take(rows), 0) @ q, target.take(rows) - lay.starts[c])
    return out


# -- training


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The values' sums by row."""
    d = values.shape[1]
    if d % 2 or values.dtype != np.float32:
        wide = np.zeros((len(values), d + d % 2), np.float32)
        wide[:, :d] = values
        return _summed(rows, wide, size)[:, :d]
    return _summed_each([rows], values, size)[0]


def _summed_each(rows: list[np.ndarray], values: np.ndarray, size: int) -> np.ndarray:
    """The values' sums by each of some rows: flat, as that is fast, two columns at a time (as parts of complex numbers), and a cacheful at a time."""
    k = values.shape[1] // 2
    pairs = np.ascontiguousarray(values).view(np.complex64)
    out = np.zeros((len(rows), size * k), np.complex64)
    cells = np.arange(size * k).reshape(size, k)  # looked up, as that takes less than making them for each value
    for a in range(0, len(pairs), 1024):
        some = pairs[a : a + 1024].ravel()
        for x, to in zip(rows, out, strict=True):
            np.add.at(to, cells.take(x[a : a + 1024], 0).ravel(), some)
    return out.view(np.float32).reshape(len(rows), size, 2 * k)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)  # beyond the range of floats this is 0 or 1
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """A task's parameters, their Adagrad sums, and the positions that touched each row."""

    def __init__(self, m: np.ndarray, lay: Layout, p: Params, seed: int, rate: float):
        self.model, self.lay, self.p, self.rate = Model(m.copy(), lay.size, p.dim), lay, p, rate
        self.sum = Model(np.full_like(m, 1e-8), lay.size, p.dim)
        self.touched = np.zeros(len(m))
        self.rng = np.random.default_rng(seed)
        self.class_noise, self.word_noise = np.log(p.noise * lay.class_p).astype(np.float32), np.log(p.noise * lay.word_p).astype(np.float32)

    def _step(self, x: np.ndarray, s: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        new = s[rows] + g * g
        s[rows] = new
        x[rows] -= self.rate * g / np.sqrt(new)

    def chunk(self, g: np.ndarray) -> None:
        """Visit the distinct 4-grams of a chunk once, in a random order, by their counts."""
        g, n = np.unique(g, return_counts=True)
        times = sum(np.bincount(context(g, k), n, self.lay.size + 1) for k in range(1, ORDER + 1))
        self.touched[: self.lay.size + 1] += times
        used = np.flatnonzero(times)
        local = np.zeros(self.lay.size + 1, np.int64)
        local[used] = np.arange(len(used))
        r, rs = self.model.r[used], self.sum.r[used]
        _, a, b, c = self.model.at
        self.touched[a:b] += n.sum()
        target = (g & MASK).astype(np.int64)
        times = np.bincount(target, n, self.lay.size)
        self.touched[b:c] += times
        self.touched[c:] += np.add.reduceat(times, self.lay.starts[:-1])
        order = self.rng.permutation(len(g))
        with np.errstate(over="ignore"):
            for i in range(0, len(g), self.p.batch):
                at = order[i : i + self.p.batch]
                self._batch(g.take(at), n.take(at), local, r, rs)
        self.model.r[used], self.sum.r[used] = r, rs

    def _batch(self, g: np.ndarray, n: np.ndarray, local: np.ndarray, r: np.ndarray, rs: np.ndarray) -> None:
        m, lay, k, d = self.model, self.lay, self.p.noise, self.p.dim
        target = (g & MASK).astype(np.int64)
        order = np.argsort(lay.of.take(target), kind="stable")
        g, target = g.take(order), target.take(order)
        cls = lay.of.take(target)
        w = (n.take(order) / n.sum()).astype(np.float32)
        ctx = [local.take(context(g, j)) for j in range(1, ORDER + 1)]
        turned = [r @ c for c in m.c]
        h = np.ones((len(g), d + 1), np.float32)  # with a one for the bias
        for a in range(0, len(g), 1024):  # a cacheful at a time
            i = slice(a, a + 1024)
            v = turned[0].take(ctx[0][i], 0)
            for u, x in zip(turned[1:], ctx[1:], strict=True):
                v += u.take(x[i], 0)
            h[i, :d] = v
        # noise of classes is shared by the batch, that of tokens by the class's examples
        common = np.minimum(np.searchsorted(lay.class_cum, self.rng.random(k)), lay.classes - 1)
        first, last = lay.starts[:-1, None], lay.starts[1:, None]
        noise = np.clip(np.searchsorted(lay.word_cum, np.arange(lay.classes)[:, None] + self.rng.random((lay.classes, k))), first, last - 1)
        shared = m.s.take(common, 0)
        shared[:, d] -= self.class_noise.take(common)
        dh, dn, ds = np.empty((len(g), d), np.float32), np.zeros((k, d + 1), np.float32), np.zeros_like(m.s)
        rows, grads = [], []
        edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            c, x, wx, t = int(cls[lo]), h[lo:hi], w[lo:hi], target[lo:hi]
            first, last = int(lay.starts[c]), int(lay.starts[c + 1])
            # looked at by all examples: their class, the noise of classes, and tokens: a small class's together, else the noise
            small = last - first <= 4 * k
            drawn = noise[c] if not small else np.arange(first, last) if last - first > 1 else noise[c, :0]
            v = np.concatenate([m.s[c : c + 1], shared, m.q.take(drawn, 0)])
            v[0, d] -= self.class_noise[c]
            v[k + 1 :, d] -= self.word_noise.take(drawn)
            z = _sigmoid(v @ x.T)  # a row for each of what is looked at, so that rows are long
            z[0] -= 1
            if small and len(drawn):
                flat = (t - (first - k - 1)) * (hi - lo) + np.arange(hi - lo)
                hit = z.ravel().take(flat) - 1
                z[k + 1 :] *= np.bincount(noise[c] - first, minlength=last - first).astype(np.float32)[:, None]
                z.ravel()[flat] += hit
            z *= wx
            np.matmul(z.T, v[:, :d], out=dh[lo:hi])
            dv = z @ x
            ds[c] += dv[0]
            dn += dv[1 : k + 1]
            if small and len(drawn):
                self._step(m.q, self.sum.q, dv[k + 1 :], slice(first, last))
            elif not small:
                q = m.q.take(t, 0)
                zq = ((_sigmoid(np.einsum("ij,ij->i", x, q) - self.word_noise.take(t)) - 1) * wx)[:, None]
                q *= zq
                dh[lo:hi] += q[:, :d]
                rows += [t, drawn]
                grads += [zq * x, dv[k + 1 :]]
        np.add.at(ds, common, dn)
        # contexts: through the matrix of each place
        dr, dc = np.zeros_like(r), np.empty((ORDER, d, d), np.float32)
        for j, s in enumerate(_summed_each(ctx, dh, len(r))):
            dc[j] = r.T @ s
            dr += s @ m.c[j].T
        self._step(r, rs, dr)
        self._step(m.c, self.sum.c, dc)
        self._step(m.s, self.sum.s, ds)
        if rows:
            at, place = np.unique(np.concatenate(rows), return_inverse=True)
            self._step(m.q, self.sum.q, _summed(place, np.concatenate(grads), len(at)), at)


# -- Spark


def _token_rows(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(p.bpe)
        for b in X.slices(batches, "text", p.bpe.slice_bytes):
            data, offsets, valid = X.utf8(b.column(1))
            ids, at = enc.encode(data, offsets)
            ids = ids.astype(np.uint16)
            parts = [bpe.blob(ids[i:j]) if ok else None for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], ["doc_id", "ids"])

    return run


def tokenised(ws: Workspace, docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, ids``, written: every row's ids; null for a null text."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ws.write(src.mapInArrow(_token_rows(p), "doc_id bigint, ids binary"), "tokens")


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``most`` tokens, at least one, their ids end to end, and each row's first."""
    rows: list[pa.RecordBatch] = []
    held: list[np.ndarray] = []
    total = 0
    for batch in batches:
        begin = 0
        for i, x in enumerate(batch.column(column)):
            held.append(bpe.unblob(x.as_py()) if x.is_valid else np.zeros(0, np.uint16))
            total += len(held[-1])
            if total >= most:
                rows.append(batch.slice(begin, i + 1 - begin))
                yield _joined(rows, held)
                rows, held, total, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if rows:
        yield _joined(rows, held)


def _joined(rows: list[pa.RecordBatch], held: list[np.ndarray]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    return whole, np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])


def _count_rows(size: int, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, ids, _ in _chunks(batches, 0, p.chunk):
            total += np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["token", "n"])

    return run


def _trained_rows(m: np.ndarray, lay: Layout, p: Params, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        t = Trainer(m, lay, p, p.seed + (task.partitionId() if task else 0), rate)
        for _, ids, at in _chunks(batches, 0, p.chunk):
            if len(ids):
                t.chunk(grams(lay.rank[ids], at, lay.size))
        rows = np.flatnonzero(t.touched)
        for i in range(0, len(rows), 20_000):
            some = rows[i : i + 20_000]
            flat = pa.array(t.model.m[some].ravel())
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (p.dim + 1)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(t.touched[some]), x], ["row", "w", "x"])

    return run


def fit(ws: Workspace, docs: DataFrame, p: Params = Params()) -> tuple[Model, Layout, DataFrame, int]:
    """The model, its layout, the written tokens, and how many there are."""
    table = tokenised(ws, docs, p)
    size = bpe.vocabulary(p.bpe.vocabulary).size
    counted = table.select("ids").mapInArrow(_count_rows(size, p), "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # a row per token of the vocabulary
    counts = np.zeros(size)
    counts[counted.column("token").to_numpy()] = counted.column("n").to_numpy()
    lay = Layout(counts)
    model = Model.start(p, lay)
    if not counts.any():
        return Model(np.zeros_like(model.m), size, p.dim), lay, table, 0
    for k in range(p.rounds):
        got = table.select("ids").mapInArrow(_trained_rows(model.m, lay, p, p.rate / (1 + k)), "row int, w double, x array<float>")
        # each row's weighted mean is taken by the cluster; as many rows as the model has come back
        mean = got.groupBy("row").agg(F.array(*(F.sum(F.col("w") * F.col("x")[i]) / F.sum("w") for i in range(p.dim + 1))).cast("array<float>").alias("x")).toArrow()
        m = model.m.copy()
        if mean.num_rows:
            m[mean.column("row").to_numpy()] = mean.column("x").combine_chunks().values.to_numpy().reshape(-1, p.dim + 1)
        model = Model(m, size, p.dim)
    return model, lay, table, int(counts.sum())


def _scores(m: np.ndarray, lay: Layout, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(m, lay.size, p.dim)
        turned = model.turned()
        for rows, ids, at in _chunks(batches, 1, p.chunk):
            valid = rows.column(1).is_valid().to_numpy(zero_copy_only=False)
            n = np.diff(at)
            total = np.zeros(len(n))
            if len(ids):
                order, g, times = grouped(grams(lay.rank[ids], at, lay.size))
                each = np.empty(len(ids))
                each[order] = scores(model, turned, lay, g).repeat(times)
                total = X.per_doc_sum(each, at)
            none, empty = ~valid, ~valid | (n == 0)
            mean = total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, mask=none), pa.array(total, mask=none), pa.array(mean, mask=empty), pa.array(np.exp(-mean), mask=empty)],
                ["doc_id", "n_tokens", "logprob", "mean_logprob", "perplexity"],
            )

    return run


def scored(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, n_tokens, logprob, mean_logprob, perplexity`` for every row."""
    model, lay, table, _ = fit(Workspace(docs.sparkSession, "lm"), docs, p)
    return table.mapInArrow(_scores(model.m, lay, p), "doc_id bigint, n_tokens bigint, logprob double, mean_logprob double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir, "doc_id", "text"))
