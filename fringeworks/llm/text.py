"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffers of an Arrow batch, so a whole
batch is handled by a few NumPy passes and no Python string is made per word.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes; ASCII and
Latin-1 capitals are folded.  A word never spans two documents.  Null texts
behave as empty ones and are reported by the validity mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _fold_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalnum():
            t[b] = ord(c.lower()) if b < 0x80 else b
    return t


FOLD = _fold_table()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows, from 0) and validity of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not any(is_(column.type) for is_ in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0], valid


def slices(batches, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has about ``size`` text bytes, one row at least.

    Bounds a worker's memory whatever the rows' lengths; every row appears once.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets, _ = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes folded to lower case, separators as 0."""
    f = FOLD[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        if len(lead):
            up = lead[(data[lead] >= 0x80) & (data[lead] < 0x9F)]
            f[up] |= 0x20
    return f


def spans(f: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first word index per document (``len(offsets)`` entries)."""
    n = len(f)
    w = f != 0
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = w[1:] != w[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    inside = w[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    return starts, ends, np.searchsorted(starts, offsets, side="left")


_rng = np.random.default_rng(0x5EED)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]), dtype=np.uint64)
            _INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64)
    return _POW, _INV


def hashes(f: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """64-bit polynomial hash of each span ``f[s:e]``; spans are sorted and don't overlap.

    Runs over blocks cut between spans, so the memory taken doesn't depend on a text's length.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")), at + 1)
        lo, hi = int(starts[at]), int(ends[to - 1])
        pw, inv = powers(hi - lo + 1)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[f[lo:hi]] * pw[: hi - lo], out=s[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (s[b] - s[a]) * inv[a]
        at = to
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low and high bits."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * BASE
    return h ^ (h >> np.uint64(32))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within documents, and the first index per document.

    A document of fewer than k words, but at least one, has one shingle of all its words.
    """
    n = len(h)
    counts = np.diff(first)
    acc = np.zeros(n, np.uint64)
    left = np.repeat(first[1:], counts) - np.arange(n)
    for j in range(k):
        live = left > j
        nxt = np.zeros(n, np.uint64)
        nxt[: n - j] = h[j:]
        acc = np.where(live, acc * BASE + nxt, acc)
    keep = (left >= k) | (np.arange(n) == np.repeat(first[:-1], counts)) & (np.repeat(counts, counts) < k)
    acc = mixed(acc[keep])
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return acc, np.concatenate([[0], np.cumsum(per)])


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows per document; empty documents have 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.int64 if values.dtype.kind in "iub" else values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=out.dtype)
    return out


def free_name(df, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
