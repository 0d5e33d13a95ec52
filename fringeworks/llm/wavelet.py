"""Token ids as wavelet matrices: one succinct, compressed file per shard.

A shard holds the documents of a stretch of input, end to end.  Level by level,
from the highest bit of the ids down, the matrix stores one bit per token and
moves tokens with a 0 before those with a 1.  With counts of ones before every
block of 512 bits, ``rank`` costs a table look-up and a few popcounts and
``select`` a binary search, so access, counting and occurrence look-up need only
the file itself.

A shard's tokens are first numbered by falling frequency, so high planes are
almost empty.  A plane takes the smallest of three forms: plain bits; the places
of its few ones (or zeros); or blocks of 63 bits coded by their number of ones and
their index among all blocks of as many ones, which nears the plane's entropy and
still gives rank by adding at most 16 block classes and decoding one block.

File layout (little endian): magic, levels, tokens n, documents m, symbols, size of
the table; the deflated table (doc ids, token offsets, null flags, symbols by
frequency); then per level its zeros, its form (0 or 1: places of zeros or ones,
2: plain, 3: coded), and the form's three arrays.

Defined results: a null text is a document without tokens that is flagged null;
an empty one has none and isn't flagged.  Repeated rows are stored repeatedly;
a null ``doc_id`` is kept (the value is stored with a flag).  An empty table has
no shards.  Shards follow the input's partitions: a shard ends when it holds
``shard_tokens`` tokens or its partition ends, and every row lies in exactly one; a text
of any length lies whole in one shard.  Tokens of equal frequency are numbered by id.  Other
columns aren't looked at; ``doc_id`` must be castable to bigint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .bpe import encoder, vocabulary
from .bpe import Params as BpeParams
from .workspace import documents

MAGIC = 0x314D5457
BLOCK = 512


@dataclass(frozen=True)
class Params:
    shard_tokens: int = 4_000_000
    bpe: BpeParams = field(default_factory=BpeParams)


WIDE, GROUP = 63, 16
CHOOSE = np.zeros((WIDE + 1, WIDE + 2), np.uint64)
for _n in range(WIDE + 1):
    CHOOSE[_n, 0] = 1
    for _k in range(1, _n + 1):
        CHOOSE[_n, _k] = CHOOSE[_n - 1, _k - 1] + CHOOSE[_n - 1, _k]
WIDTH = np.array([(int(CHOOSE[WIDE, k]) - 1).bit_length() for k in range(WIDE + 1)], np.int64)


def _index(words: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Each 63-bit word's index among those with as many ones."""
    k = ones.astype(np.int64)
    out = np.zeros(len(words), np.uint64)
    for pos in range(WIDE - 1, -1, -1):
        on = (words >> np.uint64(pos) & np.uint64(1)).astype(bool)
        out += np.where(on, CHOOSE[pos][k], np.uint64(0))
        k -= on
    return out


def _word(index: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The inverse of ``_index``."""
    k, rest = ones.astype(np.int64), index.copy()
    out = np.zeros(len(index), np.uint64)
    for pos in range(WIDE - 1, -1, -1):
        c = CHOOSE[pos][k]
        on = (k > 0) & (rest >= c)
        rest -= np.where(on, c, np.uint64(0))
        out |= on.astype(np.uint64) << np.uint64(pos)
        k -= on
    return out


class Plane:
    """A bit vector with rank and select; ``form`` 0 or 1: places of zeros or ones, 2: plain, 3: coded."""

    def __init__(self, n: int, zeros: int, form: int, counts: np.ndarray, words: np.ndarray, classes: np.ndarray):
        self.n, self.zeros, self.form, self.counts, self.words, self.classes = n, zeros, form, counts, words, classes

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        n = len(bits)
        ones = int(np.count_nonzero(bits))
        none, flat = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        if min(ones, n - ones) * 128 <= n:  # places take 32 bits each
            form = int(2 * ones <= n)
            return cls(n, n - ones, form, np.flatnonzero(bits if form else ~bits).astype(np.uint32), none, flat)
        share = ones / n
        entropy = -share * np.log2(share) - (1 - share) * np.log2(1 - share)
        if entropy < 0.8:
            return cls(n, n - ones, 3, *cls._coded(bits))
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-n // BLOCK) * (BLOCK // 64), np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        per = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        return cls(n, n - ones, 2, np.concatenate([[0], np.cumsum(per)]).astype(np.uint32), words, flat)

    @staticmethod
    def _coded(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = -(-len(bits) // WIDE)
        full = np.zeros((blocks, 64), np.uint8)
        flat = np.zeros(blocks * WIDE, np.uint8)
        flat[: len(bits)] = bits
        full[:, :WIDE] = flat.reshape(blocks, WIDE)
        words = np.packbits(full, axis=1, bitorder="little").view(np.uint64)[:, 0]
        ones = np.bitwise_count(words)
        width = WIDTH[ones]
        end = np.cumsum(width)
        at = end - width
        out = np.zeros(int(end[-1]) // 64 + 2, np.uint64)
        index, shift = _index(words, ones), (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, at >> 6, index << shift)
        np.bitwise_or.at(out, (at >> 6) + 1, np.where(shift > 0, index >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))
        classes = np.concatenate([ones, [0]]).astype(np.uint8)  # a last empty block, for positions at the end
        before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])[::GROUP]
        place = np.concatenate([[0], end])[::GROUP]
        return np.stack([before, place], 1).astype(np.uint32).ravel(), out, classes

    def _decoded(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before the position's block, and the block's word."""
        block = i // WIDE
        group = block // GROUP
        ones, at = self.counts[2 * group].astype(np.int64), self.counts[2 * group + 1].astype(np.int64)
        for k in range(GROUP - 1):
            b = group * GROUP + k
            c = np.where(b < block, self.classes[np.minimum(b, len(self.classes) - 1)], 0)
            ones += c
            at += np.where(b < block, WIDTH[c], 0)
        c = self.classes[block].astype(np.int64)
        shift = (at & 63).astype(np.uint64)
        raw = self.words[at >> 6] >> shift
        raw |= np.where(shift > 0, self.words[np.minimum((at >> 6) + 1, len(self.words) - 1)] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ones, _word(raw & ((np.uint64(1) << WIDTH[c].astype(np.uint64)) - np.uint64(1)), c)

    def get(self, i: np.ndarray) -> np.ndarray:
        if self.form < 2:
            at = np.minimum(np.searchsorted(self.counts, i), max(len(self.counts) - 1, 0))
            hit = self.counts[at] == i if len(self.counts) else np.zeros(np.shape(i), bool)
            return hit if self.form else ~hit
        if self.form == 3:
            return (self._decoded(i)[1] >> (i % WIDE).astype(np.uint64) & np.uint64(1)).astype(bool)
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i (0 <= i <= n)."""
        i = np.asarray(i, np.int64)
        if self.form < 2:
            r = np.searchsorted(self.counts, i)
            return r if self.form else i - r
        if self.form == 3:
            ones, word = self._decoded(i)
            return ones + np.bitwise_count(word & ((np.uint64(1) << (i % WIDE).astype(np.uint64)) - np.uint64(1)))
        block = i // BLOCK
        out = self.counts[block].astype(np.int64)
        for k in range(BLOCK // 64):
            at = block * (BLOCK // 64) + k
            bits = np.clip(i - at * 64, 0, 64)
            live = bits > 0
            word = self.words[np.minimum(at, len(self.words) - 1)]
            mask = np.where(bits >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            out += np.where(live, np.bitwise_count(word & mask), 0)
        return out

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        if self.form == int(one):
            return self.counts[k].astype(np.int64)
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            r = self.rank(np.minimum(mid + 1, self.n))
            r = r if one else np.minimum(mid + 1, self.n) - r
            right = (r <= k) & (lo < hi)
            lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, np.where(lo < hi, mid, hi))
        return lo


class WaveletMatrix:
    """Access, count and occurrences of tokens, and the documents they lie in."""

    def __init__(self, n: int, planes: list[Plane], symbols: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray, flags: np.ndarray):
        self.bits, self.n, self.planes = len(planes), n, planes
        self.symbols, self.doc_ids, self.offsets, self.flags = symbols, doc_ids, offsets, flags
        self._order = np.argsort(symbols)

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> WaveletMatrix:
        """``flags``: 1 for a null text, 2 for a null doc_id."""
        n = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
        symbols = np.argsort(-n, kind="stable")[: int(np.count_nonzero(n))]
        bits = max(1, (len(symbols) - 1).bit_length()) if len(symbols) else 1
        code = np.zeros(len(n), np.uint16 if bits <= 16 else np.uint32)
        code[symbols] = np.arange(len(symbols))
        x = code[ids]
        planes = []
        for b in range(bits - 1, -1, -1):
            one = (x >> x.dtype.type(b) & x.dtype.type(1)).astype(bool)
            plane = Plane.of(one)
            planes.append(plane)
            if 0 < plane.zeros < len(x):
                x = np.concatenate([x[~one], x[one]])
        return cls(len(ids), planes, symbols.astype(np.uint32), doc_ids.astype(np.int64), offsets.astype(np.int64), flags.astype(np.uint8))

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token, sorter=self._order))
        return int(self._order[k]) if k < len(self.symbols) and self.symbols[self._order[k]] == token else None

    def access(self, i) -> np.ndarray:
        """Tokens at the given positions."""
        at = np.atleast_1d(np.asarray(i, np.int64)).copy()
        out = np.zeros(len(at), np.int64)
        for p in self.planes:
            b = p.get(at)
            r = p.rank(at)
            out = out << 1 | b
            at = np.where(b, p.zeros + r, at - r)
        return self.symbols[out].astype(np.int64)

    def _range(self, code: int, a: int, b: int) -> tuple[int, int]:
        for k, p in enumerate(self.planes):
            ra, rb = (int(v) for v in p.rank(np.array([a, b])))
            a, b = (p.zeros + ra, p.zeros + rb) if code >> (self.bits - 1 - k) & 1 else (a - ra, b - rb)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences in positions a up to b."""
        code = self._code(token)
        if code is None:
            return 0
        lo, hi = self._range(code, a, self.n if b is None else b)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, ascending."""
        code = self._code(token)
        if code is None:
            return np.zeros(0, np.int64)
        lo, hi = self._range(code, 0, self.n)
        at = np.arange(lo, hi)
        for k in range(self.bits - 1, -1, -1):
            p = self.planes[k]
            if code >> (self.bits - 1 - k) & 1:
                at = p.select(at - p.zeros, True)
            else:
                at = p.select(at, False)
        return at

    def document(self, k: int) -> np.ndarray:
        """Tokens of the k-th document of the shard."""
        return self.access(np.arange(self.offsets[k], self.offsets[k + 1]))

    def tobytes(self) -> bytes:
        table = zlib.compress(b"".join(x.tobytes() for x in (self.doc_ids, self.offsets, self.flags, self.symbols)), 1)
        parts = [np.array([MAGIC, self.bits, self.n, len(self.doc_ids), len(self.symbols), len(table)], np.int64).tobytes(), table]
        for p in self.planes:
            parts += [np.array([p.zeros, p.form, len(p.counts), len(p.words), len(p.classes)], np.int64).tobytes(), p.counts.tobytes(), p.words.tobytes(), p.classes.tobytes()]
        return b"".join(parts)

    @classmethod
    def frombytes(cls, raw: bytes) -> WaveletMatrix:
        magic, bits, n, m, k, size = np.frombuffer(raw, np.int64, 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        table = zlib.decompress(raw[48 : 48 + size])
        at, planes = 48 + size, []
        for _ in range(bits):
            zeros, form, c, w, k8 = np.frombuffer(raw, np.int64, 5, at).tolist()
            at += 40
            planes.append(Plane(n, zeros, form, np.frombuffer(raw, np.uint32, c, at), np.frombuffer(raw, np.uint64, w, at + 4 * c), np.frombuffer(raw, np.uint8, k8, at + 4 * c + 8 * w)))
            at += 4 * c + 8 * w + k8
        tables = [np.frombuffer(table, t, c, o) for t, c, o in ((np.int64, m, 0), (np.int64, m + 1, 8 * m), (np.uint8, m, 16 * m + 8), (np.uint32, k, 17 * m + 8))]
        return cls(n, planes, tables[3], *tables[:3])


def _shards(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, kind = encoder(p.bpe), np.uint16 if vocabulary(p.bpe.vocabulary).size <= 1 << 16 else np.uint32
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 24
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = made = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, docs, flags, sizes, held, made
            n = np.concatenate(sizes)
            wm = WaveletMatrix.build(np.concatenate(ids), np.concatenate(docs), np.concatenate([[0], np.cumsum(n)]), np.concatenate(flags))
            out = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([wm.n], pa.int64()), pa.array([wm.bits], pa.int32()), pa.array([wm.tobytes()], pa.binary())], ["shard_id", "n_docs", "n_tokens", "bits", "payload"])
            ids, docs, flags, sizes, held, made = [], [], [], [], 0, made + 1
            return out

        for b in X.slices(batches, "text", p.bpe.slice_bytes):
            data, offsets, valid = X.utf8(b.column(1))
            token, at = enc.encode(data, offsets)
            key = b.column(0)
            ids.append(token.astype(kind))
            docs.append(key.fill_null(0).to_numpy())
            none = key.is_null().to_numpy(zero_copy_only=False)
            flags.append((~valid).astype(np.uint8) | none.astype(np.uint8) << 1)
            sizes.append(np.diff(at))
            held += len(token)
            if held >= p.shard_tokens:
                yield close()
        if sizes:
            yield close()

    return run


def shards(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``shard_id, n_docs, n_tokens, bits, payload``: the payload is the shard's whole file."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_shards(p), "shard_id bigint, n_docs bigint, n_tokens bigint, bits int, payload binary")


def write(made: DataFrame, path: str) -> DataFrame:
    """Write each shard of ``shards`` to ``path/<shard_id>.wm`` from the tasks; returns ``shard_id, file, size``.

    A file is written under its task's own name and then moved, so a lost executor leaves no half a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            files = []
            for k, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/.{k}-{attempt}") as f:
                    f.write(payload)
                fs.move(f"{root}/.{k}-{attempt}", f"{root}/{k}.wm")
                files.append((k, f"{path.rstrip('/')}/{k}.wm", len(payload)))
            ks, names, sizes = map(list, zip(*files, strict=True)) if files else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["shard_id", "file", "size"])

    return made.select("shard_id", "payload").mapInArrow(run, "shard_id bigint, file string, size bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir, "doc_id", "text"))
