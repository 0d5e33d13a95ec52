"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's frequent pieces (words with their leading space) are compiled into a
minimal acyclic automaton: common prefixes and suffixes share states, every edge
carries the number of words that sort before it, so a walk ends at the word's
number, which indexes its token ids.  The compiled arrays are one file in the
shared folder and are memory-mapped by the tasks.  Pieces that aren't in the
lexicon are merged exactly, many at a time, and remembered.

The lexicon only saves work: a piece's ids are the same from the automaton, from
memory or from merging.  Pieces are cut as by the vocabulary's pattern
(contractions, letters, digits, other signs, white space).

Defined results: a null text has null ids, an empty one has none; every row is
treated alone, a text of any length is encoded whole, and other columns aren't looked
at.  ``n_tokens`` of a null text is null.  ``roundtrip`` says that decoding gave the
text's bytes back.  An empty table gives no rows.  Ties can't arise: pieces of equal number
are compiled all or none.  ``doc_id`` must be castable to bigint.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .workspace import Workspace, documents

NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Params:
    """``lexicon``: pieces compiled at most; ``memory``: remembered pieces a task holds before it starts afresh."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    lexicon: int = 65536
    memory: int = 500_000
    slice_bytes: int = 2 << 20


# -- vocabulary


class Vocabulary:
    """Token bytes by id, and the id of every pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, i in ranks.items():
            tokens[i] = t
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]] << 20 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        key = np.array([p for p, _ in pairs], np.uint64)
        to = np.array([i for _, i in pairs], np.int32)
        # open addressing, as many probes as the longest chain
        self.bits = 20
        slots = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.slot_to = np.full(1 << self.bits, NONE)
        place = self._place(key)
        rest, self.probes = np.arange(len(key)), 0
        while len(rest):
            at = (place[rest] + np.uint64(self.probes)) & np.uint64((1 << self.bits) - 1)
            free = slots[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(rest), bool)
            win[first] = True
            win &= free
            slots[at[win]] = key[rest[win]]
            self.slot_to[at[win]] = to[rest[win]]
            rest = rest[~win]
            self.probes += 1
        self.slot_key = slots

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key * X.BASE) >> np.uint64(64 - self.bits)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token id of each concatenated pair, NONE where it's no token."""
        key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(key.shape, NONE)
        flat, res = key.ravel(), out.ravel()
        place = self._place(flat)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        for k in range(self.probes):
            if not len(todo):
                break
            at = (place[todo] + np.uint64(k)) & np.uint64((1 << self.bits) - 1)
            got = self.slot_key[at]
            hit = got == flat[todo]
            res[todo[hit]] = self.slot_to[at[hit]]
            todo = todo[~hit & (got != np.uint64(2**64 - 1))]
        return res.reshape(key.shape)

    # -- exact merging

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece of any length; a heap of pairs, lowest rank first, leftmost of equal ones."""
        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        toks, ranks = self.tokens, self.ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(toks[ids[i]] + toks[ids[i + 1]])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = r
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (q := ranks.get(toks[r] + toks[ids[nxt[j]]])) is not None:
                    heappush(heap, (q, i, r, ids[nxt[j]]))
            if prv[i] >= 0 and (q := ranks.get(toks[ids[prv[i]]] + toks[r])) is not None:
                heappush(heap, (q, prv[i], ids[prv[i]], r))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many pieces, end to end, and how many each has; equal lengths are merged together."""
        n = len(starts)
        size = ends - starts
        count = np.ones(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows, id matrix
        for bound, low in ((4, 0), (8, 4), (12, 8), (16, 12), (24, 16), (40, 24)):
            rows_all = np.flatnonzero((size > low) & (size <= bound))
            for at in range(0, len(rows_all), 32768):
                rows = rows_all[at : at + 32768]
                parts.append((rows, self._merge_block(data, starts[rows], size[rows], bound)))
        for rows, m in parts:
            count[rows] = (m >= 0).sum(1)
        long = {int(i): self.merge(data[starts[i] : ends[i]].tobytes()) for i in np.flatnonzero(size > 40)}
        for i, ids in long.items():
            count[i] = len(ids)
        off = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(off[-1], np.int32)
        for rows, m in parts:
            live = m >= 0
            out[np.repeat(off[rows], count[rows]) + np.nonzero(live)[1]] = m[live]
        for i, ids in long.items():
            out[off[i] : off[i + 1]] = ids
        return out, count

    def _merge_block(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        n = len(starts)
        col = np.arange(width)
        inside = col < size[:, None]
        m = np.where(inside, self.byte[data[np.minimum(starts[:, None] + col, len(data) - 1)]], -1).astype(np.int32)
        out = np.full((n, width), -1, np.int32)
        row = np.arange(n)
        rank = self.pair(m[:, :-1], m[:, 1:]) if width > 1 else np.full((n, 0), NONE)
        while len(m):
            best = rank.argmin(1)
            k = np.arange(len(m))
            top = rank[k, best]
            done = top == NONE
            if done.any():
                out[row[done], : m.shape[1]] = m[done]
                keep = ~done
                m, rank, row, best, top, k = m[keep], rank[keep], row[keep], best[keep], top[keep], np.arange(keep.sum())
                if not len(m):
                    break
            # put the merged token in place and close the gap behind it
            shift = col[: m.shape[1] - 1] > best[:, None]
            m = np.where(shift, m[:, 1:], m[:, :-1])
            m[k, best] = top
            if m.shape[1] == 1:
                rank = np.full((len(m), 0), NONE)
                out[row, :1] = m
                break
            rank = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
            last = np.minimum(best, m.shape[1] - 2)
            right = self.pair(m[k, last], m[k, last + 1])
            has = best < m.shape[1] - 1
            rank[k[has], best[has]] = right[has]
            b = np.flatnonzero(best > 0)
            if len(b):
                rank[b, best[b] - 1] = self.pair(m[b, best[b] - 1], m[b, best[b]])
        return out

    # -- decoding

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of token ids."""
        size = self.length[ids]
        end = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.bytes[np.repeat(self.offset[ids] - end + size, size) + np.arange(end[-1])]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


# -- pieces

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        out[found] = kind
    assert unicodedata.category("a") == "Ll"
    return out


def classes(data: np.ndarray) -> np.ndarray:
    """Class of the code point that each UTF-8 byte belongs to."""
    table = _classes()
    out = table[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        n = 1 + (b >= 0xE0) + (b >= 0xF0)
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
        cp = np.where(n == 1, b & 0x1F, np.where(n == 2, b & 0x0F, b & 0x07))
        for k in range(1, 4):
            cp = np.where(k <= n, cp << 6 | pad[lead + k], cp)
        kind = table[np.minimum(cp, 0x10FFFF)]
        for k in range(4):
            m = k <= n
            out[lead[m] + k] = kind[m]
    return out


_SUFFIX = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut points (first 0, last the length) of the pattern's pieces; no piece spans documents."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    cls = classes(data)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = cls[1:] != cls[:-1]
    cut[offsets] = True
    run = np.flatnonzero(cut)
    a, b = run[:-1], run[1:]
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets] = True
    # white space before something else: all but its last character, then that character, which a plain space gives to what follows
    w = (cls[a] == SPACE) & ~doc_end[b]
    last = b[w] - 1
    while True:
        inner = (data[last] & 0xC0) == 0x80
        if not inner.any():
            break
        last = last - inner
    cut[last] = True
    cut[b[w][data[last] == 32]] = False
    # contractions: a lone apostrophe not taken by a space, followed by one of the suffixes
    q = a[(cls[a] == OTHER) & (b - a == 1)]
    q = q[(data[q] == 39) & cut[q]]
    if len(q):
        limit = offsets[np.searchsorted(offsets, q, side="right")]
        for p, end in zip(q.tolist(), limit.tolist(), strict=True):
            tail = data[p + 1 : min(p + 3, end)].tobytes()
            for s in _SUFFIX:
                if tail.startswith(s):
                    cut[p + 1] = False
                    cut[p + 1 + len(s)] = True
                    break
    return np.flatnonzero(cut)


# -- lexicon


class Lexicon:
    """A minimal acyclic automaton whose n-th word (in byte order) has the n-th run of ids."""

    NAMES = ("edge", "to", "skip", "final", "off", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], vocab: Vocabulary) -> Lexicon:
        """Incremental construction from sorted words; equal right languages share a state."""
        words = sorted(set(words))
        children: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, byte, child, not yet shared
        last = b""

        def share(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (final[child], tuple(children[child].items()))
                same = register.get(key)
                if same is None:
                    register[key] = child
                else:
                    children[parent][byte] = same

        for w in words:
            common = 0
            while common < len(w) and common < len(last) and w[common] == last[common]:
                common += 1
            share(common)
            state = path[-1][2] if path else 0
            for byte in w[common:]:
                children.append({})
                final.append(False)
                children[state][byte] = len(children) - 1
                path.append((state, byte, len(children) - 1))
                state = len(children) - 1
            final[state] = True
            last = w
        share(0)
        order, seen, stack = [], {0}, [0]
        while stack:
            s = stack.pop()
            order.append(s)
            for t in children[s].values():
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        number = {s: i for i, s in enumerate(order)}
        total: dict[int, int] = {}

        def count(s: int) -> int:
            todo = [s]
            while todo:
                x = todo[-1]
                need = [t for t in children[x].values() if t not in total]
                if need:
                    todo += need
                else:
                    total[x] = final[x] + sum(total[t] for t in children[x].values())
                    todo.pop()
            return total[s]

        count(0)
        edge, to, skip = [], [], []
        for s in order:
            before = int(final[s])
            for byte, t in sorted(children[s].items()):
                edge.append(number[s] << 8 | byte)
                to.append(number[t])
                skip.append(before)
                before += total[t]
        buf = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        ids, n = vocab.merge_many(buf, ends - np.array([len(w) for w in words], np.int64), ends) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return cls(edge=np.array(edge, np.int64), to=np.array(to, np.int32), skip=np.array(skip, np.int32), final=np.array([final[s] for s in order], bool), off=np.concatenate([[0], np.cumsum(n)]).astype(np.int64), ids=ids)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each piece's word number, -1 for unseen ones; all pieces walk at once."""
        n = len(starts)
        out = np.full(n, -1, np.int64)
        if not len(self.edge) or not n:
            return out
        live, state, number, at = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), starts.copy()
        edge, to, skip, final = self.edge, self.to, self.skip, self.final
        while len(live):
            key = state << 8 | data[at]
            i = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
            ok = edge[i] == key
            live, i, at, number = live[ok], i[ok], at[ok] + 1, number[ok]
            state = to[i].astype(np.int64)
            number = number + skip[i]
            end = at == ends[live]
            hit = end & final[state]
            out[live[hit]] = number[hit]
            live, state, number, at = live[~end], state[~end], number[~end], at[~end]
        return out

    def save(self, path: str) -> str:
        """One file of all arrays, written through Arrow; returns its path."""
        fs, name = _fs(path)
        arrays = [np.ascontiguousarray(getattr(self, k)) for k in self.NAMES]
        with fs.open_output_stream(name) as f:
            head = np.array([len(a) for a in arrays], np.int64)
            f.write(head.tobytes())
            for a in arrays:
                raw = a.tobytes()
                f.write(raw + b"\0" * (-len(raw) % 8))
        return path

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-map the file (or read it where the shared folder isn't a mounted one)."""
        fs, name = _fs(path)
        if isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.exists(name):
            raw = np.memmap(name, np.uint8, mode="r")
        else:
            with fs.open_input_file(name) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        head = np.frombuffer(raw[:48], np.int64)
        kinds = (np.int64, np.int32, np.int32, np.bool_, np.int64, np.int32)
        at, out = 48, {}
        for k, kind, n in zip(cls.NAMES, kinds, head.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            out[k] = raw[at : at + size].view(kind)
            at += size + (-size % 8)
        return cls(**out)


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# -- encoder


class Encoder:
    """Ids of whole slices: cut, look each distinct piece up once, spread the ids."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, memory: int = 1_500_000):
        self.vocab, self.lexicon, self.memory = vocab, lexicon, memory
        self._forget()

    def _forget(self) -> None:
        self.known, self.where, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        number = self.lexicon.lookup(data, starts, ends) if self.lexicon is not None else np.full(len(h), -1, np.int64)
        seen = number >= 0
        ids, count = self.vocab.merge_many(data, starts[~seen], ends[~seen])
        size = np.zeros(len(h), np.int32)
        where = np.zeros(len(h), np.int64)
        size[~seen] = count
        where[~seen] = np.concatenate([[0], np.cumsum(count)])[:-1]
        if seen.any():
            a, b = self.lexicon.off[number[seen]], self.lexicon.off[number[seen] + 1]
            n = b - a
            cum = np.cumsum(n)
            size[seen] = n
            where[seen] = len(ids) + cum - n
            ids = np.concatenate([ids, self.lexicon.ids[np.repeat(a - cum + n, n) + np.arange(cum[-1])]])
        where += len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.known, h)
        self.known, self.where, self.size = np.insert(self.known, at, h), np.insert(self.where, at, where), np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and the offset of each document's first."""
        cut = pieces(data, offsets)
        starts, ends = cut[:-1], cut[1:]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        h = X.hashes(data, starts, ends)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.memory:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
        new = np.ones(len(u), bool) if not len(self.known) else self.known[at] != u
        if new.any():
            self._learn(u[new], data, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.known, u)
        size, where = self.size[at][inv].astype(np.int64), self.where[at][inv]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(where - end + size, size) + np.arange(end[-1])]
        if not np.array_equal(self.vocab.decode(ids), data):  # two pieces with one hash: merge each by itself
            each = [self.vocab.merge(data[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids, end = np.array([i for x in each for i in x], np.int32), np.cumsum([len(x) for x in each])
        per = np.concatenate([[0], end])
        return ids, per[np.searchsorted(cut, offsets)]


def blob(ids: np.ndarray) -> bytes:
    """Ids, compressed: they are moved and stored in this form."""
    return zstandard.ZstdCompressor(3).compress(ids.tobytes())


def unblob(raw: bytes, kind: str = "<u2") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def kind(p: Params) -> str:
    """The least type that holds all ids."""
    return "<u2" if vocabulary(p.vocabulary).size <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def encoder(p: Params) -> Encoder:
    """A worker's encoder without a lexicon; what it learns outlives the task, within ``memory``."""
    return Encoder(vocabulary(p.vocabulary), None, p.memory)


# -- Spark


def _piece_counts(p: Params):
    """Each slice's distinct pieces and their numbers; equal pieces of a task are added up by Spark before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches, "text", p.slice_bytes):
            data, offsets, _ = X.utf8(b.column(0))
            cut = pieces(data, offsets)
            if len(cut) < 2:
                continue
            _, first, n = np.unique(X.hashes(data, cut[:-1], cut[1:]), return_index=True, return_counts=True)
            start, size = cut[first], cut[first + 1] - cut[first]
            end = np.cumsum(size)
            raw = data[np.repeat(start - end + size, size) + np.arange(end[-1])]
            off = np.concatenate([[0], end]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())]), pa.array(n.astype(np.int64))], ["w", "n"])

    return run


def frequent(ws: Workspace, docs: DataFrame, p: Params) -> list[bytes]:
    """The pieces that occur oftenest in all documents, ``lexicon`` at most.

    They are all those above a number of occurrences, found from the pieces per 64th of an octave of that
    number, so that neither many rows nor candidates of each task reach the driver.
    """
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_piece_counts(p), "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    table = ws.write(counts.withColumn("b", F.floor(F.log2("n") * 64).cast("int")), "pieces")
    room, least = p.lexicon, None
    for r in table.groupBy("b").agg(F.count("*").alias("k")).orderBy(F.desc("b")).collect():  # 64 rows an octave
        if r.k > room:
            break
        room, least = room - r.k, r.b
    found = [] if least is None else [w.as_py() for w in table.where(F.col("b") >= least).select("w").toArrow().column("w")]
    ws.drop(table)
    return found


def lexicon(ws: Workspace, docs: DataFrame, p: Params) -> str:
    """Compile the frequent pieces of all documents; returns the shared file's path."""
    words = frequent(ws, docs, p)
    ws.spark.createDataFrame([(len(words),)], "words int").write.parquet(ws.path("lexicon-size"))  # makes the folder
    return Lexicon.build(words, vocabulary(p.vocabulary)).save(f"{ws.root}/lexicon.bin")


def _encoded(path: str | None, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(p.vocabulary)
        enc = Encoder(vocab, Lexicon.load(path) if path else None, p.memory)
        for b in X.slices(batches, "text", p.slice_bytes):
            data, offsets, valid = X.utf8(b.column(1))
            ids, at = enc.encode(data, offsets)
            back = vocab.decode(ids)
            if len(back) == len(data):
                wrong = np.concatenate([[0], np.cumsum(back != data)])
                size = np.concatenate([[0], np.cumsum(vocab.length[ids])])
                ok = (wrong[offsets[1:]] == wrong[offsets[:-1]]) & (size[at] == offsets)[1:]
            else:
                ok = np.array([np.array_equal(vocab.decode(ids[at[i] : at[i + 1]]), data[offsets[i] : offsets[i + 1]]) for i in range(len(at) - 1)])
            none = ~valid
            off = pa.array(at.astype(np.int32), mask=np.concatenate([none, [False]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(at).astype(np.int32), mask=none), pa.ListArray.from_arrays(off, pa.array(ids)), pa.array(ok, mask=none)],
                ["doc_id", "n_tokens", "ids", "roundtrip"],
            )

    return run


def encoded(docs: DataFrame, p: Params = Params(), path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, roundtrip`` for every row."""
    path = path or lexicon(Workspace(docs.sparkSession, "bpe"), docs, p)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_encoded(path, p), "doc_id bigint, n_tokens int, ids array<int>, roundtrip boolean")


def decoded(tokens: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that aren't UTF-8 are replaced, null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(p.vocabulary)
        for b in batches:
            texts = [None if x is None else vocab.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir, "doc_id", "text"))
