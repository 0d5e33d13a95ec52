"""Near-duplicate documents: SimHash fingerprints retrieved through the Golay code.

A fingerprint has eight segments of 23 bits, voted by the document's distinct
words.  Each segment decodes to one or six codeword indices (``golay``), so two
segments at distance 2 or less always share an index; the keys are the index
pairs of all 28 pairs of segments.  (Rows are sent once for each index of a
pair's first segment; the second's are decoded again where they meet.)  Thus, by the pigeonhole principle, every
pair of fingerprints in which two segments differ by at most 2 bits meets, as do
all pairs at distance 20 or less and most at up to ``hamming``.  Pairs that meet
are compared on the whole fingerprint and on 64 one-bit minima of their word
pairs, and then verified by the Jaccard index of their word pairs, from bottom-k
sketches that are exact for short texts.  Groups
are the connected components; each keeps its least ``doc_id``.

Texts that are byte for byte equal are collapsed first, so their keys are made
once.  Inside buckets all rows are compared with their bucket's first, many buckets
at once, and then only those unlike it with all others; a bucket with another large
group of copies is explored breadth first, which costs no more than one pass for a
group of any size.

Defined results: rows with a null or empty text, or without ``doc_id``, are no
copies of anything and stay.  Texts without any word are compared only for
equality.  Of repeated rows of one ``doc_id``, one stays (the first by text and
then by all other columns that can be ordered).  Ties can't arise, as ids are
unique within a group.  Other columns pass through whatever their names.  Texts of any
length are fingerprinted whole.  An empty table gives no rows.  ``doc_id`` must be castable
to bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import golay
from . import text as X
from .components import components
from .workspace import Workspace, documents

SEGMENTS = 8
BITS = SEGMENTS * golay.BITS
SKETCH = 96
MINIMA = 64
WORDS = 1 + -(-BITS // 64)  # the minima, then the segments' bits
NAMES = [f"w{i}" for i in range(WORDS)]
_LONGS = ", ".join(f"{n} bigint" for n in NAMES)


@dataclass(frozen=True)
class Params:
    """``broadcast_rows`` is the greatest number of dropped ids (8 bytes each) that is broadcast.

    ``split`` bits of the second index go into the sent key.  0 sends about 150 rows a document in
    114,688 groups; each bit doubles the groups, and adds rows.  If it is None, it is chosen so that a group
    has some 26,000 rows, from the number of distinct texts.  The result is the same.
    """

    hamming: int = 52
    minima: int = 43
    split: int | None = None
    jaccard: float = 0.5
    broadcast_rows: int = 2_000_000


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Eight 23-bit segments per document from the votes of its distinct word hashes."""
    n = len(first) - 1
    out = np.zeros((n, SEGMENTS), np.int32)
    if not len(h):
        return out
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = np.sort((doc << np.uint64(44)) | (h >> np.uint64(20)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    a = X.mixed(key & np.uint64((1 << 44) - 1))
    votes = np.zeros((n, BITS), np.int32)
    full = np.flatnonzero(np.diff(at) > 0)
    # bit planes are summed eight at a time: bytes of a word hold eight counters of up to 255
    lanes = np.zeros(256, np.uint64)
    for bit in range(8):
        lanes[(np.arange(256) >> bit & 1) == 1] += np.uint64(1) << np.uint64(8 * bit)
    blocks = np.unique(np.concatenate([np.arange(0, len(a), 240), at[:-1][full]]))
    owner = np.searchsorted(at, blocks, side="right") - 1
    raw = np.stack([a, b := X.mixed(a), X.mixed(b)], 1).view(np.uint8)
    for byte in range((BITS + 7) // 8):
        sums = np.add.reduceat(lanes[raw[:, byte]], blocks)
        part = sums.view(np.uint8).reshape(-1, 8)
        for bit in range(min(8, BITS - 8 * byte)):
            votes[:, 8 * byte + bit] = np.bincount(owner, part[:, bit], n)
    ones = 2 * votes > np.diff(at)[:, None]
    for s in range(SEGMENTS):
        out[:, s] = ones[:, s * golay.BITS : (s + 1) * golay.BITS] @ (1 << np.arange(golay.BITS))
    return out


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The least SKETCH distinct hashes of word pairs, 32 bits each, and one bit of the least in each of MINIMA bins."""
    s, at = X.shingles(h, first, 2)
    n = len(at) - 1
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(32)) | (s >> np.uint64(32)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    cell = (key >> np.uint64(32)).astype(np.int64) * MINIMA + (low.astype(np.int64) * MINIMA >> 32)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    bits = np.zeros(n * MINIMA, bool)
    bits[cell[lead]] = X.mixed(key[lead] & np.uint64(2**32 - 1)) & np.uint64(1)
    return [low[at[i] : min(at[i + 1], at[i] + SKETCH)].tobytes() for i in range(n)], bits.reshape(n, MINIMA)


def packed(fp: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Words per document: the minima, then two segments each and a share of the last two."""
    f = fp.astype(np.uint64)
    at = lambda x, n: x << np.uint64(n)
    two = [f[:, 2 * i] | at(f[:, 2 * i + 1], 23) for i in range(3)]
    rest = f[:, 6] | at(f[:, 7], 23)  # 46 bits: 18, 18 and 10
    cut = np.uint64((1 << 18) - 1)
    words = [two[0] | at(rest & cut, 46), two[1] | at(rest >> np.uint64(18) & cut, 46), two[2] | at(rest >> np.uint64(36), 46)]
    return [w.view(np.int64) for w in (np.packbits(bits, axis=1).view(np.uint64)[:, 0], *words)]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in X.slices(batches, "text"):
        data, offsets, _ = X.utf8(b.column(1))
        f = X.folded(data)
        starts, ends, first = X.spans(f, offsets)
        h = X.hashes(f, starts, ends)
        sketch, bits = sketches(h, first)
        words = packed(fingerprints(h, first), bits)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), pa.array(np.diff(first).astype(np.int32)), *map(pa.array, words), pa.array(sketch, pa.binary())],
            ["doc_id", "h1", "h2", "n_words", *NAMES, "sketch"],
        )


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Exact hashes, fingerprint and sketch of each document that can be a copy."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    src = src.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return src.mapInArrow(_fingerprint_rows, f"doc_id bigint, h1 bigint, h2 bigint, n_words int, {_LONGS}, sketch binary")


_PAIRS = list(combinations(range(SEGMENTS), 2))


def segment(words: list[np.ndarray], s: int) -> np.ndarray:
    """The s-th segment of packed words (as unsigned numbers)."""
    one = np.uint64((1 << golay.BITS) - 1)
    if s < 6:
        return (words[1 + s // 2] >> np.uint64(golay.BITS * (s % 2)) & one).astype(np.int64)
    rest = sum((w >> np.uint64(46)) << np.uint64(18 * i) for i, w in enumerate(words[1:]))
    return (rest >> np.uint64(golay.BITS * (s - 6)) & one).astype(np.int64)


def _key_rows(split: int):
    """A row for each pair of segments, each index of its first one, and each distinct head of the second's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 4000) for i in range(0, batch.num_rows, 4000)):
                ids, *signed = (b.column(i).to_numpy() for i in range(1 + WORDS))
                words = [w.view(np.uint64) for w in signed]
                lists = [golay.indices(segment(words, s)) for s in range(SEGMENTS)]
                keys, rows = [], []
                for c, (i, j) in enumerate(_PAIRS):
                    (first, n), (second, m) = lists[i], lists[j]
                    live = np.arange(6) < m[:, None]
                    head = np.sort(np.where(live, second >> (golay.MESSAGE - split), -1), axis=1)
                    fresh = (head >= 0) & np.concatenate([np.ones((len(head), 1), bool), head[:, 1:] != head[:, :-1]], 1)
                    row, slot, at = np.nonzero((np.arange(6) < n[:, None])[:, :, None] & fresh[:, None, :])
                    keys.append(((c << golay.MESSAGE | first[row, slot]) << split | head[row, at]).astype(np.int32))
                    rows.append(row)
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids[row]), *(pa.array(w[row]) for w in signed)], ["k", "id", *NAMES])

    return run


def alike(words: list[np.ndarray], a, b, p: Params) -> np.ndarray:
    """Fingerprints that agree in ``minima`` minima and are within ``hamming`` of each other (unsigned words).

    Few pairs that meet by chance pass the minima, which are one word, so the others are read for few.
    """
    near = np.bitwise_count(words[0][a] ^ words[0][b]) <= MINIMA - p.minima
    if near.any():
        a, b = (np.broadcast_to(i, near.shape)[near] for i in (a, b))
        near[near] = sum(np.bitwise_count(w[a] ^ w[b]) for w in words[1:]) <= p.hamming
    return near


def bucket_edges(ids: np.ndarray, words: list[np.ndarray], p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first edges that connect all documents alike, directly or not; from the least id on."""
    order = np.argsort(ids, kind="stable")
    ids, words = ids[order], [w[order] for w in words]
    rest = np.arange(len(ids))
    out = []
    while len(rest) > 1:
        queue, rest, done = [rest[0]], rest[1:], 0
        while done < len(queue) and len(rest):
            at = queue[done]
            done += 1
            near = alike(words, rest, at, p)
            if near.any():
                got = rest[near]
                out.append((np.full(len(got), ids[at]), ids[got]))
                queue.extend(got.tolist())
                rest = rest[~near]
    return out


SLICE_ROWS = 200_000
_SMALL = 48  # rows of a bucket that is compared together with the others of its size
_CELLS = 30_000  # words of a block of buckets, so that it stays in a core's cache


def _pairs_of_size(w0: np.ndarray, begin: np.ndarray, n: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within all buckets of ``n`` rows that agree in the minima."""
    left, right = [], []
    step = max(1, _CELLS // n)
    for k in range(0, len(begin), step):
        at = begin[k : k + step, None] + np.arange(n)
        m = w0[at]
        for d in range(1, n):
            row, i = np.nonzero(np.bitwise_count(m[:, d:] ^ m[:, :-d]) <= MINIMA - p.minima)
            if len(row):
                left.append(at[row, i])
                right.append(at[row, i + d])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def edges_within(cut: np.ndarray, at: np.ndarray, ids: np.ndarray, words: list[np.ndarray], p: Params) -> np.ndarray:
    """Edges, as pairs of rows, that connect what is alike within each of many buckets.

    Bucket b has the rows ``at[cut[b]:cut[b + 1]]``, by rising id.  All are compared with their bucket's
    first; then those unlike it with all others of the bucket, many buckets at a time.
    """
    size = np.diff(cut)
    w0 = words[0][at]
    head = np.repeat(cut[:-1], size)
    near = np.bitwise_count(w0 ^ np.repeat(w0[cut[:-1]], size)) <= MINIMA - p.minima
    near[cut[:-1]] = False
    x = np.flatnonzero(near)
    x = x[alike(words, at[head[x]], at[x], p)]
    out = [np.stack([at[head[x]], at[x]], 1)]
    star = np.zeros(len(at), bool)
    star[cut[:-1]] = star[x] = True
    left_over = size - np.add.reduceat(star, cut[:-1], dtype=np.int64) if len(at) else size
    open_ = (left_over > 0) & (size > 2)
    for n in np.unique(size[open_ & (size <= _SMALL)]).tolist():
        i, j = _pairs_of_size(w0, cut[:-1][open_ & (size == n)], n, p)
        some = ~(star[i] & star[j])
        i, j = at[i[some]], at[j[some]]
        near = alike(words, i, j, p)
        out.append(np.stack([i[near], j[near]], 1))
    for b in np.flatnonzero(open_ & (size > _SMALL)).tolist():
        rows = at[cut[b] : cut[b + 1]]
        rest = np.flatnonzero(~star[cut[b] : cut[b + 1]])
        found, most = [], 8 * len(rows)
        for k in range(0, len(rest), 256):
            i, j = np.nonzero(np.bitwise_count(words[0][rows[rest[k : k + 256]], None] ^ words[0][rows]) <= MINIMA - p.minima)
            i = rest[k + i]
            other = i != j
            i, j = rows[np.minimum(i, j)[other]], rows[np.maximum(i, j)[other]]
            near = alike(words, i, j, p)
            found.append(np.stack([i[near], j[near]], 1))
            most -= len(found[-1])
            if most < 0:  # another large group of copies: breadth first takes as many edges as rows
                found = [np.stack([rows[u], rows[v]], 1) for u, v in bucket_edges(np.arange(len(rows)), [w[rows] for w in words], p)]
                break
        out += found
    return np.concatenate(out)


def distinct_pairs(e: np.ndarray) -> np.ndarray:
    """The distinct rows of pairs, sorted."""
    e = e[np.lexsort((e[:, 1], e[:, 0]))]
    fresh = np.ones(len(e), bool)
    fresh[1:] = (e[1:] != e[:-1]).any(1)
    return e[fresh]


def _edge_rows(p: Params, split: int):
    """Edges of a stream of rows sorted by ``k``: decodes each second segment and compares within buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        found: list[np.ndarray] = []

        def flush(cols: list[np.ndarray]) -> None:
            """Whole groups of ``k``; wide ones are taken in several passes over the second index."""
            if not len(cols[0]):
                return
            by_id = np.lexsort((cols[1], cols[0]))
            k, ids, *signed = (c[by_id] for c in cols)
            words = [w.view(np.uint64) for w in signed]
            second = np.array([j for _, j in _PAIRS])[k >> (golay.MESSAGE + split)]
            word = np.zeros(len(k), np.int64)
            for j in range(1, SEGMENTS):
                m = second == j
                word[m] = segment([w[m] for w in words], j)
            index, count = golay.indices(word)
            head = index >> (golay.MESSAGE - split) == (k & ((1 << split) - 1))[:, None]
            row, slot = np.nonzero((np.arange(6) < count[:, None]) & head)
            value = index[row, slot].astype(np.int64)
            group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
            passes = -(-len(k) // (4 * SLICE_ROWS))
            for n in range(passes):
                m = slice(None) if passes == 1 else value % passes == n
                r = row[m]
                # sorted with the place in the lowest bits, so ids rise within a bucket
                bits = np.uint64(len(r).bit_length())
                key = np.sort((group[r] << golay.MESSAGE | value[m]).astype(np.uint64) << bits | np.arange(len(r), dtype=np.uint64))
                r, key = r[(key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)], key >> bits
                edge = np.concatenate([[True], key[1:] != key[:-1], [True]]) if len(key) else np.ones(1, bool)
                several = ~(edge[1:] & edge[:-1])
                r, first = r[several], edge[:-1][several]
                e = edges_within(np.concatenate([np.flatnonzero(first), [len(r)]]), r, ids, words, p)
                if len(e):
                    both = np.unique(e[:, 0] * len(ids) + e[:, 1])
                    found.append(np.sort(np.stack([ids[both // len(ids)], ids[both % len(ids)]], 1), axis=1))

        def distinct() -> np.ndarray:
            e = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            return distinct_pairs(e[e[:, 0] != e[:, 1]])

        rows = 0
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(2 + WORDS)]
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            if rows < SLICE_ROWS or held[0][0][0] == cols[0][-1]:
                continue
            cat = [np.concatenate([h[i] for h in held]) for i in range(2 + WORDS)]
            end = int(np.searchsorted(cat[0], cat[0][-1], side="left"))
            flush([c[:end] for c in cat])
            held = [[c[end:] for c in cat]]
            rows = len(held[0][0])
            if sum(map(len, found[1:])) > max(1_000_000, len(found[0])):
                found = [distinct()]
        if held:
            flush([np.concatenate([h[i] for h in held]) for i in range(2 + WORDS)])
        e = distinct()
        for i in range(0, len(e), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(e[i : i + 100_000, 0]), pa.array(e[i : i + 100_000, 1])], ["u", "v"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Index of two bottom-k sketches; exact if both sets are smaller than a sketch."""
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:
        union = union[:SKETCH]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union).sum() / len(union))


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [jaccard(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) >= least for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    return run


def groups(ws: Workspace, docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The fingerprint table, and ``u, v``: copy u of the group whose least doc_id is v (u > v)."""
    table = ws.write(fingerprinted(docs), "fingerprints")
    slim = table.select("doc_id", "h1", "h2", "n_words", *NAMES)
    reps = ws.write(slim.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_words", *NAMES)).alias("r"), F.count("*").alias("n")), "texts")
    same = slim.select("doc_id", "h1", "h2").join(reps.where("n > 1").select("h1", "h2", F.col("r.doc_id").alias("v")), ["h1", "h2"]).select(F.col("doc_id").alias("u"), "v").where("u <> v")
    split = max(0, ceil(log2(max(1, reps.count()) / 2e7))) if p.split is None else p.split
    keys = reps.where("r.n_words > 0").select("r.doc_id", *(f"r.{n}" for n in NAMES)).mapInArrow(_key_rows(split), f"k int, id bigint, {_LONGS}")
    near = keys.repartition("k").sortWithinPartitions("k").mapInArrow(_edge_rows(p, split), "u bigint, v bigint")
    near = ws.write(near.distinct(), "candidates")
    # most copies are alike their component's least document: verify that edge first, and all edges only of the others
    stars = ws.write(verified(table, components(ws, near), p), "stars")
    apart = stars.where("not ok").select(F.col("u").alias("x")).distinct()
    rest = near.join(apart, near.u == apart.x, "left_semi").union(near.join(apart, near.v == apart.x, "left_semi")).distinct()
    edges = stars.where("ok").select("u", "v").union(verified(table, rest, p).where("ok").select("u", "v"))
    return table, components(ws, edges.union(same))


def verified(table: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """``u, v, ok``: whether the sketches of an edge's documents are alike enough."""
    ids = edges.select(F.col("u").alias("doc_id")).union(edges.select("v")).distinct()
    sk = table.select("doc_id", "sketch").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("sketch").alias("sketch"))
    a, b = sk.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a")), sk.select(F.col("doc_id").alias("v"), F.col("sketch").alias("b"))
    return edges.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_verified(p.jaccard), "u bigint, v bigint, ok boolean")


def grouped(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, group_id, is_kept`` for each distinct doc_id; a document alone is its own group."""
    ws = Workspace(docs.sparkSession, "simhash")
    _, links = groups(ws, docs, p)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    out = ids.join(links, ids.doc_id == links.u, "left").select("doc_id", F.coalesce("v", "doc_id").alias("group_id"))
    return out.withColumn("is_kept", F.col("group_id").eqNullSafe(F.col("doc_id")))


def kept(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    ws = Workspace(docs.sparkSession, "simhash")
    table, links = groups(ws, docs, p)
    out = without(docs, links.select(F.col("u").alias("_gone")), p.broadcast_rows)
    repeated = ws.write(table.groupBy(F.col("doc_id").alias("_rep")).count().where("count > 1").select("_rep"), "repeated")
    if repeated.isEmpty():
        return out
    again = out.join(repeated, out["doc_id"] == repeated["_rep"], "left_semi")
    sortable = [F.col(f"`{f.name}`") for f in out.schema.fields if not isinstance(f.dataType, MapType)]
    w = Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), F.col("text") == "", F.col("text"), *sortable)
    rn = X.free_name(out, "_rn")
    first = again.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)
    rest = out.join(repeated, out["doc_id"] == repeated["_rep"], "left_anti")
    return rest.unionByName(first)


def without(docs: DataFrame, gone: DataFrame, most: int) -> DataFrame:
    """Rows whose doc_id isn't in ``gone``; the ids are broadcast only while they are few."""
    few = gone.limit(most + 1).count() <= most
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir, "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs)
