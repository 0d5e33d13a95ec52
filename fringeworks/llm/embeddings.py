"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

All valid vectors, scaled to length 1, give the mean and covariance; the leading
principal axes are turned by a rotation that alternates between binary codes and
the orthogonal matrix that fits them best (both steps sum over all vectors where
they lie; only matrices of the dimension's size reach the driver).  Codes are
cut into ``tables`` parts; each vector is filed under every part and all values
one bit from it, so two codes meet if some part differs by at most 2 bits, which
holds whenever the codes differ by at most ``3 * tables - 1`` bits.  Pairs within
``hamming`` bits are ranked again with the original vectors.

A pair is made at one of the places where it meets (the first table, the least
key), so nothing has to be made distinct and no partner is cut off.  The query returns
a row for each id: its class (the connected component of the pairs, by its least id)
and its number of links, so its rows follow the input's however large the classes are.

Defined results: rows with a null id, or a vector that is null, of another than the
commonest dimension, zero, or with null or infinite entries, have no partners.
Of repeated rows of an id the likest counts; an id is no partner of itself.  Fewer than two
vectors give no pairs, as does an empty table.  Vectors of equal codes or cosines are
all paired, so ties need no order.  An id without partners is its own class and has no
links; rows without id are in none.  Other columns, whatever their names, aren't looked at;
``vec_id`` must be castable to bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace


@dataclass(frozen=True)
class Params:
    cosine: float = 0.95
    hamming: int = 11
    tables: int = 4
    rounds: int = 8
    seed: int = 3


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the valid rows, and which rows those are."""
    n = len(column)
    size = np.zeros(n, np.int64)
    off = column.offsets.to_numpy().astype(np.int64)
    none = column.is_null().to_numpy(zero_copy_only=False)
    size = np.where(none, 0, np.diff(off))
    flat = column.values
    v = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) if flat.null_count else flat.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(size == dim)
    m = v[off[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    norm = np.sqrt((m * m).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return m[good] / norm[good, None], rows[good]


def _total(rows: DataFrame, f, width: int) -> np.ndarray:
    """Sum over all batches of ``f(unit vectors)``; one row of ``width`` numbers per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += f(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    got = rows.mapInArrow(run, "s array<double>").toArrow().column("s").to_pylist()
    return np.sum(np.array(got, float).reshape(-1, width), axis=0)


@dataclass
class Quantiser:
    """Codes are the signs of the centred vectors' projections."""

    mean: np.ndarray
    axes: np.ndarray

    def codes(self, m: np.ndarray) -> np.ndarray:
        bits = (m - self.mean) @ self.axes > 0
        packed = np.packbits(bits, axis=1, bitorder="little")
        full = np.zeros((len(m), 8), np.uint8)
        full[:, : packed.shape[1]] = packed
        return full.view(np.uint64)[:, 0].view(np.int64)


def learn(rows: DataFrame, dim: int, p: Params) -> Quantiser | None:
    """Principal axes of all vectors, turned for balanced codes; None with fewer than two vectors."""

    def moments(c: pa.Array) -> np.ndarray:
        m, _ = matrix(c, dim)
        return np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])

    s = _total(rows, moments, 1 + dim + dim * dim)
    n = s[0]
    if n < 2:
        return None
    mean = s[1 : 1 + dim] / n
    cov = s[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    bits = min(dim, 64)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values)[:bits]]
    turn = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((bits, bits)))[0]
    for _ in range(p.rounds):

        def fitted(c: pa.Array, turn: np.ndarray = turn) -> np.ndarray:
            z = (matrix(c, dim)[0] - mean) @ axes
            return (np.where(z @ turn > 0, 1.0, -1.0).T @ z).ravel()

        u, _, vt = np.linalg.svd(_total(rows, fitted, bits * bits).reshape(bits, bits))
        turn = (u @ vt).T
    return Quantiser(mean, axes @ turn)


def _widths(bits: int, tables: int) -> list[tuple[int, int]]:
    """First bit and width of each part."""
    cut = np.linspace(0, bits, tables + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def _part(code: np.ndarray, first: int, width: int) -> np.ndarray:
    return code >> first & ((1 << width) - 1)


def _key_rows(q: Quantiser, dim: int, p: Params):
    parts = _widths(q.axes.shape[1], p.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, rows = matrix(b.column(1), dim)
            ids, code = b.column(0).to_numpy()[rows], q.codes(m)
            keys, who = [], []
            for t, (first, width) in enumerate(parts):
                v = _part(code, first, width)
                for flip in (0, *(1 << i for i in range(width))):
                    keys.append(t << 40 | (v ^ flip))
                    who.append(np.arange(len(code)))
            key, row = np.concatenate(keys), np.concatenate(who)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), pa.array(code[row])], ["k", "id", "code"])

    return run


def _here(key: int, a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Whether ``key`` is the place where the pairs (a, b) are made."""
    t, value = key >> 40, key & ((1 << 40) - 1)
    out = np.ones(len(a), bool)
    for s, (first, width) in enumerate(parts[: t + 1]):
        x, y = _part(a, first, width), _part(b, first, width)
        d = x ^ y
        n = np.bitwise_count(d)
        if s < t:
            out &= n > 2
        else:
            low = d & -d
            out &= np.where(n == 0, x, np.where(n == 1, np.minimum(x, y), np.minimum(x ^ low, y ^ low))) == value
    return out


def _pair_rows(bits: int, p: Params):
    parts = _widths(bits, p.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(k: np.ndarray, ids: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, int)
            out, n = [], 0
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if z - a < 2:
                    continue
                x, y = ids[a:z], code[a:z]
                for i in range(0, z - a, 512):  # a block of rows against the rest of the bucket
                    near = np.bitwise_count(y[i : i + 512, None] ^ y[None, i:]) <= p.hamming
                    r, c = np.nonzero(near & (np.arange(z - a - i)[None, :] > np.arange(len(near))[:, None]))
                    r, c = r + i, c + i
                    ok = (x[r] != x[c]) & _here(int(k[a]), y[r], y[c], parts)
                    if ok.any():
                        u, v = x[r[ok]], x[c[ok]]
                        out.append((np.minimum(u, v), np.maximum(u, v)))
                        n += len(u)
                    if n > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*out, strict=True)], ["a", "b"])
                        out, n = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*out, strict=True)], ["a", "b"])

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            held.append(cols)
            if held[0][0][0] == cols[0][-1]:
                continue
            cat = [np.concatenate([h[i] for h in held]) for i in range(3)]
            end = int(np.searchsorted(cat[0], cat[0][-1], side="left"))
            yield from flush(*(c[:end] for c in cat))
            held = [[c[end:] for c in cat]]
        if held:
            yield from flush(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return run


def _reranked(dim: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = matrix(b.column(2), dim)
            y, _ = matrix(b.column(3), dim)
            cos = np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos)], ["a", "b", "cosine"]).filter(pa.array(cos >= least))

    return run


def _commonest(vec: DataFrame) -> int | None:
    """The commonest dimension of column ``v``."""
    size = vec.where("v is not null").groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).first()
    return None if size is None else size.n


def pairs(table: DataFrame, p: Params = Params()) -> DataFrame:
    """``vec_a, vec_b, cosine`` with vec_a < vec_b for all retrieved pairs at or above the threshold."""
    spark = table.sparkSession
    schema = "a bigint, b bigint, cosine double"
    vec = table.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null and v is not null")
    dim = _commonest(vec)
    q = learn(vec.select("v"), dim, p) if dim is not None else None
    if q is None:
        return spark.createDataFrame([], schema).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), "cosine")
    ws = Workspace(spark, "embeddings")
    keys = vec.mapInArrow(_key_rows(q, dim, p), "k bigint, id bigint, code bigint")
    near = keys.repartition("k").sortWithinPartitions("k").mapInArrow(_pair_rows(q.axes.shape[1], p), "a bigint, b bigint")
    near = ws.write(near, "pairs")
    valid = _valid(vec, dim)
    va, vb = valid.select(F.col("id").alias("a"), F.col("v").alias("va")), valid.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    ranked = near.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(_reranked(dim, p.cosine), schema)
    return ranked.groupBy(F.col("a").alias("vec_a"), F.col("b").alias("vec_b")).agg(F.max("cosine").alias("cosine"))


def _valid(vec: DataFrame, dim: int) -> DataFrame:
    return vec.where(F.size("v") == dim).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def classes(table: DataFrame, p: Params = Params()) -> DataFrame:
    """``vec_id, class_id, links`` for each vec_id: the least id that links lead to, and the number of ids linked directly.

    Ids of one and the same vector are searched as one, the least of them, which counts as many.
    """
    spark = table.sparkSession
    ws = Workspace(spark, "embeddings")
    vec = table.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null")
    ids = vec.select("id").distinct()
    sizes = _commonest(vec)
    if sizes is None:
        return ids.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    valid = _valid(vec, sizes).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    each = valid.groupBy("id").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"), ((F.min("h1") < F.max("h1")) | (F.min("h2") < F.max("h2"))).alias("several"))
    each = ws.write(each, "ids")
    same = each.where("not several").groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.count("*").alias("n"))
    member = each.where("not several").join(same, ["h1", "h2"]).select("id", "owner", "n")
    # an id of several vectors is searched by each of them
    member = ws.write(member.unionByName(each.where("several").select("id", F.col("id").alias("owner"), F.lit(1).cast("bigint").alias("n"))), "members")
    owners = member.where("id = owner").select("id", "n")
    searched = valid.join(owners.select("id"), "id", "left_semi").dropDuplicates(["id", "h1", "h2"])
    found = ws.write(pairs(searched.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), p).select(F.col("vec_a").alias("u"), F.col("vec_b").alias("v")), "links")
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = both.join(owners.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("owner")).agg(F.sum("n").alias("others"))
    top = components(ws, found).select(F.col("u").alias("owner"), F.col("v").alias("top"))
    known = member.join(links, "owner", "left").join(top, "owner", "left").select("id", F.coalesce("top", "owner").alias("c"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("k"))
    return ids.join(known, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("c", "id").alias("class_id"), F.coalesce("k", F.lit(0)).cast("bigint").alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's class and number of links."""
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


PAIRS = f"""SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {Params().cosine}"""
ORACLE = f"""WITH RECURSIVE p AS ({PAIRS}),
l AS (SELECT vec_a AS a, vec_b AS b FROM p UNION SELECT vec_b, vec_a FROM p),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT v AS vec_id, min(c) AS class_id, coalesce(any_value(links), 0) AS links FROM r LEFT JOIN n ON n.a = r.v GROUP BY v"""
