"""Document fingerprints by winnowing.

Every run of ``k`` consecutive words is hashed (rolling, 64 bits); of each window
of ``w`` consecutive hashes the least is chosen, the rightmost of equal ones, and
its position (the index of its first word) is kept.  So any two texts that share
a passage of ``k + w - 1`` words share a fingerprint (the guarantee), and none
that share no passage of ``k`` words do (but for equal 64-bit hashes).

Defined results: a document with at least k words but fewer than a window's has
one window; one of fewer words, an empty and a null text have no fingerprints.
Every row is treated alone, so repeated rows give repeated fingerprints; a null
``doc_id`` is carried along.  Other columns aren't looked at.  A text of any length
is read whole, a slice of rows at a time.  An empty table gives no rows.  ``doc_id`` must be
castable to bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .sql import FOLDED, WORD, mixed_sql, word_hash_sql
from .workspace import documents


@dataclass(frozen=True)
class Params:
    """A shared passage of k + w - 1 words is always found: 15, as many as the shortest benchmark item has."""

    k: int = 14
    w: int = 2


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams within documents, and the first index per document."""
    n = len(h)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    power, inverse = X.powers(n)  # rolling: a gram is a difference of prefix sums, shifted to its own first power
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * inverse[:n])])
    acc = (sums[k:] - sums[: n - k + 1]) * power[k - 1 : n]
    keep = np.repeat(first[:-1], counts) + np.arange(at[-1]) - np.repeat(at[:-1], counts)
    return X.mixed(acc[keep]) >> np.uint64(1), at


def _right(v: np.ndarray, p: np.ndarray, w: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    later = w <= v
    return np.where(later, w, v), np.where(later, q, p)


def winnow(g: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Indices into ``g`` of the chosen hashes, ascending."""
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    counts = np.diff(at)
    v, p, span = g, np.arange(n), 1
    while span * 2 <= w and span < n:
        m = n - 2 * span + 1
        if m <= 0:
            break
        v, p = _right(v[:m], p[:m], v[span : span + m], p[span : span + m])
        span *= 2
    out = []
    m = n - w + 1
    if m > 0:
        if span < w:
            v, p = _right(v[:m], p[:m], v[w - span : w - span + m], p[w - span : w - span + m])
        left = np.repeat(at[1:], counts)[:m] - np.arange(m)
        out.append(p[:m][left >= w])
    few = np.flatnonzero((counts > 0) & (counts < w))
    if len(few):
        least = np.minimum.reduceat(g, at[:-1][counts > 0])
        low = np.repeat(least, counts[counts > 0]) == g
        last = np.maximum.reduceat(np.where(low, np.arange(n), -1), at[:-1][counts > 0])
        out.append(last[(counts < w)[counts > 0]])
    return np.unique(np.concatenate(out))


def _rows(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches, "text"):
            data, offsets, _ = X.utf8(b.column(1))
            f = X.folded(data)
            starts, ends, first = X.spans(f, offsets)
            g, at = grams(X.hashes(f, starts, ends), first, p.k)
            chosen = winnow(g, at, p.w)
            if len(chosen):
                doc = np.searchsorted(at, chosen, side="right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array((chosen - at[doc]).astype(np.int32)), pa.array(g[chosen].view(np.int64))], ["doc_id", "pos", "hash"])

    return run


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, pos, hash`` for each fingerprint; one scan, no shuffle."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_rows(p), "doc_id bigint, pos int, hash bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir, "doc_id", "text"))


_P = Params()
ORACLE = f"""
WITH tok AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i
  FROM (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS ws FROM documents)
), vocab AS (SELECT w, {word_hash_sql("w")} AS h FROM (SELECT DISTINCT w FROM tok)),
hashed AS (SELECT doc_id, i, h FROM tok JOIN vocab USING (w)),
gram AS (
  SELECT doc_id, i, {mixed_sql(f"list_reduce(list_transform(hs, lambda x: x::UHUGEINT), lambda a, x: (a * {int(X.BASE)}::UHUGEINT + x) % 18446744073709551616::UHUGEINT)")} >> 1 AS g
  FROM (SELECT doc_id, i, array_agg(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_P.k - 1} FOLLOWING) AS hs FROM hashed)
  WHERE len(hs) = {_P.k}
), low AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n,
    min(g::UHUGEINT * 4294967296::UHUGEINT + (4294967295 - i)::UHUGEINT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {_P.w - 1} PRECEDING AND CURRENT ROW) AS m
  FROM gram
)
SELECT DISTINCT doc_id, (4294967295 - (m % 4294967296::UHUGEINT)::BIGINT)::INTEGER AS pos, (m // 4294967296::UHUGEINT)::BIGINT AS hash
FROM low WHERE i >= least({_P.w}, n) - 1
"""
