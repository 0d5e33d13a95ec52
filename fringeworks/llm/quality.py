"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree per feature and round on the binned
feature and adds it to that feature's lookup table; then the strongest feature
pairs get two-dimensional tables from the residuals.  Scoring is a sum of table
lookups.  Two such models are fitted: ``quality`` (label 1 is good) and
``toxic`` (label 1 is toxic).  A document is kept if it is likely good and
unlikely toxic.

The models are fitted on at most ``Params.sample`` labelled documents, chosen by
a hash of ``doc_id``; the toxic lexicon comes from the same documents.

Defined results: a null, empty or blank text has null scores and is not kept.
Labels that are null are left out; of repeated labels of a document the worst
counts.  If a head's labels hold fewer than two classes it rejects nothing.
Every input row gives one output row, so repeated rows are scored alike; a text of
any length is read whole, and an empty table gives no rows.  Scores at the threshold are
kept; of equally good splits and pairs the first counts.  Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .workspace import Workspace, documents


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the labelled documents that the models are fitted on."""

    sample: int = 8192
    bins: int = 32
    rounds: int = 150
    rate: float = 0.15
    pairs: int = 6
    pair_bins: int = 8
    pair_rounds: int = 40
    leaves: int = 3
    lexicon: int = 256
    lexicon_min_docs: int = 4
    lexicon_min_share: float = 0.01
    lexicon_min_odds: float = 8.0
    clean_loss: float = 0.002
    bad_recall: float = 0.95
    seed: int = 7


FEATURES = (
    "log_bytes", "words", "word_len", "upper", "digit", "punct", "symbol", "bang", "bar", "newline_rate", "line_len", "repeated_lines",
    "distinct_words", "short_words", "stops", "non_ascii", "capitalised", "glued", "longest_word", "toxic_rate", "toxic_hits",
)

#: what the toxic head sees: toxicity lies in the words, not in the form
TOXIC = [FEATURES.index(f) for f in ("toxic_rate", "toxic_hits", "words")]

_CLASS = np.zeros((8, 256), np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[0, _b] = 65 <= _b <= 90
    _CLASS[1, _b] = 48 <= _b <= 57
    _CLASS[2, _b] = _c in ".,;:?'\"()-"
    _CLASS[3, _b] = _c in "#$%&*@^~_+=<>{}[]\\/`"
    _CLASS[4, _b] = _c == "!"
    _CLASS[5, _b] = _c == "|"
    _CLASS[6, _b] = _c == "\n"
    _CLASS[7, _b] = _b >= 0xC0
_BITS = np.packbits(_CLASS, axis=0, bitorder="little")[0]
_BIT_SUM = [(_BITS >> k & 1).astype(np.int8) for k in range(8)]


def features(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """One row per document, columns as in FEATURES; ``lexicon`` is a sorted array of word hashes."""
    data, offsets, _ = X.utf8(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float64)
    size = np.diff(offsets)
    if not len(data):
        return out
    full = np.flatnonzero(size > 0)
    at = offsets[:-1][full]
    one = np.maximum(size, 1).astype(np.float64)
    counts = np.zeros((8, n))
    for k in range(8):
        counts[k, full] = np.add.reduceat(_BIT_SUM[k][data], at, dtype=np.int64)
    upper, digit, punct, symbol, bang, bar, lines, wide = counts
    f = X.folded(data)
    starts, ends, first = X.spans(f, offsets)
    words = np.diff(first).astype(np.float64)
    wone = np.maximum(words, 1)
    h = X.hashes(f, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    length = ends - starts
    letters = np.bincount(doc, length, n)
    short = np.bincount(doc, length <= 3, n)
    longest = np.zeros(n)
    some = np.flatnonzero(words > 0)
    if len(some):
        longest[some] = np.maximum.reduceat(length, first[:-1][some])
    order = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    fresh = np.ones(len(order), bool)
    fresh[1:] = order[1:] != order[:-1]
    distinct = np.bincount((order[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)[:n]
    initial = data[starts] if len(starts) else np.zeros(0, np.uint8)
    capital = np.bincount(doc, (initial >= 65) & (initial <= 90) | (initial == 0xC3), n)
    after = np.full(len(ends), 10, np.uint8)
    inner = ends < len(data)
    after[inner] = data[ends[inner]]
    glued = np.bincount(doc, (_CLASS[3] | _CLASS[4])[after] > 0, n)
    stop = np.bincount(doc, (after == 46) | (after == 63), n)
    hit = np.zeros(n)
    if len(lexicon) and len(h):
        where = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = np.bincount(doc, lexicon[where] == h, n)
    # lines: hash each by the words' sum is order-free, so hash bytes between newlines
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[np.flatnonzero(data == 10) + 1] = True
    cut = np.flatnonzero(edge)
    ls, le = cut[:-1], cut[1:]
    lh = X.hashes(data, ls, le)
    ldoc = np.searchsorted(offsets, ls, side="right") - 1
    many = np.bincount(ldoc, minlength=n).astype(np.float64)
    lo = np.sort((ldoc.astype(np.uint64) << np.uint64(44)) | (lh >> np.uint64(20)))
    lf = np.ones(len(lo), bool)
    lf[1:] = lo[1:] != lo[:-1]
    ldistinct = np.bincount((lo[lf] >> np.uint64(44)).astype(np.int64), minlength=n)[:n]
    for j, v in enumerate((
        np.log1p(size), words, letters / wone, upper / one, digit / one, punct / one, symbol / one, bang / wone, bar / wone, lines / wone, size / np.maximum(many, 1), 1 - ldistinct / np.maximum(many, 1),
        distinct / wone, short / wone, stop / wone, wide / one, capital / wone, glued / wone, longest, hit / wone, hit,
    )):
        out[:, j] = v
    return out


def blank(column: pa.Array) -> np.ndarray:
    """Null, empty or white-space-only texts."""
    data, offsets, valid = X.utf8(column)
    solid = X.per_doc_sum((data > 32).astype(np.int8), offsets)
    return ~valid | (solid == 0)


@dataclass
class Additive:
    """Edges per feature, a table per feature and pair, and an offset; ``logit`` adds bins up."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    offset: float = 0.0
    threshold: float = 0.0
    held: tuple[float, float] = (0.0, 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.offset)
        for j, t in enumerate(self.tables):
            s += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, ea, eb, t in self.pairs:
            s += t[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return s

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    at = np.searchsorted(u, q)
    return np.unique((u[np.minimum(at, len(u) - 1)] + u[np.maximum(at - 1, 0)]) / 2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float = 1.0) -> np.ndarray:
    """Leaf values per bin of a tree of few leaves over ordered bins, grown best first."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            tg, th = cg[-1], ch[-1]
            gain = cg[:-1] ** 2 / (ch[:-1] + reg) + (tg - cg[:-1]) ** 2 / (th - ch[:-1] + reg) - tg**2 / (th + reg)
            m = int(np.argmax(gain))
            if gain[m] > best[0]:
                best = (gain[m], k, a + m + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + reg)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float = 1.0) -> tuple[float, np.ndarray]:
    """Best pair of cuts of a two-dimensional histogram, and the four leaf values spread over it."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    rg, rh = cg[:-1, -1:], ch[:-1, -1:]
    dg, dh = cg[-1:, :-1], ch[-1:, :-1]
    quads = ((a, b), (rg - a, rh - b), (dg - a, dh - b), (tg - rg - dg + a, th - rh - dh + b))
    if not a.size:
        return 0.0, np.zeros_like(g)
    gain = sum(x**2 / (y + reg) for x, y in quads) - tg**2 / (th + reg)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(x[i, j] / (y[i, j] + reg)) for x, y in quads]
    t = np.empty_like(g)
    t[: i + 1, : j + 1], t[: i + 1, j + 1 :], t[i + 1 :, : j + 1], t[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), t


def fit(x: np.ndarray, y: np.ndarray, p: Params) -> Additive:
    """Cyclic boosting of main effects, then of the pairs whose residual gain is greatest."""
    n, d = x.shape
    edges = [_edges(x[:, j], p.bins) for j in range(d)]
    bins = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Additive(edges, tables, offset=float(np.log(mean / (1 - mean))))
    s = np.full(n, model.offset)
    for _ in range(p.rounds):
        for j in range(d):
            if not len(edges[j]):
                continue
            q = 1 / (1 + np.exp(-s))
            step = p.rate * _tree(np.bincount(bins[j], y - q, len(tables[j])), np.bincount(bins[j], q * (1 - q), len(tables[j])), p.leaves)
            tables[j] += step
            s += step[bins[j]]
    coarse = [_edges(x[:, j], p.pair_bins) for j in range(d)]
    cbins = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(d)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat = cbins[a] * shape[1] + cbins[b]
        q = 1 / (1 + np.exp(-s))
        size = shape[0] * shape[1]
        return flat, np.bincount(flat, y - q, size).reshape(shape), np.bincount(flat, q * (1 - q), size).reshape(shape)

    gains = sorted(((_quadrants(*grids(a, b)[1:])[0], a, b) for a in range(d) for b in range(a) if len(coarse[a]) and len(coarse[b])), reverse=True)
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains[: p.pairs]]
    for _ in range(p.pair_rounds):
        for a, b, t in chosen:
            flat, g, h = grids(a, b)
            step = p.rate * _quadrants(g, h)[1]
            t += step
            s += step.ravel()[flat]
    model.pairs = [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen]
    return model


def fit_head(x: np.ndarray, good: np.ndarray, clean: np.ndarray, p: Params) -> Additive | None:
    """A model of ``good`` whose threshold, set on held-out thirds, loses few ``clean`` rows.

    Where that would let more than ``1 - bad_recall`` of the others pass, the threshold is raised until it
    doesn't, or to even odds.  ``held`` of the model has the held-out share of others found and of clean rows lost.
    """
    if len(x) < 20 or good.all() or not good.any():
        return None
    fold = np.random.default_rng(p.seed).permutation(len(x)) % 3
    held = np.zeros(len(x))
    for k in range(3):
        held[fold == k] = fit(x[fold != k], good[fold != k].astype(float), p).logit(x[fold == k])
    final = fit(x, good.astype(float), p)
    q, bad = np.sort(held[clean]), np.sort(held[~good])
    lost = float(q[int(p.clean_loss * len(q))]) - 1e-9 if len(q) else 0.0
    final.threshold = min(0.0, max(lost, float(bad[min(len(bad) - 1, int(p.bad_recall * len(bad)))]) + 1e-9))
    final.held = (float((bad < final.threshold).mean()), float((q < final.threshold).mean()) if len(q) else 0.0)
    return final


@dataclass
class Model:
    lexicon: np.ndarray
    quality: Additive | None
    toxic: Additive | None
    rows: int

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = features(column, self.lexicon)
        none = blank(column)
        q = self.quality.logit(x) if self.quality else np.full(len(x), 40.0)
        t = self.toxic.logit(x[:, TOXIC]) if self.toxic else np.full(len(x), 40.0)
        keep = ~none & (q >= (self.quality.threshold if self.quality else 0)) & (t >= (self.toxic.threshold if self.toxic else 0))
        sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        return sig(q), 1 - sig(t), keep, none


def _sample(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    chosen = (
        labels.select(F.col("doc_id").alias("_l_id"), F.col("quality").alias("_l_q"), F.col("toxic").alias("_l_t"))
        .where("_l_id is not null and _l_q is not null and _l_t is not null")
        .groupBy("_l_id").agg(F.min("_l_q").alias("_l_q"), F.max("_l_t").alias("_l_t"))
        .orderBy(F.xxhash64("_l_id"), "_l_id").limit(p.sample)
    )
    rows = docs.select(F.col("doc_id").alias("_d_id"), F.col("text").alias("_d_text")).where("_d_text is not null")
    return rows.join(F.broadcast(chosen), F.col("_d_id") == F.col("_l_id")).select("_d_text", "_l_q", "_l_t", "_d_id")


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents, and how many toxic ones, each word occurs; summed per slice."""
    for b in X.slices(batches, "_d_text"):
        data, offsets, _ = X.utf8(b.column(0))
        f = X.folded(data)
        starts, ends, first = X.spans(f, offsets)
        h = X.hashes(f, starts, ends)
        bad = b.column(1).to_numpy() == 1
        words = [np.unique(h[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
        u, inv = np.unique(np.concatenate(words), return_inverse=True)
        toxic = np.repeat(bad, [len(w) for w in words])
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, minlength=len(u))), pa.array(np.bincount(inv, toxic, len(u)).astype(np.int64))], ["h", "n", "bad"])


def lexicon(sample: DataFrame, p: Params) -> np.ndarray:
    """Hashes of words much likelier in toxic documents, sorted; at most ``Params.lexicon`` of them."""
    toxic, total = sample.agg(F.coalesce(F.sum((F.col("_l_t") == 1).cast("int")), F.lit(0)), F.count("*")).first()
    n1, n0 = max(toxic, 1), max(total - toxic, 1)
    rows = sample.select("_d_text", "_l_t").mapInArrow(_word_rows, "h bigint, n bigint, bad bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / n1) - F.log((F.col("n") - F.col("bad") + 0.5) / n0)
    likely = rows.where(F.col("bad") >= max(p.lexicon_min_docs, p.lexicon_min_share * n1)).withColumn("o", odds).where(F.col("o") >= float(np.log(p.lexicon_min_odds)))
    top = likely.orderBy(F.desc(F.col("o") * F.sqrt("bad")), "h").limit(p.lexicon).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def _feature_rows(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches, "_d_text"):
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), b.column(2).cast(pa.int32()), pa.array(list(features(b.column(0), words)), pa.list_(pa.float64()))], ["q", "t", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit both heads on the bounded sample, which is written once and read for the lexicon and the features."""
    ws = Workspace(docs.sparkSession, "quality")
    sample = ws.write(_sample(docs, labels, p), "sample")
    words = lexicon(sample, p)
    table = sample.select("_d_text", "_l_q", "_l_t").mapInArrow(_feature_rows(words), "q int, t int, x array<double>").toArrow()
    ws.drop(sample)
    if not table.num_rows:
        return Model(words, None, None, 0)
    q, t = table.column("q").to_numpy(), table.column("t").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, t, q))  # the same whatever order the rows came in
    q, t, x = q[order], t[order], x[order]
    clean = (q == 1) & (t == 0)
    return Model(words, fit_head(x, q == 1, clean, p), fit_head(x[:, TOXIC], t == 0, clean, p), len(q))


SCORES = T.StructType([T.StructField("quality_score", T.DoubleType()), T.StructField("toxic_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def scorer(spark: SparkSession, model: Model):
    """An Arrow UDF of a text column; the model is a few hundred kB whatever the corpus."""
    held = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for column in it:
            parts = []
            for b in X.slices([pa.RecordBatch.from_arrays([column], ["t"])], "t"):
                q, t, keep, none = m.score(b.column(0))
                parts.append(pa.StructArray.from_arrays([pa.array(q, mask=none), pa.array(t, mask=none), pa.array(keep)], ["quality_score", "toxic_score", "keep"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("quality_score", pa.float64()), ("toxic_score", pa.float64()), ("keep", pa.bool_())]))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SCORES)


def scored(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, quality_score, toxic_score, keep`` for every row of ``docs``."""
    udf = scorer(docs.sparkSession, train(docs, labels, p)).asNondeterministic()
    return docs.select(F.col("doc_id"), udf(F.col("text")).alias("_s")).select("doc_id", "_s.*")


def kept(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; no shuffle."""
    udf = scorer(docs.sparkSession, train(docs, labels, p))
    ok: Column = udf(F.col("text")).getField("keep")
    return docs.where(ok)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
