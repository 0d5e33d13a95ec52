"""Best-fit packing of documents into token sequences of fixed capacity.

Texts are encoded to the token ids of ``bpe`` once; a document longer than a
sequence is cut into pieces at multiples of the capacity; full pieces are
sequences by themselves.  The other pieces are packed bulk-synchronously.  Each
round

* ranks open gaps and waiting pieces within their size classes,
* sweeps down the sizes, so that each piece meets the tightest gap at or above
  its size that no larger piece took (as brackets match: gaps open, pieces
  close; gap and piece at the same depth belong together),
* resolves pieces that want the same gap by rank (a class's k-th piece takes the
  k-th gap from the top of the stack); a gap that holds several of the largest
  waiting piece takes part with as many slots,
* updates the gaps; pieces without a gap open new sequences, largest first, as
  many as their lengths sum up to,

until no piece waits.  Pieces of a size are a run of ids, and gaps that were filled
alike are runs of sequences, so the rounds run on counts per size in the driver
(``arranged``): what they hold is bounded by the capacity, and one job counts sizes
and one looks places up, whatever the number of rounds.  ``slots`` and ``sweep`` are
the same steps on tables with a row per gap and piece.  Packing moves only numbers;
the token ids are moved twice, to meet their places and to be put together.

Defined results: null and empty texts have no tokens and aren't packed (no
output).  Rows are documents in their own right, so repeated rows are packed once
each.  A text of any length is cut into as many pieces as it fills.  A piece's
number is its place in the order of falling length, ``doc_id`` (nulls first), the
text's hash and the piece's place in its text; ties are broken by that number,
which is the same however the rows are partitioned (pieces equal in all four are
interchangeable), and a sequence has the number of its first piece.  An empty
table gives no sequences.  ``doc_id`` must be castable to bigint; other columns
aren't looked at.  Every token appears exactly once; no sequence exceeds its
capacity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from . import text as X
from .workspace import Workspace, documents


@dataclass(frozen=True)
class Params:
    capacity: int = 8192  # tokens of a sequence
    bpe: bpe.Params = field(default_factory=bpe.Params)


def _piece_rows(p: Params):
    c = p.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = bpe.encoder(p.bpe), bpe.kind(p.bpe)
        for b in X.slices(batches, "text", p.bpe.slice_bytes):
            data, offsets, _ = X.utf8(b.column(1))
            ids, at = enc.encode(data, offsets)
            ids = ids.astype(kind)
            n = np.diff(at)
            count = -(-n // c)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * c
            size = np.minimum(c, n[row] - start)
            first = at[row] + start
            parts = [bpe.blob(ids[i : i + k]) for i, k in zip(first.tolist(), size.tolist(), strict=True)]
            numbers = (pa.array(x.astype(np.int32)) for x in (piece, start, size))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(2).take(pa.array(row)), *numbers, pa.array(parts, pa.binary())], ["doc_id", "h", "piece", "start", "length", "part"])

    return run


def pieces(ws: Workspace, docs: DataFrame, p: Params) -> DataFrame:
    """``row, doc_id, h, piece, start, length, part``, written: each text's ids cut at multiples of the capacity; ``row`` is unique."""
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).where("text <> ''").withColumn("h", F.xxhash64("text"))
    out = src.mapInArrow(_piece_rows(p), "doc_id bigint, h bigint, piece int, start int, length int, part binary")
    return ws.write(out.withColumn("row", F.monotonically_increasing_id()), "pieces")


def numbered(ws: Workspace, rows: DataFrame) -> DataFrame:
    """``rows`` with ``id``, their place by falling length, doc_id, hash and piece.

    Rows are sorted by ranges; a row's place is its place in its range plus the rows of those before,
    of which there is one number per range.
    """
    order = (F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("piece").asc())
    table = ws.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "numbers")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    known = table.withColumn("part", part).join(F.broadcast(first), "part")  # a row per range
    return known.withColumn("id", F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first")


def _placed(events: DataFrame) -> DataFrame:
    """Events with ``at``, their class's exclusive net depth above it, ``above``, the pieces larger, and ``r``, their rank in the class.

    An event is a gap (kind 0) or a piece (kind 1) of a ``size``, or a piece that has opened its sequence (kind 2); the
    sweep goes down the sizes, gaps first.
    """
    counts = events.groupBy("size", "kind").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("size").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    net = F.when(F.col("kind") == 0, F.col("n")).when(F.col("kind") == 1, -F.col("n")).otherwise(0)
    pieces_ = F.when(F.col("kind") == 1, F.col("n")).otherwise(0)
    place = counts.select("size", "kind", F.coalesce(F.sum(net).over(order), F.lit(0)).alias("at"), F.coalesce(F.sum(pieces_).over(order), F.lit(0)).alias("above"))
    rank = F.row_number().over(Window.partitionBy("size", "kind").orderBy("id", "slot"))
    return events.withColumn("r", rank).join(F.broadcast(place), ["size", "kind"])  # at most 2 x capacity rows


_ROW = "struct<kind:int,id:bigint,size:int,bin:bigint,seq:bigint>"


def _row(kind, id_, size, bin_, seq):
    return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), size.alias("size"), bin_.alias("bin"), seq.alias("seq")).cast(_ROW)


def _same():
    return F.struct("kind", "id", "size", F.lit(None).alias("bin"), F.lit(None).alias("seq")).cast(_ROW)


def slots(gaps: DataFrame, most: int) -> DataFrame:
    """``size, kind, id, slot``: each gap (bin, space) as slots of the largest piece's size, the last with what is left over."""
    n = F.greatest(F.floor(F.col("space") / max(most, 1)), F.lit(1)).cast("int")
    each = gaps.select("bin", "space", n.alias("n")).select("bin", "space", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    size = F.when(F.col("slot") < F.col("n") - 1, F.lit(most)).otherwise(F.col("space") - F.col("slot") * most)
    return each.select(size.cast("int").alias("size"), F.lit(0).alias("kind"), F.col("bin").alias("id"), "slot")


def sweep(events: DataFrame, turn: int = 0) -> DataFrame:
    """One round: placements (kind 2), what is left of the slots (0) and pieces that still wait (1)."""
    # a gap raises the depth to its level, a piece lowers it from its level: at a level they alternate
    level = F.when(F.col("kind") == 0, F.col("at") + F.col("r")).when(F.col("kind") == 1, F.col("at") - F.col("r") + 1).otherwise(F.col("id"))
    w = Window.partitionBy("level", F.col("kind") == 2).orderBy(F.col("size").desc(), "kind")
    seen = _placed(events).select("size", "kind", "id", "slot", level.alias("level"))
    seen = seen.withColumn("before", F.lag(F.struct("kind", "id", "size", "slot")).over(w)).withColumn("after", F.lead("kind").over(w))
    gap, piece, none = F.col("kind") == 0, F.col("kind") == 1, F.lit(None)
    got = F.array(
        _row(2, F.col("id"), F.col("size"), F.col("before.id"), F.lit(turn).cast("bigint") * 1_000_000 + F.col("before.slot")),
        _row(0, F.col("before.id"), F.col("before.size") - F.col("size"), none, none),
    )
    opened = F.array(_row(2, F.col("id"), F.col("size"), F.col("id"), F.lit(-1)))
    rows = F.when(F.col("kind") == 2, opened).when(piece & (F.col("before.kind") == 0), got).when(gap & (F.col("after") == 1), F.array().cast(f"array<{_ROW}>")).otherwise(F.array(_same()))
    return seen.select(F.explode(rows).alias("e")).select("e.*").where("size > 0")


# -- rounds on counts


class Places:
    """Where pieces go: runs of consecutive ids that start at ``first``.

    A run's pieces go ``width`` to a sequence, to those from ``bin`` on upwards (step 1) or downwards (-1); the last of a
    sequence's comes at ``off``, those before it by ``size`` further on each.
    """

    NAMES = ("first", "bin", "step", "width", "off", "size")

    def __init__(self, runs: list[tuple[int, ...]]):
        t = np.array(sorted(runs), np.int64).reshape(len(runs), len(self.NAMES)).T
        self.first, self.bin, self.step, self.width, self.off, self.size = (np.ascontiguousarray(x) for x in t)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's sequence and place in it."""
        run = np.searchsorted(self.first, ids, side="right") - 1
        at, k = np.divmod(ids - self.first[run], self.width[run])
        return self.bin[run] + self.step[run] * at, self.off[run] + (self.width[run] - 1 - k) * self.size[run]


def _filled(gap: tuple[int, int, int], c: int, slots_: list[tuple[int, ...]], last: list[tuple[int, ...]], width: int, runs: list[tuple[int, ...]]) -> Iterator[tuple[int, int, int]]:
    """What is left of the sequences of a gap, as gaps; ``slots_`` (``width`` to a sequence) and ``last`` (one) are what took
    them: first and end of the slots, the piece that has the last of these, and the pieces' size."""
    lo, n, space = gap
    edge = {0, n, *(e for x, y, _, _ in last for e in (x, y))}
    for x, y, _, _ in slots_:
        edge |= {x // width, -(-x // width), y // width, -(-y // width)}
    slots_, last, cut = sorted(slots_), sorted(last), sorted(edge)
    i = j = 0
    for u, v in zip(cut[:-1], cut[1:], strict=True):  # sequences that are filled alike, or one
        used = 0
        for kind, k, m in ((slots_, i, width), (last, j, 1)):
            while k < len(kind) and kind[k][1] <= u * m:
                k += 1
            i, j = (k, j) if kind is slots_ else (i, k)
            while k < len(kind) and kind[k][0] < v * m:
                x, y, piece, size = kind[k]
                begin, end = max(x, u * m), min(y, v * m)
                each = (end - begin) // (v - u)
                runs.append((piece + y - end, lo + v - 1, -1, each, c - space + used, size))
                used += each * size
                k += 1
        if used < space:
            yield lo + u, v - u, space - used


def arranged(classes: list[tuple[int, int, int]], c: int) -> Places:
    """All rounds, on runs of pieces and of gaps: ``classes`` has the size, first id and number of pieces of each size.

    Pieces of a size that wait are a run of ids, and sequences of consecutive ids with as much room are a gap (first,
    number, space), as what is filled alike stays together.  A round adds a few gaps for each size that waits, so their
    number is bounded by the capacity, whatever the number of pieces.
    """
    runs = [(first, first, 1, 1, 0, c) for size, first, n in classes if size == c and n]
    waiting = sorted(((s, first, n) for s, first, n in classes if s < c and n), reverse=True)
    gaps: list[tuple[int, int, int]] = []
    before = 0
    while waiting:
        count, length = sum(n for _, _, n in waiting), sum(s * n for s, _, n in waiting)
        least, most, room = waiting[-1][0], waiting[0][0], sum(n * space for _, n, space in gaps)
        # as many sequences as the room lacks; one at least if the gaps took nothing
        want = max(-(-(length - room) // c), int(count == before or room < least))
        before = count
        gaps = [g for g in gaps if g[2] >= least]
        entries = []  # size, first sequence, slots to a sequence, gap, whether each sequence's last slot
        for g, (lo, n, space) in enumerate(gaps):
            k = max(space // most, 1)
            rest = space - (k - 1) * most
            if k == 1 or rest == most:
                entries.append((min(space, rest), lo, k, g, False))
            else:
                entries += [(most, lo, k - 1, g, False), (rest, lo, 1, g, True)]
        if want > 0:
            left, above = [], 0
            for s, first, n in waiting:
                k = n if s > c // 2 else min(max(want - above, 0), n)
                above += n
                if k:
                    runs.append((first, first, 1, 1, 0, s))
                    entries.append((c - s, first, 1, len(gaps), False))
                    gaps.append((first, k, c - s))
                if k < n:
                    left.append((s, first + k, n - k))
            waiting = left
        entries.sort(key=lambda e: (-e[0], e[1]))
        took: dict[tuple[int, bool], list[tuple[int, ...]]] = {}
        stack: list[list] = []  # gap, last, slots left
        left, e = [], 0
        for s, first, n in waiting:
            while e < len(entries) and entries[e][0] >= s:
                _, _, width, g, end = entries[e]
                stack.append([g, end, width * gaps[g][1]])
                e += 1
            while n and stack:
                g, end, free = top = stack[-1]
                k = min(n, free)
                took.setdefault((g, end), []).append((free - k, free, first, s))
                first, n, top[2] = first + k, n - k, free - k
                if k == free:
                    stack.pop()
            if n:
                left.append((s, first, n))
        waiting = left
        width = {g: w for _, _, w, g, end in entries if not end}
        new = []
        for g, gap in enumerate(gaps):
            a, b = took.get((g, False), []), took.get((g, True), [])
            new += _filled(gap, c, a, b, width[g], runs) if a or b else [gap]
        gaps = []
        for lo, n, space in sorted(new):
            if gaps and gaps[-1][2] == space and gaps[-1][0] + gaps[-1][1] == lo:
                gaps[-1] = (gaps[-1][0], gaps[-1][1] + n, space)
            else:
                gaps.append((lo, n, space))
    return Places(runs)


def _placed_rows(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, off = places.value.of(b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins), pa.array(off.astype(np.int32))], ["key", "bin", "off"])

    return run


def assigned(ws: Workspace, items: DataFrame, p: Params, key: str = "id") -> DataFrame:
    """``key, bin, off`` for items with ``id, length`` (0 < length <= capacity; ids number the items by falling length)."""
    found = items.groupBy("length").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).collect()  # a row per size
    if any(r.last - r.first + 1 != r.n for r in found):
        raise ValueError("ids must number the items by falling length")
    places = ws.spark.sparkContext.broadcast(arranged([(r.length, r.first, r.n) for r in found], p.capacity))
    return items.select(F.col(key).alias("key"), "id").mapInArrow(_placed_rows(places), "key bigint, bin bigint, off int").withColumnRenamed("key", key)


# -- sequences


SEQUENCES = "bin_id bigint, n_tokens int, doc_ids array<bigint>, pieces array<int>, starts array<int>, offsets array<int>, tokens array<int>"
_OUT = 64  # sequences of a batch


def _sequence_rows(kind: str):
    """Sequences of a stream of pieces sorted by sequence and place."""

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bins, size = t.column("bin").to_numpy(), t.column("length").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(bins[1:] != bins[:-1]) + 1, [len(bins)]])
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        for i in range(0, len(edge) - 1, _OUT):
            e = edge[i : i + _OUT + 1]
            some = t.slice(e[0], e[-1] - e[0])
            ids = np.concatenate([bpe.unblob(x, kind) for x in some.column("part").to_pylist()]).astype(np.int32)
            each, tok = pa.array((e - e[0]).astype(np.int32)), pa.array((at[e] - at[e[0]]).astype(np.int32))
            of = lambda c, some=some, each=each: pa.ListArray.from_arrays(each, some.column(c).combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins[e[:-1]]), pa.array(np.diff(at[e]).astype(np.int32)), of("doc_id"), of("piece"), of("start"), of("off"), pa.ListArray.from_arrays(tok, pa.array(ids))],
                ["bin_id", "n_tokens", "doc_ids", "pieces", "starts", "offsets", "tokens"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for b in X.slices([batch], "part"):
                bins = b.column(0).to_numpy()
                if held and held[-1].column(0)[0].as_py() != bins[-1] or not held and bins[0] != bins[-1]:
                    end = int(np.flatnonzero(bins != bins[-1])[-1]) + 1 if bins[0] != bins[-1] else 0
                    yield from made(pa.Table.from_batches([*held, b.slice(0, end)]))
                    held = [b.slice(end)]
                else:
                    held.append(b)
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


def packed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Sequences: ``bin_id, n_tokens, tokens``, and which piece of which document begins at which offset.

    ``doc_ids, pieces, starts, offsets`` have an entry per piece, in the sequence's order: the document,
    the piece's number and first token in it, and its first token in the sequence.
    """
    ws = Workspace(docs.sparkSession, "packing")
    every = pieces(ws, docs, p)
    table = numbered(ws, every.select("row", "doc_id", "h", "piece", "length"))
    at = assigned(ws, table, p, "row")
    met = every.select("row", "doc_id", "piece", "start", "length", "part").join(at, "row").select("bin", "off", "doc_id", "piece", "start", "length", "part")
    return met.repartition("bin").sortWithinPartitions("bin", "off").mapInArrow(_sequence_rows(bpe.kind(p.bpe)), SEQUENCES)


def unpacked(sequences: DataFrame) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_offset, tokens`` for every piece of the sequences."""
    places = F.arrays_zip("doc_ids", "pieces", "starts", "offsets", F.slice(F.concat("offsets", F.array("n_tokens")), F.lit(2), F.size("offsets")).alias("ends"))
    each = sequences.select("bin_id", "tokens", F.explode(places).alias("p"))
    size = F.col("p.ends") - F.col("p.offsets")
    return each.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), size.alias("length"), "bin_id", F.col("p.offsets").alias("bin_offset"), F.slice("tokens", F.col("p.offsets") + 1, size).alias("tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir, "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)
