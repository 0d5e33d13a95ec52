import numpy as np
import pytest

from fringeworks.llm import bpe
from fringeworks.llm import packing as K
from fringeworks.llm.workspace import Workspace, documents

from .conftest import SF

VOCAB = bpe.vocabulary(bpe.Params().vocabulary)


def check(docs, sequences, p):
    """Texts come back from the sequences; no sequence is over-full; number of sequences, and the least there can be."""
    parts, total = {}, 0
    for r in sequences.collect():
        assert len(r.tokens) == r.n_tokens <= p.capacity and r.offsets[0] == 0
        assert len(r.doc_ids) == len(r.pieces) == len(r.starts) == len(r.offsets)
        total += r.n_tokens
    rows = K.unpacked(sequences).collect()
    assert sum(r.length for r in rows) == total
    for r in rows:
        assert 0 < r.length == len(r.tokens) and r.start == r.piece * p.capacity
        parts.setdefault((r.doc_id, r.piece), []).append(r)
    got = []
    for (i, piece), v in parts.items():
        if piece == 0:
            for k in range(len(v)):  # repeated rows have equal pieces
                ids, n = [], 0
                while (i, n) in parts:
                    if k >= len(parts[i, n]):
                        break
                    ids += parts[i, n][k].tokens
                    n += 1
                got.append((i, VOCAB.decode(np.array(ids)).tobytes().decode()))
    assert sorted(got, key=repr) == sorted([(i, t) for i, t in docs if t], key=repr)
    return sequences.count(), -(-total // p.capacity)


def test_messy(messy, nothing):
    p = K.Params(capacity=64)
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    n, least = check(docs, K.packed(messy, p).cache(), p)
    assert n <= least + 3
    assert K.packed(nothing, p).count() == 0


def test_corpus_is_close_to_the_lower_bound(spark):
    p = K.Params()
    docs = documents(spark, SF)
    n, least = check([(r.doc_id, r.text) for r in docs.collect()], K.packed(docs, p).cache(), p)
    assert n <= 1.02 * least + 1


def test_the_same_whatever_the_partitions(spark):
    docs = documents(spark, SF, "doc_id", "text")
    docs = docs.union(docs.limit(40))
    p = K.Params(capacity=512)
    found = [sorted(map(repr, K.packed(d, p).collect())) for d in (docs.coalesce(1), docs.repartition(3), docs.repartition(7, "text").sortWithinPartitions("doc_id"))]
    assert found[0] == found[1] == found[2]


def rounds(sizes, c):
    """The rounds of the packing one piece at a time: {id: (bin, place)}."""
    waiting, room, bins, before = dict(sizes), {}, {}, 0
    while waiting:
        least, most = min(waiting.values()), max(waiting.values())
        events = [(s, 1, i, 0) for i, s in waiting.items()]
        for b, space in room.items():
            if space >= least:
                n = max(space // most, 1)
                events += [(most if k < n - 1 else space - k * most, 0, b, k) for k in range(n)]
        all_room = sum(room.values())
        want = max(-(-(sum(waiting.values()) - all_room) // c), int(len(waiting) == before or all_room < least))
        before = len(waiting)
        order = sorted(waiting, key=lambda i: (-waiting[i], i))
        for k, i in enumerate(order):
            if want > 0 and (waiting[i] > c // 2 or k < want):
                bins.setdefault(i, []).append(i)
                room[i] = c - sizes[i]
                events.remove((sizes[i], 1, i, 0))
                events.append((c - sizes[i], 0, i, 0))
                del waiting[i]
        stack, got = [], []
        for s, kind, i, slot in sorted(events, key=lambda e: (-e[0], e[1], e[2], e[3])):
            if kind == 0:
                stack.append((i, slot))
            elif stack:
                got.append((stack.pop(), i))
        for (b, _), i in sorted(got):
            bins.setdefault(b, []).append(i)
            room[b] -= sizes[i]
            del waiting[i]
    out = {}
    for b, ids in bins.items():
        at = 0
        for i in ids:
            out[i] = (b, at)
            at += sizes[i]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_all_rounds_equal_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    c = 40
    sizes = {i: int(s) for i, s in enumerate(sorted(np.minimum(r.geometric(0.12, 70), c - 1).tolist(), reverse=True))}
    items = spark.createDataFrame(list(sizes.items()), "id long, length int")
    got = {x.id: (x.bin, x.off) for x in K.assigned(Workspace(spark, "t"), items, K.Params(capacity=c)).collect()}
    assert got == rounds(sizes, c)


def brute(gaps, items):
    """Pieces by falling size, each taking the tightest gap left; gaps of a size and pieces of a size by rank."""
    events = sorted([(-s, 0, i) for i, s in gaps] + [(-s, 1, i) for i, s in items])
    stack, out = [], {}
    for s, kind, i in events:
        if kind == 0:
            stack.append(i)
        elif stack:
            out[i] = stack.pop()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sweep_matches_a_stack(spark, seed):
    r = np.random.default_rng(seed)
    gaps = [(int(i), int(s)) for i, s in enumerate(r.integers(1, 12, 40))]
    items = [(int(i), int(s)) for i, s in enumerate(r.integers(1, 12, 60))]
    events = spark.createDataFrame([(s, 0, i, 0) for i, s in gaps] + [(s, 1, i, 0) for i, s in items], "size int, kind int, id long, slot int")
    rows = K.sweep(events).collect()
    want = brute(gaps, items)
    assert {x.id: x.bin for x in rows if x.kind == 2} == want
    assert sorted(x.id for x in rows if x.kind == 1) == sorted(set(dict(items)) - set(want))
    left = dict(gaps)
    for i, g in want.items():
        left[g] -= dict(items)[i]
    assert {x.id: x.size for x in rows if x.kind == 0} == {g: s for g, s in left.items() if s}


def test_slots_share_out_a_gap(spark):
    gaps = spark.createDataFrame([(1, 100), (2, 7), (3, 20)], "bin long, space int")
    got = {}
    for r in K.slots(gaps, 10).collect():
        got.setdefault(r.id, []).append((r.slot, r.size))
    assert sorted(got[1]) == [(k, 10) for k in range(10)] and got[2] == [(0, 7)] and sorted(got[3]) == [(0, 10), (1, 10)]


def test_jobs_do_not_follow_the_rounds(spark):
    r = np.random.default_rng(5)
    sizes = sorted(np.minimum(r.geometric(0.02, 400), 199).tolist(), reverse=True)
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, length int")
    spark.sparkContext.setJobGroup("packing-rounds", "")
    try:
        got = K.assigned(Workspace(spark, "t"), items, K.Params(capacity=200)).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {x.id: (x.bin, x.off) for x in got} == rounds(dict(enumerate(sizes)), 200)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("packing-rounds")) <= 3


@pytest.mark.parametrize("seed", range(30))
def test_places_are_whole_for_any_sizes(seed):
    r = np.random.default_rng(seed)
    c = int(r.integers(3, 60))
    sizes = np.sort(np.maximum(np.minimum(r.geometric(r.uniform(0.03, 0.6), 300) if seed % 2 else r.integers(1, c + 1, 300), c), 1))[::-1]
    each, first, n = np.unique(-sizes, return_index=True, return_counts=True)
    bins, off = K.arranged(list(zip((-each).tolist(), first.tolist(), n.tolist(), strict=True)), c).of(np.arange(len(sizes)))
    filled = {}
    for b, at, size in sorted(zip(bins.tolist(), off.tolist(), sizes.tolist(), strict=True)):
        assert at == filled.get(b, 0)  # pieces follow each other
        filled[b] = at + size
    assert max(filled.values()) <= c and all(bins[b] == b and off[b] == 0 for b in filled)


def test_runs_do_not_grow_with_the_pieces():
    sizes = list(range(199, 0, -1))
    runs = []
    for n in (10, 1000):
        places = K.arranged([(s, i * n, n) for i, s in enumerate(sizes)], 200)
        runs.append(len(places.first))
    assert runs[1] <= 1.2 * runs[0]
