"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of words anywhere in a text, whatever its line breaks and
comment signs; it has ``slack`` times the words of the template it is held
against.  Blocks and templates are sets of words.  A pair is found if the block
holds at least ``containment`` of the template's words; overlapping blocks that do
are one passage, given by its best block (the first of equal ones).  The words are
ordered by their frequency in all documents, rarest first; then

* prefix filter: a template of n words that needs m of them must share one of
  its n - m + 1 rarest words, so only blocks near one of these are looked at,
* length filter: a stretch of blocks must hold m template words at all,
* positional filter: words further than a block from the next can't be in one,

and what remains is verified on the words themselves (not their hashes).
Templates are few (``Params.most`` at most), so they go with the task; documents aren't shuffled.

``scanned`` takes lines as blocks: the form in which a notice stands alone.

Defined results: null and empty texts and blocks without words match nothing; a
template without words is ignored.  Words of equal frequency are ordered by
hash.  Every row is treated alone, so repeated rows give repeated pairs, null
``doc_id`` is carried along, and other columns aren't looked at.  A text of any length is
read whole.  An empty table gives no rows.  ``doc_id`` must be castable to bigint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .sql import FOLDED, WORD
from .workspace import documents

TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    (
        "mit-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class Params:
    containment: float = 0.9
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    slack: float = 1.5
    most: int = 10_000

    @classmethod
    def of(cls, table: DataFrame, **more) -> Params:
        """With the templates of a table (``name, text``), of which there may be ``most``."""
        p = cls(**more)
        rows = table.select("name", "text").where("name is not null and text is not null").limit(p.most + 1).collect()
        if len(rows) > p.most:
            raise ValueError(f"more than {p.most} templates")
        return replace(p, templates=tuple(sorted((r.name, r.text) for r in rows)))


def words_of(text: str) -> list[bytes]:
    """Distinct folded words, in the order of their first places."""
    raw = np.frombuffer(text.encode(), np.uint8)
    f = X.folded(raw)
    starts, ends, _ = X.spans(f, np.array([0, len(raw)]))
    return list(dict.fromkeys(f[a:b].tobytes() for a, b in zip(starts, ends, strict=True)))


def _hash(word: bytes) -> int:
    f = np.frombuffer(word, np.uint8)
    return int(X.hashes(f, np.array([0]), np.array([len(f)]))[0])


def _length(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return len(X.spans(X.folded(raw), np.array([0, len(raw)]))[0])


class Index:
    """Templates as sorted ordinals of their words, rarest first, and what each needs."""

    def __init__(self, p: Params, frequency: dict[int, int] | None = None):
        self.names, self.window, sets = [], [], []
        for name, text in p.templates:
            words = words_of(text)
            if words:
                self.names.append(name)
                self.window.append(math.ceil(p.slack * _length(text)))
                sets.append(words)
        every = {w: _hash(w) for ws in sets for w in ws}
        order = sorted(every, key=lambda w: ((frequency or {}).get(every[w], 0), every[w]))
        self.words = order
        self.hashes = np.array([every[w] for w in order], np.uint64)
        self.sorted = np.argsort(self.hashes)
        place = {w: i for i, w in enumerate(order)}
        self.sets = [sorted(place[w] for w in ws) for ws in sets]
        self.need = [max(1, math.ceil(p.containment * len(s) - 1e-9)) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (s, m) in enumerate(zip(self.sets, self.need, strict=True)):
            for at, o in enumerate(s[: len(s) - m + 1]):
                self.prefix.setdefault(o, []).append((t, at))
        self.starts = np.zeros(len(order), bool)
        self.starts[list(self.prefix)] = True
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of template words, and their ordinals."""
        at = np.flatnonzero(self.gate[(h >> np.uint64(48)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self.hashes[self.sorted]
        where = np.minimum(np.searchsorted(low, h[at]), len(low) - 1)
        good = low[where] == h[at]
        return at[good], self.sorted[where[good]]

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, block, template, overlap) of every pair that meets the threshold."""
        data, offsets, _ = X.utf8(column)
        f = X.folded(data)
        starts, ends, _ = X.spans(f, offsets)
        at, ordinal = self.hits(X.hashes(f, starts, ends))
        if not len(at):
            return []
        breaks = np.flatnonzero(data == 10)
        doc = np.searchsorted(offsets, starts[at], side="right") - 1
        line = np.searchsorted(breaks, starts[at])
        block = line - np.searchsorted(breaks, offsets[doc])
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])
        group = np.cumsum(edge) - 1
        cut = np.concatenate([np.flatnonzero(edge), [len(at)]])
        out = []
        for g in np.unique(group[self.starts[ordinal]]):
            a, b = cut[g], cut[g + 1]
            have = np.unique(ordinal[a:b]).tolist()
            tried = set()
            for q, o in enumerate(have):
                for t, place in self.prefix.get(o, ()):
                    if t in tried:
                        continue
                    tried.add(t)
                    need = self.need[t]
                    if len(have) < need or 1 + min(len(self.sets[t]) - place - 1, len(have) - q - 1) < need:
                        continue
                    real = {f[s:e].tobytes() for s, e in zip(starts[at[a:b]], ends[at[a:b]], strict=True)}
                    overlap = sum(self.words[x] in real for x in self.sets[t])
                    if overlap >= need:
                        out.append((int(doc[a]), int(block[a]), t, overlap))
        return out

    def passages(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, first word, template, overlap) of every passage of any lines that meets the threshold."""
        data, offsets, _ = X.utf8(column)
        f = X.folded(data)
        starts, ends, first = X.spans(f, offsets)
        at, ordinal = self.hits(X.hashes(f, starts, ends))
        doc = np.searchsorted(first, at, side="right") - 1
        out = []
        for t, (s, need, width) in enumerate(zip(self.sets, self.need, self.window, strict=True)):
            inside, rare = np.zeros(len(self.words), bool), np.zeros(len(self.words), bool)
            inside[s] = True
            rare[s[: len(s) - need + 1]] = True
            mine = np.flatnonzero(inside[ordinal])
            seed = at[mine][rare[ordinal[mine]]]
            if not len(seed):
                continue
            k = np.searchsorted(seed, at[mine])
            near = (seed[np.minimum(k, len(seed) - 1)] - at[mine] < width) & (k < len(seed)) | (at[mine] - seed[k - 1] < width) & (k > 0)
            mine = mine[near]
            cut = np.flatnonzero((np.diff(at[mine]) >= width) | (np.diff(doc[mine]) > 0)) + 1
            for run in np.split(mine, cut):
                if len(run) >= need:
                    out += [(int(doc[run[0]]), int(a - first[doc[run[0]]]), t, n) for a, n in self._slide(f, starts, ends, at[run].tolist(), set(s), need, width)]
        return sorted(out)

    def _slide(self, f: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: list[int], inside: set[int], need: int, width: int) -> Iterator[tuple[int, int]]:
        """First word and overlap of the best window of each stretch of overlapping windows that meet the threshold."""
        names = {self.words[o] for o in inside}
        words = [f[starts[a] : ends[a]].tobytes() for a in at]
        held: dict[bytes, int] = {}
        left, end, best = 0, -1, (0, 0)
        for right, (a, w) in enumerate(zip(at, words, strict=True)):
            if w in names:  # equal hashes of other words don't count
                held[w] = held.get(w, 0) + 1
            while a - at[left] >= width:
                old = words[left]
                if old in held:
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                left += 1
            if len(held) >= need:
                if best[1] and at[left] > end:
                    yield best
                    best = (0, 0)
                if len(held) > best[1]:
                    best = (at[left], len(held))
                end = a
        if best[1]:
            yield best


def _counts(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(p)
        total = np.zeros(len(index.words), np.int64)
        for b in X.slices(batches, "text"):
            data, offsets, _ = X.utf8(b.column(0))
            f = X.folded(data)
            starts, ends, _ = X.spans(f, offsets)
            _, ordinal = index.hits(X.hashes(f, starts, ends))
            total += np.bincount(ordinal, minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(index.hashes.view(np.int64)), pa.array(total)], ["h", "n"])

    return run


def frequencies(docs: DataFrame, p: Params) -> dict[int, int]:
    """Occurrences, in all documents, of each word of any template."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(p), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return {r.h & (2**64 - 1): r.n for r in rows.collect()}  # as many rows as templates have words


def _search(index: Index, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches, "text"):
            found = (index.passages if whole else index.search)(b.column(1))
            if found:
                row, block, t, n = map(list, zip(*found, strict=True))
                share = [x / len(index.sets[y]) for x, y in zip(n, t, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(block, pa.int32()), pa.array([index.names[y] for y in t]), pa.array(n, pa.int32()), pa.array(share, pa.float64())],
                    ["doc_id", "word" if whole else "block", "template", "overlap", "containment"],
                )

    return run


def scanned(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, block, template, overlap, containment`` for every pair at or above the threshold."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(p, frequencies(docs, p))
    return src.mapInArrow(_search(index), "doc_id bigint, block int, template string, overlap int, containment double")


def passages(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, word, template, overlap, containment`` for every passage, wrapped or not; ``word`` is the index of its first word."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(p, frequencies(docs, p))
    return src.mapInArrow(_search(index, True), "doc_id bigint, word int, template string, overlap int, containment double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir, "doc_id", "text"))


def _oracle(p: Params = Params()) -> str:
    """Of each template word's places, the block that ends there; runs of overlapping blocks over the threshold, and the best of each."""
    index = Index(p)
    rows = ", ".join("('{}', [{}], {}, {})".format(n, ", ".join(f"'{index.words[o].decode()}'" for o in s), m, w) for n, s, m, w in zip(index.names, index.sets, index.need, index.window, strict=True))
    return f"""
WITH templates(template, ts, need, width) AS (VALUES {rows}),
names AS (SELECT template, unnest(ts) AS w FROM templates), every AS (SELECT DISTINCT w FROM names),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS ws FROM documents),
places AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
few AS MATERIALIZED (SELECT r, doc_id, w, pos FROM places JOIN every USING (w)),
hits AS MATERIALIZED (SELECT r, doc_id, template, w, pos, need, width FROM few JOIN names USING (w) JOIN templates USING (template)),
blocks AS (SELECT b.r, b.doc_id, b.template, b.pos AS right_, b.need, min(a.pos) AS left_, count(DISTINCT a.w) AS overlap FROM hits b JOIN hits a ON a.r = b.r AND a.template = b.template AND a.pos <= b.pos AND a.pos > b.pos - b.width GROUP BY ALL),
good AS (SELECT * FROM blocks WHERE overlap >= need),
runs AS (SELECT *, left_ > coalesce(lag(right_) OVER o, -1) AS fresh FROM good WINDOW o AS (PARTITION BY r, template ORDER BY right_)),
passages AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY r, template ORDER BY right_) AS passage FROM runs),
best AS (SELECT * FROM passages QUALIFY row_number() OVER (PARTITION BY r, template, passage ORDER BY overlap DESC, right_) = 1)
SELECT doc_id, left_::INTEGER AS word, template, overlap::INTEGER AS overlap, overlap::DOUBLE / len(ts) AS containment FROM best JOIN templates USING (template)
"""


ORACLE = _oracle()
