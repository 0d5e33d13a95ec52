import math
import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from fringeworks.llm import license as C


def words(t):
    return {w.decode() for w in C.words_of(t)}


def brute(texts, p):
    out = []
    for i, t in enumerate(texts):
        for b, line in enumerate((t or "").split("\n")):
            for name, template in p.templates:
                ts = words(template)
                n = len(ts & words(line))
                if ts and n >= max(1, math.ceil(p.containment * len(ts) - 1e-9)):
                    out.append((i, b, name, n))
    return sorted(out)


TEMPLATES = (("x", "a b c d e"), ("y", "c d"), ("z", "e f g"), ("none", "..."))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcdefgh \n.", max_size=40)), max_size=6), st.sampled_from([0.3, 0.5, 0.67, 0.8, 1.0]))
def test_join_is_exact(texts, threshold):
    p = C.Params(threshold, TEMPLATES)
    for frequency in (None, {C._hash(b"c"): 9, C._hash(b"d"): 3, C._hash(b"a"): 5}):
        index = C.Index(p, frequency)
        got = sorted((i, b, index.names[t], n) for i, b, t, n in index.search(pa.array(texts, pa.string())))
        assert got == brute(texts, p)


@pytest.mark.parametrize("name,template", C.TEMPLATES)
def test_templates_find_themselves(spark, name, template):
    index = C.Index(C.Params())
    if name == "mit-full":
        assert len(index.sets[index.names.index(name)]) > 50
    got = index.search(pa.array(["Some prose first.\n" + re.sub(r"\s+", "  ", template.upper()) + " And more."]))
    assert name in {index.names[t] for _, _, t, _ in got} and all(b == 1 for _, b, _, _ in got)


def test_messy(spark, messy, nothing):
    assert C.scanned(messy).count() == 0
    p = C.Params(0.5, (("fox", "quick brown fox"),))
    got = [tuple(r) for r in C.scanned(messy, p).collect()]
    assert got.count((1, 0, "fox", 3, 1.0)) == 2 and got.count((2, 0, "fox", 3, 1.0)) == 1 and len(got) == 3
    assert C.scanned(nothing).count() == 0


@pytest.mark.parametrize("name,template", C.TEMPLATES)
def test_wrapped_templates_are_found(name, template):
    index = C.Index(C.Params())
    for sign in ("", "# ", " * ", "// "):
        for width in (40, 60, 72, 80):
            wrapped = "\n".join(sign + x for x in textwrap.wrap("Some prose comes first. " + template + " And more.", width - len(sign)))
            got = index.passages(pa.array([None, "none", wrapped]))
            assert (2, name, len(index.sets[index.names.index(name)])) in {(d, index.names[t], n) for d, _, t, n in got}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcdefgh \n.", max_size=60)), max_size=5), st.sampled_from([0.5, 0.8, 1.0]))
def test_passages_are_where_a_window_meets_the_threshold(texts, threshold):
    p = C.Params(threshold, TEMPLATES)
    index = C.Index(p, {C._hash(b"c"): 9})
    want = set()
    for i, t in enumerate(texts):
        ws = re.findall("[a-z]+", t or "")
        for k, (s, need, width) in enumerate(zip(index.sets, index.need, index.window)):
            names = {index.words[o].decode() for o in s}
            if any(len(names & set(ws[j : j + width])) >= need for j in range(len(ws))):
                want.add((i, k))
    got = index.passages(pa.array(texts, pa.string()))
    assert {(i, k) for i, _, k, _ in got} == want


def test_passages_messy(spark, messy, nothing):
    assert C.passages(messy).count() == 0 and C.passages(nothing).count() == 0
    got = [tuple(r) for r in C.passages(messy, C.Params(0.5, (("fox", "quick brown fox"),))).collect()]
    assert got.count((1, 1, "fox", 3, 1.0)) == 2 and got.count((2, 1, "fox", 3, 1.0)) == 1 and len(got) == 3


def test_templates_of_a_table(spark, messy):
    table = spark.createDataFrame([("fox", "quick brown fox"), ("none", None), (None, "x")], "name string, text string")
    p = C.Params.of(table, containment=0.5)
    assert p.templates == (("fox", "quick brown fox"),) and C.passages(messy, p).count() == 3
    with pytest.raises(ValueError):
        C.Params.of(table.union(table), most=1)


def test_sql_equals_the_passages_of_wrapped_notices(spark):
    import duckdb

    rows = []
    for k, (_, t) in enumerate(C.TEMPLATES):
        gap = " filler words between the copies of this and that " * (k % 4 * 3)
        rows.append((k, "Prose.\n" + "\n".join("# " + x for x in textwrap.wrap(t, 50)) + gap + t.upper() + " end of it"))
    rows += [(99, None), (98, ""), (97, "the license is granted to any person"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    got = sorted(map(tuple, C.passages(docs).collect()))
    assert got == sorted(tuple(r) for r in c.sql(C.ORACLE).fetchall()) and len(got) > 2 * len(C.TEMPLATES)
