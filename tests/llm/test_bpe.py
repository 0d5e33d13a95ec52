import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeworks.llm import bpe as B
from fringeworks.llm import text as X
from fringeworks.llm.workspace import Workspace

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def vocab():
    return B.vocabulary(B.Params().vocabulary)


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def encode(encoder, texts):
    data, offsets, _ = X.utf8(pa.array(texts, pa.string()))
    ids, at = encoder.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\t''abdelmrstvST1٣,.!-"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_equals_the_public_encoder(vocab, reference, texts):
    got = encode(B.Encoder(vocab), texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [vocab.decode(np.array(g, np.int64)).tobytes().decode() for g in got] == texts


def test_long_pieces_and_forgetting(vocab, reference):
    rng = random.Random(1)
    texts = ["a" * 5000, " " * 300 + "x", "".join(rng.choice("thean") for _ in range(900)), *("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 60))) for _ in range(400))]
    e = B.Encoder(vocab, None, memory=10)
    for _ in range(2):
        assert encode(e, texts) == [reference.encode_ordinary(t) for t in texts]


def test_lexicon_finds_exactly_its_words(vocab, tmp_path):
    words = [b" the", b" then", b" thing", b"ring", b"king", b" a", b"a", "été".encode()]
    lex = B.Lexicon.build(words, vocab)
    lex = B.Lexicon.load(lex.save(str(tmp_path / "lexicon.bin")))
    asked = [*words, b" th", b"", b" thens", b"rin", b"zing", b"\xc3"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    got = lex.lookup(data, ends - [len(w) for w in asked], ends)
    assert got.tolist() == [sorted(words).index(w) for w in words] + [-1] * 6
    for w, n in zip(words, got):
        assert lex.ids[lex.off[n] : lex.off[n + 1]].tolist() == vocab.merge(w)
    assert len(lex.final) < sum(len(w) for w in words)  # suffixes are shared


def test_messy(spark, messy, nothing, reference):
    p = B.Params(slice_bytes=1 << 16)
    rows = B.encoded(messy, p).collect()
    assert len(rows) == messy.count()
    text = {r.doc_id: r.text for r in messy.where("doc_id is not null").collect()}
    for r in rows:
        if r.doc_id == 3:
            assert r.ids is None and r.n_tokens is None and r.roundtrip is None
        elif r.doc_id is not None:
            assert r.roundtrip and r.n_tokens == len(r.ids) and r.ids == reference.encode_ordinary(text[r.doc_id])
    back = B.decoded(spark.createDataFrame(rows, "doc_id long, n_tokens int, ids array<int>, roundtrip boolean")).collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in back) == sorted((repr(r.doc_id), repr(r.text)) for r in messy.collect())
    assert B.encoded(nothing, p).count() == 0


def test_lexicon_changes_nothing(spark, messy):
    one = sorted(map(repr, B.encoded(messy, B.Params()).collect()))
    path = B.lexicon(Workspace(spark, "t"), messy, B.Params(lexicon=0))
    assert sorted(map(repr, B.encoded(messy, B.Params(), path).collect())) == one


def test_the_lexicon_holds_the_oftenest_pieces_of_all_documents(spark, reference):
    """Pieces are counted over all tasks, whatever the partitions; those of equal number are in together."""
    import collections

    import regex

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(13)
    count = collections.Counter(w for t in texts for w in regex.findall(PATTERN, t))
    found = B.frequent(Workspace(spark, "t"), docs, B.Params(lexicon=50, slice_bytes=200))
    assert 30 <= len(found) <= 50
    least = min(count[w.decode()] for w in found)
    assert {w.decode() for w in found} == {w for w, n in count.items() if n >= least}


def test_equal_hashes_are_merged_apart(vocab, reference, monkeypatch):
    """If all pieces had one hash the ids would still be those of each piece."""
    monkeypatch.setattr(B.X, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["the thing and then", "", "another, it's"]
    assert encode(B.Encoder(vocab), texts) == [reference.encode_ordinary(t) for t in texts]
