import numpy as np
import pytest

import corpus_pipeline
from fringeworks.llm import bpe, packing, pii, quality, simhash
from fringeworks.llm.workspace import documents

from .conftest import SF


def test_stages_on_the_corpus(spark):
    docs = documents(spark, SF)
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs)
    first, second, third, last = seen
    whole = documents(spark, SF)
    assert first.columns == second.columns == third.columns == whole.columns
    keep = {r.doc_id for r in quality.query(spark, SF).where("keep").collect()}
    assert {r.doc_id for r in first.collect()} == keep
    groups = {r.doc_id: r.group_id for r in simhash.grouped(first).collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(groups.values()))
    clean = {r.doc_id: r.text for r in pii.redacted(second).collect()}
    assert {r.doc_id: r.text for r in third.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in third.collect())
    assert rebuilt(last) == {i: t for i, t in clean.items() if t}


def rebuilt(sequences):
    """Texts by doc_id, from the sequences alone."""
    vocab, ids = bpe.vocabulary(bpe.Params().vocabulary), {}
    for r in sorted(packing.unpacked(sequences).collect(), key=lambda r: (r.doc_id, r.piece)):
        ids.setdefault(r.doc_id, []).extend(r.tokens)
    return {i: vocab.decode(np.array(x)).tobytes().decode() for i, x in ids.items()}


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    clean = pii.redacted(simhash.kept(quality.stage(spark, documents(spark, SF), SF)))
    assert rebuilt(got) == {r.doc_id: r.text for r in clean.collect() if r.text}


@pytest.fixture
def folder(messy, nothing, labels, tmp_path):
    """Tables of messy, and of no documents, with labels."""
    for name, docs in (("messy", messy), ("nothing", nothing)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    return tmp_path


def test_messy_stages(spark, folder, messy):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names in every stage; then an empty table."""
    for name in ("messy", "nothing"):
        docs = spark.read.parquet(str(folder / name / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES:
            out = function(spark, docs, str(folder / name)).cache()
            if stage != "best_fit_packing":
                assert out.columns == docs.columns
            if stage == "simhash_near_dedup":
                ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids)) and (name == "nothing" or {1, 6, 8} <= set(ids) and not {2, 3, 4, 5, 9} & set(ids))  # the classifier rejects null and empty texts
            docs = out
        assert docs.count() == 0 if name == "nothing" else docs.count() >= 1


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii_redaction", "best_fit_packing"]
    assert packing.stage and corpus_pipeline.ORACLE_SQL is None
