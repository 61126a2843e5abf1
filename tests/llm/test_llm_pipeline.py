import re

import corpus_pipeline
import pytest
from llm_cases import awkward, empty

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_registered():
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{i}" for i in range(1, 14)} | {"pipeline"} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]


def test_all_but_the_last_keep_the_columns(steps):
    for step in steps[1:-1]:
        assert step.columns == steps[0].columns


def test_language_keeps_documents_with_language(steps):
    before, after = steps[0].collect(), {r.doc_id for r in steps[1].collect()}
    assert all(any(c.isalpha() for c in r.text or "") for r in before if r.doc_id in after)
    assert len(after) >= 0.97 * len(before)


def test_texts_that_mix_known_languages_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.lang: " ".join((r.text or "").split()[:40]) for r in docs.where("lang is not null").orderBy("n_chars").collect()}
    assert len(one) >= 4
    mixed = [(9001, " ".join(one.values()), None, "a", 1), (9002, " ".join(list(one.values())[:3]), next(iter(one)), "a", 1), (9003, "½ ² 77", "en", "a", 1)]
    kept = corpus_pipeline.language_stage(spark, docs.union(spark.createDataFrame(mixed, docs.schema)), sf).where("doc_id > 9000")
    assert sorted((r.doc_id, r.lang is None) for r in kept.collect()) == [(9001, False), (9002, False)]


def test_one_document_of_each_group(spark, steps):
    from test_llm_simhash import groups, plain

    docs = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    roots = groups([plain(d.text) for d in docs])
    assert {r.doc_id for r in steps[2].collect()} == {docs[r].doc_id for r in set(roots)}


def test_no_secret_is_left(steps):
    from test_llm_secrets import plain

    before, after = {r.doc_id: r.text for r in steps[2].collect()}, {r.doc_id: r for r in steps[3].collect()}
    assert before.keys() == after.keys()
    assert not any(plain(r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert all(after[i].text == t for i, t in before.items() if "[SECRET]" not in after[i].text)


def test_mixture_and_ids(steps):
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    base, mixed, coded = steps[3].collect(), steps[4].collect(), steps[5].collect()
    assert count(mixed) == pytest.approx(1.5 * count(base), rel=0.05)
    texts = {r.doc_id: r.text for r in base}
    assert all(r.text in texts[r.doc_id] for r in mixed)
    assert len(coded) == len(mixed) and all(r.round_trip for r in coded)


def test_awkward_documents_pass_every_stage(spark, sf):
    for docs in (awkward(spark), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            if name != "byte-level BPE":
                assert docs.columns == columns
        rows = docs.collect()
        assert all(r.round_trip for r in rows)
