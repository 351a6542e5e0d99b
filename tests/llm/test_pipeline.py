"""The corpus pipeline: its stages against plain versions, on documents and on odd rows."""

from __future__ import annotations

from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanwright.llm import decontaminate, quality, secrets

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, in order."""
    from spanwright.llm.common import stash, table

    docs, out = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA), name)
        out[name] = docs
    return out


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_stages_keep_the_columns_of_documents(spark, documents, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    assert all(kept[n].dtypes == documents.dtypes for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality_stage_drops_what_the_report_rejects(documents, kept):
    want = {r.doc_id for r in quality.quality_report(documents).where("kept").collect()}
    assert {r.doc_id for r in kept["quality_rules"].collect()} == want
    plain = {r.doc_id: len((r.text or "").split()) for r in documents.collect()}
    assert all(plain[d] >= 50 for d in want)


def test_near_dedup_stage_keeps_one_of_each_group(kept):
    before = {r.doc_id: r.text for r in kept["quality_rules"].collect()}
    after = {r.doc_id: r.text for r in kept["simhash_near_dedup"].collect()}
    assert all(before[d] == t for d, t in after.items())
    sets = {d: shingles(t) for d, t in before.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = sorted(before)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near(a, b):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    groups = defaultdict(list)
    for d, r in root.items():
        groups[r].append(d)
    assert len(groups) <= len(after) <= len(groups) + 0.05 * len(ids) and all(set(g) & set(after) for g in groups.values())


def test_decontamination_stage_drops_leaks(spark, kept):
    before = kept["simhash_near_dedup"]
    bad = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept["benchmark_decontamination"].collect()} == {r.doc_id for r in before.collect()} - bad


def test_secret_stage_leaves_no_span(kept):
    before = {r.doc_id: r for r in kept["benchmark_decontamination"].collect()}
    after = {r.doc_id: r for r in kept["secret_scan"].collect()}
    assert set(before) == set(after)
    for d, r in after.items():
        assert not [c for c in secrets.candidates(r.text) if c[1] < 3]
        assert r.text == before[d].text or secrets.candidates(before[d].text)


def test_packing_stage_holds_every_id(kept):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["secret_scan"].collect()}
    got, places = defaultdict(int), defaultdict(list)
    for r in kept["best_fit_packing"].collect():
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for v in places.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
        assert at <= 4096


def test_stages_on_odd_and_empty_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            last = stage is corpus_pipeline.STAGES[-1][1]
            ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
            assert ids(out) == ids(docs) if last else ids(out) <= ids(docs)
            assert last or (out.columns == docs.columns and out.count() <= docs.count())
