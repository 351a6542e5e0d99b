"""Substring and suffix dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from spanwright.llm import regions
from spanwright.llm.regions import Shape, owned
from spanwright.llm.substring import remove_repeated_words, word_units
from spanwright.llm.suffixes import remove_repeated_bytes


def cut(units, width, seen):
    covered = set()
    for i in range(len(units) - width + 1):
        if seen[tuple(units[i : i + width])] > 1:
            covered.update(range(i, i + width))
    return covered


def windows(all_units, width):
    seen = Counter()
    for u in all_units:
        seen.update(tuple(u[i : i + width]) for i in range(len(u) - width + 1))
    return seen


def check_words(spark, texts, width, gram):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_words(df, width, gram).collect()}
    words = [(t or "").encode().split() for t in texts]
    seen = windows(words, width)
    for i, w in enumerate(words):
        c = cut(w, width, seen)
        kept = b" ".join(x for k, x in enumerate(w) if k not in c)
        assert got[i] == (len(w), len(c), hashlib.sha256(kept).hexdigest()), i


def check_bytes(spark, texts, width, gram):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(df, width, gram).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = windows(raw, width)
    for i, w in enumerate(raw):
        c = cut(w, width, seen)
        spans = sum(1 for k in c if k - 1 not in c)
        kept = bytes(x for k, x in enumerate(w) if k not in c)
        assert got[i] == (len(w), len(c), spans, hashlib.sha256(kept).hexdigest()), i


def planted(seed):
    """Few words, periodic stretches, passages in several documents, copies, near copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "c", "the", "é", "of"])
    passage = [word() for _ in range(30)]
    texts = [None, "", "a " * 60, "a bb " * 30]
    for _ in range(12):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(w))
            lo = rng.randint(0, 10)
            w[at:at] = passage[lo : rng.randint(lo + 8, 30)]
        texts.append(" ".join(w))
    texts += [texts[5], texts[6].replace("the", "zz", 1)]
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_words_equal_brute_force(spark, seed):
    check_words(spark, planted(seed), 9, 4)


@pytest.mark.parametrize("seed", range(4))
def test_bytes_equal_brute_force(spark, seed):
    check_bytes(spark, planted(seed), 20, 8)


def test_odd_rows(odd, empty):
    rows = remove_repeated_words(odd).collect()
    assert len(rows) == 10 and {(r.doc_id, r.n_words, r.n_removed) for r in rows} >= {(2, 0, 0), (3, 0, 0), (4, 0, 0), (6, 2, 0)}
    assert len(remove_repeated_bytes(odd).collect()) == 10
    assert remove_repeated_words(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0


def test_very_long_text_and_real_widths(spark, documents):
    """The widths of the queries, on whole documents and a long text that holds some of them."""
    texts = [r.text for r in documents.orderBy("doc_id").limit(60).collect()]
    texts.append(" ".join(f"w{i}" for i in range(30_000)) + (texts[3] or "") + (texts[4] or ""))
    check_words(spark, texts, 35, 10)
    check_bytes(spark, texts[:20] + texts[-1:], 400, 96)


@pytest.mark.parametrize("bits", [6, 20])
def test_every_window_is_owned_once(monkeypatch, bits):
    monkeypatch.setattr(regions, "STRETCH_BITS", bits)
    codes, _ = word_units(" ".join(random.Random(3).choice("abcd") for _ in range(400)).encode())
    shape, seen = Shape(9, 4), []
    for _, at, first, last in owned(codes, shape):
        for p, s, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            seen += [w for w in range(s, e + 1) if w <= p <= w + shape.reach]
    assert sorted(seen) == list(range(len(codes) - 8))


@pytest.mark.parametrize("seed", range(2))
def test_hot_anchors_are_split(monkeypatch, spark, seed):
    """Results don't change where every anchor counts as hot, and chunks are small."""
    monkeypatch.setattr(regions, "HOT_REGIONS", 1)
    monkeypatch.setattr(regions, "CHUNK_BYTES", 64)
    check_words(spark, planted(seed), 9, 4)
    check_bytes(spark, planted(seed), 20, 8)


def test_null_bytes_and_clashing_columns(spark):
    rows = [(1, "ab\x00" * 200, "x", 1), (2, "zz" + "ab\x00" * 200, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, spans int")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in remove_repeated_bytes(df).collect()}
    assert got == {1: (600, 600), 2: (602, 600)}
