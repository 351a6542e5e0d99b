from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanwright.llm.packing import best_fit, sweep
from spanwright.llm.rangecoder import pack_ids, unpack_ids
from spanwright.llm.token_files import read_token_files, write_token_files
from spanwright.llm.tokens import Pieces

ODD = ["", "a  b", "a \n b", "a\n b", "  x", " x ", "don't we'll 12 3.4,", "éx ́ y", "İstanbul ΣΑΣ. x", "a \n \n b", "<|endoftext|> hi", "\x1c \x85x", "foo.. bar,, b.", "日本語 x.", "A\tb \tc", "end \n", "x   y"]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_pieces_equal_whole_texts(documents, path, spaced):
    p, plain = Pieces(path, spaced), Tokenizer.from_file(path)
    texts = ODD + [r.text for r in documents.select("text").limit(60).collect()]
    whole = lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert [t for t in texts if p.ids(t) != whole(t)] == []
    assert len(p.ids("<|endoftext|>")) == 4


def ids_of(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("capacity", [1, 7, 100])
def test_sweep_fills_without_overlap(capacity):
    rng = np.random.default_rng(capacity)
    counts = Counter(rng.integers(1, capacity + 1, 500).tolist())
    held: dict[int, list] = {}
    for r in sweep(counts, capacity):
        for q in range(r.count):
            held.setdefault(r.sequence + q // r.per, []).append((r.at + q % r.per * r.length, r.length))
    assert Counter(n for v in held.values() for _, n in v) == counts
    for v in held.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
        assert at <= capacity
    assert sorted(held) == list(range(len(held)))


def test_packing_of_odd_rows(spark, odd, empty):
    rows = best_fit(odd, WORD, capacity=512).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    long = sorted(by_doc[5], key=lambda r: r.piece)
    ids = np.array(ids_of(WORD, odd.where("doc_id = 5").first().text, 1), dtype="<u4")
    assert [r.start for r in long] == list(range(0, len(ids), 512)) and all(r.length == 512 for r in long[:-1])
    assert [r.ids_crc32 for r in long] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in long]
    assert [r.length for r in by_doc[2]] == [1] and len(by_doc[6]) == 3
    places = [(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)]
    assert len(places) == len(set(places)) and max(p for _, p in places) < 512
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 512) + 1
    assert best_fit(empty, WORD).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2049, 5000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.full(n, 9), rng.zipf(1.4, n) % 50_257):
        assert np.array_equal(unpack_ids(pack_ids(ids)), ids)


def test_damage_is_found():
    data = pack_ids(np.arange(5000) % 77)
    with pytest.raises(ValueError):
        unpack_ids(data[:-1])
    with pytest.raises(ValueError):
        unpack_ids(b"XXXX" + data[4:])
    with pytest.raises(ValueError):
        unpack_ids(data[:40] + bytes([data[40] ^ 1]) + data[41:-9] + bytes([data[-9] ^ 255]) + data[-8:])
    with pytest.raises(ValueError):
        pack_ids(np.array([1 << 32]))


def test_wide_ids():
    ids = np.random.default_rng(3).integers(0, 1 << 32, 3000)
    assert np.array_equal(unpack_ids(pack_ids(ids)), ids)
    few = np.array([5, 70_000, 5, 2])
    assert np.array_equal(unpack_ids(pack_ids(few)), few)


@pytest.mark.parametrize("capacity", [64, 1000])
def test_sweep_opens_as_few_as_best_fit_decreasing(capacity):
    """Piece by piece into the smallest gap that holds it, in a list."""
    rng = np.random.default_rng(capacity)
    for _ in range(5):
        lengths = sorted(np.minimum(rng.zipf(1.3, 400), capacity).tolist(), reverse=True)
        gaps: list[int] = []
        for n in lengths:
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(capacity - n)
        used = {r.sequence + q // r.per for r in sweep(Counter(lengths), capacity) for q in range(r.count)}
        assert len(used) == len(gaps)


def test_files_hold_all_rows_in_order(spark, odd, empty, tmp_path):
    write_token_files(odd, f"{tmp_path}/ids", BYTE, 2)
    rows = sorted(read_token_files(spark, f"{tmp_path}/ids", with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 6, 7]
    at = 0
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    for r in rows:
        want = [ids_of(BYTE, t, 2) for d, t in texts if d == r.doc_id]
        assert list(r.ids) in want and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    write_token_files(empty, f"{tmp_path}/none", BYTE, 2)
    assert read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_workers_let_go_of_their_pieces():
    import public_tokenizers

    from spanwright.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    before = tokens.pieces_of(path, spaced=False)
    want = before.ids("some words to keep")
    tokens.forget()
    again = tokens.pieces_of(path, spaced=False)
    assert again is not before and not again.known and again.ids("some words to keep") == want


def test_many_lanes_share_a_step():
    """A step costs the same for one lane as for a thousand, so a segment has many, in little more space than order 0."""
    from spanwright.llm import rangecoder as coder

    ids = np.random.default_rng(5).zipf(1.3, 300_000) % 50_257
    lanes, steps = coder._lanes(len(ids))
    assert lanes >= 1000 and lanes * steps < len(ids) + lanes
    assert len({coder._lanes(n)[0] for n in (1 << 22, 1 << 25)}) == 1 and coder._lanes(1 << 28)[1] <= coder.LONGEST
    data = pack_ids(ids)
    assert np.array_equal(unpack_ids(data), ids)
    share = np.bincount(ids) / len(ids)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(data) * 8 < 1.15 * bits * len(ids)


def test_carries_run_through_many_words():
    from spanwright.llm import rangecoder as coder

    frequency = np.array([1, 65_534, 1])
    symbols = np.concatenate((np.full(3000, 1), [2], np.full(3000, 2), [0], np.full(2000, 2), np.full(7, 1)))
    assert np.array_equal(coder._decode_plain(coder._encode_plain(symbols, frequency), len(symbols), frequency), symbols)
    every = np.arange(65_536)
    assert np.array_equal(unpack_ids(pack_ids(every)), every)


def test_many_texts_at_once_equal_whole_texts(documents, monkeypatch):
    from spanwright.llm import tokens

    texts = [*ODD, "", "x\u00a0y z", "a b\n\n c", " 's 've", "<|endoftext|>", *[r.text for r in documents.select("text").limit(60).collect()]]
    plain = Tokenizer.from_file(BYTE)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for kept, run in ((500_000, 200), (3, 2)):
        monkeypatch.setattr(tokens, "KEPT", kept)
        monkeypatch.setattr(tokens, "RUN", run)
        p = Pieces(BYTE, True)
        for _ in range(2):
            ids, lengths = p.many(texts)
            ends = np.cumsum(lengths).tolist()
            assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths.tolist(), strict=True)] == want
    assert [len(x) for x in p.many([])] == [0, 0]
