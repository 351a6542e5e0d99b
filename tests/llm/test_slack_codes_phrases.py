from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwright.llm import bin_slack, codes, phrases
from spanwright.llm.codes import Coding, compressed, digest, nearest, with_group_total
from spanwright.llm.phrases import Phrases, Summary, collocations

BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---- minimum bin slack


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        used = bin_slack.fullest(sorted(set(items)), Counter(items), room)
        assert sum(s * n for s, n in used.items()) == best
        assert all(n <= items.count(s) for s, n in used.items())


def test_windows_take_the_least_slack_each_time():
    rng = random.Random(2)
    for _ in range(50):
        counts = Counter(rng.randint(1, 40) for _ in range(30))
        left = Counter(counts)
        for used, times in bin_slack.windows(counts, 40):
            for _ in range(times):
                longest = max(s for s, n in left.items() if n)
                rest = left - Counter({longest: 1})
                best = bin_slack.fullest(sorted(rest), rest, 40 - longest)
                assert longest in used
                assert sum(s * n for s, n in used.items()) == longest + sum(s * n for s, n in best.items())
                left -= Counter(used)
        assert not +left


def held_to_tokenizer(docs, packed, capacity):
    """Every id once, checksums right, sequences gapless, and no padding."""
    coder = Tokenizer.from_file(BPE)
    wanted = Counter()
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        got = coder.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        ids.setdefault(r["doc_id"], []).append(got)
        wanted[r["doc_id"]] += len(got)
    rows = packed.collect()
    lengths = Counter()
    places = {}
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
        texts = [t for t in ids[r["doc_id"]] if len(t) == r["doc_tokens"]]
        sums = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for t in texts}
        assert r["ids_crc32"] in sums
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert lengths == wanted
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        total = sum(n for _, n in held)
        assert total == capacity or (total < capacity and total & (total - 1) == 0)
    return rows


def test_slack_over_documents(documents):
    rows = held_to_tokenizer(documents, bin_slack.minimum_slack(documents, BPE), 1024)
    once = {(r["doc_id"], r["start"]) for r in rows}
    assert len(once) == len(rows)


def test_slack_with_many_buckets_and_odd_rows(spark, odd, documents, monkeypatch):
    monkeypatch.setattr(bin_slack, "BUCKET_ROWS", 20)
    held_to_tokenizer(documents, bin_slack.minimum_slack(documents, BPE, capacity=256), 256)
    held_to_tokenizer(odd, bin_slack.minimum_slack(odd, BPE), 1024)


def test_slack_where_no_two_pieces_fit(spark):
    docs = spark.createDataFrame([(i, " word" * 599) for i in range(40)], "doc_id long, text string")
    rows = held_to_tokenizer(docs, bin_slack.minimum_slack(docs, BPE), 1024)
    assert len({r["sequence_id"] for r in rows}) <= 40 * 600 // 1024 + 10


def test_slack_of_an_empty_table(empty):
    assert bin_slack.minimum_slack(empty, BPE).count() == 0


# ---- vector codes


def plain_codes(rows, how):
    """Lloyd rounds with every distance, in Python's whole numbers."""
    kept = sorted(((i, [int(np.floor(how.scale * float(x))) for x in v]) for i, v in rows), key=lambda r: r[0])
    width = len(kept[0][1]) // how.parts
    cut = [[v[p * width : (p + 1) * width] for p in range(how.parts)] for _, v in kept]
    books = [[list(v[p]) for v in cut[: how.entries]] for p in range(how.parts)]

    def pick(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(how.rounds):
        for p in range(how.parts):
            groups = {}
            for v in cut:
                groups.setdefault(pick(v[p], books[p])[1], []).append(v[p])
            for i, members in groups.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for (i, _), v in zip(kept, cut, strict=True):
        found = [pick(v[p], books[p]) for p in range(how.parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e12])
def test_nearest_equals_all_distances(spread):
    rng = np.random.default_rng(3)
    for width, k in ((1, 1), (3, 7), (8, 16)):
        values = np.floor(rng.normal(0, 3 * spread, (200, width))).astype(np.int64)
        entries = np.floor(rng.normal(0, 3 * spread, (k, width))).astype(np.int64)
        who, far = nearest(values, entries)
        for v, w, f in zip(values.tolist(), who.tolist(), far.tolist(), strict=True):
            assert (f, w) == min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(entries.tolist()))


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    data = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(120), rng.normal(0, 0.3, (120, 16)), strict=True)]
    data += [(500, data[3][1]), (501, data[3][1])]
    how = Coding(rounds=4)
    coded, books = compressed(spark.createDataFrame([(i, v, i % 3) for i, v in data], "vec_id long, embedding array<float>, label int"), how)
    wanted, plain = plain_codes(data, how)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == sorted(wanted)
    assert digest(books) == digest([np.array(b) for b in plain])


def test_codes_of_odd_rows(spark):
    good = [(i, [float(i), 1.0, -0.5, 2.0 * i], None if i % 2 else 1) for i in range(5)]
    bad = [(90, None, 1), (91, [1.0, None, 2.0, 3.0], 1), (92, [1.0, float("nan"), 0.0, 0.0], 1), (93, [float("inf"), 0.0, 0.0, 0.0], None), (94, [], 1), (95, [1.0, 2.0], 2)]
    rows = [(*r, "x", 7) for r in [*good, *bad, (None, [0.0, 0.0, 0.0, 0.0], None), (4, [4.0, 1.0, -0.5, 8.0], 1)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, packed int")
    coded, _ = compressed(df, Coding(parts=2))
    got = with_group_total(coded, "label", "error", "label_error").collect()
    assert sorted(r["vec_id"] for r in got if r["vec_id"] is not None) == [0, 1, 2, 3, 4, 4] and len(got) == 7
    for null in (True, False):
        group = [r for r in got if (r["label"] is None) == null]
        assert {r["label_error"] for r in group} == {sum(r["error"] for r in group)}
    none, books = compressed(df.limit(0))
    assert none.count() == 0 and books == []


def test_group_totals_of_crowded_keys(spark):
    rows = spark.createDataFrame([(None if i < 40 else i // 2, i) for i in range(100)], "label int, error long")
    for most in (1000, 3):
        got = with_group_total(rows, "label", "error", "total", most).collect()
        assert len(got) == 100
        wanted = Counter()
        for r in rows.collect():
            wanted[r["label"]] += r["error"]
        assert all(r["total"] == wanted[r["label"]] for r in got)


# ---- phrases


def plain_phrases(rows, how):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, how.longest + 1):
                counts.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    found = {}
    for (lang, *p), a in counts.items():
        if len(p) < 2 or a < how.least:
            continue
        longer = [b for (other, *q), b in counts.items() if other == lang and b >= how.least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= how.covered * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, *p[:k]] * counts[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, *p[:k]], counts[lang, *p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, words[lang], -score)
        for lang, held in found.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(held)[: how.first], 1)
    )


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["Der", "the", "of", "ça", "x", "new", "york", "city", "日本", "a"]
    texts = []
    for _ in range(n):
        w = rng.choices(vocabulary, [1, 6, 5, 2, 2, 3, 3, 3, 1, 1], k=rng.randint(0, 30))
        w += ["New", "York", "City"] * rng.randint(0, 2)
        texts.append((rng.choice(["en", "de", None]), "".join(x + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "? "]) for x in w)))
    return texts


def test_phrases_equal_plain_counts(spark):
    rows = random_texts(150, 5)
    how = Phrases(least=4, first=25)
    got = as_rows(collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), how))
    assert got == plain_phrases(rows, how) and got


def test_phrases_with_small_turns_and_a_full_bitmap(spark, monkeypatch):
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(phrases)  # workers see the small limits, too
    monkeypatch.setattr(phrases, "HELD_GRAMS", 40)
    monkeypatch.setattr(phrases, "BITMAP", 64)
    monkeypatch.setattr(phrases, "PART_BYTES", 500)
    monkeypatch.setattr(phrases, "BLOCK_ROWS", 20)
    try:
        rows = random_texts(120, 6)
        how = Phrases(least=5)
        assert as_rows(collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), how)) == plain_phrases(rows, how)
    finally:
        pickle.unregister_pickle_by_value(phrases)


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(7)
    for least in (2, 5, 10):
        stream = rng.zipf(1.3, 4000).astype(np.uint64) % np.uint64(5000)
        summary = Summary(len(stream), least)
        for part in np.array_split(stream, 37):
            keys, counts = np.unique(part, return_counts=True)
            summary.merge(keys, counts)
            assert len(summary.keys) <= summary.capacity
        keys, counts = np.unique(stream, return_counts=True)
        assert summary.error < least
        assert set(keys[counts >= least].tolist()) <= set(summary.frequent().tolist()) <= set(summary.keys.tolist())


def test_scores_are_exact(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        a = rng.randint(1, 10 ** rng.randint(1, 15))
        rows.append((a, a + rng.randint(0, a), a + rng.randint(0, 5)))
    rows += [(3 * 10**15, 3 * 10**15 + 1, 3 * 10**15), (1, 1, 1)]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", phrases.floored_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_phrases_of_odd_rows(odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    how = Phrases(least=2)
    assert as_rows(collocations(odd, how)) == plain_phrases(rows, how)
    assert collocations(empty).count() == 0
