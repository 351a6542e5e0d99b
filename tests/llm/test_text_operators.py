from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanwright.llm import chat, decontaminate, quality, secrets, simhash, toxicity


def plain_statistics(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics_equal_plain_counts(documents, odd):
    for df in (documents, odd):
        for r in quality.text_statistics(df.select("doc_id", "text")).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text or ""), r.doc_id


def test_blank_lines_are_no_lines(spark):
    text = "a b\n\nc\n\n \n \na b"
    r = quality.text_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_lines, r.n_dup_lines) == (3, plain_statistics(text)[3]) == (3, 1)


def test_windows_are_compared_by_all_bits(spark):
    """Hashes that differ only in their upper 20 bits, or their lowest, are no repeat."""
    many = [[5, 5 + (1 << 44), 5 + (1 << 50), 6], [7, 8, 7 + (1 << 60), 7]]
    df = spark.createDataFrame([(m,) for m in many], "h array<bigint>")
    assert [r[0] for r in df.select(quality._covered(F.col("h"))).collect()] == [0, 6]


def test_windows_of_one_hash_are_told_apart_by_words(spark):
    rows = [([9, 9, 9], list("abcde")), ([9, 9, 9, 9], list("aaaaxy")), ([9, 4, 9, 4, 9], list("abababc"))]
    df = spark.createDataFrame(rows, "h array<bigint>, w array<string>")
    assert [r[0] for r in df.select(quality._covered(F.col("h"), F.col("w"))).collect()] == [0, 4, 6]


def test_quality_keeps_clean_and_drops_junk(spark, documents):
    rows = quality.quality_report(documents).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed and r.doc_id in labels}
    good = [d for d in kept if labels[d] == 1]
    assert len(rows) == documents.count() and np.mean([kept[d] for d in good]) >= 0.98


def test_mcd_ignores_a_far_quarter(spark):
    """Estimates rest on the bulk: a quarter of far points moves neither centre nor scatter."""
    rng = np.random.default_rng(0)
    bulk, far = rng.normal(0, 1, (900, 5)), rng.normal(8, 1, (200, 5))
    rows = [("g", *map(float, x)) for x in np.vstack([bulk, far])]
    rules = quality.Rules(floors=(0.01,) * 5, cover=0.75)
    fit = quality.mcd_estimates(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double"), rules).first()
    assert all(abs(fit[f"m{i}"]) < 0.2 and 0.8 < fit[f"l{i}{i}"] < 1.25 for i in range(5))


def plain_mcd(x, cover, steps, floors):
    """Concentration by sorting whole distances, from many random starts: the least determinant."""
    rng, best = np.random.default_rng(5), None
    scale = quality.consistency(cover, x.shape[1])
    for _ in range(40):
        part = x[rng.choice(len(x), 40, replace=False)]
        for _ in range(30):
            s = np.cov(part.T, bias=True) * scale + np.diag(np.square(floors))
            d = np.einsum("ij,jk,ik->i", x - part.mean(0), np.linalg.inv(s), x - part.mean(0))
            part = x[np.argsort(d)[: int(np.ceil(cover * len(x)))]]
        s = np.cov(part.T, bias=True) * scale + np.diag(np.square(floors))
        if best is None or np.linalg.det(s) < best[0]:
            best = (np.linalg.det(s), part.mean(0), s)
    return best


def test_mcd_and_verdicts_against_plain_search(spark):
    """Correlated bulk, a tight far cluster and a light cloud: the estimate and the verdicts of a
    search over 40 random starts with sorted distances."""
    rng = np.random.default_rng(2)
    mix = rng.normal(0, 1, (5, 5))
    x = np.vstack([rng.normal(0, 1, (1500, 5)) @ mix, rng.normal(0, 0.2, (200, 5)) + 9, rng.normal(0, 6, (100, 5))])
    rules = quality.Rules(floors=(0.01,) * 5)
    rows = [("g", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    fit = quality.mcd_estimates(df, rules).first()
    low = np.array([[fit[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    det, mean, scatter = plain_mcd(x, rules.cover, 30, rules.floors)
    assert np.prod(np.diag(low)) ** 2 < 1.3 * det
    far = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    ours, theirs = far(np.array([fit[f"m{i}"] for i in range(5)]), low @ low.T), far(mean, scatter)
    cut = quality.chi2_quantile(0.999, 5)
    assert np.mean((ours > cut) == (theirs > cut)) > 0.98


def test_small_languages_are_judged_with_all(spark, documents):
    """A junk text of a language of its own is held to the estimate over all languages."""
    junk = "###### $$$$ %%%% &&&& |||| " * 8 + " ".join(f"q{i}|#$%&|||###" for i in range(60))
    more = spark.createDataFrame([(10**6, junk, "xx", "s")], "doc_id long, text string, lang string, source string")
    rows = quality.quality_report(documents.select("doc_id", "text", "lang", "source").unionByName(more)).where("doc_id = 1000000").collect()
    assert len(rows) == 1 and not rows[0].base_failed and not rows[0].kept


def test_quality_of_odd_rows(odd, empty):
    rows = quality.quality_report(odd).collect()
    assert len(rows) == 10 and all(not r.kept for r in rows if r.n_words < 50)
    kept = quality.good_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 5}
    assert quality.quality_report(empty).count() == 0


def plain_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, budget):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("budget", [1, 3])
def test_trie_join_equals_all_pairs(spark, budget):
    rng = np.random.default_rng(budget)
    values = [int(v) for v in rng.integers(0, 1 << 63, 20)]
    for v in list(values):  # chains, balls and pairs just beyond the budget
        for _ in range(6):
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                v ^= 1 << int(b)
            values.append(v)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "f long")
    got = defaultdict(set)
    for r in simhash.near_groups(df, budget).collect():
        got[r.root].add(r.f & (1 << 64) - 1)
    want = defaultdict(set)
    for v, r in plain_groups(values, budget).items():
        want[r].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_odd_rows(odd, empty):
    rows = simhash.simhash_components(odd).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(plain_fingerprint(r.text, 3))
    assert len(rows) == 10 and all(r.f & (1 << 64) - 1 in texts[r.doc_id] for r in rows)
    zero = {r.component_id for r in rows if r.f == 0}
    assert zero == {2}
    assert {r.component_id for r in rows if r.doc_id == 6} == {6}
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "6", "7", "None"]
    assert simhash.simhash_components(empty).count() == 0


def shingle_sets(texts, n=5):
    out = []
    for t in texts:
        w = t.encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    return out


def test_near_copies_equal_all_pairs_by_shingles(spark, documents):
    """Groups of at least 0.8, against all pairs; edited copies at all similarities, many of one."""
    rng = np.random.default_rng(1)
    texts = sorted({r.text for r in documents.collect() if r.text and len(r.text.split()) > 60})[:60]
    for t in texts[:25]:
        w = t.split()
        for share in (0.004, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(f"q{rng.integers(1e6)}" if rng.random() < share else x for x in w))
    texts += [f"{texts[0]} end{i}" for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "t long, text string")
    root = {r.t: r.root for r in simhash.near_copies(df).collect()}
    sets = shingle_sets(texts)
    close = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = sum(root[i] == root[j] for i, j in close)
    assert len(close) > 200 and found >= 0.95 * len(close)
    whole = {i: i for i in range(len(texts))}  # groups that all close pairs make
    for i, j in close:
        a, b = whole[i], whole[j]
        whole = {k: min(a, b) if v in (a, b) else v for k, v in whole.items()}
    assert all(whole[i] == whole[r] for i, r in root.items())  # nothing else is linked


def test_one_of_each_group_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f g h", "x", 5), (2, "a b c d e f g h", "y", 6), (3, None, "z", 7), (4, " ", "w", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, _text long")
    kept = simhash.one_of_each_group(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


BENCH = ["Tom has 12 apples and gives 5 kg of them to Mary before the long train leaves Paris at night", "what is the capital of the country that borders the sea to the north and the hills"]


def test_templates_catch_new_numbers_and_names(spark):
    docs = [
        (1, "intro words here. " + BENCH[0] + " and more."),
        (2, "Some say Ann has 99 apples and gives 7 kg of them to Lucy before the long train leaves Rome at night"),
        (3, "Ann has 99 apples and gives 99 kg of them to Ann before the long train leaves Ann at night now"),
        (4, "nothing of the kind is here, only plain words that go on and on for a while"),
        (5, BENCH[1].upper()),
        (6, None),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(BENCH), (7, None), (8, "short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 1)} and got[1, 0] == 0 and got[2, 0] > 0
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {3, 4, 6}


def test_templates_in_short_sentences(spark):
    """Names at sentence starts, in every window, and of a document's neighbour in a batch."""
    item = "Tom has 5 apples. Mary has 3 apples. Tom gives Mary 2 apples. Tom eats 1 apple. How many are left?"
    docs = [
        (1, "Ann has 7 apples. Lucy has 4 apples. Ann gives Lucy 6 apples. Ann eats 8 apple. How many are left?"),
        (2, "so Ann has 7 apples. Lucy has 4 apples. then Ann gives Lucy 6 apples. Ann eats 8 apple. How many are left?"),
        (3, "Ann has 7 apples. Lucy has 4 apples. Eve gives Zoe 6 apples. Kim eats 8 apple. How many are left?"),
        (4, item),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_windows, r.item_windows, r.n_changed) for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {1, 2, 4} and got[4][0] == got[4][1] and got[4][2] == 0 and got[1][2] > 0


def test_first_word_does_not_hang_on_the_batch(spark):
    rows = ["no mark at the end", "Paris is the town where five old trains leave every night"]
    alone = spark.createDataFrame([(2, rows[1])], "doc_id long, text string")
    both = spark.createDataFrame([*enumerate(rows, 1)], "doc_id long, text string").coalesce(1)
    found = lambda df: {(r.at, r.hash, r.plain) for r in decontaminate.windows(df, "doc_id", decontaminate.Templates(), None).where("doc_id = 2").collect()}
    assert found(alone) == found(both)


def test_short_and_crowded_items(spark):
    """An item shorter than a window, one of numbers only, and one too short to tell."""
    items = [(1, "Where do Tom and Ann live?"), (2, "12 34 56 78 90 11 22 33 44 55"), (3, "yes indeed"), (4, "12 34 kg for 56 78 Ann")]
    docs = [
        (1, "so they ask. Where do Bob and Eve live? Nobody knows."),
        (2, "numbers 12 34 56 78 90 11 22 33 44 55 here"),
        (3, "numbers 13 35 57 79 91 12 23 34 45 56 here"),
        (4, "yes indeed it is so"),
        (5, "where do we live and why does it matter"),
        (6, "paid 12 34 kg for 56 78 Ann today"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items * 2, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.item_windows) for r in decontaminate.leaks(d, b).collect()}
    assert {(x[0], x[1]) for x in got} == {(1, 1), (2, 2), (6, 4)} and all(w == n for _, _, w, n in got)


def plain_leaks(docs, items, n, share):
    """Verbatim windows: items of which a text has that share in one alignment."""
    found = set()
    for d, text in docs:
        w = (text or "").split()
        at = defaultdict(list)
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
        for k, item in items:
            v = item.split()
            shifts = Counter(i - j for j in range(len(v) - n + 1) for i in at.get(tuple(v[j : j + n]), ()))
            if shifts and max(shifts.values()) >= share * (len(v) - n + 1):
                found.add((d, k))
    return found


def test_verbatim_leaks_equal_brute_force(spark, documents):
    """Texts and benchmark without capitals and digits, where a template is the words."""
    plain = lambda t: re.sub(r"[^a-z ]", "", (t or "").lower()).strip()
    docs = [(r.doc_id, plain(r.text)) for r in documents.collect()]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    items = [(r.item_id, plain(r.text)) for r in bench if len(plain(r.text).split()) >= 8 and not set(plain(r.text).split()) & decontaminate.UNITS]
    docs = [(d, t) for d, t in docs if not set(t.split()) & decontaminate.UNITS]
    docs.append((10**6, "one two " + items[0][1] + " three"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert got == plain_leaks(docs, items, 8, 0.3) and len(got) >= 1


def test_leaks_of_odd_rows(spark, odd, empty, documents):
    b = spark.createDataFrame([(1, "x y z"), (None, None)], "item_id long, text string")
    assert decontaminate.leaks(odd, b).count() == 0 and decontaminate.leaks(empty, b).count() == 0
    assert decontaminate.without_leaks(odd, b).count() == 10
    assert decontaminate.leaks(odd, b.limit(0)).count() == 0


def test_secret_spans_and_ownership(spark):
    key, shared = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    docs = [(1, f'token = "abcdef123" then {key} ok', "a")] + [(10 + i, f"see é {shared} here", s) for i, s in enumerate("abcd")] + [(20, "PassWord: 'x1' API_KEY=zz", "a"), (21, "live Ab3dEf6hIj9kLm2nOp5qRs8tUv1w tail", "a"), (22, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: [(s.start, secrets.KINDS[s.kind], s.end, s.live) for s in r.spans] for r in secrets.judged_spans(d, ("doc_id",)).collect()}
    assert got[1] == [(0, "assign", 18, True), (25, "access", 45, True)]
    assert all(got[10 + i] == [(6, "hex", 38, False)] for i in range(4))
    assert got[20] == [] and got[22] == [] and got[21] == [(5, "token", 33, True)]
    clean = {r.doc_id: r.text for r in secrets.redacted(d).collect()}
    assert clean[1] == '<assign>" then <access> ok' and clean[10] == "see é <hex:example> here" and clean[22] is None


def test_long_tokens_are_whole(spark):
    body = "Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4z" * 7
    texts = ["see " + body + "TAIL1 end", "see " + body + "TAIL2 end", "-" * 800 + "Ab3dEf6hIj9kLm2nOp5qRs8tUv1w ok", body[:150] + "AKIA" + "Q7" * 8 + " ok"]
    got = [[(s, secrets.KINDS[k], e) for s, k, e, _ in secrets.candidates(t)] for t in texts]
    assert got[0] == [(4, "token", 4 + len(body) + 5)] and got[2] == [(0, "token", 828)] and got[3] == [(0, "token", 150), (150, "access", 170)]
    d = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in secrets.redacted(d).collect()}
    assert clean[0] == clean[1] == "see <token> end" and clean[3] == "<token><access> ok"
    hashes = {tuple(r.hashes) for r in secrets.find(d, ("doc_id",)).where("doc_id < 2").collect()}
    assert len(hashes) == 2


def test_copies_are_one_repository(spark):
    """Many copies of a document under two owners are no sign that its secret is shared."""
    live = "see 0123456789abcdef0123456789abcdef here"
    rows = [(i, live, "ab"[i % 2]) for i in range(40)] + [(100 + i, f"doc {i} fedcba9876543210fedcba9876543210", "ab"[i % 2]) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.spans[0].live for r in secrets.judged_spans(d, ("doc_id",)).collect()}
    assert all(v == (k < 100) for k, v in got.items()) and len(got) == 80


def test_redaction_keeps_clashing_columns(spark):
    rows = [(1, "token = abcdef1 x", "a", "keep", 7, [1])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _text string, text_hash long, _spans array<int>")
    assert [tuple(r) for r in secrets.redacted(d).collect()] == [(1, "<assign> x", "a", "keep", 7, [1])]


def test_secrets_of_odd_rows(odd, empty):
    assert secrets.judged_spans(odd, ("doc_id",)).where("size(spans) = 0").count() == 10
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert secrets.judged_spans(empty, ("doc_id",)).count() == 0


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "héllo"), (1, 2, "bob", "héllo"), (1, 3, None, None), (None, 0, "ann", "x")] + [(2, i, "ann" if i % 2 else "bob", "t" * i) for i in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.rotate(df).collect()
    views = defaultdict(list)
    for r in rows:
        views[r.conv_id, r.perspective].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (2, "ann"), (2, "bob")}
    for (_, who), segments in views.items():
        at, text = 0, ""
        for s in sorted(segments, key=lambda s: s.at):
            assert s.at == at
            text += s.header + s.text + "\n"
            at = len(text)
            masked = text[s.masked_from : s.masked_to]
            assert masked == (s.text if s.header == "<|assistant|>\n" else "")
            assert (s.header == f"<|user|> name={who}\n") is False
    assert chat.rotate(df.limit(0)).count() == 0


def test_toxicity_learns_and_ignores_groups(spark):
    words = lambda i: " ".join(f"w{(i * 7 + k) % 40}" for k in range(12))
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        group = " women" if bad and i % 2 else " men" if i % 5 == 0 else ""
        rows.append((i, words(i) + (" vile scoundrel" if bad else "") + group, int(bad and i % 20 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    test = spark.createDataFrame([(1, "you vile scoundrel"), (2, "w1 w2 women"), (3, "w1 w2 men"), (4, None), (5, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in model.score(test).collect()}
    assert s[1] > 0.5 > max(s[2], s[3], s[4]) and abs(s[2] - s[3]) < 0.1 and s[4] == s[5]
    free = toxicity.train(df, df, toxicity.Fit(swap=0.0))
    gap = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    assert gap(model) < gap(free)


def test_toxicity_ignores_inflected_groups_and_stems(spark):
    """Toxic labels lean on a plural and on its stem; the score must not."""
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        group = " muslims" if bad and i % 4 == 0 else " immigrants" if bad and i % 4 == 2 else " hindus" if i % 8 == 1 else ""
        rows.append((i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(12)) + (" vile" if bad and i % 3 == 0 else "") + group, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    assert model.swapped == sum(any(w in t for w in ("muslims", "immigrants", "hindus")) for _, t, _ in rows) > 0
    pairs = ["muslims", "christians", "muslim", "christian", "immigrants", "refugees"]
    test = spark.createDataFrame([(i, "w1 w2 " + p) for i, p in enumerate(pairs)], "doc_id long, text string")
    s = [r.score for r in sorted(model.score(test).collect(), key=lambda r: r.doc_id)]
    assert abs(s[0] - s[1]) < 0.15 and abs(s[2] - s[3]) < 0.15 and abs(s[4] - s[5]) < 0.15


def test_swaps_give_features_anew():
    swaps = toxicity.swaps_of(toxicity.IDENTITY)
    touched, changes = toxicity.changes_of(b"Nobody came. The Muslims said so! Die Frauen auch", swaps)
    assert touched == 2
    assert {loss for _, loss in changes} == {(b"^musli", b"^muslim", b"muslims"), (b"^fraue", b"frauen")}
    assert all(gain and b"muslims" not in gain for gain, _ in changes)
    assert toxicity.changes_of(b"nothing of the kind", swaps) == (0, {})


def test_toxicity_without_labels(spark, odd, empty):
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in none.score(odd).collect()} == {0.0} and none.score(empty).count() == 0


def test_toxicity_of_odd_rows(spark, odd, empty):
    """Labels that repeat, contradict each other, name no document or hold nulls."""
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (6, 1), (5, 0), (99, 1), (None, 1), (4, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, toxicity.Fit(rare=1, z=0.0))
    scores = model.score(odd).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores) and model.swapped == 0
    assert model.weights.get("^brown") is None and "fox" in model.weights
    assert toxicity.train(empty, labels).weights == {}


def test_held_out_fold(spark):
    import zlib

    ids = [1, 2, 33, 404, -5, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_near_copies_try_more_than_the_nearest_candidate(spark, monkeypatch):
    """Where the nearest by bits isn't alike enough, the others of its component are held, too."""
    words = [f"w{i}" for i in range(400)]
    left = [[*words], [*words, "x"], [*words, "x", "y"]]
    right = [[*words, *[f"z{i}" for i in range(20)], *end] for end in ([], ["x"], ["x", "y"])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(left + right)], "t long, text string")
    across = {(i, j) for i in range(3) for j in range(3, 6)}
    calls = []

    def picky(pairs, docs, how):
        """Each side is a component; across, only pairs that aren't the nearest are alike."""
        rows = {(r.a, r.b) for r in pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).collect()}
        calls.append(rows)
        alike = {1: [(0, 1), (0, 2), (3, 4), (3, 5)], 2: []}.get(len(calls), sorted(rows))
        return spark.createDataFrame(alike, "a long, b long")

    monkeypatch.setattr(simhash, "_verified", picky)
    root = {r.t: r.root for r in simhash.near_copies(df).collect()}
    assert len(calls) == 3 and calls[2] and not calls[1] & calls[2] and calls[1] | calls[2] == across
    assert set(root.values()) == {0}


def test_near_copies_of_a_crowd_make_no_pair_rows(spark, monkeypatch):
    """Many texts that are near by fingerprint and below 0.8 but for some: all true pairs are found, and
    candidates by row don't grow with the square of the group (they were all pairs)."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(240):
        w = list(base)
        for at in rng.choice(200, 5 if i % 4 else 2, replace=False):
            w[at] = f"q{i}x{at}"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{i}x{j}" for j in range(60)) for i in range(20)]
    asked, verified = [], simhash._verified

    def counted(pairs, docs, how):
        asked.append(pairs.count())
        return verified(pairs, docs, how)

    monkeypatch.setattr(simhash, "_verified", counted)
    monkeypatch.setattr(simhash, "CROWDED", 16)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 50)
    monkeypatch.setattr(simhash, "BLOCK_OWN", 20)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "t long, text string")
    root = {r.t: r.root for r in simhash.near_copies(df).collect()}
    sets = shingle_sets(texts)
    whole = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and whole[i] != whole[j]:
                a, b = sorted((whole[i], whole[j]))
                whole = {k: a if v == b else v for k, v in whole.items()}
    assert 60 < len(set(whole.values())) < len(texts) and root == whole
    assert sum(asked) < 4 * len(texts)


def test_blocks_find_what_sets_tell():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12))) for _ in range(60)]
    c, right = np.arange(60) // 2 * 2, np.arange(60) >= 35
    for cut in (right, right & False):
        names, roots = simhash._alike_in(pa.chunked_array([pa.array(sets, pa.list_(pa.int64()))]), c, cut, 0.8)
        sides = [range(35), range(35, 60)] if cut.any() else [range(60)] * 2
        links = [(i, j) for i in sides[0] for j in sides[1] if c[i] != c[j] and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
        least = dict(zip(c.tolist(), c.tolist(), strict=True))
        for i, j in links:
            a, b = sorted((least[c[i]], least[c[j]]))
            least = {k: a if v == b else v for k, v in least.items()}
        assert links and dict(zip(names.tolist(), roots.tolist(), strict=True)) == {k: v for k, v in least.items() if k != v}
